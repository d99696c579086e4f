"""All queries of the subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from palimpsest.llm import chat, language, mixing, ngram_join, packing, paragraph_dedup, quality_classifier, quality_rules, suffix_dedup, vector_search

MODULES = (quality_rules, quality_classifier, packing, chat, suffix_dedup, ngram_join, mixing, paragraph_dedup, vector_search, language)


def queries() -> dict:
    out = {}
    for module in MODULES:
        out |= module.QUERIES
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    out = {}
    for module in MODULES:
        out |= module.SQL
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
