"""From documents to packed sequences: language, near duplicates, repeated passages, mix, packing.

Each stage reads what the one before wrote. Documents whose language is not told (`und`, or a score under 0.4) go;
of documents that links of 80 % of five-word shingles join, the first stays; passages of 50 words or more that repeat
stay once, and documents that held nothing else go; sources are mixed to their targets, a document standing once per
copy; the rest is packed into sequences of 2,048 tokens.

Any column may be null; each stage says what that means for it. Texts are read whole, however long; empty ones have
no language and go first. Equal rows are documents of their own until the join keeps one; ties go to the first by id.
An empty table gives an empty result of the same columns. Columns other than those of documents are dropped by the
first stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import language, mixing, ngram_join, packing, paragraph_dedup
from palimpsest.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[1:]
LEAST_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: without null, empty or letterless texts, and those whose score is too low.

    The model learns from rows with text and lang; where there are none, nothing can be told and no document stays.
    """
    model = language.trained_on(docs, F.lit(False))
    found = language.identify(docs, model, keep=REST)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links join, the first by id, null ids last; of equal rows one. Texts without words stay."""
    return ngram_join.keep_one_each(docs.select(*COLUMNS), width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that repeat in an earlier place; n_chars counts what is left where something was cut.

    Null texts and texts without a repeat stay as they are; a document of which nothing is left goes.
    """
    out = paragraph_dedup.substring_dedup(docs, keep=("lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    out = out.where(~changed | (F.length(F.trim("text")) > 0))
    return out.select("doc_id", "text", "lang", "source", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, by the targets of sources; a null source is a source. Those not taken, and texts without words, go."""
    out = mixing.pareto_mix(docs, keep=("text", "lang", "n_chars")).where("copies > 0")
    return out.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def pack_best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens; a null text is empty, equal rows are packed each."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("pack_best_fit", pack_best_fit),
]

#: SQL cannot express the model, the tokenizer or the MinHash bands; tests hold each stage against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
