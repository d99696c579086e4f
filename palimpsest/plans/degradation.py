"""The degradation curve: corpus, conditions, four retrievers, metrics; and the account of quantized caches.

All conditions go through one job: the condition is a column, not a loop. Corrupted chunks and rankings are kept
while both the fusion and the evaluation read them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import bm25, metrics, models, noise, ranking
from palimpsest.sources import corpus

BY = ("condition",)


def rankings(damaged: DataFrame, questions: DataFrame, encode: Callable[[DataFrame, str], DataFrame], depth: int | None = None) -> DataFrame:
    """(condition, retriever, qid, id, score, rank) of all four retrievers; depth: ranks kept of each, else all."""
    ids, qids = damaged.select("condition", "id"), questions.select("qid")
    full = lambda scores, name: ranking.rank_all(scores, ids, qids, BY).withColumn("retriever", F.lit(name))
    plain = full(bm25.scores(damaged, questions, False, "indexed", BY), "bm25")
    canonical = full(bm25.scores(damaged, questions, True, "indexed", BY), "bm25-canon")
    asked = encode(questions.select("qid", "question"), "question").select("qid", "embedding")
    dense = full(ranking.dense_scores(encode(damaged.select("condition", "id", "indexed"), "indexed"), asked, BY), "dense")
    parents = canonical.unionByName(dense).persist()
    hybrid = full(ranking.fuse(parents, by=BY), "hybrid")
    out = plain.unionByName(parents).unionByName(hybrid)
    return out.where(F.col("rank") <= depth) if depth else out


def toy_encoding(rows: DataFrame, text: str) -> DataFrame:
    return models.encoded(rows, text, models.toy_encoder())


def degradation(spark: SparkSession, chunks: DataFrame | None = None, questions: DataFrame | None = None, quick: bool = False, as_is: bool = False, seed: int = 7, encode=toy_encoding) -> DataFrame:
    """(condition, retriever, cer, recall_at_5, mrr_at_10, ans_exact_at_5, ans_canon_at_5)."""
    chunks = (chunks if chunks is not None else corpus.chunks(spark)).persist()
    questions = (questions if questions is not None else corpus.questions(spark)).persist()
    damaged = noise.corrupt_all(chunks, noise.conditions(spark, quick, as_is), seed).persist()
    found = rankings(damaged, questions, encode, depth=10)
    told = metrics.evaluate(found, questions, damaged, by=("condition", "retriever"))
    return told.join(noise.mean_error_rate(chunks, damaged), "condition").select("condition", "retriever", "cer", "recall_at_5", "mrr_at_10", "ans_exact_at_5", "ans_canon_at_5")
