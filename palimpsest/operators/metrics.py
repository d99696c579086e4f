"""Retrieval metrics and their means, latency statistics, and comparisons of retrievers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import contains_answer
from palimpsest.sources.shared import written


def recall_at(k: int) -> Column:
    """Over a question's ranking, whose rows have id, rank and gold_chunk_id."""
    return F.coalesce(F.max(F.when((F.col("id") == F.col("gold_chunk_id")) & (F.col("rank") <= k), 1.0)), F.lit(0.0))


def reciprocal_rank_at(k: int) -> Column:
    return F.coalesce(F.max(F.when((F.col("id") == F.col("gold_chunk_id")) & (F.col("rank") <= k), 1.0 / F.col("rank"))), F.lit(0.0))


def evaluate(rankings: DataFrame, questions: DataFrame, chunks: DataFrame, k: int = 5, mrr_k: int = 10, by: tuple[str, ...] = ("retriever",), text: str = "indexed") -> DataFrame:
    """(by..., recall_at_5, mrr_at_10, ans_exact_at_5, ans_canon_at_5): means over all questions.

    rankings: by..., qid, id, rank. Answers are looked for in the chunks as they were indexed before any canonical
    form, whatever the retriever; chunks may differ by those columns of `by` that they have.
    """
    shared = [c for c in by if c in chunks.columns]
    keys = rankings.select(*by).distinct()
    asked = questions.select("qid", "answer", "gold_chunk_id")
    near = rankings.where(F.col("rank") <= max(k, mrr_k)).join(asked, "qid")  # ten rows a question and ranking
    near = F.broadcast(near).join(chunks.select(*shared, "id", F.col(text).alias("passage")), [*shared, "id"])
    top = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", "passage")))), lambda x: x["passage"])
    per = near.groupBy(*by, "qid", "answer").agg(recall_at(k).alias("r"), reciprocal_rank_at(mrr_k).alias("m"), top.alias("top"))
    per = per.withColumn("e", contains_answer(F.col("top"), "answer").cast("double")).withColumn("c", contains_answer(F.col("top"), "answer", True).cast("double"))
    every = asked.crossJoin(F.broadcast(keys)).select("qid", *by)
    filled = every.join(per.drop("answer", "top"), [*by, "qid"], "left")
    means = [F.avg(F.coalesce(c, F.lit(0.0))).alias(name) for c, name in (("r", "recall_at_5"), ("m", "mrr_at_10"), ("e", "ans_exact_at_5"), ("c", "ans_canon_at_5"))]
    return filled.groupBy(*by).agg(*means)


def latency(samples: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., p50, p95): the median, and the value at place floor(0.95 n), from 0, in order."""
    # values are counted, dealt by range, and their places told from sums over ranges: no group is in one task
    held = samples.select(*by, F.col(value).cast("double").alias("v")).where("v is not null").groupBy(*by, "v").agg(F.count(F.lit(1)).alias("times"))
    held = written(held.repartitionByRange(*by, "v").withColumn("range", F.spark_partition_id()), "latency")
    per = held.groupBy(*by, "range").agg(F.sum("times").alias("times"))  # a row for each range and group in it
    order = Window.partitionBy(*by).orderBy("range")
    per = per.select(*by, "range", (F.sum("times").over(order) - F.col("times")).alias("before"), F.sum("times").over(Window.partitionBy(*by)).alias("n"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"h.{c}").eqNullSafe(F.col(f"p.{c}"))
    placed = held.alias("h").join(F.broadcast(per.alias("p")), same & (F.col("h.range") == F.col("p.range"))).select(*[F.col(f"h.{c}") for c in by], "h.range", "v", "times", "before", "n")
    upto = F.col("before") + F.sum("times").over(Window.partitionBy(*by, "range").orderBy("v"))
    placed = placed.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("times"))
    at = lambda place: F.max(F.when((F.col("from") <= place) & (place < F.col("upto")), F.col("v")))
    n = F.col("n")
    return placed.groupBy(*by).agg(((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("p50"), at(F.floor(n * 95 / 100)).alias("p95"))


def compare(metrics: DataFrame, left: str, right: str, measure: str = "recall_at_5", by: tuple[str, ...] = ("condition",)) -> DataFrame:
    """(wins, ties, losses) of one retriever against another over conditions."""
    wide = metrics.groupBy(*by).pivot("retriever", [left, right]).agg(F.first(measure))
    gap = F.round(F.col(f"`{left}`") - F.col(f"`{right}`"), 9)
    count = lambda c: F.sum(c.cast("long"))
    return wide.agg(count(gap > 0).alias("wins"), count(gap == 0).alias("ties"), count(gap < 0).alias("losses"))


def accounted(parts: DataFrame) -> DataFrame:
    """Adds the hybrid's row to (condition, retriever, build_ms, bytes, query_ms, fusion_ms): its two parents' sums."""
    both = parts.where(F.col("retriever").isin("bm25-canon", "dense")).groupBy("condition").agg(
        F.sum("build_ms").alias("build_ms"), F.sum("bytes").alias("bytes"), (F.sum("query_ms") + F.max("fusion_ms")).alias("query_ms"), F.max("fusion_ms").alias("fusion_ms")
    )
    return parts.unionByName(both.withColumn("retriever", F.lit("hybrid")))
