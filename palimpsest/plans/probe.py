"""One query at a time: latency of each retriever, and the rate at which texts are encoded."""

from __future__ import annotations

import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import bm25, models, noise, ranking
from palimpsest.plans.report import peak_rss_mb
from palimpsest.sources import corpus

MODES = ("bm25", "dense", "hybrid", "ingest")
CONDITION = "scan-realistic"


def timed(action, queries: list) -> dict[str, float]:
    """Median and 95th of 100 places, in milliseconds."""
    took = []
    for q in queries:
        at = time.perf_counter()
        action(q)
        took.append((time.perf_counter() - at) * 1e3)
    return {"p50_ms": statistics.median(took), "p95_ms": sorted(took)[int(0.95 * len(took))]}


def probe(spark: SparkSession, mode: str = "hybrid", queries: int = 5, condition: str = CONDITION) -> dict:
    """Encoding is inside the timed part, as a user would wait for it; every action is a Spark job of its own."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    spec = dict(noise.CONDITIONS)[condition]
    damaged = noise.corrupt(corpus.chunks(spark), spec).persist()
    asked = [r["question"] for r in corpus.questions(spark).orderBy("qid").limit(queries).collect()]
    weights = models.toy_encoder()
    if mode == "ingest":
        n = damaged.agg(F.count(F.lit(1)), F.sum(F.length("indexed"))).first()
        at = time.perf_counter()
        models.encoded(damaged, "indexed", weights).write.format("noop").mode("overwrite").save()
        s = time.perf_counter() - at
        return {"mode": mode, "ms": s * 1e3, "chunks_per_s": n[0] / s, "kchars_per_s": n[1] / 1e3 / s, "peak_rss_mb": peak_rss_mb()}
    vectors = models.encoded(damaged, "indexed", weights).select("id", "embedding").persist()
    vectors.count()

    def question(q: str):
        return spark.createDataFrame([(0, q)], "qid long, question string")

    def lexical(q: str):
        return bm25.scores(damaged, question(q), True, "indexed")

    def dense(q: str):
        return ranking.dense_scores(vectors, models.encoded(question(q), "question", weights))

    def hybrid(q: str):
        ranks = [ranking.top_k(s(q), 1 << 30).withColumn("retriever", F.lit(n)) for n, s in (("bm25-canon", lexical), ("dense", dense))]
        return ranking.fuse(ranks[0].unionByName(ranks[1]))

    score = {"bm25": lexical, "dense": dense, "hybrid": hybrid}[mode]
    return {"mode": mode, **timed(lambda q: ranking.top_k(score(q), 5).collect(), asked), "peak_rss_mb": peak_rss_mb()}
