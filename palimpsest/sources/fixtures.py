"""The driver's tables seen as chunks, questions and vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.shared import bounded_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("doc_title"), F.col("lang").alias("section"), "text")


def holders(items: DataFrame, docs: DataFrame, run: int = 4) -> DataFrame:
    """(item_id, text, doc_id) where a body contains an item's text.

    Words inside an item stand between blanks in every body that holds it, so items and bodies meet by runs of four
    such words; only items of fewer than six words are looked for in every body. Documents are read once, in one pass
    without a shuffle; every task has the items, which are the benchmark's.
    """
    held = [(r["item_id"], r["text"]) for r in items.select("item_id", "text").where("text is not null").collect()]
    words = [t.split(" ") for _, t in held]
    short = [k for k, w in enumerate(words) if len(w) < run + 2]
    keys = {k: w[1 : 1 + run] for k, w in enumerate(words) if len(w) >= run + 2}
    known = pa.array(sorted({w for key in keys.values() for w in key}), pa.string())
    place = {w: k for k, w in enumerate(known.to_pylist())}
    size = len(place) + 1
    by_key: dict[tuple, list[int]] = {}
    for k, key in keys.items():
        by_key.setdefault(tuple(place[w] for w in key), []).append(k)
    pairs = np.unique([a * size + b for key in by_key for a, b in zip(key, key[1:], strict=False)]).astype(np.int64)

    def run_of(batches):
        for batch in batches:
            bodies, found = batch.column("body"), []
            lists = pc.split_pattern(bodies, " ")
            ends = lists.offsets.to_numpy()
            codes = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(bodies)), np.diff(ends))
            both = (codes[:-1] >= 0) & (codes[1:] >= 0) & (row[:-1] == row[1:])
            both[both] = np.isin(codes[:-1][both] * size + codes[1:][both], pairs)
            starts = both[: len(both) - run + 2].copy()
            for k in range(1, run - 1):
                starts &= both[k : len(both) - run + 2 + k]
            looked = {(r, k) for r in range(len(bodies)) for k in short}
            for i in np.flatnonzero(starts).tolist():
                looked.update((int(row[i]), k) for k in by_key.get(tuple(codes[i : i + run].tolist()), ()))
            for r, k in sorted(looked):
                if (body := bodies[r].as_py()) is not None and held[k][1] in body:
                    found.append((r, k))
            at, which = zip(*found, strict=True) if found else ((), ())
            columns = [pa.array([held[k][0] for k in which], pa.int64()), pa.array([held[k][1] for k in which], pa.string()), batch.column("doc_id").take(pa.array(at, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "text", "doc_id"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "body").mapInArrow(run_of, f"item_id long, text string, doc_id {dict(docs.dtypes)['doc_id']}")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that some document holds: 12 words as question, the next three as answer, the first document as gold."""
    items = table(spark, sf_dir, "benchmark")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    words = F.split("text", " ", -1)
    gold = holders(items, docs).groupBy("item_id", "text").agg(F.min("doc_id").alias("gold_chunk_id"))
    return gold.select(F.col("item_id").alias("qid"), F.array_join(F.slice(words, 1, 12), " ").alias("question"), F.array_join(F.slice(words, 13, 3), " ").alias("answer"), "gold_chunk_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
