"""What the training-data operators share: tables, written intermediates, words, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a fresh local one where it is unset, as in tests."""
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        set_to = spark.conf.get("spark.checkpoint.dir", None)
        if set_to is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(set_to or tempfile.mkdtemp(prefix="palimpsest-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of materialized frames that nothing will read again."""
    for df in frames:
        path = getattr(df, "_written_at", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def collect_garbage(spark: SparkSession) -> None:
    """Lets broadcasts and shuffle files of plans that are through go at once, and the driver's heap shrink again."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at 4 MB or 2,000 rows, so that very long texts do not swell a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


#: Texts hashed at once.
SLICE = 256


def sliced(batches):
    """Arrow batches in parts of SLICE rows, whose arrays take little memory."""
    for batch in batches:
        for k in range(0, len(batch), SLICE):
            yield batch.slice(k, SLICE)


#: Edges that one task of a round takes, about; edges up to which one task finds all components.
EDGES_A_TASK, EDGES_AT_ONCE = 200_000, 1_000_000


def least_of_component(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of all nodes of the edges a[i] - b[i]."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    least = np.arange(len(nodes))
    while len(u):
        low, high = np.minimum(least[u], least[v]), np.maximum(least[u], least[v])
        np.minimum.at(least, high, low)  # each root goes below the least one that an edge shows it
        while (least[least] < least).any():
            least = least[least]
        open_ = least[u] != least[v]
        u, v = u[open_], v[open_]
    return nodes, nodes[least]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph (columns a, b) as (node, component), component the smallest node.

    Up to EDGES_AT_ONCE edges go to one task. With more, large-star and small-star steps alternate until every node
    but the smallest of its component has one edge, to that one. Each step is a shuffle with map-side minima, so a hub
    costs one partial row per task, and each is written to the shared folder. Isolated nodes are not returned.
    """
    now = materialize(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    if now.count() <= EDGES_AT_ONCE:

        def run(batches):
            held = [[c.to_numpy() for c in batch.columns] for batch in batches]
            if held:
                told = least_of_component(*(np.concatenate(x) for x in zip(*held, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in told], names=["node", "component"])

        return arrow_map(now.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1), run, "node long, component long")
    for _ in range(max_rounds):
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        n, open_ = per.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count(F.when((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0), 1))).first()
        if not open_:
            break
        tasks = max(1, -(-n // EDGES_A_TASK))
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large.coalesce(tasks), "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        small = materialize(small.coalesce(tasks), "cc")
        discard(now, large)
        now = small
    else:
        raise RuntimeError("components have not settled")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
