"""Row operators on streams: noise, canonical form, tokens and quantization need nothing but their own row."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import canon, tokens
from palimpsest.operators import kv, noise
from palimpsest.sources.shared import shared_root


def read_parquet(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def corrupted(chunks: DataFrame, spec: dict[str, float], seed: int = 7) -> DataFrame:
    return noise.corrupt(chunks, spec, seed)


def canonical_tokens(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.withColumn("canon", canon(text)).withColumn("tokens", tokens("canon"))


def quantized(rows: DataFrame, bits: int = 8, vec: str = "embedding") -> DataFrame:
    return kv.quantized(rows, bits, vec)


def value_stats(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Count and mean of event values by window and type, with late rows dropped after a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there and reads back what it wrote, in the shared folder where one is named."""
    spark = stream.sparkSession
    at = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
