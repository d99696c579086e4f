"""Quantized key and value vectors: asymmetric per vector, four bits packed two to a byte, with byte and error accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = (32, 16, 8, 4)
#: Layers, heads and head size of the decoder that sizes are quoted for.
LAYERS, HEADS, HEAD = 12, 12, 64


def bit_widths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b,) for b in BITS], "bits int")


def vector_range(vec: Column, bits: int) -> tuple[Column, Column]:
    """(scale, low): the step between levels, a tiny one for a constant vector, and the least value."""
    low, high = F.array_min(vec).cast("double"), F.array_max(vec).cast("double")
    step = (high - low) / (2**bits - 1)
    return F.when(step == 0, F.lit(1e-8)).otherwise(step), low


def codes(vec: Column, bits: int) -> Column:
    scale, low = vector_range(vec, bits)
    return F.transform(vec, lambda x: F.least(F.greatest(F.rint((x.cast("double") - low) / scale), F.lit(0.0)), F.lit(float(2**bits - 1))).cast("smallint"))


def quantized(rows: DataFrame, bits: int, vec: str = "vec") -> DataFrame:
    """Adds q (codes of 0 to 2^bits - 1), scale and lo."""
    scale, low = vector_range(F.col(vec), bits)
    return rows.withColumns({"q": codes(F.col(vec), bits), "scale": scale, "lo": low})


def packed(q: Column) -> Column:
    """Two codes of four bits to a number, the earlier in the lower half; their count must be even."""
    even = F.when(F.size(q) % 2 != 0, F.raise_error(F.lit("an odd number of codes cannot be packed"))).otherwise(F.size(q))
    at = F.when(even > 0, F.sequence(F.lit(0), F.greatest(F.floor(even / 2).cast("int") - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: (F.get(q, i * 2) + F.get(q, i * 2 + 1) * 16).cast("smallint"))


def unpacked(p: Column) -> Column:
    return F.flatten(F.transform(p, lambda b: F.array((b % 16).cast("smallint"), F.floor(b / 16).cast("smallint"))))


def restored(q: Column, scale: Column, lo: Column) -> Column:
    return F.transform(q, lambda x: x * scale + lo)


def half(vec: Column) -> Column:
    """Values rounded to half precision (11 significant bits, ties to even), for magnitudes in its normal range."""

    def to_half(x: Column) -> Column:
        x = x.cast("double")
        size = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)) - 10)
        return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x / size) * size)

    return F.transform(vec, to_half)


def through(vec: Column, bits: int) -> Column:
    """A vector as it comes back from storage of this width."""
    if bits == 32:
        return F.transform(vec, lambda x: x.cast("float").cast("double"))
    if bits == 16:
        return half(vec)
    scale, low = vector_range(vec, bits)
    q = codes(vec, bits)
    return restored(unpacked(packed(q)) if bits == 4 else q, scale, low)


def stored_bytes(size: Column, bits: Column) -> Column:
    """Bytes of a vector of this size: payload, and scale and low where it is quantized."""
    return (size * bits / 8 + F.when(bits < 16, 8).otherwise(0)).cast("long")


def bytes_per_token(spark: SparkSession, layers: int = LAYERS, heads: int = HEADS, head: int = HEAD) -> DataFrame:
    """(bits, bytes_per_token): keys and values of one token in all layers and heads."""
    return bit_widths(spark).select("bits", (stored_bytes(F.lit(head), F.col("bits")) * (2 * layers * heads)).alias("bytes_per_token"))


def appended(cache: DataFrame, more: DataFrame) -> DataFrame:
    """A cache with further tokens; both have side, layer, head, token, vec."""
    return cache.unionByName(more)


def sequences(cache: DataFrame) -> DataFrame:
    """(side, layer, head, vecs): a cache's vectors in order of tokens."""
    held = F.array_sort(F.collect_list(F.struct("token", "vec")))
    return cache.groupBy("side", "layer", "head").agg(F.transform(held, lambda x: x["vec"]).alias("vecs"))


def tiled(ids: Column, n: int) -> Column:
    """Ids repeated until there are n."""
    return F.slice(F.flatten(F.array_repeat(ids, F.ceil(F.lit(n) / F.greatest(F.size(ids), F.lit(1))).cast("int"))), 1, n)


def summary(steps: DataFrame, mb: DataFrame) -> DataFrame:
    """(bits, ppl, ppl_delta_pct, top1_agree, mem_ratio) against 32 bits. steps: bits, step, nll, top; mb: bits, mb."""
    full = steps.where("bits = 32").select("step", F.col("top").alias("full_top"))
    per = steps.join(full, "step").groupBy("bits").agg(F.exp(F.avg("nll")).alias("ppl"), F.avg((F.col("top") == F.col("full_top")).cast("double")).alias("top1_agree"))
    per = per.join(mb.select("bits", F.round("mb", 2).alias("mb")), "bits")
    base = F.broadcast(per.where("bits = 32").select(F.col("ppl").alias("ppl32"), F.col("mb").alias("mb32")))
    return per.crossJoin(base).select("bits", "ppl", ((F.col("ppl") / F.col("ppl32") - 1) * 100).alias("ppl_delta_pct"), "top1_agree", (F.col("mb") / F.col("mb32")).alias("mem_ratio"))
