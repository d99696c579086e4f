"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

Documents have weights; by default longer documents count more (1 below 32 words, 2 below 128, 3 below 512, else 4). A
document's expected number of copies is its weight times a unit, 3 at most; a source's unit is such that its expected
words are its target, so what the limit takes from heavy documents goes to the lighter ones. The whole part is
certain. The rest is sampled with unequal probabilities: documents stand in the order of odds(u) / odds(p), u a number drawn from the
document's id and p its inclusion probability, and are taken until the source's target is met. Ranks need no sort
of a source: sums over 4,096 cells of the order, then over 4,096 cells of the cell where the target falls, leave
about one row in 16 million to rank, so a hot source is never in one task.

Null texts have size 0, take nothing and stay in the result; a null source is a source of its own, the last one.
Null or repeated ids are documents of their own; equal rows share a number and are told apart by rank. An empty
table gives an empty result. Extra columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import WORD, materialize, table

CELLS = 4096


def source_targets(sized: DataFrame, weights=(5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target): all sizes shared by weight, none above `most` times its source's size."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    filled = per.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    up = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    filled = filled.withColumn("level", level)
    filled = filled.withColumn("open", F.col("cap") >= F.col("level") * F.col("weight"))
    share = F.coalesce(F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"], F.lit(float("inf")))
    return filled.select("source", "source_size", F.least(F.col("cap"), share * F.col("weight")).alias("target"))


def size_weight(size: Column) -> Column:
    return F.when(size < 32, 1.0).when(size < 128, 2.0).when(size < 512, 3.0).otherwise(4.0)


def units(sized: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(source, unit): how many copies a unit of weight stands for, so that the expected words are the target."""
    per = sized.groupBy("source", "w").agg(F.sum("size").alias("words")).alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.*", "target")
    down = Window.partitionBy("source").orderBy(F.col("w").desc())
    heavier = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lighter = F.sum(F.col("words") * F.col("w")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = per.withColumn("unit", F.when(lighter > 0, (F.col("target") - heavier * F.lit(float(most))) / lighter))
    # the heaviest weight that stays below the limit; none: every document is taken as often as it may be
    best = F.max(F.when(F.col("unit") * F.col("w") <= most, F.struct("w", "unit")))["unit"]
    return level.groupBy("source").agg(F.when(F.sum("words") > 0, F.coalesce(best, F.lit(float("inf")))).otherwise(0.0).alias("unit"))


def pareto_mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weight_col: str | None = None, weights=(5, 2, 1), most: int = 3, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken, and the columns of `keep`.

    weight_col: documents' own relative weights within their source (positive, of few values; null: 1); without it
    those of their sizes.
    Columns to keep are written once beside the sizes and take part in no shuffle, but for the few rows to rank.
    """
    weight = F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)) if weight_col else None
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double")
    kept = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    measured = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ((drawn + 0.5) / float(1 << 48)).alias("u"), *([weight.alias("w")] if weight_col else []), *kept,
    )
    measured = measured if weight_col else measured.withColumn("w", size_weight(F.col("size")))
    measured = materialize(measured, "mix-sizes")  # sizes are counted once
    sized = measured.drop(*[f"kept_{i}" for i in range(len(keep))])
    targets = materialize(source_targets(sized, weights, most), "mix-targets")
    goal = targets.alias("g").join(units(sized, targets, most).alias("m"), F.col("g.source").eqNullSafe(F.col("m.source"))).select("g.*", "unit")
    goal = materialize(goal, "mix-goals")
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    expected = F.least(F.col("unit") * F.col("w"), F.lit(float(most)))
    part = F.col("expected") - F.col("whole")
    odds = (F.col("u") / (1 - F.col("u"))) * (1 - F.col("p")) / F.col("p")
    rank = lambda rows: (
        rows.alias("s").join(goal.alias("g"), same("s", "g"))
        .select("s.*", "g.source_size", "g.target", expected.alias("expected"))
        .withColumn("whole", F.floor("expected").cast("long")).withColumn("p", part)
        .withColumn("v", F.when(F.col("p") > 0, odds / (1 + odds)).otherwise(1.0))
        .withColumn("fine", F.least(F.floor(F.col("v") * float(CELLS * CELLS)), F.lit(CELLS * CELLS - 1)).cast("long"))
        .withColumn("cell", F.floor(F.col("fine") / CELLS).cast("long"))
    )
    ranked = rank(sized)
    rest = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("rest"))

    def crossing(cells: DataFrame, key: str, start: str | None) -> DataFrame:
        """Of cells with sums: the one of each source in which its target falls, with the words before it."""
        run = Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = F.sum("words").over(run) + (F.col(start) if start else F.lit(0))
        return cells.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("words")).where("from <= rest and rest < upto")

    coarse = ranked.where("p > 0").groupBy("source", "cell").agg(F.sum("size").alias("words")).alias("c").join(rest.alias("r"), same("c", "r")).select("c.*", "rest")
    first = crossing(coarse, "cell", None).select("source", "cell", "rest", F.col("from").alias("begun"))
    at = ranked.where("p > 0").alias("d").join(first.alias("f"), same("d", "f") & (F.col("d.cell") == F.col("f.cell")))
    finer = at.groupBy("f.source", "fine", "rest", "begun").agg(F.sum("size").alias("words"))
    second = crossing(finer, "fine", "begun").select("source", F.col("fine").alias("edge"), F.col("from").alias("begun"), "rest")
    # a source without a crossing takes all its documents' parts (rest is their sum) or has none
    bounds = materialize(rest.alias("r").join(second.alias("b"), same("r", "b"), "left").select("r.source", "r.rest", "edge", "begun"), "mix-edges")
    placed = (rank(measured) if keep else ranked).alias("d").join(bounds.alias("b"), same("d", "b")).select("d.*", "rest", "edge", "begun")
    clear = placed.where("edge is null or fine <> edge or p <= 0").withColumn("extra", F.when(F.col("p") <= 0, 0).when(F.col("edge").isNull(), (F.col("rest") > 0).cast("int")).otherwise((F.col("fine") < F.col("edge")).cast("int")))
    run = Window.partitionBy("source").orderBy("v", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tight = placed.where("fine = edge and p > 0").withColumn("extra", ((F.sum("size").over(run) + F.col("begun") - F.col("size") / 2) <= F.col("rest")).cast("int"))
    out = clear.unionByName(tight)
    copies = (F.col("whole") + F.col("extra")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)])


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH counted AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::UBIGINT::DOUBLE + 0.5e0) / 281474976710656e0 AS u
  FROM documents),
sized AS (SELECT *, CASE WHEN size < 32 THEN 1e0 WHEN size < 128 THEN 2e0 WHEN size < 512 THEN 3e0 ELSE 4e0 END AS w FROM counted),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, source_size * 3e0 AS cap FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
    / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
goal AS (SELECT source, source_size, least(cap, weight * (SELECT coalesce(arg_min(level, cap / weight), 'infinity'::DOUBLE) FROM levels WHERE cap >= level * weight)) AS target FROM levels),
classes AS (SELECT s.source, w, sum(size)::BIGINT AS words, any_value(target) AS target FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source GROUP BY s.source, w),
steps AS (
  SELECT *, (target - coalesce(sum(words) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3e0)
    / nullif(sum(words * w) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0e0) AS unit FROM classes),
unit AS (SELECT source, CASE WHEN sum(words) > 0 THEN coalesce(arg_max(unit, w) FILTER (unit * w <= 3e0), 'infinity'::DOUBLE) ELSE 0e0 END AS unit FROM steps GROUP BY source),
expected AS (
  SELECT s.doc_id, s.source, s.size, s.u, g.source_size, g.target, least(unit * w, 3e0) AS e
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source JOIN unit v ON s.source IS NOT DISTINCT FROM v.source),
ranked AS (SELECT *, floor(e)::BIGINT AS whole, e - floor(e) AS p FROM expected),
placed AS (
  SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS rest,
         CASE WHEN p > 0 THEN sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (
           PARTITION BY source ORDER BY (CASE WHEN p > 0 THEN ((u / (1 - u)) * (1 - p) / p) / (1 + (u / (1 - u)) * (1 - p) / p) ELSE 1e0 END), doc_id NULLS FIRST, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS upto FROM ranked)
SELECT doc_id, size::BIGINT AS size, source_size, target, ((whole + CASE WHEN p > 0 AND upto - size / 2e0 <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM placed
"""

QUERIES = {"op7_mix_sources": op7_mix_sources}
SQL = {"op7_mix_sources": OP7_SQL}
