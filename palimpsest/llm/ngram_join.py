r"""N-gram Jaccard join: which documents share at least a given part of their word n-grams.

The documents' n-gram incidence is a sparse matrix; similar documents are large entries of its product with itself.
Documents with equal rows are one class. N-grams are ordered by a count of all classes' n-grams, common ones last;
by the bound that a set's size sets on the overlap, similar sets share one of their first few columns. The product is
taken in blocks. The first block is of these columns: a join on them gives an entry's overlap so far and drops those
that cannot reach the bound of both sizes with all that stands behind. For the entries that remain, rows are dealt in
blocks of at most 512 beside one other row, and the other columns follow in four blocks; counts add up, and entries
fall out between blocks as soon as they cannot reach the bound (similarity.overlaps). Not all entries of a group are
made: rows are multiplied with those of leaders first, and with each other only where leaders leave them apart
(similarity). Counts are kept in 2^20 cells; cells may be shared, which moves n-grams in the order but never loses a
link.

Null texts and texts without words have no n-grams and are linked with nothing. Each row is in the result, repeated
ones too; a null id names no component unless all ids of a component are null. Ties and equal texts are one class.
Sets are named by 64-bit hashes; two sets of one name are told apart by a second. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, discard, materialize, sliced, table
from palimpsest.llm.similarity import class_of, link_classes, offered, packed, sets_of, small_or_shuffled, verify_sets

CELL_BITS, PARTS = 20, 32


def cells_of(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def document_classes(docs: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, row_hash, n, cid, check), and rows with the counts of n-grams of a task, in parts: (part, counts)."""
    names = ["doc_id", "row_hash", "n", "cid", "check", "part", "counts"]

    def run(batches):
        counts, seen = np.zeros(1 << CELL_BITS, np.int64), set()
        for batch in sliced(batches):
            sets = sets_of(batch.column(2).to_pylist(), width)
            cids = [class_of(s) if len(s) else None for s in sets]
            checks = [class_of(s, 1) if len(s) else None for s in sets]
            for s, c in zip(sets, cids, strict=True):
                if c is not None and c not in seen:
                    seen.add(c)
                    np.add.at(counts, cells_of(s), 1)
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(cids, pa.int64()), pa.array(checks, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=names,
            )
        parts = np.split(np.minimum(counts, (1 << 31) - 1).astype(np.int32), PARTS)
        none = pa.nulls(PARTS, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    return arrow_map(docs, run, "doc_id long, row_hash long, n long, cid long, check long, part int, counts binary")


def column_counts(parts: DataFrame) -> np.ndarray:
    """The counts of all tasks together; their number of cells is fixed."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(raw, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "counts"])

    out = np.zeros(1 << CELL_BITS, np.int64)
    step = len(out) // PARTS
    for r in arrow_map(parts.repartition(PARTS, "part"), run, "part int, counts binary").collect():
        out[r["part"] * step : (r["part"] + 1) * step] += np.frombuffer(r["counts"], np.int64)
    return out


def first_columns(docs: DataFrame, counts: np.ndarray, width: int, percent: int, clashes: frozenset = frozenset()) -> DataFrame:
    """Postings (key, cid, place) of each class's rarest n-grams, as many as its size calls for."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))

    def run(batches):
        common, seen = shared.value, set()
        for batch in sliced(batches):
            keys, cids, places = [], [], []
            for s in sets_of(batch.column(2).to_pylist(), width):
                cid = class_of(s)
                if cid in clashes:
                    cid = class_of(s, 1)
                if not len(s) or cid in seen:
                    continue
                seen.add(cid)
                size = len(s)
                first = offered(size, percent)
                keys.append(s[np.lexsort((s, common[cells_of(s)]))[:first]].view(np.int64))
                cids.append(np.full(first, cid, np.int64))
                places.append(packed(size, np.arange(first)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (keys, cids, places)], names=["key", "cid", "place"])

    return arrow_map(docs, run, "key long, cid long, place long")


def ngram_jaccard(docs: DataFrame, width: int = 5, percent: int = 80, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: doc_id, row_hash, n_shingles, component_id (the least doc_id that links reach), component (its name)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row_hash"), F.col(text_col).alias("text"))
    found = materialize(document_classes(own, width), "ngram-classes")
    rows = found.where("part is null").select("doc_id", "row_hash", "n", "cid", "check")
    # two sets under one 64-bit name (expected once in 4 thousand million classes) take their second name
    per = rows.groupBy("cid").agg(F.min("check").alias("low"), F.max("check").alias("high"))
    clashes = frozenset(r["cid"] for r in per.where("low < high").select("cid").collect())
    rows = rows.withColumn("cid", F.when(F.col("cid").isin(*clashes), F.col("check")).otherwise(F.col("cid"))) if clashes else rows
    counts = column_counts(found.where("part is not null").select("part", "counts"))
    postings = materialize(first_columns(own, counts, width, percent, clashes), "ngram-postings")
    classes = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "row_hash")).alias("home"))
    homes = classes.select("cid", F.col("home.doc_id").alias("home_id"), F.col("home.row_hash").alias("home_hash"))

    def make(tasks: DataFrame) -> DataFrame:
        where = small_or_shuffled(materialize(tasks.select("cid", "home_id", "home_hash", "goals"), "ngram-goals"), F.size("goals"))
        texts = own.alias("d").join(where.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.home_id")) & (F.col("d.row_hash") == F.col("w.home_hash")))

        def run(batches):
            for batch in sliced(batches):
                out: list[tuple] = []
                held = 0
                sets = sets_of(batch.column(1).to_pylist(), width)
                for cid, goals, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), sets, strict=True):
                    raw = s.tobytes()
                    out += [(cid, g["to"], g["salt"], g["role"], raw) for g in goals]
                    held += len(raw) * len(goals)
                    if held > 8 << 20:
                        yield packed(out)
                        out, held = [], 0
                yield packed(out)

        def packed(out):
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["cid", "to", "salt", "role", "hashes"])

        return arrow_map(texts.select("cid", "text", "goals"), run, "cid long, to long, salt int, role int, hashes binary")

    near = link_classes(postings, lambda pairs: verify_sets(pairs, homes, make, percent), percent)
    least = classes.select("cid", "doc_id").join(near, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    named = least.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = materialize(least.join(named, "component").select("cid", "component", "component_id"), "ngram-named")
    discard(postings)  # rows are still read
    return rows.join(by_class, "cid", "left").select("doc_id", "row_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "component")


def keep_one_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col="doc_id", text_col="text") -> DataFrame:
    """The documents without those that links join to an earlier one, by id (null last); of equal rows one stays."""
    rows = materialize(ngram_jaccard(docs, width, percent, id_col, text_col), "ngram-rows")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_hash")
    first = rows.where("component is not null").groupBy("component").agg(F.min(row).alias("first"))
    told = rows.where("component is not null").join(first, "component").select("doc_id", "row_hash", row.eqNullSafe(F.col("first")).alias("stays"))
    told = materialize(told.groupBy("doc_id", "row_hash").agg(F.min("stays").alias("stays"), F.count(F.lit(1)).alias("times")), "ngram-told")
    gone = small_or_shuffled(told.where("not stays").select(F.col("doc_id").alias("gone_id"), F.col("row_hash").alias("gone_hash")))
    left = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("gone_id")) & (F.xxhash64(text_col) == F.col("gone_hash")), "left_anti")
    twice = told.where("stays and times > 1").select(F.col("doc_id").alias("twice_id"), F.col("row_hash").alias("twice_hash"))
    if twice.isEmpty():
        return left
    twice = small_or_shuffled(twice)
    matches = F.col(id_col).cast("long").eqNullSafe(F.col("twice_id")) & (F.xxhash64(text_col) == F.col("twice_hash"))
    return left.join(twice, matches, "left_anti").unionByName(left.join(twice, matches, "left_semi").dropDuplicates([id_col, text_col]))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3]) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * o >= 85 * (s.n + t.n - o)),
links AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT b, c FROM reach JOIN links ON a = reach.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(c) FROM reach r WHERE r.doc_id = d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
"""

QUERIES = {"op6_ngram_jaccard_join": op6_ngram_jaccard_join}
SQL = {"op6_ngram_jaccard_join": OP6_SQL}
