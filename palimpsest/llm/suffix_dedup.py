r"""Suffix-array dedup: removes every byte of a string of `length` bytes that starts anywhere else too.

Two equal strings of `length` bytes have their least 64-byte hash at the same place, so only text around such anchors
that occur more than once can hold repeats. A run of starts with one anchor, with the bytes that their strings cover,
is a context. Equal contexts are counted, not compared: all their starts repeat. Where an anchor has different
contexts, these are dealt by anchor to shards of about 1 MB, and each shard's text is sorted by external induction
(suffix_sort), which holds 65,536 tuples in memory and works on files beyond, so shards may be far larger: a start repeats if its common prefix with a neighbour in the suffix array is `length` at least. An
anchor with very many contexts, as at the edges of a passage that a large part of all documents holds, is
cut into single strings first, which meet by hash in as many tasks as there are; so no shard grows with one anchor.

Null texts are empty. Rows that repeat are documents of their own, whose strings repeat each other; rows with equal
ids and different texts are too. Null ids are allowed. An empty table gives an empty result. Extra columns are not
read.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, discard, materialize, table
from palimpsest.llm.similarity import FACTOR, powers, small_or_shuffled, spread
from palimpsest.llm.suffix_sort import repeated_starts

#: Bytes of an anchor; starts of a text that are handled at once; bits of a place in them.
GRAM, SEGMENT, PLACE_BITS = 64, 1 << 17, 24
#: Bytes of a shard's text, about, many times what the sorter holds in memory; contexts of an anchor from which its
#: strings are dealt one by one; tasks that shards are dealt to.
SHARD_BYTES, HOT_CONTEXTS, MOST_TASKS = 1 << 20, 2048, 10_000


BYTE_VALUES = spread(np.arange(1, 257, dtype=np.uint64) * FACTOR)


def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + y


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of each run of GRAM bytes, put together from those of runs of 1, 2, 4, ... bytes."""
    x, width, out, done = text.astype(np.uint64), 1, None, 0
    while True:
        if GRAM & width:
            m = len(text) - done - width + 1
            out = x[:m] if out is None else mixed(out[:m], x[done : done + m])
            done += width
        if width * 2 > GRAM:
            return spread(out)
        m = len(x) - width
        x = (x[:m] | (x[width : width + m] << np.uint64(8 * width))) if width < 8 else mixed(x[:m], x[width : width + m])
        width *= 2


def window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` keys."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def text_runs(raws: list[bytes], length: int):
    """Arrays of (text number, first start, starts, anchor hash, hash of its bytes) of all runs of starts with one anchor."""
    cuts = [(k, s, min(len(raw) - length + 1, s + SEGMENT)) for k, raw in enumerate(raws) for s in range(0, max(0, len(raw) - length + 1), SEGMENT)]
    group: list = []
    size = 0
    for cut in [*cuts, None]:
        if cut is None or group and size + cut[2] - cut[1] + length > SEGMENT + length:
            yield from _runs_of(raws, group, length)
            group, size = [], 0
        if cut:
            group.append(cut)
            size += cut[2] - cut[1] + length - 1


def _runs_of(raws, group, length):
    if not group:
        return
    whole = b"".join(raws[k][a : b + length - 1] for k, a, b in group)
    flat = np.frombuffer(whole, np.uint8)
    sizes = np.array([b - a + length - 1 for _, a, b in group])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    hashes = gram_hashes(flat)
    low = np.uint64((1 << PLACE_BITS) - 1)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    anchors = (window_least(keys, length - GRAM + 1) & low).astype(np.int64)
    valid = np.zeros(len(anchors) + 1, bool)
    owner = np.full(len(anchors) + 1, -1, np.int64)
    for i, (b, e) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
        valid[b : e - length + 1] = True
        owner[b : e - length + 1] = i
    at = np.flatnonzero(valid[:-1])
    change = np.concatenate([[True], (anchors[at[1:]] != anchors[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])])
    first = at[change]
    count = np.diff(np.concatenate([np.flatnonzero(change), [len(at)]]))
    own = owner[first]
    starts = first - begins[own] + np.array([a for _, a, _ in group])[own]
    texts = np.array([k for k, _, _ in group])[own]
    grams = hashes[anchors[first]].view(np.int64)
    # hashes of the runs' bytes, from differences of running sums
    up, down = powers(len(flat) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_VALUES[flat] * up[: len(flat)])])
    ends = first + count + length - 1
    names = spread((sums[ends] - sums[first]) * down[first] + count.astype(np.uint64))
    yield texts, starts, count, grams, names.view(np.int64)


def name_of(context: bytes, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(context, seed) - (1 << 63)


def context_rows(docs: DataFrame, length: int) -> DataFrame:
    """Rows (anchor, context, doc_id, row_hash, start, n) of all runs."""

    def run(batches):
        for batch in batches:
            raws = [(t or "").encode() for t in batch.column(2).to_pylist()]
            for texts, starts, count, grams, names in text_runs(raws, length):
                own = [batch.column(k).take(pa.array(texts)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(names), *own, pa.array(starts), pa.array(count.astype(np.int32))], names=["anchor", "context", "doc_id", "row_hash", "start", "n"])

    return arrow_map(docs, run, "anchor long, context long, doc_id long, row_hash long, start long, n int")


def fetched(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, context, hot, n, bytes) of contexts, read again from one text that holds them."""
    by_row = wanted.groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("anchor", "context", "hot", "start", "n")).alias("wanted"))
    by_row = small_or_shuffled(materialize(by_row, "suffix-wanted"), F.size("wanted")).alias("w")
    texts = docs.alias("d").join(by_row, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.row_hash") == F.col("w.row_hash"))).select("d.text", "w.wanted")

    def run(batches):
        names, types = ["anchor", "context", "hot", "n", "bytes"], [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 5, types, strict=True)], names=names)
        for batch in batches:
            out: list[tuple] = []
            for text, goals in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                out += [(g["anchor"], g["context"], g["hot"], g["n"], raw[g["start"] : g["start"] + g["n"] + length - 1]) for g in goals]
                if len(out) > 10_000:
                    yield pack(out)
                    out = []
            yield pack(out)

    # a row may stand several times in the input
    return arrow_map(texts, run, "anchor long, context long, hot boolean, n int, bytes binary").dropDuplicates(["anchor", "context"])


HITS = "anchor long, context long, froms array<int>, tos array<int>"


def ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of True."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def sorted_hits(contexts: DataFrame, length: int, shard_bytes: int | None = None) -> DataFrame:
    """The repeated starts of contexts (anchor, context, n, bytes), by suffix sorting shards dealt by anchor.

    A shard's contexts stream to a file as they arrive, and the sorter works on that. A row without anchor has an
    account of each shard: (runs that queues wrote to disk, levels of recursion) as froms.
    """
    size = contexts.agg(F.sum(F.length("bytes") + 1)).first()[0] or 0
    shards = max(1, -(-size // (shard_bytes or SHARD_BYTES)))
    types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    names = ["anchor", "context", "froms", "tos"]

    def hits(path: str, told: list[tuple[int, int, int]]):
        text = np.memmap(path, np.uint8, "r")
        repeated, spills, levels = repeated_starts(text, length)
        out: list[list] = [[None], [None], [np.array([spills, levels])], [[]]]
        b = 0
        for anchor, context, size in told:
            froms, tos = ranges(repeated[b : b + size - length + 1])
            if len(froms):
                for column, value in zip(out, (anchor, context, froms, tos), strict=True):
                    column.append(value)
            b += size + 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    def run(batches):
        at, told = None, []
        with tempfile.TemporaryDirectory() as folder:
            path = f"{folder}/text"
            f = open(path, "wb")  # noqa: SIM115
            for batch in batches:
                for shard, anchor, context, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    if told and shard != at:
                        f.close()
                        yield hits(path, told)
                        f, told = open(path, "wb"), []  # noqa: SIM115
                    at = shard
                    # no byte of UTF-8 is over 244, so 2 can be added; 1 stands between contexts, so no common prefix of `length` goes past it
                    f.write((np.frombuffer(raw, np.uint8) + np.uint8(2)).tobytes() + b"\1")
                    told.append((anchor, context, len(raw)))
            f.close()
            if told:
                yield hits(path, told)

    dealt = contexts.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard"), "anchor", "context", "bytes")
    return arrow_map(dealt.repartition(min(shards, MOST_TASKS), "shard").sortWithinPartitions("shard"), run, HITS)


def hot_hits(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many contexts, whose strings meet one by one."""

    def run(batches):
        names = ["anchor", "context", "at", "string", "other"]
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for a, c, n, raw in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for i in range(n):
                    s = raw[i : i + length]
                    for column, value in zip(out, (a, c, i, name_of(s, 1), name_of(s, 2)), strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=names)

    strings = arrow_map(contexts.select("anchor", "context", "n", "bytes"), run, "anchor long, context long, at int, string long, other long")
    strings = materialize(strings, "suffix-strings")
    again = strings.groupBy("string", "other").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("string", "other")
    found = strings.join(again, ["string", "other"]).groupBy("anchor", "context").agg(F.collect_set("at").alias("ats"))  # at most one for each start of a context
    edge = lambda step: F.array_sort(F.filter("ats", lambda x: ~F.array_contains("ats", x + step)))
    return found.select("anchor", "context", edge(-1).alias("froms"), edge(1).alias("tos"))


def merged_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, row_hash, starts, ends): each row's spans, joined where they overlap or touch."""
    dealt = spans.repartition("doc_id", "row_hash").sortWithinPartitions("doc_id", "row_hash", "start")

    def run(batches):
        at, starts, ends = None, [], []
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["doc_id", "row_hash", "starts", "ends"]
        pack = lambda done: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done, strict=True)) or [()] * 4, types, strict=True)], names=names)
        for batch in batches:
            done = []
            for doc, row, s, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (doc, row):
                    if starts:
                        done.append((*at, starts, ends))
                    at, starts, ends = (doc, row), [s], [e]
                elif s <= ends[-1]:
                    ends[-1] = max(ends[-1], e)
                else:
                    starts.append(s)
                    ends.append(e)
            yield pack(done)
        if starts:
            yield pack([(*at, starts, ends)])

    return arrow_map(dealt, run, "doc_id long, row_hash long, starts array<long>, ends array<long>")


def repeated_spans(own: DataFrame, length: int) -> DataFrame:
    """The merged spans of repeated strings of rows (doc_id, row_hash, text)."""
    runs = materialize(context_rows(own, length), "suffix-runs")
    often = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("times"), F.min("context").alias("low"), F.max("context").alias("high")).where("times > 1")
    # written first: a join of two plain reads is one whose hot keys can be split while it runs
    often = materialize(often.select("anchor", (F.col("low") < F.col("high")).alias("several")), "suffix-anchors")
    near = materialize(runs.join(often, "anchor"), "suffix-near")
    discard(runs, often)
    home = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_hash", "start", "n"))
    classes = materialize(near.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("copies"), F.first("several").alias("several"), home.alias("home")), "suffix-classes")
    contexts = classes.where("several").select("anchor", "context", "home.doc_id", "home.row_hash", "home.start", "home.n")
    hot = contexts.groupBy("anchor").count().where(F.col("count") > HOT_CONTEXTS).select("anchor", F.lit(True).alias("hot"))
    contexts = contexts.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    held = materialize(fetched(own, contexts, length), "suffix-contexts")
    hits = sorted_hits(held.where("not hot"), length).where("anchor is not null")
    if not held.where("hot").isEmpty():
        hits = hits.unionByName(hot_hits(held.where("hot"), length))
    # contexts that stand twice or more repeat as a whole
    whole = classes.where("copies > 1").select("anchor", "context", F.array(F.lit(0)).alias("froms"), F.array(F.col("home.n") - 1).alias("tos"))
    single = classes.where("several and copies = 1").select("anchor", "context")
    hits = materialize(whole.unionByName(hits.join(single, ["anchor", "context"], "left_semi")), "suffix-hits")
    spans = near.join(hits, ["anchor", "context"]).select("doc_id", "row_hash", "start", F.explode(F.arrays_zip("froms", "tos")).alias("x"))
    spans = spans.select("doc_id", "row_hash", (F.col("start") + F.col("x.froms")).alias("start"), (F.col("start") + F.col("x.tos") + length).alias("end"))
    out = materialize(merged_spans(spans), "suffix-spans")
    discard(near, classes, held, hits)
    return out


def suffix_dedup(docs: DataFrame, length: int = 200, keep_text: bool = True, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text the remaining bytes as `kept`."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row_hash"), F.col(text_col).alias("text"))
    spans = small_or_shuffled(repeated_spans(own, length), F.size("starts")).alias("s")
    rows = own.alias("d").join(spans, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.row_hash") == F.col("s.row_hash")), "left")

    def run(batches):
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        width = 6 if keep_text else 5
        for batch in batches:
            out = []
            for doc, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode()
                starts, ends = starts or [], ends or []
                kept = b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)], strict=True))
                out.append((doc, len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept)[:width])
            columns = list(zip(*out, strict=True)) or [()] * width
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=names[:width])

    return arrow_map(rows.select("d.doc_id", "d.text", "starts", "ends"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), keep_text=False)


QUERIES = {"op5_suffix_array_dedup": op5_suffix_array_dedup}
SQL: dict[str, str] = {}
