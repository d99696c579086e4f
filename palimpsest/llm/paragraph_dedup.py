r"""Substring dedup by paragraph MinHash banding.

A paragraph is a run of words between content-defined cuts; line ends are blanks like others. A cut falls where the
hash of five words is the least among `REACH` neighbours on either side, so copies of a passage are cut alike wherever
they stand and however their lines are wrapped, and every word of a text lies in a paragraph. Equal paragraphs are one
class; different ones under one 64-bit name are told apart by a second hash. MinHash signatures of classes are cut into bands, chosen so that a pair at the threshold collides with the
wanted recall; classes that collide are checked against two leaders by the exact Jaccard similarity of their word
shingles. What bands and leaders leave apart follows exactly: each class offers its rarest shingles, as many as its size
calls for, so that any two similar classes share one, and all such pairs from different components are counted and
checked; where many classes share a shingle, 256 bits of each set first show which pairs differ too much. So no link is
lost. Components of similar classes are clusters; of each the first paragraph stays, by document
id and place.

What is repeated is then followed word by word to the ends of the passage, across paragraphs: windows of `least` words
that stand earlier too are added (word_runs). Repeated paragraphs and windows that overlap or touch are one passage; a
passage of `least` words or more is cut, a shorter one stays, so that common phrases, headings and short texts are left
alone.

Null and empty texts have no paragraphs and stay as they are. Rows with equal id and text are one document and lose
the same; rows that share an id but not a text are documents of their own. Null ids come after all others. Texts of
one repeated phrase are one paragraph of any length. An empty table gives an empty result. Extra columns can be
carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, collect_garbage, discard, materialize, sliced, table
from palimpsest.llm.ngram_join import CELL_BITS, PARTS, cells_of, column_counts
from palimpsest.llm.similarity import link_classes, offered, packed, shingles, sketches, small_or_shuffled, spread, verify_sets
from palimpsest.llm.word_runs import DOC, ODD, merged, repeated_windows, run_hashes, segments_of, sliding_least, streams, without

#: Words of a shingle; neighbours on either side that a cut's hash must be less than.
WIDTH, REACH = 5, 24
#: Paragraphs of a band that every other one there is checked against, before the exact way for what they leave apart.
LEADERS = 2
#: What a set is wanted for, a number each: class, leader, place and size of a paragraph, block and role.
WANTED = ("cid", "to", "at", "goal")
MOST = np.uint64(np.iinfo(np.uint64).max)


def tuned_bands(percent: int, recall: float = 0.999, most: int = 16) -> tuple[int, int]:
    """(bands, rows): the longest bands that need at most `most` hashes for the recall of a pair at the threshold."""
    s = percent / 100
    for rows in range(most, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(s**rows)))) if s < 1 else 1
        if bands * rows <= most:
            return bands, rows
    return most, 1


def paragraphs_of(flat: np.ndarray, of: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word in the stream, words, text) of all paragraphs of texts in a row."""
    n = len(flat)
    if not n:
        return (np.empty(0, np.int64),) * 3
    runs = run_hashes(flat, WIDTH)
    m = len(runs)
    cuts = np.empty(0, np.int64)
    if m:
        whole = of[:m] == of[n - m :]
        place = np.arange(m) + (of[:m] + 1) * REACH  # gaps between texts, so that none has a say in another's cuts
        spaced = np.full(int(place[-1]) + REACH + 2, MOST)
        spaced[place[whole]] = runs[whole]
        least = sliding_least(spaced, REACH)
        cuts = np.flatnonzero(whole & (runs < least[place - REACH]) & (runs <= least[np.minimum(place + 1, len(least) - 1)]))
    first = np.unique(np.concatenate([np.unique(starts[np.append(starts[1:], n) > starts]), cuts]))
    text = of[first]
    return first, np.diff(np.append(first, n)), text


def names_of(flat: np.ndarray, first: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit name of each run of words."""
    offset = (np.arange(len(flat)) - np.repeat(first, size)).astype(np.uint64)
    return spread(np.add.reduceat(spread(flat ^ spread((offset + np.uint64(seed)) * ODD)), first) + size.astype(np.uint64) * ODD)


def band_keys(runs: np.ndarray, first: np.ndarray, count: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band of the MinHash signatures of the shingles runs[first : first + count]: sets x bands."""
    edges = np.stack([first, first + count], 1).ravel()
    salted = np.append(runs, MOST)
    keys = np.empty((len(first), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(first), b + 1, np.uint64)
        for r in range(rows):
            salt = spread(np.array([b * rows + r + 1], np.uint64) * ODD)[0]
            acc = spread(acc ^ np.minimum.reduceat((salted ^ salt) * np.uint64(0xD6E8FEB86659FD93), edges)[::2]) + ODD
        keys[:, b] = acc
    return keys


def unseen(names: np.ndarray, of: np.ndarray, seen: set) -> np.ndarray:
    """Which of the names at `of` are not in `seen`, to which they are added."""
    new = np.zeros(len(names), bool)
    for i in np.flatnonzero(of).tolist():
        if (name := int(names[i])) not in seen:
            seen.add(name)
            new[i] = True
    return new


def renamed(name, n):
    """The name of a paragraph whose 64-bit name another one has too, by its second hash: numbers, or columns."""
    return name.bitwiseXOR(F.shiftleft(n.cast("long"), 32)) if isinstance(name, Column) else name ^ (n << 32)


def second_names(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (names_of(flat, first, size, 1 << 40) >> np.uint64(33)).astype(np.int64)


def runs_in(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, place) of all elements of sets that stand at [first : first + count]."""
    return np.repeat(np.arange(len(first)), count), np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)


PIECES = "unnamed boolean, doc long, row_hash long, pos int, size int, key long, name long, n int, keys array<long>, part int, counts binary"


def found_pieces(docs: DataFrame, least: int, bands: int, rows: int, percent: int) -> DataFrame:
    """Three kinds of rows from one reading of the texts: paragraphs (without key; band keys once for a class and
    task), segments of windows (see word_runs.segments_of), and counts of the shingles of a task's classes, in parts.

    A paragraph of fewer words than a shingle is similar to equal ones only, which are the same class: it needs no
    bands. Its `n` is a second hash of 31 bits.
    """
    fields = ["pos", "size", "key", "name", "n", "keys", "part", "counts"]

    def run(batches):
        seen, counts = set(), np.zeros(1 << CELL_BITS, np.int64)
        for batch in sliced(batches):
            flat, of, starts = streams(batch.column(3).to_pylist())
            first, size, text = paragraphs_of(flat, of, starts)
            if not len(first):
                continue
            names = names_of(flat, first, size).view(np.int64)
            count = size - WIDTH + 1
            new = unseen(names, count > 0, seen)
            runs = run_hashes(flat, WIDTH)
            keys = band_keys(runs, first[new], count[new], bands, rows).view(np.int64) if new.any() else np.empty((0, bands), np.int64)
            np.add.at(counts, cells_of(runs[runs_in(first[new], count[new])[1]]), 1)
            ends = np.concatenate([[0], np.cumsum(new * bands)]).astype(np.int32)
            none = pa.nulls(len(first))
            second = second_names(flat, first, size)
            columns = [first - starts[text], size, none, names, second, pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            own = lambda at: [batch.column(k).take(pa.array(at)) for k in range(3)]  # noqa: B023, E731
            no_counts = lambda n: [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([*own(text), *(pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)), *no_counts(len(text))], names=[*DOC, *fields])
            at, *columns = segments_of(flat, of, starts, least)
            if len(at):
                yield pa.RecordBatch.from_arrays([*own(at), *(pa.array(c).cast(t) for c, t in zip(columns, types[:5], strict=True)), pa.nulls(len(at), types[5]), *no_counts(len(at))], names=[*DOC, *fields])
        if seen:
            none = [pa.nulls(PARTS, t) for t in (pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))]
            told = [p.tobytes() for p in np.split(np.minimum(counts, (1 << 31) - 1).astype(np.int32), PARTS)]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(PARTS), pa.int32()), pa.array(told, pa.binary())], names=[*DOC, *fields])

    return arrow_map(docs.select(*DOC, "text"), run, PIECES)


def first_shingles(docs: DataFrame, counts: np.ndarray, percent: int, clashes: frozenset = frozenset()) -> DataFrame:
    """Postings (key, cid, place) of each class's rarest shingles, as many as its size calls for: similar classes share one.

    clashes: names that different paragraphs have, which are told apart by their second hashes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))

    def run(batches):
        common, seen = shared.value, set()
        for batch in sliced(batches):
            flat, of, starts = streams(batch.column(0).to_pylist())
            first, size, _ = paragraphs_of(flat, of, starts)
            if not len(first):
                continue
            names = names_of(flat, first, size).view(np.int64)
            if clashes:
                names = np.where(np.isin(names, list(clashes)), renamed(names, second_names(flat, first, size)), names)
            new = unseen(names, size >= WIDTH, seen)
            if not new.any():
                continue
            own, at = runs_in(first[new], size[new] - WIDTH + 1)
            hashes = run_hashes(flat, WIDTH)[at]
            order = np.lexsort((hashes, common[cells_of(hashes)], own))
            own, hashes = own[order], hashes[order]
            distinct = np.append(True, (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1]))
            own, hashes = own[distinct], hashes[distinct]
            n = np.bincount(own)
            pos = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            some = pos < offered(n, percent)[own]
            own, columns = own[some], [hashes[some].view(np.int64), names[new][own[some]], packed(n[own[some]], pos[some])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "cid", "place"])

    return arrow_map(docs.select("text"), run, "key long, cid long, place long")


def classes_of(found: DataFrame) -> DataFrame:
    """A row for each name: its first paragraph, how many have it, and whether their second hashes differ."""
    per = found.groupBy(F.col("name").alias("cid")).agg(F.min(F.struct(*DOC, "pos", "size")).alias("home"), F.count(F.lit(1)).alias("copies"), (F.min("n") < F.max("n")).alias("clash"))
    return materialize(per, "paragraph-classes")


def repeated_paragraphs(found: DataFrame, docs: DataFrame, percent: int, make_rarest: Callable[[frozenset], DataFrame]) -> DataFrame:
    """(doc, span) of the paragraphs that are not the first of their cluster; make_rarest: from names that different paragraphs have to first_shingles."""
    classes = classes_of(found)
    # two paragraphs under one 64-bit name (expected once in 4 thousand million classes) take names of both hashes
    clashes = frozenset(r["cid"] for r in classes.where("clash").select("cid").collect())
    if clashes:
        discard(classes)
        found = found.withColumn("name", F.when(F.col("name").isin(*clashes), renamed(F.col("name"), F.col("n"))).otherwise(F.col("name")))
        classes = classes_of(found)
    rarest = materialize(make_rarest(clashes), "paragraph-rarest")
    postings = found.select(F.explode("keys").alias("key"), F.col("name").alias("cid"), packed(F.lit(0).cast("long"), F.lit(0).cast("long")).alias("place"))
    place = F.struct(*DOC, "pos")
    homes = classes.select("cid", "home")

    def make(tasks: DataFrame) -> DataFrame:
        flat = tasks.select("cid", *[F.col(f"home.{c}").alias(c) for c in (*DOC, "pos", "size")], F.explode("goals").alias("g"))
        one = F.struct("cid", F.col("g.to").alias("to"), packed(F.col("pos").cast("long"), F.col("size")).alias("at"), (F.col("g.salt") * 2 + F.col("g.role")).alias("goal"))
        per = flat.groupBy(*DOC).agg(F.collect_list(one).alias("wanted"))
        # arrays of numbers are a third of arrays of rows, in a broadcast too
        where = materialize(per.select(*DOC, *[F.col(f"wanted.{c}").alias(c) for c in WANTED]), "paragraph-goals")
        made.append(where)
        where = small_or_shuffled(where, F.size("cid"))

        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

        def run(batches):
            for batch in sliced(batches):
                out: list[tuple] = []
                held = 0
                flat, _, starts = streams(batch.column(0).to_pylist())
                runs = shingles(flat, WIDTH)
                for start, *wanted in zip(starts.tolist(), *(batch.column(k).to_pylist() for k in range(1, 1 + len(WANTED))), strict=True):
                    last = raw = None
                    for cid, to, at, goal in zip(*wanted, strict=True):
                        if at != last:
                            a, n, last = start + (at >> 32), at & (1 << 32) - 1, at
                            own = np.sort(runs[a : a + n - WIDTH + 1] if n >= WIDTH else shingles(flat[a : a + n], WIDTH))
                            raw = own[np.append(True, own[1:] != own[:-1])].tobytes()
                        out.append((cid, to, goal >> 1, goal & 1, raw))
                        held += len(raw)
                        if held > 8 << 20:
                            yield told(out)
                            out, held = [], 0
                yield told(out)

        def told(out):
            columns = list(zip(*out, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["cid", "to", "salt", "role", "hashes"])

        # a text that stands in several rows is read once
        texts = docs.join(where, list(DOC)).dropDuplicates(list(DOC)) if repeated_rows else docs.join(where, list(DOC))
        return arrow_map(texts.select("text", *WANTED), run, "cid long, to long, salt int, role int, hashes binary")

    made: list[DataFrame] = []
    repeated_rows = not docs.groupBy(*DOC).count().where("count > 1").isEmpty()

    verify = lambda pairs: verify_sets(pairs, homes, make, percent)
    near = link_classes(postings, verify, None, rounds=LEADERS, exhaustive=False)
    collect_garbage(docs.sparkSession)
    near = link_classes(rarest, verify, percent, rounds=1, known=near, sketch=lambda some: sketches(some, homes, make))
    collect_garbage(docs.sparkSession)
    placed = classes.join(near, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    first = placed.groupBy("component").agg(F.min("home").alias("first"), F.sum("copies").alias("copies")).where("copies > 1")
    repeats = materialize(placed.join(first.select("component", "first"), "component").select(F.col("cid").alias("name"), F.struct(*[f"first.{c}" for c in (*DOC, "pos")]).alias("first")), "paragraph-repeats")
    gone = found.join(small_or_shuffled(repeats), "name")
    gone = gone.where(place != F.col("first"))
    out = materialize(gone.select(*DOC, F.struct(F.col("pos").alias("a"), (F.col("pos") + F.col("size")).alias("b")).alias("span")), "paragraph-spans")
    discard(classes, near, repeats, rarest, *made)
    collect_garbage(docs.sparkSession)
    return out


def passages(spans: DataFrame, least: int) -> DataFrame:
    """(doc, spans): each text's spans, joined where they overlap or touch, of `least` words at least."""
    every = spans.groupBy(*DOC).agg(F.collect_list("span").alias("spans"))  # as many as a text has paragraphs and segments

    def run(batches):
        for batch in batches:
            held = batch.column(3)
            a, b = (x.to_numpy().astype(np.int64) for x in held.flatten().flatten())
            of, a, b = merged(np.repeat(np.arange(len(batch)), held.value_lengths().to_numpy()), a, b, least)
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(batch)))]).astype(np.int32)
            told = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["a", "b"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), told], names=[*DOC, "spans"])

    return arrow_map(every, run, "unnamed boolean, doc long, row_hash long, spans array<struct<a:int,b:int>>").where(F.size("spans") > 0)


def substring_dedup(docs: DataFrame, least: int = 50, percent: int = 80, recall: float = 0.999, id_col="doc_id", text_col="text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, the columns of `keep`, text without what is repeated, n_removed (characters), n_spans, spans (words from, to)."""
    bands, band_rows = tuned_bands(percent, recall)
    carried = [f"carried_{i}" for i in range(len(keep))]
    own = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row_hash")]
    named = docs.select(*own, *[F.col(c).alias(name) for c, name in zip(keep, carried, strict=True)])
    named = named.withColumns({"unnamed": F.col("doc_id").isNull(), "doc": F.coalesce("doc_id", F.lit(0).cast("long"))})
    texts = named.select(*DOC, "text")
    pieces = materialize(found_pieces(texts, least, bands, band_rows, percent), "paragraph-pieces")
    counts = column_counts(pieces.where("part is not null").select("part", "counts"))
    paragraphs = repeated_paragraphs(pieces.where("key is null and part is null").select(*DOC, "pos", "size", "name", "n", "keys"), texts, percent, lambda clashes: first_shingles(texts, counts, percent, clashes))
    windows = repeated_windows(pieces.where("key is not null").select(*DOC, "pos", "size", "key", "name", "n"), texts, least)
    discard(pieces)
    spans = materialize(passages(paragraphs.unionByName(windows), least), "paragraph-cuts")
    discard(paragraphs, windows)
    collect_garbage(docs.sparkSession)
    joined = named.join(small_or_shuffled(spans, F.size("spans")), list(DOC), "left").select("doc_id", *carried, "text", "spans")
    width = 1 + len(carried)
    names = ["doc_id", *carried, "text", "n_removed", "n_spans", "spans"]

    def run(batches):
        for batch in batches:
            texts, cuts = batch.column(width).to_pylist(), [[(x["a"], x["b"]) for x in s or ()] for s in batch.column(width + 1).to_pylist()]
            kept = [without(t, c) if c else t for t, c in zip(texts, cuts, strict=True)]
            removed = [len(t) - len(k) if c else 0 for t, k, c in zip(texts, kept, cuts, strict=True)]
            told = pa.array([[{"a": a, "b": b} for a, b in c] for c in cuts], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
            columns = [pa.array(kept, pa.string()), pa.array(removed, pa.int64()), pa.array([len(c) for c in cuts], pa.int64()), told]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(width)), *columns], names=names)

    types = {f.name: f.dataType.simpleString() for f in joined.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in names[: width + 1]) + ", n_removed long, n_spans long, spans array<struct<a:int,b:int>>"
    out = arrow_map(joined, run, schema)
    return out.select("doc_id", *[F.col(name).alias(c) for c, name in zip(keep, carried, strict=True)], "text", "n_removed", "n_spans", "spans")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_removed (characters cut; 0 exactly where nothing was), n_spans, text (what remains)."""
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_removed", "n_spans", "text")


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
SQL: dict[str, str] = {}
