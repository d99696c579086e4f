r"""Windows of words that repeat, wherever they stand in lines.

A text is one stream of words; line ends are blanks like others. A window is `least` consecutive words. Each window
has an anchor, the least hash of its runs of `ANCHOR` words, so equal windows have equal anchors. Windows in a row with one
anchor are a segment; only segments whose anchor stands in several places take part. Equal segments are counted by
hash, and windows only where the segments of an anchor differ. Of equal windows the first stays, by document id
and place; the words of the others are told, which amounts to maximal runs. Where a window overlaps its own first
occurrence, only what lies behind that is told. Nothing is compared pair by pair, so a run that many texts share costs
a row per copy.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, discard, materialize, sliced
from palimpsest.llm.similarity import small_or_shuffled, spread, word_hashes

#: Words of an anchor.
ANCHOR = 18
#: Characters of scripts that put no blanks between words: each counts as a word.
UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
HAS_UNSPACED = re.compile(f"[{UNSPACED}]")
TOKENS = re.compile(f"[{UNSPACED}]|[^{UNSPACED}\\x09-\\x0d\\x20]+")
ODD = np.uint64(0x9E3779B97F4A7C15)
DOC = ("unnamed", "doc", "row_hash")


def words_of(text: str) -> list[bytes]:
    """Lower-cased (ASCII) words between ASCII white space; characters of scripts without blanks one by one."""
    if text.isascii() or not HAS_UNSPACED.search(text):
        return text.encode().lower().split()
    return [w.encode().lower() for w in TOKENS.findall(text)]


def joined(a: np.ndarray, step: int) -> np.ndarray:
    """Hashes of the runs that start as one of `a` and end as the one `step` later."""
    return spread((a[: len(a) - step] ^ ODD) * ODD + a[step:]) if len(a) > step else a[:0]


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words, by doubling."""
    size = 1
    while 2 * size <= width:
        hashes, size = joined(hashes, size), 2 * size
    return joined(hashes, width - size) if width > size else hashes


def sliding_least(a: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        a, size = np.minimum(a[: max(0, len(a) - size)], a[size:]), 2 * size
    return np.minimum(a[: max(0, len(a) - width + size)], a[width - size :])


def spaced(text: str | None) -> bytes:
    """The text with blanks about the characters of scripts without blanks."""
    raw = (text or "").encode()
    if len(raw) == len(text or "") or max(raw) < 0xE0 or not HAS_UNSPACED.search(text):
        return raw
    return HAS_UNSPACED.sub(lambda m: f" {m[0]} ", text).encode()


def streams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes of all texts in a row, the text of each word, and where each text starts."""
    flat, sizes = word_hashes([spaced(t) for t in texts])
    return flat, np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes


def anchored(flat: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `ANCHOR` words, and of each window its anchor."""
    runs = run_hashes(flat, min(ANCHOR, least))
    return runs, sliding_least(runs, least - min(ANCHOR, least) + 1)


def segments_of(flat: np.ndarray, of: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(text, pos, size, key, seg, n): of each text the runs of `size` windows with one anchor `key`, and the hash of
    their words; n is 2 where the anchor's words stand in several places of the text."""
    m = max(0, len(flat) - least + 1)
    where = np.flatnonzero(of[:m] == of[len(of) - m :])
    if not len(where):
        none = np.empty(0, np.int64)
        return none, none, none, none, none, none
    runs, anchors = anchored(flat, least)
    at, keys = of[where], anchors[where]
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (keys[1:] != keys[:-1]) | (where[1:] != where[:-1] + 1)))
    size = np.diff(np.append(new, len(where)))
    offset = (np.arange(len(where)) - np.repeat(new, size)).astype(np.uint64)
    segs = np.add.reduceat(spread(run_hashes(flat, least)[where] + offset * ODD), new)
    at, keys, begin = at[new], keys[new], where[new]
    named, counts = np.unique(runs + of[: len(runs)].astype(np.uint64) * ODD, return_counts=True)
    n = np.minimum(counts[np.searchsorted(named, keys + at.astype(np.uint64) * ODD)], 2)
    return at, begin - starts[at], size, keys.view(np.int64), segs.view(np.int64), n


def found_windows(docs: DataFrame, least: int) -> DataFrame:
    """(doc, pos, window): the windows of each text's `ranges` (pos, size)."""

    def run(batches):
        for batch in sliced(batches):
            flat, _, starts = streams(batch.column(3).to_pylist())
            hashes = run_hashes(flat, least)
            ranges = batch.column(4)
            of = np.repeat(np.arange(len(batch)), ranges.value_lengths().to_numpy())
            first, size = (x.to_numpy() for x in ranges.flatten().flatten())
            if not len(of):
                continue
            at = np.repeat(of, size)
            pos = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
            own = [batch.column(k).take(pa.array(at)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(pos.astype(np.int32)), pa.array(hashes[starts[at] + pos].view(np.int64))], names=[*DOC, "pos", "window"])

    return arrow_map(docs.select(*DOC, "text", "ranges"), run, "unnamed boolean, doc long, row_hash long, pos int, window long")


def repeats(found: DataFrame, name: list[str], words: Column, least: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc, pos) with equal columns `name`: where it stands first and how often; and of all later ones the words to cut."""
    place = F.struct(*DOC, "pos")
    first = materialize(found.groupBy(*name).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"), "run-firsts")
    later = found.join(small_or_shuffled(first), name).where(place != F.col("first"))
    same = (F.col("first.unnamed") == F.col("unnamed")) & (F.col("first.doc") == F.col("doc")) & (F.col("first.row_hash") == F.col("row_hash"))
    start = F.when(same, F.greatest("pos", F.col("first.pos") + least)).otherwise(F.col("pos"))
    spans = later.select(*DOC, F.struct(start.cast("int").alias("a"), (F.col("pos") + words).cast("int").alias("b")).alias("span"))
    return first, spans.where("span.a < span.b")


def merged(of: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (of a text, from, to) joined where they overlap or touch; those under `least` words fall out."""
    if not len(of):
        return of, a, b
    order = np.lexsort((a, of))
    wide = int(b.max()) + 2
    of = of[order]
    begin, end = a[order] + of * wide, np.maximum.accumulate(b[order] + of * wide)
    first = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
    last = np.append(first[1:], len(of)) - 1
    of, begin, end = of[first], begin[first] - of[first] * wide, end[last] - of[first] * wide
    long = end - begin >= least
    return of[long], begin[long], end[long]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of merged spans (from, to); a line end beside a span stays."""
    places = [m.span() for m in TOKENS.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        before, start = (places[a - 1][1] if a else 0), places[a][0]
        end, after = places[b - 1][1], (places[b][0] if b < len(places) else len(text))
        lone = a and "\n" not in text[before:start] and "\n" in text[end:after]
        out.append(text[at : before if lone else start])
        at = end if lone else after
    return "".join(out) + text[at:]


def repeated_windows(segments: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """(doc, span) of the windows that stand earlier too; segments: as of segments_of, with their documents."""
    shared = segments.groupBy("key").agg(F.count(F.lit(1)).alias("held"), ((F.min("name") < F.max("name")) | (F.max("n") > 1)).alias("open")).where("held > 1 OR open").drop("held")
    near = materialize(segments.join(shared, "key").drop("n"), "run-shared")
    first, spans = repeats(near, ["key", "name"], F.col("size") + least - 1, least)
    spans = materialize(spans, "run-spans")
    # equal segments have equal windows, the first one's the first; only where an anchor's words have different surroundings windows meet one by one
    single = near.where("open").join(small_or_shuffled(first), ["key", "name"], "left").where(F.col("first").isNull() | (F.struct(*DOC, "pos") == F.col("first")))
    ranges = materialize(single.groupBy(*DOC).agg(F.collect_set(F.struct("pos", "size")).alias("ranges")), "run-ranges")
    discard(near, first)
    windows = materialize(found_windows(docs.join(small_or_shuffled(ranges, F.size("ranges")), list(DOC)), least), "run-windows")
    first, more = repeats(windows, ["window"], F.lit(least), least)
    out = materialize(spans.unionByName(more), "run-cuts")
    discard(spans, ranges, windows, first)
    return out
