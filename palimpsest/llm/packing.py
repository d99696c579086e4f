"""Best-fit packing of documents into fixed-length sequences, after Martello-Toth dominance reduction.

Only the number of pieces of each length matters to a packing, so the driver plans over that histogram (at most
`capacity` entries, whatever the input) and keeps sequences as patterns with multiplicities. A piece finds its
place from its rank among the pieces of its length: its rank inside its partition plus the counts of the partitions
before. No task and no driver ever holds a group of pieces.

Null and empty texts are the end id alone. Rows that repeat, and null ids, are documents of their own. An empty
table gives an empty result. Extra columns of the input are not read.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, materialize, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Words whose ids a worker remembers, in up to 150 MB about; beyond it starts anew.
REMEMBERED = 800_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


#: Letters, then printable ASCII signs: the splitter parts them there. Apostrophes and `<` may begin other units.
PLAIN = re.compile(r"([^\W\d_]*)([!-&(-/:;=-@\[-`{-~]*)")
SIGNS = "".join(c for c in map(chr, range(128)) if PLAIN.fullmatch(c) and not c.isalpha())
PACKED = [struct.Struct(f"<{n}I").pack for n in range(16)]


def bytes_of(ids: list[int]) -> bytes:
    return PACKED[len(ids)](*ids) if len(ids) < len(PACKED) else struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """Ids of each blank-free stretch of a text, as little-endian unsigned 32-bit bytes.

    The tokenizer's normalizer and splitter never look across white space, so a text's ids are those of its
    stretches. Latin letters and the signs after them go straight to the merges, and are known as stretches too.
    ASCII texts are put in lower case first, as the normalizer does, so a word is known whatever its case.
    Beyond REMEMBERED / 2 stretches a new generation begins; the one before is kept, so frequent words stay known.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.older: dict[str, bytes] = {"": b""}

    def encoded(self, stretch: str) -> bytes:
        return bytes_of(self.tokenizer.encode(stretch, add_special_tokens=False).ids)

    def merged(self, core: str) -> bytes:
        spelled = core if core.isascii() else "".join(map(self.letters.__getitem__, core.encode()))
        return bytes_of([t.id for t in self.model.tokenize(spelled)])

    def parted(self, stretch: str, letters: str, signs: str) -> bytes:
        """Ids of letters in lower case, then signs; each is a stretch of its own unless it is the whole one."""
        if stretch == letters or stretch == signs:
            return self.merged(stretch)
        return (self[letters] if letters else b"") + (self[signs] if signs else b"")

    def __missing__(self, stretch: str) -> bytes:
        ids = self.older.get(stretch)
        if ids is None and stretch.isascii():
            core = stretch.rstrip(SIGNS)
            if core and not core.isalpha():
                ids = self.encoded(stretch)
            else:
                ids = self.parted(stretch, core.lower(), stretch[len(core) :])
        elif ids is None:
            found = PLAIN.fullmatch(stretch)
            if found and (not found[1] or max(found[1]) < "ɐ" and found[1].isalpha() and (low := found[1].lower()).isalpha()):
                ids = self.parted(stretch, low if found[1] else "", found[2])
            else:
                ids = self.encoded(stretch)
        self[stretch] = ids
        return ids

    def text_ids(self, text: str | None) -> bytes:
        if len(self) > REMEMBERED // 2:
            self.older = {"": b""} | self
            self.clear()
        text = text or ""
        if text.isascii():  # elsewhere marks that follow a letter ask for its case
            text = text.lower()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(1)
def word_ids(tokenizer_path: str) -> WordIds:
    """A worker's words: known ones stay known from one task of a worker to its next."""
    return WordIds(tokenizer_path)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, keep_ids: bool, id_col: str, text_col: str) -> DataFrame:
    schema = PIECES + (", ids array<int>" if keep_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words, part, seen = word_ids(tokenizer_path), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            out: list[list] = [[] for _ in range(8 if keep_ids else 7)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = words.text_ids(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    n = len(piece) // 4
                    values = [doc, k, at // 4, n, zlib.crc32(piece), part, seen[n]]
                    for column, value in zip(out, values, strict=False):
                        column.append(value)
                    if keep_ids:
                        out[7].append(np.frombuffer(piece, "<u4").astype(np.int32))
                    seen[n] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names=names[: len(out)])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sequences that some best packing surely has, as (lengths, how often), and the pieces left.

    For the longest piece: alone if nothing fits beside it; with its exact complement; with the longest that fits
    if no two others fit, or if no three fit and no two together are longer than that one.
    """
    left, fixed = dict(counts), []
    sizes = sorted(left)

    def drop(size: int, n: int) -> None:
        left[size] -= n
        if not left[size]:
            del left[size]
            sizes.pop(bisect.bisect_left(sizes, size))

    def smallest(k: int, without: int) -> list[int]:
        out: list[int] = []
        for size in sizes:
            out += [size] * min(k - len(out), left[size] - (size == without))
            if len(out) >= k:
                break
        return out

    def best_pair(room: int, without: int) -> int:
        have = lambda s: left[s] - (s == without)
        low, high, best = 0, bisect.bisect_right(sizes, room) - 1, 0
        while low <= high:
            a, b = sizes[low], sizes[high]
            if a + b > room or have(b) < 1:
                high -= 1
            else:
                if have(a) > (a == b):
                    best = max(best, a + b)
                low += 1
        return best

    for size in sorted(left, reverse=True):
        while left.get(size):
            room, few = capacity - size, smallest(3, size)
            if not few or few[0] > room:
                fixed.append(((size,), left[size]))
                drop(size, left[size])
                continue
            at = bisect.bisect_right(sizes, room) - 1
            if sizes[at] == size and left[size] < 2:
                at -= 1
            mate = sizes[at]
            sure = mate == room or len(few) < 2 or few[0] + few[1] > room
            if not sure and (len(few) < 3 or sum(few) > room):
                sure = mate >= best_pair(room, size)
                times = 1
            else:
                times = left[size] // 2 if mate == size else min(left[size], left[mate])
            if not sure:
                break
            fixed.append(((size, mate), times))
            drop(size, times)
            drop(mate, times)
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: each piece goes where the least room stays."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            bisect.insort(rooms, room)
        open_bins[room].append((pattern, times))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            else:
                room, pattern, times = capacity, (), n
            each = min(room // size, n)
            full = min(times, n // each)
            put(room - each * size, pattern + (size,) * each, full)
            if times > full and pattern:
                put(room, pattern, times - full)
            n -= full * each
    return [x for room in rooms for x in open_bins[room]]


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Runs of ranks of each length and the sequences they go to."""
    fixed, left = reduce_by_dominance({k: v for k, v in counts.items() if v}, capacity)
    used, runs, sequence = defaultdict(int), [], 0
    for pattern, times in fixed + best_fit(left, capacity):
        place = 0
        for size in dict.fromkeys(pattern):
            each = pattern.count(size)
            runs.append((size, used[size], each, sequence, place))
            used[size] += each * times
            place += each * size
        sequence += times
    runs.sort()
    return {k: np.array([r[i] for r in runs], np.int64) for i, k in enumerate(("length", "base", "each", "sequence", "place"))}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, id_col="doc_id", text_col="text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with keep_ids also the ids."""
    pieces = materialize(tokenized_pieces(docs, tokenizer_path, capacity, end_id, keep_ids, id_col, text_col), "pack-pieces")
    local = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    counts = {r["length"]: r["n"] for r in local.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = plan(counts, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = local.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", *["ids"] * keep_ids)
    wide = 1 << 40

    def place(batches):
        keys = runs["length"] * wide + runs["base"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            nth = rank - runs["base"][at]
            sequence = runs["sequence"][at] + nth // runs["each"][at]
            offset = runs["place"][at] + nth % runs["each"][at] * length
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(offset), *batch.columns[6:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids])

    return arrow_map(ranked, place, PLACED + (", ids array<int>" if keep_ids else ""))


def op3_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op3_pack_best_fit": op3_pack_best_fit}
SQL: dict[str, str] = {}
