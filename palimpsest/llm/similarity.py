"""From postings of text classes to components of similar classes, without listing the pairs of a group.

A posting says that a class holds a key (a rare n-gram, a MinHash band). Classes that share a key may be similar.
First every class is checked against one leader of each of its keys, the most central class there, and what is similar
is joined into components. Only keys whose classes are then still in different components need more: a second leader,
and where no link may be lost, all pairs from different components that their counts of shared keys leave. So a group
of near copies costs one check per copy. Where many classes just below the threshold share a key, sketches of their
sets are compared inside that join, so that a pair becomes a row only if it can be similar. Joins on keys and leaders are
ordinary equi-joins, which adaptive execution splits where a key is hot.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, collect_garbage, connected_components, discard, materialize

#: Items (rows, or elements of their arrays) of a frame that a join may broadcast, after they were counted.
BROADCAST_ITEMS = 1_000_000
#: Members that one task checks against a leader; bytes of rows that it holds at once, about; 4 blocks of columns.
BLOCK, BLOCK_BYTES, COLUMN_BITS = 512, 4 << 20, 2
#: Classes of a key beyond which their pairs are compared by sketches first; bits of a sketch, a multiple of 64.
CROWD, SKETCH_BITS = 64, 256


#: Bytes hashed at once, about; the odd factor of the words' polynomials.
CHUNK, FACTOR = 1 << 16, np.uint64(0x9E3779B97F4A7C15)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _values() -> np.ndarray:
    """A number of each byte, the same for A-Z and a-z; 0 for ASCII white space."""
    out = spread(np.arange(1, 257, dtype=np.uint64) * FACTOR)
    out[65:91] = out[97:123]
    out[SPACE] = 0
    return out


VALUES = _values()
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The factor's first powers, and their inverses modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((int(FACTOR), pow(int(FACTOR), -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of all texts, one after another, and the number of words of each.

    Words stand between ASCII white space; A-Z count as a-z. A word's hash is a polynomial of its bytes' numbers,
    taken from differences of running sums, so no word becomes an object of its own.
    """
    data = np.frombuffer(b"\n" + b"\n".join(raws) + b"\n", np.uint8)
    space = SPACE[data]
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        a = int(starts[k])
        n = max(k + 1, int(np.searchsorted(ends, a + CHUNK, "right")))
        b = int(ends[n - 1])
        up, down = powers(max(CHUNK, b - a) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(VALUES[data[a:b]] * up[: b - a])])
        s, e = starts[k:n] - a, ends[k:n] - a
        out[k:n] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        k = n
    borders = np.cumsum([0] + [len(r) + 1 for r in raws])
    return spread(out), np.diff(np.searchsorted(starts, borders + 1))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words; of all words, if they are fewer."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    acc = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        acc = spread(acc ^ hashes[k : n - width + 1 + k]) + np.uint64(0x9E3779B97F4A7C15)
    return acc


def sets_of(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    flat, sizes = word_hashes([(t or "").encode() for t in texts])
    runs = shingles(flat, width) if len(flat) >= width else flat[:0]
    out, at = [], 0
    for n in sizes.tolist():
        own = np.sort(runs[at : at + n - width + 1]) if n >= width else shingles(flat[at : at + n], width)
        out.append(own[np.append(True, own[1:] != own[:-1])] if len(own) else own)
        at += n
    return out


def class_of(distinct: np.ndarray, seed: int = 0) -> int:
    """A signed 64-bit name of a set of hashes, given sorted."""
    return xxhash.xxh3_64_intdigest(distinct.tobytes(), seed) - (1 << 63)


def needed(size, percent: int):
    """The least overlap with a set at all that is similar to one of this size."""
    return -(-percent * size // 100)


def sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def small_or_shuffled(df: DataFrame, items: Column | None = None) -> DataFrame:
    """For a join with texts: broadcast where a sum over the frame's rows (of their items, else of 1) shows it small."""
    total = df.agg(F.sum(F.lit(1) if items is None else items)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_ITEMS else df


def offered(size: int, percent: int) -> int:
    """How many of its first keys a set must offer: one more than it can lack."""
    return size - needed(size, percent) + 1


def packed(n, pos):
    """A set's size and a key's place in it as one number, which halves what a posting adds to a shuffle."""
    return n * (1 << 32) + pos


def pairs_fit(percent: int) -> Column:
    """Of keys at pos in a set of n and at `at` in a set of m: whether they can be the first that similar sets share."""
    need = F.ceil(percent * (F.col("n") + F.col("m")) / (100 + percent))
    return sizes_fit(F.col("n"), F.col("m"), percent) & (F.col("pos") <= F.col("n") - need) & (F.col("at") <= F.col("m") - need)


def sketches_near(percent: int) -> Column:
    """Whether sets of n and m, with sketches s0, s1, ... and t0, t1, ..., can be similar: sketches differ in no more bits than sets in hashes."""
    differ = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"t{k}"))) for k in range(SKETCH_BITS // 64)), F.lit(0))
    return differ <= F.col("n") + F.col("m") - 2 * F.ceil(percent * (F.col("n") + F.col("m")) / (100 + percent))


def link_classes(postings: DataFrame, verify: Callable[[DataFrame], DataFrame], percent: int | None, rounds: int = 2, exhaustive: bool = True, known: DataFrame | None = None, sketch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) of the classes that are similar to another; postings: key, cid, place (see packed).

    verify: from pairs (a, b) to those that are similar. percent: two classes can only be similar if their sizes n
    allow it and if they share a key that stands, by its place pos, among those that either can lack for the overlap
    that both sizes call for, and one; the keys that a pair shares are counted, and it is dropped if they and all that
    stands behind the last of them cannot reach that overlap. Without percent, sharing a key is enough. exhaustive:
    after the rounds of leaders, all pairs of what they leave apart are checked. known: components, as returned, that
    other postings gave; only classes that they leave apart are checked. sketch: from classes (cid) to their sketches;
    with it and percent, pairs of a key that more than `CROWD` classes left apart share must also have near sketches.
    """

    def apart(near: DataFrame, some: DataFrame) -> DataFrame:
        """Rows of keys whose classes are in several components."""
        placed = some.drop("component").join(near, F.col("cid") == F.col("node"), "left").drop("node").withColumn("component", F.coalesce("component", "cid"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        return materialize(placed.join(mixed, "key"), "link-rest")

    both = postings.groupBy("key").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low < high").select("key")
    shared = postings.join(both, "key").distinct()
    shared = materialize(shared.select("key", "cid", F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND((1 << 32) - 1).alias("pos")), "link-shared")
    open_ = shared if known is None else apart(known, shared)
    # the more of its keys a class shares, the more central it is
    central = open_.groupBy("cid").agg(F.count(F.lit(1)).alias("weight"))
    rows = materialize(open_.join(central, "cid"), "link-rows")
    placed = [] if known is None else ["component"]

    def summed(pairs: DataFrame) -> DataFrame:
        """Pairs (cid with n and pos, other with m and at), a row for each key that they share: the pairs that remain."""
        if not percent:
            return pairs.select(F.least("other", "cid").alias("a"), F.greatest("other", "cid").alias("b")).distinct()
        flip = F.col("other") > F.col("cid")
        some = pairs.where(pairs_fit(percent)).select(F.least("other", "cid").alias("a"), F.greatest("other", "cid").alias("b"), F.when(flip, F.col("n")).otherwise(F.col("m")).alias("n"), F.when(flip, F.col("pos")).otherwise(F.col("at")).alias("pos"), F.when(flip, F.col("m")).otherwise(F.col("n")).alias("m"), F.when(flip, F.col("at")).otherwise(F.col("pos")).alias("at"))
        per = some.groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap"), F.max("pos").alias("pos"), F.max("at").alias("at"), F.max("n").alias("n"), F.max("m").alias("m"))
        reach = F.col("overlap") + F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at")) - 1
        return per.where(reach >= F.ceil(percent * (F.col("n") + F.col("m")) / (100 + percent))).select("a", "b")

    def star(some: DataFrame, lead: DataFrame) -> DataFrame:
        return summed(some.join(lead, "key").where("component <> component2" if placed else "other <> cid"))

    def leaders(some: DataFrame) -> DataFrame:
        best = some.groupBy("key").agg(F.max(F.struct("weight", "cid", "n", "pos", *placed)).alias("c"))
        return best.select("key", F.col("c.cid").alias("other"), F.col("c.n").alias("m"), F.col("c.pos").alias("at"), *[F.col(f"c.{c}").alias(f"{c}2") for c in placed])

    def across(some: DataFrame, words: int = 0) -> DataFrame:
        """Pairs from different components, a row for each key that they share; words: numbers of their sketches."""
        left = some.select("key", "cid", "n", "pos", "component", *[f"s{k}" for k in range(words)])
        right = some.select("key", F.col("cid").alias("other"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("component").alias("component2"), *[F.col(f"s{k}").alias(f"t{k}") for k in range(words)])
        return left.join(right, "key").where("component < component2")

    rest, tested, spent = rows, None, [shared, open_, rows]
    edges = None if known is None else known.select(F.col("node").alias("a"), F.col("component").alias("b"))
    for k in range(rounds):
        lead = leaders(rest)
        if k:  # the most central class outside the component of the most central one
            chief = rest.join(lead.select("key", F.col("other").alias("chief")), "key")
            own = chief.where("cid = chief").select("key", F.col("component").alias("chiefs"))
            lead = leaders(rest.join(own, "key").where("component <> chiefs"))
        pairs = star(rest, lead)
        pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti") if k else pairs, "link-star")
        tested = tested.unionByName(pairs) if k else pairs
        found = verify(pairs)
        edges = materialize(found if edges is None else edges.unionByName(found), "link-edges")
        near = materialize(connected_components(edges), "link-components")
        collect_garbage(edges.sparkSession)
        spent += [pairs, edges]
        if exhaustive or k + 1 < rounds:
            rest = apart(near, rest)
            spent.append(rest)
    if exhaustive:
        pairs = across(rest)
        if sketch and percent:
            crowded = rest.groupBy("key").agg(F.count(F.lit(1)).alias("classes")).where(F.col("classes") > CROWD).select("key")
            crowd = materialize(rest.join(crowded, "key"), "link-crowd")
            if not crowd.isEmpty():
                drawn = materialize(crowd.join(sketch(crowd.select("cid").distinct()), "cid"), "link-sketches")
                # a pair that is dropped here and met under another key is not similar, so its count of keys does not matter
                pairs = across(rest.join(crowded, "key", "left_anti")).unionByName(across(drawn, SKETCH_BITS // 64).where(pairs_fit(percent)).where(sketches_near(percent)).select(pairs.columns))
                spent.append(drawn)
            spent.append(crowd)
        cross = materialize(summed(pairs).join(tested, ["a", "b"], "left_anti"), "link-cross")
        more = materialize(verify(cross), "link-edges")
        if not more.isEmpty():
            near = materialize(connected_components(edges.unionByName(more)), "link-components")
        spent += [cross, more]
    discard(*spent)
    return near


def overlaps(leaders: list[np.ndarray], members: list[np.ndarray], to: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of a block are similar to the leader that `to` names: a product of sparse rows, by blocks of columns.

    Overlap counts add up block by block; a row falls out once what it has and what its or the leader's later columns
    can add at most is below the bound of both sizes.
    """
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (members, leaders))
    need = -(-percent * (n + m[to]) // (100 + percent))
    salts = spread(np.arange(1, len(leaders) + 1, dtype=np.uint64) * FACTOR)  # one table for all leaders' columns
    rows = [(np.concatenate(x), np.repeat(np.arange(len(x)), k)) for x, k in ((members, n), (leaders, m))]
    cells = [(flat >> np.uint64(64 - COLUMN_BITS)).astype(np.int8) for flat, _ in rows]
    (flat, of), (columns, lead) = rows
    flat, columns = flat ^ salts[to][of], columns ^ salts[lead]
    counts, later, ahead = np.zeros(len(n), np.int64), n.copy(), m.copy()
    alive = np.minimum(n, m[to]) >= need
    for k in range(1 << COLUMN_BITS):
        here, own = (cells[0] == k) & alive[of], np.sort(columns[cells[1] == k])
        who = of[here]
        if len(own):
            wanted = flat[here]
            counts += np.bincount(who[own[np.minimum(np.searchsorted(own, wanted), len(own) - 1)] == wanted], minlength=len(n))
        later -= np.bincount(who, minlength=len(n))
        ahead -= np.bincount(lead[cells[1] == k], minlength=len(m))
        alive &= counts + np.minimum(later, ahead[to]) >= need
    return alive & (100 * counts >= percent * (n + m[to] - counts))


def sketches(classes: DataFrame, homes: DataFrame, make: Callable) -> DataFrame:
    """(cid, s0, s1, ...): of each of `SKETCH_BITS` remainders, whether an odd number of a class's hashes has it; homes, make: as for verify_sets."""
    goal = F.array(F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).alias("salt"), F.lit(0).alias("role")))
    sets = make(classes.select("cid", goal.alias("goals")).join(homes, "cid"))
    names = [f"s{k}" for k in range(SKETCH_BITS // 64)]

    def run(batches):
        for batch in batches:
            odd = np.zeros((len(batch), SKETCH_BITS), np.int64)
            for row, raw in zip(odd, batch.column(1).to_pylist(), strict=True):
                row += np.bincount((np.frombuffer(raw, np.uint64) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
            words = np.packbits(odd, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(w) for w in np.ascontiguousarray(words.T))], names=["cid", *names])

    # dealt out first: a task with two Python functions in a row holds two workers, and idle ones stay in an executor's memory
    return arrow_map(sets.select("cid", "hashes").repartition("cid"), run, ", ".join(f"{c} long" for c in ("cid", *names)))


def verify_sets(pairs: DataFrame, homes: DataFrame, make: Callable, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose sets of hashes have a Jaccard similarity of percent / 100.

    homes: (cid, *key) rows naming where a class's set can be made again; make(keys with the blocks of a class) gives
    (cid, block, role, set as bytes). Sets travel once per block of `BLOCK` members of a leader, so a hot leader is
    spread over tasks.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK)).cast("int")
    size = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("members"))
    salted = pairs.join(size, "a").select("a", "b", F.pmod(F.xxhash64("b"), blocks).cast("int").alias("salt"))
    leaders = size.select(F.col("a").alias("cid"), F.col("a").alias("to"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("salt"), F.lit(0).alias("role"))
    members = salted.select(F.col("b").alias("cid"), F.col("a").alias("to"), "salt", F.lit(1).alias("role"))
    tasks = leaders.unionByName(members).groupBy("cid").agg(F.collect_list(F.struct("to", "salt", "role")).alias("goals"))
    sets = make(tasks.join(homes, "cid"))  # cid, to, salt, role, hashes
    dealt = sets.repartition("to", "salt").sortWithinPartitions("to", "salt", "role")

    def run(batches):
        at, leaders, tos, names, rows, to, held = None, [], [], [], [], [], 0

        def judged():
            good = overlaps(leaders, rows, np.array(to, np.int64), percent) if rows else np.empty(0, bool)
            return pa.RecordBatch.from_arrays([pa.array(np.array(tos, np.int64)[np.array(to, np.int64)][good]), pa.array(np.array(names, np.int64)[good])], names=["a", "b"])

        for batch in batches:
            for cid, goal, salt, role, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and held > BLOCK_BYTES:
                    yield judged()
                    leaders, tos, names, rows, to, held = leaders[-1:], tos[-1:], [], [], [], 0
                own = np.frombuffer(raw, np.uint64)
                held += len(raw)
                if role == 0:
                    at = (goal, salt)
                    leaders.append(own)
                    tos.append(goal)
                elif at == (goal, salt):
                    names.append(cid)
                    rows.append(own)
                    to.append(len(leaders) - 1)
        yield judged()

    return arrow_map(dealt, run, "a long, b long")
