"""External suffix sorting by induction with disk-backed priority queues.

A suffix is larger (L) or smaller (S) than the next one. Sorted S suffixes that follow an L suffix (seeds) induce the
order of all L suffixes in one ascending pass, and those that of all S suffixes in one descending pass: whoever is
taken from the queue pushes the suffix before it, as a tuple of first character, position and the place of its source.
Seeds are sorted by naming the stretches between them and sorting the shorter text of names in the same way, down to
`base` names, which are sorted in memory. On the text itself tuples also carry common-prefix values: those of two
neighbours with equal first characters are one more than the least value between their sources. Values are kept up to
a cap; those of the seeds are told by comparing them, eight bytes at a time, which the cap bounds.

Memory holds `held` tuples or places at a time. The queues write sorted runs beyond that, a bucket is read in blocks,
and the text, its names, orders and values are mapped files worked on in blocks, so a text can be far larger than
memory. Of names, a bucket and what is due soon after are in memory together.
"""

from __future__ import annotations

import os
import tempfile
from itertools import chain

import numpy as np

#: Tuples or places held in memory; names that are sorted in memory.
HELD, BASE = 1 << 16, 1 << 17


def mapped(path: str, kind, mode: str = "r", shape=None) -> np.ndarray:
    return np.memmap(path, kind, mode, shape=shape).view(np.ndarray)


class DiskQueue:
    """A priority queue of (character, position, source): tuples of a character leave in order of entry."""

    def __init__(self, folder: str, held: int = HELD, kind=np.int64):
        self.folder, self.limit, self.kind, self.n, self.runs, self.spills = folder, held, kind, 0, [], 0
        self.buckets: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def push(self, chars: np.ndarray, pos: np.ndarray, src: np.ndarray) -> None:
        if not len(chars):
            return
        order = np.argsort(chars, kind="stable")
        chars, pos, src = chars[order], pos[order], src[order]
        cuts = np.concatenate([[0], np.flatnonzero(chars[1:] != chars[:-1]) + 1, [len(chars)]]).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            self.buckets.setdefault(int(chars[a]), []).append((pos[a:b], src[a:b]))
        self.n += len(chars)
        if self.n > self.limit:
            self.spill()

    def spill(self) -> None:
        keys = sorted(self.buckets)
        parts = [[np.concatenate([x[k] for x in self.buckets[c]]) for c in keys] for k in (0, 1)]
        ends = np.cumsum([len(p) for p in parts[0]]).tolist()
        handle, path = tempfile.mkstemp(dir=self.folder)
        with os.fdopen(handle, "wb") as f:
            for p in parts[0] + parts[1]:
                p.astype(self.kind).tofile(f)
        self.runs.append((mapped(path, self.kind).reshape(2, -1), {c: (e - len(p), e) for c, p, e in zip(keys, parts[0], ends, strict=True)}))
        os.unlink(path)  # the mapping keeps it until it is dropped
        self.buckets, self.n, self.spills = {}, 0, self.spills + 1

    def pop(self, char: int):
        """Blocks of (positions, sources) of a character; what it pushes into itself meanwhile is left for the next call."""
        runs = [(run, at) for run, index in self.runs if (at := index.pop(char, None))]
        self.runs = [r for r in self.runs if r[1]]
        own = self.buckets.pop(char, [])
        self.n -= sum(len(p) for p, _ in own)
        some, n = [], 0  # small parts, up to a block of them
        for pos, src in chain((run[:, k : min(b, k + self.limit)] for run, (a, b) in runs for k in range(a, b, self.limit)), own):
            some.append((pos, src))
            n += len(pos)
            if n >= self.limit:
                yield np.concatenate([x for x, _ in some]), np.concatenate([x for _, x in some])
                some, n = [], 0
        if some:
            yield np.concatenate([x for x, _ in some]), np.concatenate([x for _, x in some])

class RangeQueue:
    """A priority queue of (key, position) from which all up to a key leave at once, by key and order of entry."""

    def __init__(self, folder: str, held: int = HELD):
        self.folder, self.limit, self.runs, self.spills = folder, held, [], 0
        self.keys, self.pos = np.empty(0, np.int64), np.empty(0, np.int64)

    def push(self, keys: np.ndarray, pos: np.ndarray) -> None:
        self.keys, self.pos = np.concatenate([self.keys, keys]), np.concatenate([self.pos, pos])
        if len(self.keys) > self.limit:
            order = np.argsort(self.keys, kind="stable")
            handle, path = tempfile.mkstemp(dir=self.folder)
            with os.fdopen(handle, "wb") as f:
                self.keys[order].tofile(f)
                self.pos[order].tofile(f)
            self.runs.append([mapped(path, np.int64).reshape(2, -1), 0])
            os.unlink(path)
            self.keys, self.pos, self.spills = np.empty(0, np.int64), np.empty(0, np.int64), self.spills + 1

    def least(self) -> int | None:
        heads = [int(run[0, at]) for run, at in self.runs] + ([int(self.keys.min())] if len(self.keys) else [])
        return min(heads, default=None)

    def take(self, upto: int) -> tuple[np.ndarray, np.ndarray]:
        keys, pos = [], []
        for r in self.runs:
            run, at = r
            end = at + int(np.searchsorted(run[0, at:], upto, "right"))
            keys.append(np.array(run[0, at:end]))
            pos.append(np.array(run[1, at:end]))
            r[1] = end
        self.runs = [r for r in self.runs if r[1] < r[0].shape[1]]
        due = self.keys <= upto
        keys, pos = np.concatenate([*keys, self.keys[due]]), np.concatenate([*pos, self.pos[due]])
        self.keys, self.pos = self.keys[~due], self.pos[~due]
        order = np.argsort(keys, kind="stable")
        return keys[order], pos[order]


def place_kind(n: int):
    """The type that places of a text of n characters take."""
    return np.int32 if n < 1 << 31 else np.int64


class Sorter:
    def __init__(self, folder: str, held: int = HELD, base: int = BASE):
        self.folder, self.held, self.base, self.spills, self.levels = folder, held, base, 0, 0

    def array(self, n: int, kind) -> np.ndarray:
        if n <= self.held:
            return np.zeros(n, kind)
        handle, path = tempfile.mkstemp(dir=self.folder)
        os.close(handle)
        out = mapped(path, kind, "w+", (n,))
        os.unlink(path)
        return out

    def blocks(self, n: int):
        return ((a, min(n, a + self.held)) for a in range(0, n, self.held))

    def joined(self, parts, total: int, kind=np.int64) -> np.ndarray:
        """Arrays one after another, `total` at most."""
        out, at = self.array(total, kind), 0
        for p in parts:
            out[at : at + len(p)] = p
            at += len(p)
        return out[:at]

    def shape(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is S, length of the run of equal characters from here, 65,535 at most)."""
        n = len(t)
        is_s, run = self.array(n, bool), self.array(n, np.uint16)
        after = None  # of the next block's first place: (character, is S, run)
        for a, b in list(self.blocks(n))[::-1]:
            own = np.asarray(t[a:b])
            ends = np.concatenate([np.flatnonzero(own[1:] != own[:-1]), [b - a - 1]])
            lengths = np.diff(np.concatenate([[-1], ends]))
            smaller = np.ones(len(ends), bool)
            smaller[:-1] = own[ends[:-1]] < own[ends[:-1] + 1]
            more = 0
            if after:
                more = after[2] if own[-1] == after[0] else 0
                smaller[-1] = after[1] if more else own[-1] < after[0]
            here = np.repeat(ends, lengths) - np.arange(b - a) + 1
            here[b - a - lengths[-1] :] += more
            is_s[a:b], run[a:b] = np.repeat(smaller, lengths), np.minimum(here, 65535)
            after = (own[0], bool(is_s[a]), int(min(here[0], 65535)))
        return is_s, run

    def seeds(self, is_s: np.ndarray) -> np.ndarray:
        n = len(is_s)
        count = sum(int((is_s[max(a, 1) : b] & ~is_s[max(a, 1) - 1 : b - 1]).sum()) for a, b in self.blocks(n))
        found = (np.flatnonzero(is_s[max(a, 1) : b] & ~is_s[max(a, 1) - 1 : b - 1]) + max(a, 1) for a, b in self.blocks(n))
        return self.joined(found, count, place_kind(n)) if count else np.array([n - 1])

    def induce(self, t, is_s, run, seeds, seed_lcp=None, cap=0):
        """Order of all suffixes, and common-prefix values with the one before, from the seeds'; these in order of first characters."""
        n, carry = len(t), seed_lcp is not None
        kind = np.uint8 if cap < 256 else np.uint16
        chars = np.unique(np.concatenate([np.unique(t[a:b]) for a, b in self.blocks(n)]))
        n_l = n - sum(int(is_s[a:b].sum()) for a, b in self.blocks(n))
        order, lcp = self.array(n_l + len(seeds), place_kind(n)), self.array(n_l + len(seeds) if carry else 0, kind)
        first = self.joined((t[seeds[a:b]] for a, b in self.blocks(len(seeds))), len(seeds), t.dtype)
        seed_at, seed_to = np.searchsorted(first, chars), np.searchsorted(first, chars, side="right")
        bounds: dict[int, tuple[int, int]] = {}

        def induced(values, src, begun, last):
            """Values of a bucket's next tuples: one more than the least value between two sources."""
            froms = np.concatenate([[last], src[:-1]]) + 1
            if not begun:
                froms[0] = src[0]
            out = np.minimum.reduceat(values[froms[0] : src[-1] + 1], froms - froms[0]).astype(np.int64) + 1
            if not begun:
                out[0] = 0
            return np.minimum(out, cap)

        def drained(queue, c, out, values, filled, wanted):
            """Takes all of a character, block by block, and what it pushes into itself."""
            last, some = -1, True
            while some:
                some = False
                for pos, src in queue.pop(c):
                    some = True
                    out[filled : filled + len(pos)] = pos
                    if carry:
                        values[filled : filled + len(pos)] = induced(values, src, last >= 0, last)
                    last = int(src[-1])
                    here = np.arange(filled, filled + len(pos))
                    filled += len(pos)
                    ok = pos > 0
                    before, here = pos[ok] - 1, here[ok]
                    ch = t[before]
                    good = ch >= c if wanted == "L" else ch <= c
                    queue.push(ch[good], before[good], here[good])
            return filled

        queue, filled = DiskQueue(self.folder, self.held, place_kind(n)), 0
        for k, c in enumerate(chars.tolist()):
            start = filled
            filled = drained(queue, c, order, lcp, filled, "L")
            bounds[c] = (start, filled)
            for a in range(seed_at[k], seed_to[k], self.held):
                own = np.array(seeds[a : min(seed_to[k], a + self.held)])
                order[filled : filled + len(own)] = own
                if carry:
                    lcp[filled : filled + len(own)] = seed_lcp[a : a + len(own)]
                    if a == seed_at[k]:
                        lcp[filled] = min(int(run[order[filled - 1]]), int(run[own[0]]), cap) if filled > start else 0
                here = np.arange(filled, filled + len(own))[own > 0]
                filled += len(own)
                before = own[own > 0] - 1
                queue.push(t[before], before, here)
        self.spills += queue.spills
        down, down_lcp = self.array(n, place_kind(n)), self.array(n if carry else 0, kind)
        queue, filled = DiskQueue(self.folder, self.held, place_kind(n)), 0
        for c in chars[::-1].tolist():
            start = filled
            if c != chars[0]:  # the end of the text, the least suffix, has no source
                filled = drained(queue, c, down, down_lcp, filled, "S")
            a, b = bounds[c]
            for e in range(b, a, -self.held):
                s = max(a, e - self.held)
                own = np.array(order[s:e])[::-1]
                down[filled : filled + len(own)] = own
                if carry:
                    down_lcp[filled + 1 : filled + len(own)] = np.array(lcp[s + 1 : e])[::-1]
                    if e == b:
                        down_lcp[filled] = min(int(run[down[filled - 1]]), int(run[own[0]]), cap) if filled > start else 0
                    else:
                        down_lcp[filled] = lcp[e]
                here = np.arange(filled, filled + len(own))
                filled += len(own)
                ok = own > 0
                before, here = own[ok] - 1, here[ok]
                ch = t[before]
                queue.push(ch[ch < c], before[ch < c], here[ch < c])
        self.spills += queue.spills
        down[filled] = n - 1
        if not carry:
            return down[::-1], None
        down_lcp[filled] = 0
        values = self.array(n, kind)
        for a, b in self.blocks(n - 1):
            values[a + 1 : b + 1] = down_lcp[n - b : n - a][::-1]
        return down[::-1], values

    def sweep(self, t, is_s, listed, smaller: bool, size: int) -> np.ndarray:
        """One pass of induction over a text of names: all suffixes of a kind from those listed, in order.

        Names are many and their buckets small, so buckets are taken together, as far as none pushes into another.
        """
        top = int(t[int(listed[0])]) if smaller else 0
        key_of = (lambda c: top - c) if smaller else (lambda c: c)
        out, filled, at, width = self.array(size, place_kind(len(t))), 0, 0, 256
        queue, never = RangeQueue(self.folder, self.held), np.iinfo(np.int64).max

        def target(pos):
            """The keys that positions push to."""
            before = np.maximum(pos - 1, 0)
            return np.where((pos > 0) & (is_s[before] == smaller), key_of(t[before].astype(np.int64)), never)

        keys = self.joined((key_of(t[listed[a:b]].astype(np.int64)) for a, b in self.blocks(len(listed))), len(listed))
        while at < len(listed) or queue.least() is not None:
            low = min(x for x in (queue.least(), int(keys[at]) if at < len(listed) else None) if x is not None)
            high = low + width
            m = int(np.searchsorted(keys, high, "right"))
            k, p = queue.take(high)
            # twice the key, and one more for what is listed, which comes behind what was pushed
            code, pos = np.concatenate([2 * k, 2 * keys[at:m] + 1]), np.concatenate([p, listed[at:m]])
            at, rounds = m, 0
            order = code.argsort(kind="stable")
            code, pos = code[order], pos[order]
            to = target(pos)
            while len(code):
                rounds += 1
                n = int(code.searchsorted(2 * min(int(to.min()), high + 1)))
                if not n:  # the first bucket pushes into itself: what it holds so far, then what that pushed, then what is listed
                    n = int(code.searchsorted(code[0], "right"))
                new = pos[:n][code[:n] & 1 == 0]
                out[filled : filled + len(new)] = new
                filled += len(new)
                due, before = to[:n], pos[:n] - 1
                near = due <= high
                far = (due > high) & (due < never)
                if far.any():
                    queue.push(due[far], before[far])
                code, pos, to = code[n:], pos[n:], to[n:]
                if near.any():
                    before = before[near]
                    code, pos, to = np.concatenate([code, 2 * due[near]]), np.concatenate([pos, before]), np.concatenate([to, target(before)])
                    order = code.argsort(kind="stable")
                    code, pos, to = code[order], pos[order], to[order]
            width = max(1, width // 2) if rounds > 8 else width * 2 if rounds < 4 and width < self.held else width
        self.spills += queue.spills
        return out[:filled]

    def swept(self, t, is_s, seeds) -> np.ndarray:
        """Order of all suffixes of a text of names, from the seeds' order."""
        n_s = sum(int(is_s[a:b].sum()) for a, b in self.blocks(len(t)))
        larger = self.sweep(t, is_s, seeds, False, len(t) - n_s)
        if not len(larger):
            return np.arange(len(t))[::-1] if len(t) == 1 else np.array([len(t) - 1])
        smaller = self.sweep(t, is_s, larger[::-1], True, n_s)
        # of a name, larger suffixes come before smaller ones; the end of the text is the least
        out, x, y, filled = self.array(len(t), place_kind(len(t))), 0, 0, 1
        out[0] = len(t) - 1
        ascending = smaller[::-1]
        while x < len(larger) or y < len(ascending):
            a, b = larger[x : x + self.held], ascending[y : y + self.held]
            ka, kb = t[a], t[b]
            if len(a) and len(b):  # all up to the lesser of the two blocks' last names, ties on the larger kind's side first
                edge = min(ka[-1], kb[-1])
                a, b = a[: np.searchsorted(ka, edge, "right")], b[: np.searchsorted(kb, edge, "right" if ka[-1] > edge or x + self.held >= len(larger) else "left")]
            names = np.concatenate([t[a], t[b]])
            both = np.concatenate([a, b])[np.argsort(names, kind="stable")]
            out[filled : filled + len(both)] = both
            filled, x, y = filled + len(both), x + len(a), y + len(b)
        return out

    @staticmethod
    def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray | int) -> np.ndarray:
        """Common prefixes of suffixes a and b, up to `most`; texts of bytes are compared eight at a time."""
        n, out = len(t), np.zeros(len(a), np.int64)
        most = np.broadcast_to(most, a.shape)
        a, b = a.astype(np.int64), b.astype(np.int64)
        rest = np.arange(len(a))
        if t.dtype == np.uint8 and n > 8:
            words = np.ndarray((n - 7,), "<u8", t, strides=(1,))
            safe = np.maximum(a, b) + most < n - 15
            live, rest, done = rest[safe], rest[~safe], 0
            x, y, least = a[live], b[live], most[live]
            while len(live):
                differ = words[x] ^ words[y]
                equal = differ == 0
                odd = differ[~equal]
                out[live[~equal]] = done + (np.frexp((odd & (~odd + np.uint64(1))).astype(float))[1] - 1 >> 3)
                done += 8
                out[live[equal]] = done
                equal &= least > done
                live, x, y, least = live[equal], x[equal] + 8, y[equal] + 8, least[equal]
        while len(rest):
            x, y = a[rest] + out[rest], b[rest] + out[rest]
            near = np.maximum(x, y) < n
            near[near] = t[x[near]] == t[y[near]]
            rest = rest[near]
            out[rest] += 1
            rest = rest[out[rest] < most[rest]]
        return np.minimum(out, most)

    @staticmethod
    def doubled(names: np.ndarray) -> np.ndarray:
        """Suffix array of a text of names in memory."""
        rank, width, n = names.astype(np.int64), 1, len(names)
        while True:
            ahead = np.full(n, 0, np.int64)
            ahead[: n - width] = rank[width:] + 1
            key = rank * (n + 2) + ahead
            order = np.argsort(key)
            sorted_ = key[order]
            new = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1 or width >= n:
                return order
            width *= 2

    def by_first(self, t, seeds) -> np.ndarray:
        """Seeds in order of their first characters."""
        if len(seeds) <= self.held:
            return seeds[np.argsort(t[seeds], kind="stable")]
        out = self.array(len(seeds), place_kind(len(t)))
        if t.dtype.itemsize < 4:  # few characters: each seed goes to its place by counts
            counts = sum(np.bincount(t[seeds[a:b]], minlength=1 << 8 * t.dtype.itemsize) for a, b in self.blocks(len(seeds)))
            start = np.cumsum(counts) - counts
            for a, b in self.blocks(len(seeds)):
                chars = t[seeds[a:b]]
                by = np.argsort(chars, kind="stable")
                some = np.bincount(chars, minlength=len(start))
                out[(start - np.cumsum(some) + some)[chars[by]] + np.arange(b - a)] = seeds[a:b][by]
                start += some
            return out
        queue, at = RangeQueue(self.folder, self.held), 0
        for a, b in self.blocks(len(seeds)):
            queue.push(t[seeds[a:b]].astype(np.int64), np.array(seeds[a:b]))
        while (low := queue.least()) is not None:
            some = queue.take(low + self.held // 2)[1]
            out[at : at + len(some)] = some
            at += len(some)
        self.spills += queue.spills
        return out

    def sort(self, t: np.ndarray, cap: int = 0, level: int = 0):
        """(suffix array, values up to `cap` or None); t's last character is its least and stands there only."""
        self.levels = max(self.levels, level)
        ordered = lambda seeds: self.swept(t, is_s, seeds) if level else self.induce(t, is_s, run, seeds)[0]
        is_s, run = self.shape(t)
        seeds = self.seeds(is_s)
        order, is_seed = ordered(self.by_first(t, seeds)), self.array(len(t), bool)
        for a, b in self.blocks(len(seeds)):
            is_seed[seeds[a:b]] = True
        by_stretch = self.joined((x[is_seed[x]] for a, b in self.blocks(len(t)) for x in [np.array(order[a:b])]), len(seeds), place_kind(len(t)))
        names, name = self.array(len(seeds), place_kind(len(t))), 0
        for s, e in self.blocks(len(seeds)):
            some = np.array(by_stretch[max(s - 1, 0) : e])
            at = np.searchsorted(seeds, some)
            length = np.where(at + 1 < len(seeds), seeds[np.minimum(at + 1, len(seeds) - 1)], len(t) - 1) - some + 1
            a, b = some[:-1], some[1:]
            same = length[:-1] == length[1:]
            same[same] = self.common(t, a[same], b[same], length[:-1][same]) == length[:-1][same]
            told = np.concatenate([[0], np.cumsum(~same)]) + name
            names[at[1:] if s else at] = told[1:] if s else told
            name = int(told[-1])
        del order, is_seed, by_stretch
        if name == len(seeds) - 1:
            rank = self.array(len(seeds), place_kind(len(t)))
            for a, b in self.blocks(len(seeds)):
                rank[names[a:b]] = np.arange(a, b)
        elif len(names) <= self.base:
            rank = self.doubled(np.array(names))
        else:
            rank, _ = self.sort(names, 0, level + 1)
        seeds = self.joined((seeds[rank[a:b]] for a, b in self.blocks(len(seeds))), len(seeds), place_kind(len(t)))
        del names, rank
        if not cap:
            return ordered(seeds), None
        values = self.array(len(seeds), np.uint8 if cap < 256 else np.uint16)
        for s, e in self.blocks(len(seeds)):
            some = np.array(seeds[max(s - 1, 0) : e])
            values[max(s, 1) : e] = self.common(t, some[:-1], some[1:], cap)
        return self.induce(t, is_s, run, seeds, values, cap)


def ended(text: np.ndarray, sorter: Sorter) -> np.ndarray:
    """The text with its end, in a mapped file if it is long."""
    most = max((int(text[a:b].max()) for a, b in sorter.blocks(len(text))), default=0)
    out = sorter.array(len(text) + 1, np.uint8 if most < 256 else np.uint16 if most < 65536 else np.int64)
    for a, b in sorter.blocks(len(text)):
        out[a:b] = text[a:b]
    out[len(text)] = 0
    return out


def sorted_suffixes(text: np.ndarray, cap: int, held: int = HELD, base: int = BASE):
    """Suffix array and common-prefix values up to `cap` (65,534 at most) of characters of at least 1; the end is added."""
    with tempfile.TemporaryDirectory() as folder:
        sorter = Sorter(folder, held, base)
        order, values = sorter.sort(ended(text, sorter), cap)
        return np.array(order), np.array(values)


def repeated_starts(text: np.ndarray, length: int, held: int = HELD, base: int = BASE) -> tuple[np.ndarray, int, int]:
    """Which strings of `length` characters start elsewhere too; the runs that queues wrote to disk, and levels of recursion."""
    with tempfile.TemporaryDirectory() as folder:
        sorter = Sorter(folder, held, base)
        order, values = sorter.sort(ended(text, sorter), length)
        out = sorter.array(len(text) + 1, bool)
        for a, b in sorter.blocks(len(order)):
            near = np.flatnonzero(values[a:b] >= length) + a
            out[order[near]] = True
            out[order[near - 1]] = True
        return np.array(out[:-1]), sorter.spills, sorter.levels
