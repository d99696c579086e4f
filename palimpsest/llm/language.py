r"""Language ID with a linear-chain conditional random field over the words of a text.

Words are runs of letters and marks of any script, lower-cased; a run of over 24 bytes, as in scripts without blanks,
is several words of the chain that overlap by two characters, so every letter is read. Their features are character
pairs and triples, prefixes and suffixes up to four bytes, and the languages whose lexicon holds them; the field
learns their weights and the transitions between languages. It is fitted to a bounded sample: about 300 different
texts of each of the 1,000 commonest languages, 20,000 characters of each at most, cut to windows of which half are
spliced from two texts, so that transitions see code-switched text. Forward-backward labels every word of a whole text: its words are cut into
runs whose transfer matrices are multiplied at once, which gives the exact marginals of the whole sequence. A text's
language is the one with the largest mean marginal, its score that mean.

Null texts and texts without a letter are `und` with score 0, as are all texts where there is nothing to learn from.
Null or repeated ids and repeated rows stay rows of their own. An empty table gives an empty result. Extra columns
of the input are not read.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, table

#: Bytes of ASCII letters and of letters beyond ASCII stay; all others part words.
SPLIT = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
PAIRS, HASHED, WIDTH, RUN = 1 << 16, 1 << 17, 24, 32
#: Languages that one model can tell apart, the commonest ones; characters of a text that it may be fitted to.
MOST_LABELS, SAMPLE_CHARS = 1000, 20_000
#: Words whose scores a worker remembers; beyond it starts anew.
REMEMBERED = 300_000
#: Characters of texts whose words are labelled at once, about.
AT_ONCE = 1 << 20


@lru_cache(1 << 16)
def is_letter(c: str) -> bool:
    return unicodedata.category(c)[0] in "LM"


def pieces(word: bytes) -> list[bytes]:
    """A long word as words of at most WIDTH bytes that overlap by two characters."""
    out, some, size = [], [], 0
    for c in word.decode():
        raw = c.encode()
        if size + len(raw) > WIDTH:
            out.append(b"".join(some))
            some = some[-2:]
            size = sum(map(len, some))
        some.append(raw)
        size += len(raw)
    return [*out, b"".join(some)]


def words_of(text: str | None) -> list[bytes]:
    low = (text or "").lower()
    if not low.isascii() and (odd := [c for c in set(low) if c > "\x7f" and not is_letter(c)]):
        low = low.translate(dict.fromkeys(map(ord, odd), " "))
    words = low.encode(errors="replace").translate(SPLIT).split()
    if words and max(map(len, words)) > WIDTH:
        words = [p for w in words for p in (pieces(w) if len(w) > WIDTH else (w,))]
    return words


def word_features(words: list[bytes], lexicon: dict[bytes, int], holders: np.ndarray) -> np.ndarray:
    """Feature numbers of each word of at most WIDTH bytes, padded with the last number, whose weights are 0.

    lexicon: the row of `holders` (lists of words x languages, row 0 empty) that has the languages of a word.
    """
    n_labels = holders.shape[1]
    empty = PAIRS + HASHED + n_labels
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    m = np.zeros((n, WIDTH + 2), np.int64)
    m[:, 1:-1] = np.array(words, f"S{WIDTH}").view(np.uint8).reshape(n, WIDTH)
    m[:, 0] = 1
    m[np.arange(n), size + 1] = 2
    at = np.arange(WIDTH + 2)[None, :]
    pairs = np.where(at[:, 1:] <= size[:, None] + 1, m[:, :-1] * 256 + m[:, 1:], empty)
    mix = lambda *parts: sum(p * c for p, c in zip(parts, (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1), strict=False)) >> 7 & (HASHED - 1)
    triples = np.where(at[:, 2:] <= size[:, None] + 1, PAIRS + mix(m[:, :-2], m[:, 1:-1], m[:, 2:]), empty)
    ends = np.minimum(size[:, None] + 1 - np.arange(4)[None, :], WIDTH + 1)
    last = np.where(ends >= 0, np.take_along_axis(m, np.maximum(ends, 0), 1), 0)
    prefix = PAIRS + mix(m[:, 1], m[:, 2], m[:, 3], m[:, 4], np.int64(3))
    suffix = PAIRS + mix(last[:, 1], last[:, 2], last[:, 3], m[np.arange(n), np.maximum(size - 3, 0)], np.int64(5))
    known = np.fromiter((lexicon.get(w, 0) for w in words), np.int64, n)
    lex = np.where(holders[known], PAIRS + HASHED + np.arange(n_labels)[None, :], empty)
    return np.concatenate([pairs, triples, prefix[:, None], suffix[:, None], lex], 1)


@dataclass
class Field:
    labels: list[str]
    lexicon: dict[bytes, int]
    holders: np.ndarray  # rows that words of the lexicon name x labels
    weights: np.ndarray  # features x labels
    transitions: np.ndarray  # labels x labels, logarithms
    start: np.ndarray
    _rows: dict[bytes, int] = field(default_factory=dict)
    _scores: np.ndarray | None = None

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Score of each label for each distinct word, as exponentials of at most 1."""
        out = np.empty((len(words), len(self.labels)), np.float32)
        some = max(64, 1_200_000 // (60 + len(self.labels)))
        for i in range(0, len(words), some):
            f = word_features(words[i : i + some], self.lexicon, self.holders)
            s = sum(self.weights[f[:, j]] for j in range(f.shape[1]))
            out[i : i + some] = np.exp(s - s.max(1, keepdims=True))
        return np.maximum(out, 1e-6)

    def rows_of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if len(self._rows) > REMEMBERED:
            self._rows, self._scores = {}, None
        new = list(set().union(*texts) - self._rows.keys())
        if new:
            scores = self.emissions(new)
            self._rows.update(zip(new, range(len(self._rows), len(self._rows) + len(new)), strict=True))
            self._scores = scores if self._scores is None else np.concatenate([self._scores, scores])
        return [np.fromiter(map(self._rows.__getitem__, t), np.int64, len(t)) for t in texts]

    def marginals(self, texts: list[list[bytes]]) -> tuple[np.ndarray, list[int]]:
        """P(label) of every word of all texts, one after another, and the texts' lengths; no text is empty."""
        rows = self.rows_of(texts)
        k = len(self.labels)
        lengths = np.array([len(r) for r in rows])
        runs = -(-lengths // RUN)
        first = np.concatenate([[0], np.cumsum(runs)[:-1]])
        total = int(runs.sum())
        slot = np.concatenate([np.arange(n) for n in lengths]) + np.repeat(first * RUN, lengths)
        e = np.ones((total * RUN, k), np.float32)
        e[slot] = self._scores[np.concatenate(rows)]
        held = np.zeros(total * RUN, bool)
        held[slot] = True
        e, held = e.reshape(total, RUN, k), held.reshape(total, RUN)
        a = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        begin = np.exp(self.start - self.start.max()).astype(np.float32)
        is_first = np.zeros(total, bool)
        is_first[first] = True

        def scaled(x, axes):
            return x / np.maximum(x.sum(axis=axes, keepdims=True), 1e-30)

        def step(x, t):  # x: rows of states before word t of each run
            y = (x.reshape(-1, k) @ a).reshape(x.shape)
            if t == 0:  # a text's first word has no word before it
                y[is_first] = x[is_first].sum(-1, keepdims=True) * begin
            shape = (total,) + (1,) * (x.ndim - 2) + (k,)
            return np.where(held[:, t].reshape(shape[:-1] + (1,)), y * e[:, t].reshape(shape), x)

        # transfer matrix of each run
        move = np.broadcast_to(np.eye(k, dtype=np.float32), (total, k, k)).copy()
        for t in range(RUN):
            move = scaled(step(move, t), (1, 2))
        # states at the runs' borders, all texts at once
        into, out = np.full((total, k), 1 / k, np.float32), np.full((total, k), 1 / k, np.float32)
        order = np.argsort(-runs, kind="stable")
        for j in range(1, int(runs.max())):
            at = (first[order[: int((runs > j).sum())]]) + j
            into[at] = scaled(np.einsum("nk,nkl->nl", into[at - 1], move[at - 1]), 1)
        for j in range(2, int(runs.max()) + 1):
            some = order[: int((runs >= j).sum())]
            at = first[some] + runs[some] - j
            out[at] = scaled(np.einsum("nkl,nl->nk", move[at + 1], out[at + 1]), 1)
        forward, x = np.empty((RUN, total, k), np.float32), into
        for t in range(RUN):
            x = scaled(step(x, t), 1)
            forward[t] = x
        marginal, b = np.empty((total, RUN, k), np.float32), out
        for t in range(RUN - 1, -1, -1):
            marginal[:, t] = scaled(forward[t] * b, 1)
            b = np.where(held[:, t, None], scaled((e[:, t] * b) @ a.T, 1), b)
        return marginal.reshape(-1, k)[slot], lengths.tolist()

    def means(self, texts: list[list[bytes]]) -> np.ndarray:
        p, lengths = self.marginals(texts)
        return np.add.reduceat(p, np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0) / np.array(lengths)[:, None]


def fit(texts: list[tuple[str, str]], seed: int = 5, window: int = 24, windows_each: int = 8, rounds: int = 3, batch: int = 128) -> Field | None:
    """Fits to (text, label) rows by AdaGrad on the conditional likelihood of windows of words."""
    rng = np.random.default_rng(seed)
    labels = sorted({label for _, label in texts})
    docs = [(w, labels.index(label)) for text, label in sorted(texts) if (w := words_of(text))]
    if not docs:
        return None
    k = len(labels)
    seen: dict[bytes, np.ndarray] = {}
    for words, y in docs:
        for w in set(words):
            seen.setdefault(w, np.zeros(k))[y] += 1
    per = np.maximum(np.bincount([y for _, y in docs], minlength=k), 1)
    # a word is in a language's lexicon if three of its texts have it, half as often at least as anywhere
    sets: dict[tuple, int] = {(): 0}
    lexicon = {w: sets.setdefault(tuple(np.flatnonzero((c >= 3) & (c / per >= 0.5 * (c / per).max())).tolist()), len(sets)) for w, c in seen.items() if c.max() >= 3}
    holders = np.zeros((len(sets), k), bool)
    for held, row in sets.items():
        holders[row, list(held)] = True
    cuts = [(words[i : i + window], y) for words, y in docs for i in rng.choice(max(1, len(words) - window + 1), min(windows_each, max(1, len(words) // window)), replace=False)]
    mates = rng.permutation(len(cuts))
    sequences = []
    for n, (words, y) in enumerate(cuts):
        other, z = cuts[mates[n]]
        half = len(words) // 2 if n % 2 else len(words)
        mixed = words[:half] + other[half:window]
        sequences.append((mixed[:window], ([y] * half + [z] * len(other[half:window]))[:window]))
    vocabulary = {w: i for i, w in enumerate(sorted({w for s, _ in sequences for w in s}))}
    features = word_features(list(vocabulary), lexicon, holders)
    size = PAIRS + HASHED + k + 1
    w, w2 = np.zeros((size, k)), np.full((size, k), 1e-2)
    tr, tr2 = np.zeros((k, k)), np.full((k, k), 1.0)
    st, st2 = np.zeros(k), np.full(k, 1.0)
    for _ in range(rounds):
        for some in np.array_split(rng.permutation(len(sequences)), -(-len(sequences) // batch)):
            n = len(some)
            ids, gold, held = np.zeros((n, window), np.int64), np.zeros((n, window), np.int64), np.zeros((n, window), bool)
            for r, s in enumerate(some):
                ws, ys = sequences[s]
                ids[r, : len(ws)], gold[r, : len(ws)], held[r, : len(ws)] = [vocabulary[x] for x in ws], ys, True
            used, back = np.unique(ids, return_inverse=True)
            e = w[features[used]].sum(1)[back.reshape(ids.shape)]
            e = np.exp(e - e.max(2, keepdims=True))
            a = np.exp(tr - tr.max())
            fw, bw = np.empty_like(e), np.ones_like(e)
            fw[:, 0] = np.exp(st - st.max()) * e[:, 0]
            fw[:, 0] /= fw[:, 0].sum(1, keepdims=True)
            for t in range(1, window):
                x = (fw[:, t - 1] @ a) * e[:, t]
                fw[:, t] = np.where(held[:, t, None], x / x.sum(1, keepdims=True), fw[:, t - 1])
            for t in range(window - 2, -1, -1):
                x = (e[:, t + 1] * bw[:, t + 1]) @ a.T
                bw[:, t] = np.where(held[:, t + 1, None], x / x.sum(1, keepdims=True), bw[:, t + 1])
            p = fw * bw
            p /= p.sum(2, keepdims=True)
            miss = (np.eye(k)[gold] - p) * held[:, :, None]
            both = held[:, 1:]
            pair = fw[:, :-1, :, None] * a[None, None] * (e * bw)[:, 1:, None, :]
            pair = (pair / pair.sum((2, 3), keepdims=True) * both[:, :, None, None]).sum((0, 1))
            g_tr = np.zeros((k, k))
            np.add.at(g_tr, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            g_tr = (g_tr - pair) / n
            by_word = np.stack([np.bincount(back.ravel(), miss[:, :, j].ravel(), len(used)) for j in range(k)], 1) / n
            flat = features[used]
            g = np.stack([np.bincount(flat.ravel(), np.repeat(by_word[:, j], flat.shape[1]), size) for j in range(k)], 1) - 1e-6 * w
            g[-1] = 0
            w2 += g * g
            w += 0.1 * g / np.sqrt(w2)
            tr2 += g_tr * g_tr
            tr += 0.3 * g_tr / np.sqrt(tr2)
            g_st = miss[:, 0].sum(0) / n
            st2 += g_st * g_st
            st += 0.3 * g_st / np.sqrt(st2)
    return Field(labels, lexicon, holders, w.astype(np.float32), tr, st)


def drawn(rows: DataFrame, key: list[str], each: int) -> DataFrame:
    """About `each` of the rows (text, label, ...) of each of the commonest labels, by a hash of their keys: different (text, label) rows.

    Whatever stands in the input, no more than twice as many rows come back, and SAMPLE_CHARS characters of each.
    """
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(MOST_LABELS)
    told = counts.collect()
    place = F.pmod(F.xxhash64(*key), F.lit(1 << 32)) / float(1 << 32)
    share = F.create_map(*[F.lit(x) for r in told for x in (r["label"], each / r["n"])])[F.col("label")] if told else F.lit(None).cast("double")
    some = rows.where(place < share).select(F.substring("text", 1, SAMPLE_CHARS).alias("text"), "label")
    return some.distinct().limit(2 * each * max(1, len(told)) + 100)


def labelled_sample(docs: DataFrame, text_col: str, label_col: str, key: Column, each: int) -> list[tuple[str, str]]:
    """About `each` texts of every label for the driver; they are picked where they are read, others are not shuffled."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(label_col).alias("label"), key.alias("key"))
    return [(r["text"], r["label"]) for r in drawn(rows, ["key", "text"], each).collect()]


def portions(texts: list[str | None]):
    """Places of texts in groups of about AT_ONCE characters, so that a group's marginals take little memory."""
    some, held = [], 0
    for i, text in enumerate(texts):
        some.append(i)
        held += len(text or "")
        if held > AT_ONCE:
            yield some
            some, held = [], 0
    if some:
        yield some


def identify(docs: DataFrame, model: Field | None, id_col="doc_id", text_col="text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, the columns of `keep`, lang_pred, score."""
    extra = [c for c in keep if c != text_col]
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *extra)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = ["doc_id", *keep, "lang_pred", "score"]

    def run(batches):
        crf = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            for some in portions(texts) if crf else ():
                words = {i: w for i in some if (w := words_of(texts[i])) and (texts[i].isascii() or any(map(str.isalpha, texts[i])))}
                if words:
                    p = crf.means(list(words.values()))
                    for i, best, q in zip(words, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                        pred[i], score[i] = crf.labels[best], min(1.0, q)
            kept = [batch.column(1 if c == text_col else 2 + extra.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([batch.column(0), *kept, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=names)

    types = dict(own.dtypes) | {text_col: "string"}
    schema = ", ".join(f"`{n}` {types.get(n, {'lang_pred': 'string', 'score': 'double'}.get(n))}" for n in names)
    return arrow_map(own, run, schema)


#: Texts of each language that the model is fitted to, about.
SAMPLE_EACH = 300


def fold(key: Column, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def trained_on(docs: DataFrame, held_out: Column) -> Field | None:
    return fit(labelled_sample(docs.where(~held_out), "text", "lang", F.col("doc_id"), SAMPLE_EACH))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    found = identify(docs, trained_on(docs, held_out))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
SQL: dict[str, str] = {}
