"""Sentence encoder and cached decoder as NumPy functions behind Arrow batches; weights are a plain dict of arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gelu(x: np.ndarray) -> np.ndarray:
    """The hyperbolic-tangent form."""
    return x / 2 * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))


def layer_norm(x: np.ndarray, gain: np.ndarray, shift: np.ndarray, eps: float) -> np.ndarray:
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + eps) * gain + shift


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def log_softmax(x: np.ndarray) -> np.ndarray:
    y = x - x.max(-1, keepdims=True)
    return y - np.log(np.exp(y).sum(-1, keepdims=True))


def log_softmax_column(x: Column) -> Column:
    top = F.array_max(x)
    total = F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top)))
    return F.transform(x, lambda v: v - top - total)


def split_heads(x: np.ndarray, heads: int) -> np.ndarray:
    return np.moveaxis(x.reshape(*x.shape[:-1], heads, -1), -2, -3)


def merge_heads(x: np.ndarray) -> np.ndarray:
    x = np.moveaxis(x, -3, -2)
    return x.reshape(*x.shape[:-2], -1)


def toy_encoder(vocabulary: int = 512, width: int = 24, layers: int = 2, heads: int = 4, longest: int = 256, seed: int = 11) -> dict:
    """Small random weights with an encoder's shapes, for structure and plumbing."""
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 0.2, s).astype(np.float32)
    w = {"word": draw(vocabulary, width), "place": draw(longest, width), "kind": draw(2, width), "heads": heads, "layers": layers}
    for name in ("ln", *(f"{k}.{n}" for k in range(layers) for n in ("ln1", "ln2"))):
        w[f"{name}.gain"], w[f"{name}.shift"] = np.ones(width, np.float32), np.zeros(width, np.float32)
    for k in range(layers):
        for n, (a, b) in {"q": (width, width), "k": (width, width), "v": (width, width), "o": (width, width), "up": (width, 4 * width), "down": (4 * width, width)}.items():
            w[f"{k}.{n}"], w[f"{k}.{n}.bias"] = draw(a, b), np.zeros(b, np.float32)
    return w


def hashed_ids(text: str, vocabulary: int) -> list[int]:
    """Token ids without a vocabulary file: words hashed, 0 in front."""
    import re
    import zlib

    return [0, *(1 + zlib.crc32(t.encode()) % (vocabulary - 1) for t in re.findall(r"[a-z0-9]+", text.lower()))]


def encode(texts: list[str], w: dict, ids_of: Callable[[str, int], list[int]] = hashed_ids, batch: int = 8) -> np.ndarray:
    """Unit vectors: mean of the last layer over a text's tokens, texts padded to the longest of their batch."""
    longest, width = w["place"].shape
    out = np.zeros((len(texts), width), np.float32)
    for at in range(0, len(texts), batch):
        ids = [ids_of(t or "", len(w["word"]))[:longest] for t in texts[at : at + batch]]
        n = max(map(len, ids))
        held = np.array([[1.0] * len(i) + [0.0] * (n - len(i)) for i in ids], np.float32)
        x = w["word"][np.array([i + [0] * (n - len(i)) for i in ids])] + w["place"][:n] + w["kind"][0]
        x = layer_norm(x, w["ln.gain"], w["ln.shift"], 1e-12)
        blocked = (1 - held)[:, None, None, :] * np.float32(-1e9)
        for k in range(w["layers"]):
            q, key, v = (split_heads(x @ w[f"{k}.{m}"] + w[f"{k}.{m}.bias"], w["heads"]) for m in "qkv")
            attention = softmax(q @ np.swapaxes(key, -1, -2) / np.float32(np.sqrt(q.shape[-1])) + blocked)
            x = layer_norm(x + merge_heads(attention @ v) @ w[f"{k}.o"] + w[f"{k}.o.bias"], w[f"{k}.ln1.gain"], w[f"{k}.ln1.shift"], 1e-12)
            x = layer_norm(x + gelu(x @ w[f"{k}.up"] + w[f"{k}.up.bias"]) @ w[f"{k}.down"] + w[f"{k}.down.bias"], w[f"{k}.ln2.gain"], w[f"{k}.ln2.shift"], 1e-12)
        mean = (x * held[:, :, None]).sum(1) / np.maximum(held.sum(1, keepdims=True), 1e-9)
        out[at : at + batch] = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)
    return out


def encoded(rows: DataFrame, text: str, weights: dict, ids_of=hashed_ids, name: str = "embedding") -> DataFrame:
    """Adds the embedding of a text; weights reach each worker once, as a broadcast variable."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encode(texts.fillna("").tolist(), shared.value, ids_of)))

    return rows.withColumn(name, run(F.col(text)))


def toy_decoder(vocabulary: int = 64, width: int = 16, layers: int = 2, heads: int = 2, longest: int = 256, seed: int = 12) -> dict:
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    w = {"word": draw(vocabulary, width), "place": draw(longest, width), "heads": heads, "layers": layers}
    for name in ("ln", *(f"{k}.{n}" for k in range(layers) for n in ("ln1", "ln2"))):
        w[f"{name}.gain"], w[f"{name}.shift"] = np.ones(width, np.float32), np.zeros(width, np.float32)
    for k in range(layers):
        for n, (a, b) in {"qkv": (width, 3 * width), "o": (width, width), "up": (width, 4 * width), "down": (4 * width, width)}.items():
            w[f"{k}.{n}"], w[f"{k}.{n}.bias"] = draw(a, b), np.zeros(b, np.float32)
    return w


class Cache:
    """Keys and values of a sequence so far, held in storage of a width: floats, halves, or codes with a step and a low.

    Four-bit codes stand two to a byte, the earlier in the lower half. Values are restored whenever they are read.
    """

    def __init__(self, bits: int = 32):
        self.bits = bits
        self.parts: dict[tuple[int, str], list[tuple[np.ndarray, ...]]] = {}

    def stored(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        if self.bits >= 16:
            return (x.astype(np.float16 if self.bits == 16 else np.float32),)
        levels = 2**self.bits - 1
        low = x.min(-1, keepdims=True)
        step = (x.max(-1, keepdims=True) - low) / np.float32(levels)
        step[step == 0] = 1e-8
        codes = np.clip(np.rint((x - low) / step), 0, levels).astype(np.uint8)
        if self.bits == 4:
            codes = codes[..., ::2] | codes[..., 1::2] << 4
        return codes, step.astype(np.float32), low.astype(np.float32)

    def restored(self, part: tuple[np.ndarray, ...]) -> np.ndarray:
        if len(part) == 1:
            return part[0].astype(np.float32)
        codes, step, low = part
        if self.bits == 4:
            codes = np.stack([codes & 15, codes >> 4], -1).reshape(*codes.shape[:-1], -1)
        return codes * step + low

    def add(self, layer: int, side: str, x: np.ndarray) -> np.ndarray:
        """Takes further tokens of a layer and gives back all, as they come out of storage."""
        held = self.parts.setdefault((layer, side), [])
        held.append(self.stored(x))
        if len(held) > 16:  # few large parts, not many small ones
            held[:] = [tuple(np.concatenate(x, 1) for x in zip(*held, strict=True))]
        return np.concatenate([self.restored(p) for p in held], 1)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for held in self.parts.values() for p in held for x in p)


def decode(ids: list[int], w: dict, cache: Cache, past: int = 0) -> np.ndarray:
    """Logits of the tokens given, after `past` tokens that the cache holds."""
    n = len(ids)
    x = w["word"][ids] + w["place"][past : past + n]
    ahead = np.triu(np.full((n, n), np.float32(-1e9)), 1)
    for k in range(w["layers"]):
        q, key, v = np.split(layer_norm(x, w[f"{k}.ln1.gain"], w[f"{k}.ln1.shift"], 1e-5) @ w[f"{k}.qkv"] + w[f"{k}.qkv.bias"], 3, -1)
        key, v = (cache.add(k, side, split_heads(y, w["heads"])) for side, y in (("k", key), ("v", v)))
        q = split_heads(q, w["heads"])
        logits = q @ np.swapaxes(key, -1, -2) / np.float32(np.sqrt(q.shape[-1]))
        logits[..., past:] += ahead
        x = x + merge_heads(softmax(logits) @ v) @ w[f"{k}.o"] + w[f"{k}.o.bias"]
        x = x + gelu(layer_norm(x, w[f"{k}.ln2.gain"], w[f"{k}.ln2.shift"], 1e-5) @ w[f"{k}.up"] + w[f"{k}.up.bias"]) @ w[f"{k}.down"] + w[f"{k}.down.bias"]
    return layer_norm(x, w["ln.gain"], w["ln.shift"], 1e-5) @ w["word"].T


def teacher_forced(prefill: list[int], held_out: list[int], w: dict, bits: int) -> list[tuple[int, float, int, int]]:
    """(step, nll, top, bytes that the cache holds after it) for each held-out token; the first is told from the prefill's last logits."""
    cache, out = Cache(bits), []
    logits = decode(prefill, w, cache)[-1]
    for step, token in enumerate(held_out):
        nll, top = float(-log_softmax(logits)[token]), int(logits.argmax())
        logits = decode([token], w, cache, len(prefill) + step)[-1]
        out.append((step, nll, top, cache.nbytes))
    return out


def decoded_steps(sequences: DataFrame, weights: dict) -> DataFrame:
    """(seq_id, bits, step, nll, top, bytes) of sequences (seq_id, bits, prefill, held_out); each is one sequential task."""
    shared = sequences.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            rows = [(r["seq_id"], r["bits"], *s) for r in batch.to_pylist() for s in teacher_forced(r["prefill"], r["held_out"], shared.value, r["bits"])]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, types, strict=True)], names=["seq_id", "bits", "step", "nll", "top", "bytes"])

    return sequences.select("seq_id", "bits", "prefill", "held_out").mapInArrow(run, "seq_id long, bits int, step int, nll double, top int, bytes long")
