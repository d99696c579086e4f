r"""Compression classifier of quality: how much better a text packs with good text's dictionary than with bad's.

Two zstandard dictionaries are built from good and bad labelled texts, half of a bounded sample (about 1,500 of each,
20,000 characters of each text at most). A whole text is
compressed with each, in small blocks, so that its own repeats do not drown the dictionaries; the difference of the
two sizes over the text's own size is its one feature. Logistic calibration on the other half of the sample turns it into a
probability.

Null and empty texts have a difference of 0. Labels that are null are not learned from, and of several labels of a
document the smallest counts. If one label is missing, every score is that of the calibration without a feature.
Null or repeated ids and repeated rows stay rows of their own. An empty table gives an empty result. Extra columns
of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, table
from palimpsest.llm.language import SAMPLE_CHARS, drawn, fold

#: Labelled texts of each class that the model is fitted to, about; bytes of a dictionary and of a block.
SAMPLE_EACH, DICTIONARY, BLOCK, LEVEL = 1500, 112 << 10, 256, 3


def blocks(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


def dictionary(texts: list[str]) -> bytes:
    """Trained on the texts' blocks; their last bytes where they are too few to train on."""
    samples = [b for t in texts for b in blocks(t) if len(b) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


@dataclass
class Classifier:
    good: bytes
    bad: bytes
    slope: float = 0.0
    intercept: float = 0.0
    _packers: tuple | None = None

    def difference(self, text: str | None) -> float:
        if not self.good or not self.bad:
            return 0.0
        if self._packers is None:
            self._packers = tuple(zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (self.good, self.bad))
        cut = blocks(text)
        good, bad = (sum(len(p.compress(b)) for b in cut) for p in self._packers)
        return (bad - good) / sum(map(len, cut)) if cut else 0.0

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.intercept, -500, 500)))


def calibrate(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> tuple[float, float]:
    """Logistic regression on one feature by Newton's method."""
    scale = x.std() or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -50, 50)))
        h = z.T @ (z * (p * (1 - p))[:, None]) + np.diag([penalty, 1e-9]) * len(y) + 1e-9 * np.eye(2)
        move = np.linalg.solve(h, z.T @ (y - p) - np.array([penalty, 0]) * len(y) * b)
        b += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1])


def fit(rows: list[tuple[str, str]], share_good: float | None = None) -> Classifier:
    """Fits to (text, '0' or '1') rows; share_good: of all labelled rows, if the sample's differs."""
    rows = sorted(rows)
    by = {y: [t for t, label in rows if label == y] for y in ("0", "1")}
    if min(map(len, by.values())) < 2:
        total = sum(map(len, by.values()))
        return Classifier(b"", b"", 0.0, float(np.log((len(by["1"]) + 1) / (len(by["0"]) + 1))) if total else 0.0)
    model = Classifier(dictionary(by["1"][::2]), dictionary(by["0"][::2]))
    x = np.array([model.difference(t) for y in ("1", "0") for t in by[y][1::2]])
    y = np.array([1.0] * len(by["1"][1::2]) + [0.0] * len(by["0"][1::2]))
    model.slope, model.intercept = calibrate(x, y)
    if share_good and 0 < share_good < 1:  # the sample holds both classes alike; the odds of all labels move the intercept
        model.intercept += float(np.log(share_good / (1 - share_good)) - np.log(y.mean() / (1 - y.mean())))
    model._packers = None
    return model


def train(docs: DataFrame, labels: DataFrame, held_out: Column, label_col="quality") -> Classifier:
    told = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).cast("string").alias("label"))
    told = told.where(~held_out).where("label in ('0', '1')")
    counts = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}
    named = told.select(F.col("doc_id").cast("string").alias("text"), "label")  # ids are drawn first, at most 4 * SAMPLE_EACH + 100
    picked = F.broadcast(drawn(named, ["text"], SAMPLE_EACH).select(F.col("text").cast("long").alias("doc_id"), "label"))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")).join(picked, "doc_id")
    rows = texts.select("text", "label").distinct().limit(4 * SAMPLE_EACH + 100).collect()  # an id may stand in many rows
    total = sum(counts.values())
    return fit([(r["text"], r["label"]) for r in rows], counts.get("1", 0) / total if total else None)


def score_quality(docs: DataFrame, model: Classifier, id_col="doc_id", text_col="text") -> DataFrame:
    """Per document: doc_id, difference, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        held = shared.value
        for batch in batches:
            x = np.array([held.difference(t) for t in batch.column(1).to_pylist()], float)
            s = held.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "difference", "score", "predicted"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, difference double, score double, predicted int")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 3) == 1
    return score_quality(docs, train(docs, labels, held_out)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
SQL: dict[str, str] = {}
