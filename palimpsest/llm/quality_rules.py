r"""Weak supervision of text quality: rules vote good, bad or abstain, and expectation-maximisation weighs them.

Every document is counted once, in one pass over its whole text. A document's votes are one of 3^8 patterns; EM
runs on the counts of patterns over all documents, a table that does not grow with the input, and learns for each
rule how often it votes each way on good and on bad documents. The posterior of a pattern is its documents' score.

Null and empty texts have no words and fail the base rules. Null or repeated ids and repeated rows stay rows of
their own. An empty table gives an empty result. Extra columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, materialize, table

BLANKS, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouted", "n_marks", "n_letters", "n_solid")


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of `width` words that the text holds twice or more."""
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    seen: set = set()
    again: set = set()
    if len(set(windows)) == len(windows):
        return 0
    for w in windows:
        (again if w in seen else seen).add(w)
    flags = bytearray(len(words))
    mark = b"\1" * width
    for i, w in enumerate(windows):
        if w in again:
            flags[i : i + width] = mark
    return sum(flags)


def count_text(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    solid = raw.translate(None, BLANKS)
    return (
        len(words), len(text) - len(raw) + len(solid), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), sum(map(bytes.isupper, words)), raw.count(b"!"), len(solid) - len(solid.translate(None, LETTERS)), len(solid),
    )


def counted(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    def run(batches):
        for batch in batches:
            found = list(map(count_text, batch.column(1).to_pylist()))
            columns = list(zip(*found, strict=True)) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *COUNTS])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def ratio(a: str, b: str):
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: Each rule: its value, and the bounds of a good and of a bad vote; between them it abstains.
RULES = {
    "length": (F.col, ("n_words",), lambda x: x >= 80, lambda x: x < 50),
    "word_length": (ratio, ("word_chars", "n_words"), lambda x: x.between(3, 11), lambda x: (x < 2.2) | (x > 14)),
    "symbols": (ratio, ("n_symbols", "n_words"), lambda x: x <= 0.03, lambda x: x > 0.1),
    "duplicate_lines": (ratio, ("n_dup_lines", "n_lines"), lambda x: x <= 0.05, lambda x: x > 0.3),
    "repetition": (ratio, ("n_repeat_words", "n_words"), lambda x: x <= 0.1, lambda x: x > 0.35),
    "shouting": (ratio, ("n_shouted", "n_words"), lambda x: x <= 0.05, lambda x: x > 0.2),
    "exclamation": (ratio, ("n_marks", "n_words"), lambda x: x <= 0.05, lambda x: x > 0.15),
    "letters": (ratio, ("n_letters", "n_solid"), lambda x: x >= 0.9, lambda x: x < 0.75),
}


def vote(rule: str):
    """2 good, 0 bad, 1 abstains."""
    value, columns, good, bad = RULES[rule]
    x = value(*columns)
    return F.when(bad(x), 0).when(good(x), 2).otherwise(1)


def pattern_of():
    return sum((vote(r) * 3**k for k, r in enumerate(RULES)), F.lit(0)).cast("int")


def expectation_maximisation(counts: dict[int, int], n_rules: int = len(RULES), rounds: int = 200) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior of good for each pattern of votes; P(vote | bad, good) by rule; P(good).

    Starts from a doubtful view of every document with a bad vote. One pseudo-document for each vote keeps
    probabilities from 0; the good class is the one with fewer bad votes.
    """
    patterns = np.array(sorted(counts), np.int64)
    n = np.array([counts[p] for p in patterns.tolist()], float)
    votes = patterns[:, None] // 3 ** np.arange(n_rules) % 3
    post = np.where((votes == 0).any(1), 0.1, 0.95)
    told, prior = np.full((2, n_rules, 3), 1 / 3), 0.5
    for _ in range(rounds):
        weight = np.stack([1 - post, post]) * n
        prior = float((weight[1].sum() + 1) / (n.sum() + 2))
        told = np.stack([[np.bincount(votes[:, j], w, 3) + 1.0 for j in range(n_rules)] for w in weight])
        told /= told.sum(2, keepdims=True)
        ll = np.log([1 - prior, prior])[:, None] + sum(np.log(told[:, j, :])[:, votes[:, j]] for j in range(n_rules))
        before, post = post, 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -500, 500)))
        if len(post) and np.abs(post - before).max() < 1e-9:
            break
    if len(post) and told[1, :, 0].mean() > told[0, :, 0].mean():
        post, told, prior = 1 - post, told[::-1], 1 - prior
    return dict(zip(patterns.tolist(), post.tolist(), strict=True)), told, prior


def quality_rules(docs: DataFrame, id_col="doc_id", text_col="text", least: float = 0.5) -> DataFrame:
    """Per document: its counts, base_failed, the votes' pattern, the posterior quality, kept."""
    counts = materialize(counted(docs, id_col, text_col).withColumn("pattern", pattern_of()), "rules-counts")
    seen = {r["pattern"]: r["count"] for r in counts.groupBy("pattern").count().collect()}  # at most 3^8 rows
    posterior, _, _ = expectation_maximisation(seen)
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame(sorted(posterior.items()), "pattern int, posterior double"))  # at most 3^8 rows
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = counts.join(known, "pattern").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


QUERIES = {"op1_quality_rules": op1_quality_rules}
SQL: dict[str, str] = {}
