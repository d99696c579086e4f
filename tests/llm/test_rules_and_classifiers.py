import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import language, quality_classifier, quality_rules

W = re.compile(r"[^\x20\x09-\x0D]+")


def rules_by_hand(text):
    text = text or ""
    words = W.findall(text)
    lines = [x for x in text.split("\n") if W.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_and_base_rules(spark, messy, messy_docs, no_docs):
    got = sorted((str(r["doc_id"]), *r[1:6], r["base_failed"]) for r in quality_rules.quality_rules(messy_docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = []
    for d, t, *_ in messy:
        c = rules_by_hand(t)
        want.append((str(d), *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert got == sorted(want)
    assert not quality_rules.quality_rules(messy_docs).where("base_failed and kept").count()
    assert quality_rules.quality_rules(no_docs).count() == 0


def test_expectation_maximisation_recovers_rules():
    rng = np.random.default_rng(1)
    good = rng.random(20000) < 0.8
    told = np.array([[0.02, 0.1, 0.88], [0.6, 0.3, 0.1]])  # votes on good and on bad
    counts = Counter()
    truth = Counter()
    for g in good:
        p = sum(rng.choice(3, p=told[0] if g else told[1]) * 3**k for k in range(5))
        counts[p] += 1
        truth[p] += g
    post, learned, prior = quality_rules.expectation_maximisation(counts, 5)
    assert abs(prior - 0.8) < 0.02 and np.abs(learned[1] - told[0]).max() < 0.05 and np.abs(learned[0] - told[1]).max() < 0.05
    assert sum(counts[p] * ((post[p] >= 0.5) == (truth[p] / counts[p] >= 0.5)) for p in counts) / 20000 > 0.98
    assert quality_rules.expectation_maximisation({}, 5)[0] == {}


def test_rules_agree_with_labels(spark):
    at = "/root/testdata/sf0.01"
    told = quality_rules.op1_quality_rules(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").where("not base_failed")
    assert told.where("kept = (quality = 1)").count() / told.count() > 0.97


def test_classifier_held_out(spark):
    at = "/root/testdata/sf0.1"
    told = quality_classifier.op2_quality_classifier(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").where("held_out").persist()
    assert told.where("predicted = quality").count() / told.count() > 0.97
    by = {r["quality"]: r["m"] for r in told.groupBy("quality").agg(F.avg("score").alias("m")).collect()}
    assert by[1] - by[0] > 0.5


def test_classifier_edges(spark, folder, messy, no_docs):
    out = quality_classifier.op2_quality_classifier(spark, folder).collect()
    assert len(out) == len(messy) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    one = quality_classifier.fit([("only good text", "1")] * 5)
    assert one.difference("x") == 0 and one.score(np.array([0.0]))[0] > 0.5
    assert quality_classifier.score_quality(no_docs, one).count() == 0
    assert quality_classifier.Classifier(b"", b"").difference(None) == 0


def brute_marginals(e, a, start):
    """Forward-backward word by word."""
    n, k = e.shape
    f, b = np.zeros((n, k)), np.ones((n, k))
    f[0] = start * e[0]
    f[0] /= f[0].sum()
    for t in range(1, n):
        f[t] = f[t - 1] @ a * e[t]
        f[t] /= f[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = a @ (e[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    p = f * b
    return p / p.sum(1, keepdims=True)


def test_marginals_equal_a_plain_pass(messy):
    model = language.fit([(t, lang) for _, t, lang, *_ in messy if t and lang])
    texts = [w for _, t, *_ in messy if (w := language.words_of(t)[:700])]
    p, lengths = model.marginals(texts)
    a, start = np.exp(model.transitions - model.transitions.max()), np.exp(model.start - model.start.max())
    at = 0
    for words, n in zip(texts, lengths, strict=True):
        assert np.abs(p[at : at + n] - brute_marginals(model.emissions(words).astype(float), a, start)).max() < 2e-3
        at += n


def test_language_labels_words_in_switched_text(messy):
    rows = [(t, lang) for i, (_, t, lang, *_) in enumerate(messy[:60])]
    model = language.fit(rows[:45])
    a, b = (next(t for t, lang in rows[45:] if lang == x) for x in ("fr", "de"))
    first, second = language.words_of(a)[:30], language.words_of(b)[:30]
    p, _ = model.marginals([first + second])
    names = [model.labels[i] for i in p.argmax(1)]
    assert names[: len(first)].count("fr") > 0.9 * len(first) and names[len(first) :].count("de") > 0.9 * len(second)


def test_language_query(spark, folder, messy, no_docs):
    out = language.op10_language_id(spark, folder).collect()
    assert len(out) == len(messy)
    und = sorted(str(r["doc_id"]) for r in out if r["lang_pred"] == "und")
    assert und == sorted(str(d) for d, t, *_ in messy if not any(map(str.isalpha, t or "")))
    assert all(0 <= r["score"] <= 1 for r in out)
    assert language.identify(no_docs, None).count() == 0
    assert language.identify(no_docs.limit(0), language.fit([])).columns == ["doc_id", "lang_pred", "score"]
    at = "/root/testdata/sf0.01"
    told = language.op10_language_id(spark, at).join(spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert told.where("lang = lang_pred").count() / told.count() > 0.99


def test_folds(spark):
    import zlib

    rows = spark.range(50).select("id", language.fold(F.col("id"), 4).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in rows)


def test_words_of_any_script():
    han = "".join(chr(0x4E00 + i) for i in range(200))
    words = language.words_of(f"Ab\u00a0c\u3000d «e» x-y {han} {'q' * 60} १न्न")
    assert words[:6] == [b"ab", b"c", b"d", b"e", b"x", b"y"] and words[-1] == "न्न".encode()
    assert all(len(w) <= language.WIDTH for w in words) and set(han) <= set(b"".join(words).decode())
    assert language.words_of(han[:80] + "一" + han[81:]) != language.words_of(han)


def test_many_languages_and_bounded_samples(spark, monkeypatch):
    names = [f"l{i:02}" for i in range(70)]
    ends = {n: (chr(97 + i // 26) + chr(97 + i % 26)) * 2 for i, n in enumerate(names)}
    text = lambda n, j: " ".join("w" + "kmnprstvz"[(j * 7 + m) % 9] + ends[n] for m in range(40))
    rows = [(j, text(n, j), n) for n in names for j in range(8)] + [(1, "the same", "l00")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.trained_on(docs, F.lit(False))
    assert len(model.labels) == 70
    told = language.identify(docs.where("text <> 'the same'"), model, keep=("lang",))
    assert told.where("lang = lang_pred").count() > 0.95 * 560
    sample = language.labelled_sample(docs, "text", "lang", F.col("doc_id"), 300)
    assert len(sample) == len(set(sample)) <= 561
    monkeypatch.setattr(language, "MOST_LABELS", 3)  # the commonest ones
    assert {n for _, n in language.labelled_sample(docs, "text", "lang", F.col("doc_id"), 300)} <= {"l00", "l01", "l02"}
    long = spark.createDataFrame([(1, "ab " * 20_000, "en")], "doc_id long, text string, lang string")
    assert [len(t) for t, _ in language.labelled_sample(long, "text", "lang", F.col("doc_id"), 300)] == [language.SAMPLE_CHARS]


def test_quality_sizes_by_direct_calls(spark, messy_docs):
    """Scores from sizes that zstandard tells block by block."""
    import zstandard

    rng = np.random.default_rng(4)
    good = ["".join(rng.choice(["clear ", "useful ", "words ", "here "], 60)) for _ in range(40)]
    bad = ["".join(rng.choice(["buy ", "now!! ", "$$$ ", "click "], 60)) for _ in range(40)]
    model = quality_classifier.fit([(t, "1") for t in good] + [(t, "0") for t in bad])
    packers = [zstandard.ZstdCompressor(level=quality_classifier.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    rows = {(r["doc_id"], r["text"]) for r in messy_docs.collect()}
    want = set()
    for d, t in rows:
        raw = (t or "").encode()
        a, b = (sum(len(p.compress(raw[i : i + 256])) for i in range(0, len(raw), 256)) for p in packers)
        x = (b - a) / len(raw) if raw else 0.0
        want.add((d, round(1 / (1 + np.exp(-(model.slope * x + model.intercept))), 9)))
    got = {(r["doc_id"], round(r["score"], 9)) for r in quality_classifier.score_quality(messy_docs, model).collect()}
    assert got == want
    assert model.score(np.array([model.difference(good[0]), model.difference(bad[0])])).round().tolist() == [1.0, 0.0]
