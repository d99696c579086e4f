import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import keyed
from palimpsest.functions.text import canon, contains_answer, tokens
from palimpsest.operators import noise
from palimpsest.sources import corpus

TEXT = "The bank will lend 4,500,000 in March to account 8815-0. It will recall commitments before January, following its normal procedures. "


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def rows(spark, n=3):
    return spark.createDataFrame([(f"c{i}", "d", "Title", "Sec", TEXT * 4 + str(i)) for i in range(n)], "id string, doc_id string, doc_title string, section string, text string")


@pytest.mark.parametrize("clean, noisy, rate", [("abcdefghij", "abcdefghij", 0), ("abcdefghij", "abcdefghiX", 0.1), ("", "abc", 0), ("abc", "abcd", 1 / 3), ("abcd", "abc", 0.25), ("aaaa", "bbbb", 1.0), ("é", "e", 1.0)])
def test_char_error_rate(spark, clean, noisy, rate):
    assert one(spark, noise.char_error_rate(F.col("a"), F.col("b")), a=clean, b=noisy) == pytest.approx(rate)


@pytest.mark.parametrize("a, b", [("arnount", "amount"), ("8815", "881S"), ("l0O", "100"), ("commit-\nment", "commitment"), ("a  b\t\n c", "a b c")])
def test_canon_makes_equal(spark, a, b):
    assert one(spark, canon("a"), a=a) == one(spark, canon("a"), a=b)


@pytest.mark.parametrize("a, b", [("March", "April"), ("4500000", "4600000"), ("facility", "penalty"), ("8815-0", "8815-1")])
def test_canon_keeps_apart(spark, a, b):
    assert one(spark, canon("a"), a=a) != one(spark, canon("a"), a=b)


def test_canon_is_idempotent_and_defined_for_null(spark):
    once = one(spark, canon("a"), a=TEXT)
    assert one(spark, canon("a"), a=once) == once
    assert spark.range(1).select(canon(F.lit(None).cast("string"))).first()[0] == ""


def test_tokens(spark):
    assert one(spark, tokens("a"), a="Ab 1.2.3 x4,500 é.5") == ["ab", "1.2", "3", "x4", "500", "5"]


@pytest.mark.parametrize("passages, answer, exact, canonical", [(["due 4,500,000 now"], "4,500,000", True, True), (["due 4,S00,000"], "4,500,000", False, True), (["x", "in March"], "March", True, True), (["a b", "c d"], "b c", True, True), (["x"], "September", False, False), (["x"], "", True, True)])
def test_contains_answer(spark, passages, answer, exact, canonical):
    row = spark.createDataFrame([(passages, answer)], "p array<string>, a string")
    assert row.select(contains_answer(F.col("p"), "a"), contains_answer(F.col("p"), "a", True)).first()[:] == (exact, canonical)


def test_keyed_numbers_agree_with_numpy(spark):
    import numpy as np

    got = spark.range(200).select(keyed.uniform(keyed.key_of(F.lit(7), F.lit("x")), F.col("id"), 3).alias("u")).toPandas()["u"].to_numpy()
    want = keyed.np_uniform(keyed.np_key(7, "x"), np.arange(200), 3)
    assert (got == want).all() and 0 <= want.min() and want.max() < 1 and 0.4 < want.mean() < 0.6


@pytest.mark.parametrize("family", noise.FAMILIES)
def test_family(spark, family):
    def run(rate, seed=7):
        return [r["text"] for r in noise.corrupt(rows(spark), {family: rate}, seed).orderBy("id").collect()]

    clean = [r["text"] for r in rows(spark).orderBy("id").collect()]
    assert run(0.0) == clean
    assert run(0.9) != clean
    assert run(0.5) == run(0.5)
    assert run(0.5) != run(0.5, seed=8)


def test_redaction_shortens_without_a_mark_and_header_only_adds(spark):
    short = noise.redact(TEXT, 0.3, 5)
    assert len(short) < len(TEXT) and set(short.split()) <= set(TEXT.split())
    row = noise.corrupt(rows(spark, 1), {"header": 2.0}).first()
    lines = row["text"].split("\n")
    assert "".join(lines[::2]) == TEXT * 4 + "0" and len(lines) == 5
    assert row["doc_title"] == "Title" and row["indexed"] == "Title Sec " + row["text"]


def test_walks_equal_scans():
    """The walk over hits against a scan of every character or word in turn."""
    import random

    import numpy as np

    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("clvrn fitiB.8 ") for _ in range(rng.randint(0, 60)))
        u = keyed.np_uniform(9, np.arange(max(1, len(text)) + 1))
        out, i = "", 0
        while i < len(text):
            pair = text[i : i + 2]
            if u[i] < 0.5 and pair in noise.PAIRS:
                out, i = out + noise.PAIRS[pair], i + 2
            else:
                out, i = out + (noise.SINGLES.get(text[i], text[i]) if u[i] < 0.5 else text[i]), i + 1
        assert noise.confuse(text, 0.5, 9) == out
        words, kept, i = text.split(" "), [], 0
        spans = keyed.np_uniform(9, np.arange(len(words)), 1)
        while i < len(words):
            if u[i] < 0.3:
                i += 1 + int(spans[i] * 4)
            else:
                kept, i = kept + [words[i]], i + 1
        assert noise.redact(text, 0.3, 9) == " ".join(kept)


def test_corrupt_keeps_ids_and_is_a_copy(spark):
    out = noise.corrupt(rows(spark), {}).orderBy("id").collect()
    assert [r["id"] for r in out] == ["c0", "c1", "c2"] and [r["text"] for r in out] == [r["text"] for r in rows(spark).collect()]


def test_ladder(spark):
    labels = [label for label, _ in noise.CONDITIONS]
    assert noise.CONDITIONS[0] == ("clean", {}) and len(labels) == len(set(labels)) == 18
    assert {f for _, spec in noise.CONDITIONS for f in spec} <= set(noise.FAMILIES)
    assert noise.conditions(spark, quick=True).count() == 2 and noise.conditions(spark, as_is=True).first()["label"] == "as-is"


def test_error_rate_rises_along_the_ladder(spark):
    chunks = corpus.chunks(spark).where("id < 24").persist()
    cer = {r["condition"]: r["cer"] for r in noise.mean_error_rate(chunks, noise.corrupt_all(chunks, noise.conditions(spark))).collect()}
    assert cer["clean"] == 0 and len(cer) == 18
    for kind in ("ocr", "whitespace", "hyphen", "header", "redaction"):
        values = [cer[label] for label, _ in noise.CONDITIONS if label.startswith(kind)]
        assert values == sorted(values) and values[0] > 0
    assert abs(cer["ocr cer~5%"] - 0.05) < 0.03


def test_corpus(spark):
    both = corpus.generated(spark).orderBy("id").toPandas()
    assert both["id"].tolist() == list(range(132)) and both["question"].nunique() == 132
    assert not both["text"].str.contains("[{}]").any()
    assert all(a in t for a, t in zip(both["answer"], both["text"], strict=True))
    assert both.equals(corpus.generated(spark).orderBy("id").toPandas())
    own = corpus.checked(both.pipe(spark.createDataFrame), corpus.CHUNKS)
    assert own.columns == ["id", "doc_id", "doc_title", "section", "text"]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        below = [i + 1]
        for j, y in enumerate(b):
            below.append(min(row[j + 1] + 1, below[j] + 1, row[j] + (x != y)))
        row = below
    return row[-1]


def test_edits_against_the_whole_table_of_distances():
    draw = random.Random(5)
    for longest in [12] * 2000 + [300] * 20:
        a, b = ("".join(draw.choice("abcé ") for _ in range(draw.randint(0, longest))) for _ in range(2))
        assert noise.edits(a, b) == plain_distance(a, b)


def test_error_rates_of_long_texts_against_the_whole_table(spark):
    draw = random.Random(6)
    texts = ["", None, "x", *("".join(draw.choice("rnm clé. ") for _ in range(n)) for n in (40, noise.SHORT, noise.SHORT + 1, 900))]
    chunks = spark.createDataFrame([(i, "t", "s", t) for i, t in enumerate(texts)], "id long, doc_title string, section string, text string")
    ladder = noise.conditions(spark, quick=True)
    noisy = {(r["condition"], r["id"]): r["text"] for r in noise.corrupt_all(chunks, ladder).collect()}
    told = {r["condition"]: r["cer"] for r in noise.ladder_error_rates(chunks, ladder).collect()}
    for label in noise.QUICK:
        rates = [plain_distance(t, noisy[label, i]) / len(t) if t else 0.0 for i, t in enumerate(texts)]
        assert told[label] == pytest.approx(sum(rates) / len(texts))
    assert told["clean"] == 0 < told["scan-degraded"]


def test_walks_of_hyphens_and_headers_equal_the_expressions(spark):
    draw = random.Random(8)
    texts = ["", " ", "a. b. ", *("".join(draw.choice("abcdé .. \n") for _ in range(n)) for n in (30, 300, 3000))]
    held = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for family, walk in (("hyphenation", noise.hyphenate), ("header", noise.print_headers)):
        for rate in (0.1, 0.7, 2.0):
            key = keyed.key_of(F.lit(7), F.col("id"), F.lit(family))
            told = {r["id"]: r["x"] for r in held.select("id", noise.NOISE[family](F.col("text"), F.lit(rate), key).alias("x")).collect()}
            assert told == {i: walk(t, rate, keyed.np_key(7, i, family)) for i, t in enumerate(texts)}


def test_all_conditions_take_one_python_worker_a_task(spark):
    """Each family had a worker of its own, beside the others in every task."""
    plan = noise.corrupt_all(rows(spark), noise.conditions(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_batches_of_long_texts_are_small(spark):
    """A batch held 10,000 texts, however long."""
    held = spark.range(3000, numPartitions=1).select("id", F.repeat(F.lit("word "), 2000).alias("text"))
    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(most)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    noisy = noise.redaction_noise(F.col("text"), F.lit(0.1), F.col("id"))
    assert int(spark.conf.get(most)) <= 8 << 20
    assert held.select(noisy.alias("x")).where("length(x) < 10000").count() == 3000

    @F.pandas_udf("int")
    def size(texts):
        return texts.str.len() * 0 + len(texts)

    assert held.select(size("text").alias("n")).agg(F.max("n")).first()[0] * 10000 < 3 * (8 << 20)


def test_edits_within_what_the_noise_tells():
    """A band of the table gives the whole table's distance; noise that only adds or only takes away needs no table."""
    draw = random.Random(9)
    for n in [30] * 300 + [1500] * 3:
        clean = "".join(draw.choice("rnm clw. tif") for _ in range(n))
        for noisy, most in noise.damaged_texts(clean, [spec for _, spec in noise.CONDITIONS], 7, "x", "text"):
            told = noise.edits(clean, noisy, most)
            assert told <= most and told == (plain_distance(clean, noisy) if n < 100 else noise.edits(clean, noisy))
        for more in (0, 1, 7):
            assert noise.edits(clean, noisy, told + more) == told
    clean = "some words " * 200_000
    short = noise.redact(clean, 0.1, 5)
    assert noise.edits(clean, short, len(clean) - len(short)) == len(clean) - len(short)
