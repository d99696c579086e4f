import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cid long, key string, size int, part int"
WORDS = {"en": "the of and to in is that for with was on as by at from", "fr": "le la les des une dans qui que pour par sur avec est au du", "de": "der die das und ist von mit den dem ein eine nicht auf zu im"}


def sentence(rng, lang, n):
    common = WORDS[lang].split()
    return " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice(("ba", "ke", "li", "mo", "nu", "ra", "se", "ti")) for _ in range(rng.randint(1, 3))) + {"en": "ing", "fr": "eau", "de": "ung"}[lang] for _ in range(n))


def messy_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, near copies, shared passages."""
    rng = random.Random(11)
    rows = []
    passage = sentence(rng, "en", 70)
    for i in range(60):
        lang = ("en", "fr", "de")[i % 3]
        lines = [sentence(rng, lang, rng.randint(5, 60)) for _ in range(rng.randint(1, 6))]
        if i % 9 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        rows.append((i, "\n".join(lines), lang, f"s{i % 4}"))
    base = rows[4][1]
    for i in range(60, 72):  # copies and near copies
        words = base.split(" ")
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "en", "hot"))
    rows += [(72, None, None, None), (73, "", "en", ""), (74, " \n\t ", "en", "s1"), (75, "...!!! 123", "en", "s1"), (76, "é", "fr", "S0"), (77, "a b", "en", "s2"), (78, "A B", "en", "s2")]
    rows += [(79, "w" * 30_000 + " " + "x y z " * 20_000, "en", "s3"), (80, passage, None, None), (None, passage + " tail", "en", "s0"), (None, None, None, None), (81, "naïve #*$%&|<> | | |\n" * 30, "en", "s0")]
    rows += [rows[3], rows[3], (5, "another text under a used id " * 12, "en", "s0"), rows[72]]
    return [(d, t, lang, s, None if t is None else len(t), 7, "k", 3, None) for d, t, lang, s in rows]


@pytest.fixture(scope="session")
def messy():
    return messy_rows()


@pytest.fixture(scope="session")
def messy_docs(spark, messy):
    return spark.createDataFrame(messy, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(tmp_path_factory, spark, messy):
    """A table folder as queries read it."""
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(messy, SCHEMA).drop("cid", "key", "size", "part").write.parquet(str(at / "documents.parquet"))
    labels = [(d, None if i % 11 == 0 else int(t is not None and "#" not in t and i % 7 > 0), 0) for i, (d, t, *_) in enumerate(messy)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    return str(at)
