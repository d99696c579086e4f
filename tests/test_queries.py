"""Every query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from palimpsest import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents benchmark embeddings events"
SLOW = {"degradation_curve", "retriever_wins"}


@pytest.fixture(scope="module")
def base():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def canonical(frame):
    columns = sorted(frame.columns)
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - SLOW))
def test_query(spark, base, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name not in queries.SQL:
        assert len(got)
        return
    want = base.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_flagship(spark):
    rows = queries.flagship(spark, DATA)
    assert rows.count() > 0 and "is_gold" in rows.columns


def test_entry_point_without_the_llm_subpackage(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("palimpsest.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "palimpsest.llm", None)
    importlib.reload(__spark_entry__)
    assert set(__spark_entry__.queries()) == set(queries.QUERIES)
