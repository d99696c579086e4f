import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import bm25, hybrid, metrics, ranking
from palimpsest.plans import degradation, probe, report
from palimpsest.sources import fixtures

DOCS = [(0, "alpha beta beta 1.5"), (1, "beta gamma"), (2, ""), (3, None), (4, "alpha alpha delta beta epsilon")]


def by_hand(docs, query, k1=1.2, b=0.75):
    split = lambda t: re.findall(r"[a-z0-9]+(?:\.[0-9]+)?", (t or "").lower())
    own = {i: split(t) for i, t in docs}
    mean = sum(map(len, own.values())) / len(own) or 1.0
    df = Counter(w for t in own.values() for w in set(t))
    out = {}
    for i, t in own.items():
        for w in split(query):
            tf = t.count(w)
            if tf:
                idf = math.log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5))
                out[i] = out.get(i, 0) + tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / mean)) * idf
    return out


@pytest.mark.parametrize("query", ["alpha beta", "beta beta 1.5", "nothing here", ""])
def test_scores_are_the_formula(spark, query):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    asked = spark.createDataFrame([(7, query)], "qid long, question string")
    got = {r["id"]: r["score"] for r in bm25.scores(docs, asked).collect()}
    assert got == pytest.approx(by_hand(DOCS, query))


def test_empty_corpus_and_zero_denominator(spark):
    none = spark.createDataFrame([], "id long, text string")
    asked = spark.createDataFrame([(7, "alpha")], "qid long, question string")
    assert bm25.scores(none, asked).count() == 0
    docs = spark.createDataFrame(DOCS, "id long, text string")
    assert {r["score"] > 0 for r in bm25.scores(docs, asked, k1=0.0).collect()} == {True}


def ranks(spark, lists):
    return spark.createDataFrame([(str(k), 0, i, r + 1) for k, ids in enumerate(lists) for r, i in enumerate(ids)], "retriever string, qid long, id long, rank int")


@pytest.mark.parametrize("k", [1, 60, 500])
def test_fusion(spark, k):
    score = lambda *lists: {r["id"]: r["score"] for r in ranking.fuse(ranks(spark, lists), k).collect()}
    s = score([0, 1, 2], [0, 2, 1])
    assert max(s, key=s.get) == 0
    s = score([2, 1, 0], [0, 1, 2])
    assert s[0] == pytest.approx(s[2]) and s[0] > s[1]
    assert set(score([7], [7])) == {7} and score([]) == {}


def test_full_rankings_hold_every_id_and_ties_go_by_id(spark):
    scores = spark.createDataFrame([(0, 2, 1.0), (0, 1, 1.0)], "qid long, id long, score double")
    out = ranking.rank_all(scores, spark.range(4).toDF("id"), spark.createDataFrame([(0,), (1,)], "qid long"))
    got = {q: [r["id"] for r in sorted(out.where(F.col("qid") == q).collect(), key=lambda r: r["rank"])] for q in (0, 1)}
    assert got == {0: [1, 2, 0, 3], 1: [0, 1, 2, 3]}


def test_dense_blocks_equal_expression(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0, -0.5 * i]) for i in range(30)], "id long, embedding array<double>")
    q = v.where("id < 7").withColumnRenamed("id", "qid")
    a = {(r["qid"], r["id"]): r["score"] for r in ranking.dense_scores(v, q, block=4).collect()}
    b = {(r["qid"], r["id"]): r["score"] for r in ranking.dense_pairs(v, q).collect()}
    assert a == pytest.approx(b) and len(a) == 210
    unit = v.select(ranking.norm(ranking.normalised(F.col("embedding"))).alias("n")).collect()
    assert all(r["n"] == pytest.approx(1) for r in unit)


@pytest.mark.parametrize("ranked, gold, k, recall, rr", [([3, 7, 1], 7, 5, 1, 0.5), ([3, 7, 1], 1, 2, 0, 0), ([5, 9, 2], 5, 10, 1, 1), ([5, 9, 2], 42, 10, 0, 0)])
def test_metrics(spark, ranked, gold, k, recall, rr):
    rows = ranks(spark, [ranked]).withColumn("gold_chunk_id", F.lit(gold))
    assert rows.groupBy("qid").agg(metrics.recall_at(k), metrics.reciprocal_rank_at(k)).first()[1:] == (recall, rr)


def test_evaluate_counts_questions_without_hits(spark):
    chunks = spark.createDataFrame([(0, "the answer is 5"), (1, "nothing")], "id long, indexed string")
    asked = spark.createDataFrame([(0, "answer is", 0), (1, "missing", 9)], "qid long, answer string, gold_chunk_id long")
    found = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 1, 2)], "retriever string, qid long, id long, rank int")
    r = metrics.evaluate(found, asked, chunks).first()
    assert r[1:] == (0.5, 0.5, 0.5, 0.5)


def test_latency_place(spark):
    rows = spark.range(132).select(F.col("id").cast("double").alias("v"))
    assert metrics.latency(rows, "v").first()[:] == (65.5, 125.0)
    assert metrics.latency(rows.where("v < 100"), "v").first()["p95"] == 95.0


def test_hybrid_account_and_wins(spark):
    parts = spark.createDataFrame([("c", "bm25-canon", 1.0, 10, 2.0, 0.5), ("c", "dense", 3.0, 20, 4.0, 0.5)], "condition string, retriever string, build_ms double, bytes long, query_ms double, fusion_ms double")
    r = metrics.accounted(parts).where("retriever = 'hybrid'").first()
    assert (r["build_ms"], r["bytes"], r["query_ms"]) == (4.0, 30, 6.5)
    told = spark.createDataFrame([(c, r, v) for c, a, b in (("x", 0.5, 0.4), ("y", 0.5, 0.5), ("z", 0.1, 0.4)) for r, v in (("a", a), ("b", b))], "condition string, retriever string, recall_at_5 double")
    assert metrics.compare(told, "a", "b").first()[:] == (1, 1, 1)


def test_curve_and_reports(spark, tmp_path):
    rows = degradation.degradation(spark, quick=True).orderBy("condition", "retriever").persist()
    assert rows.count() == 8
    got = {(r["condition"], r["retriever"]): r for r in rows.collect()}
    assert got["clean", "bm25"]["cer"] == 0 and got["clean", "bm25"]["recall_at_5"] > 0.8
    assert got["scan-degraded", "bm25-canon"]["recall_at_5"] > got["scan-degraded", "bm25"]["recall_at_5"]
    about = report.meta(spark, chunks=132)
    report.write_json(rows, str(tmp_path / "r.json"), about)
    assert report.markdown(rows, about).count("\n| ") == 9  # a rule and eight rows
    report.write_rows(rows, str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 8


@pytest.mark.parametrize("mode", ["bm25", "ingest"])
def test_probe(spark, mode):
    assert probe.probe(spark, mode, queries=1)["mode"] == mode
    with pytest.raises(ValueError):
        probe.probe(spark, "other")


def test_first_of_all_pairs_are_those_of_the_window(spark, monkeypatch):
    """Only each query's first become rows, with ties by id over blocks and tasks, as rounded scores have them."""
    draw = random.Random(4)
    some = [[draw.choice((-1.0, 0.0, 0.5, 1.0)) + draw.choice((0, 1e-10, 4e-10)) for _ in range(3)] for _ in range(40)]
    v = spark.createDataFrame([(i, draw.choice(some)) for i in range(1500)], "id long, embedding array<double>").repartition(5)
    q = v.where("id % 3 = 0").withColumnRenamed("id", "qid")
    monkeypatch.setattr(ranking, "AT_ONCE", 100)
    show = lambda rows: {(r["qid"], r["rank"]): r["id"] for r in rows.collect()}
    first = ranking.dense_first(v, q, 7)
    assert show(ranking.top_k(first, 7)) == show(ranking.top_k(ranking.dense_pairs(v, q), 7))
    assert first.count() < 500 * 7 * 100 < 500 * 1500


def test_rounded_places_are_those_of_spark(spark):
    x = [0.0, -0.0, 1.5e-9, 2.5e-9, -2.5e-9, 0.1234567885, 0.1234567895, -0.0000000005, 4.9999999999e-10, 123456.1234567895, 3.0]
    want = [round(r[0] * 10**9) for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 9)).collect()]
    assert ranking.places_of(np.array(x)).tolist() == want


def test_extremes_of_all_pairs(spark):
    """Least, most and mean come from blocks; no pair is a row of the plan."""
    v = spark.createDataFrame([(i, [float(i % 7), 1.0, -0.5 * i]) for i in range(700)], "id long, embedding array<double>")
    q = v.where("id < 300").withColumnRenamed("id", "qid")
    pairs = ranking.dense_pairs(v, q).groupBy("qid").agg(F.min("score").alias("least"), F.max("score").alias("most"), F.avg("score").alias("mean"))
    told = ranking.dense_extremes(v, q)
    want = {r["qid"]: r[1:] for r in pairs.collect()}
    got = {r["qid"]: r[1:] for r in told.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_scores_are_made_where_documents_are_read(spark):
    """Postings were shuffled by document, by term and by document again; a task now gives each question's first, ties by id."""
    draw = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(draw.choice(["ab", "cd", "ef", "gh", "zz"]) for _ in range(draw.randint(0, 4)))) for i in range(3000)], "id long, text string").repartition(7)
    asked = spark.createDataFrame([(1, "ab cd"), (2, "gh"), (3, "nothing")], "qid long, question string")
    full, first = bm25.scores(docs, asked), bm25.scores(docs, asked, first=9)
    assert "Exchange" not in plan_of(full) and "Exchange" not in plan_of(first)
    show = lambda rows: {(r["qid"], r["rank"]): r["id"] for r in ranking.top_k(rows, 9).collect()}
    assert show(first) == show(full) and len(show(full)) == 18 and first.count() < full.count()
    want = by_hand([tuple(r) for r in docs.collect()], "ab cd")
    assert {r["id"]: r["score"] for r in full.where("qid = 1").collect()} == pytest.approx(want)


def test_holders_are_those_that_contain_the_item(spark):
    draw = random.Random(3)
    some = lambda n: " ".join(draw.choice(["a", "b", "c", "", "dé"]) for _ in range(n))
    items = [(i, some(n)) for i, n in enumerate([3, 5, 6, 6, 7, 8, 6, 7])]
    bodies = [None, "", *(some(draw.randint(0, 60)) for _ in range(300)), *("x" + t + "y " + some(3) for _, t in items)]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, body string")
    found = fixtures.holders(spark.createDataFrame(items, "item_id long, text string"), docs)
    assert "Exchange" not in plan_of(found)
    got = sorted((r["item_id"], r["doc_id"]) for r in found.collect())
    assert got == sorted((i, d) for i, t in items for d, b in enumerate(bodies) if b is not None and t in b) and len(got) > 20


def test_fusion_by_counted_places_equals_full_rankings(spark):
    """Neither the first k nor all fused scores take a ranking of all documents; ties, no scores and negative ones included."""
    draw = random.Random(7)
    text = lambda: " ".join(draw.choice(["ab", "cd", "ef", "gh", "zz"]) for _ in range(draw.randint(0, 3)))
    docs = spark.createDataFrame([(i, text()) for i in range(700)], "id long, text string").repartition(5)
    vectors = spark.createDataFrame([(i, [float(draw.randint(-2, 2)), float(draw.randint(-1, 1))]) for i in range(0, 900, 3)], "id long, embedding array<float>")
    asked = spark.createDataFrame([(3, "ab cd"), (6, "gh"), (9, "nothing"), (10, "ef")], "qid long, question string")
    own = asked.join(vectors, F.col("qid") == F.col("id")).select("qid", "embedding")
    dense = ranking.dense_scores(vectors.join(docs.select("id"), "id", "left_semi"), own)
    full = lambda s, name: ranking.rank_all(s, docs.select("id"), asked.select("qid")).withColumn("retriever", F.lit(name))
    parents = full(bm25.scores(docs, asked, True), "bm25-canon").unionByName(full(dense, "dense"))
    want = ranking.fuse(parents)
    held = hybrid.both(docs, asked, vectors, own)
    scores = lambda rows: {(r["qid"], r["id"]): r["score"] for r in rows.collect()}
    every = scores(hybrid.fused_all(held))
    assert len(every) == 4 * 700 and every == pytest.approx(scores(want))
    places = lambda rows: {(r["retriever"], r["qid"], r["rank"]): r["id"] for r in rows.collect()}
    first = hybrid.first_of_all(held, 10)
    expected = parents.where("rank <= 10").unionByName(ranking.top_k(want, 10).withColumn("retriever", F.lit("hybrid")))
    assert places(first) == places(expected)
    assert "Window" not in plan_of(hybrid.fused_all(held))


def test_postings_are_counted_where_documents_are_read(spark):
    """Postings were shuffled to be counted, and sorted to meet their terms' weights."""
    docs = spark.createDataFrame(DOCS, "id long, text string")
    rows = bm25.tokenized(docs)
    own = bm25.postings(rows)
    assert "Exchange" not in plan_of(own)
    split = {i: re.findall(r"[a-z0-9]+(?:\.[0-9]+)?", t or "") for i, t in DOCS}
    want = {(i, w): (len(t), n) for i, t in split.items() for w, n in Counter(t).items()}
    assert {(r["id"], r["term"]): (r["dl"], r["tf"]) for r in own.collect()} == want
    assert "SortMergeJoin" not in plan_of(bm25.weighted(own, bm25.inverse_frequency(own, bm25.corpus_size(rows))))
