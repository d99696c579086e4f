import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import common, ngram_join, paragraph_dedup, similarity, suffix_dedup, suffix_sort, word_runs
from palimpsest.llm.common import connected_components


def grams(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def join_by_hand(rows, width, percent):
    sets = [grams(t, width) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return Counter((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))), groups


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80), (2, 50)])
def test_join(spark, messy, messy_docs, width, percent):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard(messy_docs, width, percent).collect())
    want, groups = join_by_hand(messy, width, percent)
    assert got == want
    if width == 5:
        kept = ngram_join.keep_one_each(messy_docs, width, percent).collect()
        assert len(kept) == len(groups) and len(kept[0]) == 9
        assert sum(r["text"] == messy[3][1] for r in kept) == 1


def test_join_of_nothing(spark, no_docs):
    assert ngram_join.ngram_jaccard(no_docs).count() == 0 and ngram_join.keep_one_each(no_docs).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (4, 4), (3, -5)], "a long, b long")
    assert {r["node"]: r["component"] for r in connected_components(edges).collect()} == {1: -5, 2: -5, 3: -5, -5: -5, 8: 8, 9: 8}


def test_bands_reach_their_recall():
    for percent, recall in ((80, 0.999), (60, 0.99), (90, 0.95)):
        bands, rows = paragraph_dedup.tuned_bands(percent, recall)
        assert bands * rows <= 16 and 1 - (1 - (percent / 100) ** rows) ** bands >= recall


def sorted_by_hand(t, cap):
    t = [*t, 0]
    order = sorted(range(len(t)), key=lambda i: t[i:])
    common = [0] * len(t)
    for x in range(1, len(t)):
        a, b = order[x - 1], order[x]
        while common[x] < cap and max(a, b) + common[x] < len(t) and t[a + common[x]] == t[b + common[x]]:
            common[x] += 1
    return order, common


@pytest.mark.parametrize("held, base", [(1 << 20, 1 << 20), (8, 2), (5, 1)])  # in memory; spilled to disk, with recursion to the end
def test_suffix_sorting(held, base):
    rng = np.random.default_rng(7)
    for n in range(1, 120):
        for most in (1, 2, 4, 26, 300, 70_000):
            t = rng.integers(1, most + 1, n)
            if n % 3 == 0:
                t = np.tile(t[: max(1, n // 4)], 4)
            order, common = suffix_sort.sorted_suffixes(t, 20, held, base)
            assert (order.tolist(), common.tolist()) == sorted_by_hand(t.tolist(), 20)


def test_shards_far_larger_than_memory(spark):
    """A shard of the query's size spills and recurses, and marks what a count of all strings marks; so do values over 255."""
    rng = np.random.default_rng(5)
    pool = [rng.integers(97, 110, 3000) for _ in range(60)]
    text = np.concatenate([np.concatenate([pool[rng.integers(60)][rng.integers(900) :], rng.integers(97, 123, 700), [1]]) for _ in range(100)])
    for length in (200, 300):
        repeated, spills, levels = suffix_sort.repeated_starts(text, length, 4096, 256)
        assert len(text) > 64 * 4096 and spills > 10 and levels > 1
        raw = text.astype(np.uint8).tobytes()
        times = Counter(raw[i : i + length] for i in range(len(raw)))
        assert all(repeated[i] == (times[raw[i : i + length]] > 1) for i in range(len(raw) - length + 1) if b"\1" not in raw[i : i + length])
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(4000)]
    rows = []
    for k in range(4000):
        raw = " ".join(words[i] for i in rng.integers(0, 4000, 60)).encode()
        rows.append((k // 2, k, 201, bytearray(raw[:400] if k % 4 else (b"same " * 50 + raw)[:400])))
    found = suffix_dedup.sorted_hits(spark.createDataFrame(rows, "anchor long, context long, n int, bytes binary"), 200).persist()
    account = [r["froms"] for r in found.where("anchor is null").collect()]
    assert len(account) == 2 and all(spills > 10 and levels >= 1 for spills, levels in account)  # 1.6 MB in shards of the query's own settings
    assert found.where("anchor is not null").count() == 1000


def removed_by_hand(rows, length):
    raws = [(d, (t or "").encode()) for d, t, *_ in rows]
    times = Counter(raw[i : i + length] for _, raw in raws for i in range(len(raw) - length + 1))
    out = Counter()
    for d, raw in raws:
        flags = np.zeros(len(raw) + 2, np.int8)
        for i in range(len(raw) - length + 1):
            if times[raw[i : i + length]] > 1:
                flags[i + 1 : i + 1 + length] = 1
        kept = np.frombuffer(raw, np.uint8)[flags[1:-1] == 0].tobytes()
        out[d, len(raw), int(flags.sum()), int((np.diff(flags) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot, segment", [(2048, 1 << 17), (2, 1000)])  # the second: hot anchors, and texts in many pieces
def test_suffix_dedup(spark, messy, messy_docs, no_docs, hot, segment, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    short = [m for m in messy if m[1] is None or len(m[1]) < 50_000]
    docs = messy_docs.where("text is null or length(text) < 50000")
    if segment == 1 << 17:
        docs, short = messy_docs, messy
    got = Counter(r[:] for r in suffix_dedup.suffix_dedup(docs, keep_text=False).collect())
    assert got == removed_by_hand(short, 200)
    assert suffix_dedup.suffix_dedup(no_docs).count() == 0


def test_text_runs_hold_every_start(monkeypatch):
    rng = np.random.default_rng(3)
    raws = [rng.integers(97, 100, n).astype(np.uint8).tobytes() for n in (0, 199, 200, 201, 5000, 263)] + [b"a" * 900]
    for segment in (1 << 20, 700):
        monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
        starts = defaultdict(list)
        names = defaultdict(set)
        for k, s, n, _, name in (row for run in suffix_dedup.text_runs(raws, 200) for row in zip(*(x.tolist() for x in run), strict=True)):
            names[raws[k][s : s + n + 199]].add(name)
            starts[k] += range(s, s + n)
        assert all(len(x) == 1 for x in names.values()) and len(set().union(*names.values())) == len(names)
        assert all(starts[k] == list(range(max(0, len(r) - 199))) for k, r in enumerate(raws))


def test_join_query_equals_sql(spark):
    import duckdb

    at = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    want = sorted(c.execute(f"SELECT doc_id, n_shingles, component_id FROM ({ngram_join.OP6_SQL})").fetchall())
    assert sorted(r[:] for r in ngram_join.op6_ngram_jaccard_join(spark, at).select("doc_id", "n_shingles", F.col("component_id")).collect()) == want


def test_paragraphs_under_one_name_are_told_apart_and_still_cut(spark):
    one, two, other = ([f"{c}{k}" for k in range(60)] for c in "abc")
    texts = {1: one, 2: two, 3: one, 4: two, 5: other}
    docs = spark.createDataFrame([(False, d, 0, " ".join(t)) for d, t in texts.items()], "unnamed boolean, doc long, row_hash long, text string")
    found = spark.createDataFrame([(False, d, 0, 0, 60, 9 if t is other else 7, "abc".index(t[0][0]), []) for d, t in texts.items()], "unnamed boolean, doc long, row_hash long, pos int, size int, name long, n int, keys array<long>")
    seen = []

    def none(clashes):
        seen.append(clashes)
        return spark.createDataFrame([], "key long, cid long, place long")

    spans = paragraph_dedup.repeated_paragraphs(found, docs, 80, none).collect()
    assert seen == [frozenset({7})]
    assert sorted((r["doc"], r["span"]["a"], r["span"]["b"]) for r in spans) == [(3, 0, 60), (4, 0, 60)]


def test_shingles_of_clashing_names_go_by_both_hashes(spark):
    texts = [" ".join(f"{c}{k}" for k in range(9)) for c in "ab"]
    docs, counts = spark.createDataFrame([(t,) for t in texts], "text string"), np.zeros(1 << 20, np.int64)
    flat, of, starts = word_runs.streams(texts[:1])
    first, size, _ = paragraph_dedup.paragraphs_of(flat, of, starts)
    longest = size.argmax()
    name = int(paragraph_dedup.names_of(flat, first, size).view(np.int64)[longest])
    second = int(paragraph_dedup.second_names(flat, first, size)[longest])
    plain, told = ({r["cid"] for r in paragraph_dedup.first_shingles(docs, counts, 80, c).collect()} for c in (frozenset(), frozenset({name})))
    by_column = spark.range(1).select(paragraph_dedup.renamed(F.lit(name).cast("long"), F.lit(second))).first()[0]
    assert told == plain - {name} | {by_column} and by_column != name


def test_components_of_few_edges_take_few_jobs_and_rounds_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-150, 150, (160, 2))] + [(k, k + 1) for k in range(1000, 1100)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("components", "")
    found = sorted(map(tuple, connected_components(edges).collect()))
    spark.sparkContext._jsc.clearJobGroup()
    assert len(tracker.getJobIdsForGroup("components")) <= 5
    monkeypatch.setattr(common, "EDGES_AT_ONCE", 0)
    assert sorted(map(tuple, connected_components(edges).collect())) == found
    monkeypatch.undo()
    assert connected_components(edges.where("a > 5000")).collect() == []


def test_a_goal_of_paragraphs_takes_a_few_numbers(spark, monkeypatch):
    """Wanted sets are broadcast as arrays of numbers; arrays of rows took the driver's memory."""
    kinds = []
    monkeypatch.setattr(paragraph_dedup, "materialize", lambda df, name: (name == "paragraph-goals" and kinds.append(dict(df.dtypes))) or common.materialize(df, name))
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:30], "x", *words[31:]]))], "doc_id long, text string")
    cut = {r["doc_id"]: r["n_removed"] for r in paragraph_dedup.substring_dedup(docs, least=20).collect()}
    assert cut[1] == 0 and cut[2] > 0
    assert kinds and all(set(k.values()) <= {"boolean", "bigint", "array<bigint>", "array<int>"} for k in kinds)


def test_pairs_of_a_crowd_that_differ_too_much_do_not_become_rows(spark, monkeypatch):
    """Variants of one set, most of them just below the threshold: a row for each pair grew with the square of their number."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 45).astype(np.uint64)
    sets = {}
    for c in range(150):  # a run of five hashes is exchanged, in some of them as in one other
        at = int(rng.integers(0, 41))
        new = rng.integers(0, 1 << 62, 5).astype(np.uint64)
        sets[c] = np.sort(np.concatenate([base[:at], new, base[at + 5 :]]))
        if c % 10 == 0:
            sets[1000 + c] = np.sort(np.concatenate([base[:at], new[:4], rng.integers(0, 1 << 62, 1).astype(np.uint64), base[at + 5 :]]))
    count = Counter(int(h) for s in sets.values() for h in s)
    postings = []
    for c, s in sets.items():
        first = sorted(s.tolist(), key=lambda h: (count[h], h))[: similarity.offered(45, 80)]
        postings += [(h, c, similarity.packed(45, k)) for k, h in enumerate(first)]
    similar = {(a, b) for a in sets for b in sets if a < b and 100 * len(o := np.intersect1d(sets[a], sets[b])) >= 80 * (90 - len(o))}
    checked = []

    def verify(pairs):
        checked.append({r[:] for r in pairs.select("a", "b").collect()})
        return spark.createDataFrame(sorted(checked[-1] & similar), "a long, b long")

    homes = spark.createDataFrame([(c,) for c in sets], "cid long")
    made = spark.createDataFrame([(c, s.tobytes()) for c, s in sets.items()], "cid long, hashes binary")
    make = lambda tasks: tasks.select("cid").join(made, "cid")
    near = similarity.link_classes(spark.createDataFrame(postings, "key long, cid long, place long"), verify, 80, rounds=1, sketch=lambda some: similarity.sketches(some, homes, make))
    want = {int(n): int(c) for n, c in zip(*common.least_of_component(*np.array(sorted(similar)).T), strict=True)}
    assert {r["node"]: r["component"] for r in near.collect()} == want
    assert len(checked[-1]) < 2 * len(similar) and (checked[-1] - similar)


def python_in_a_row(df):
    """The most Python functions that one task of a frame's plan runs, each in a worker of its own."""

    def walk(node, n):
        n = 0 if "Exchange" in node.nodeName() else n + (node.nodeName() == "MapInArrow")
        below = node.children()
        return max([n, *(walk(below.apply(k), n) for k in range(below.size()))])

    plan = df._jdf.queryExecution().executedPlan()
    return walk(plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan, 0)


def test_no_task_of_substring_dedup_holds_two_python_workers(spark, monkeypatch):
    """Workers stay when a task is through, so sketches drawn right behind their sets kept four in an executor of two cores."""
    deepest = {}

    def noted(df, name):
        deepest[name] = max(deepest.get(name, 0), python_in_a_row(df))
        return common.materialize(df, name)

    for module in (paragraph_dedup, similarity, word_runs):
        monkeypatch.setattr(module, "materialize", noted)
    monkeypatch.setattr(similarity, "CROWD", 1)
    shared = [f"w{k}" for k in range(25)]
    texts = [" ".join([*shared, *(f"own{i}x{k}" for k in range(20))]) for i in range(6)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0].replace("own0x9", "other"), texts[0].replace("own0x19", "other")])), "doc_id long, text string")
    cut = {r["doc_id"]: r["n_removed"] for r in paragraph_dedup.substring_dedup(docs, least=40).collect()}
    assert {d for d, n in cut.items() if n} == {7}
    assert {"link-sketches", "paragraph-rarest"} <= deepest.keys()
    assert max(deepest.values()) == 1, deepest
