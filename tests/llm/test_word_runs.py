import random
from collections import defaultdict

import numpy as np
import pytest

from palimpsest.llm import paragraph_dedup, word_runs

LEAST = 50


def made(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def spans_by_hand(rows, least=LEAST, percent=80):
    """The merged spans of every document, all paragraphs compared with all and all windows with all."""
    docs = sorted({(d is None, d or 0, h, t) for d, h, t in rows if t is not None})
    words = [word_runs.words_of(t) for *_, t in docs]
    flat, of, starts = word_runs.streams([t for *_, t in docs])
    first, size, text = paragraph_dedup.paragraphs_of(flat, of, starts)
    assert sum(size) == len(flat) and all(of[f] == of[f + n - 1] for f, n in zip(first, size, strict=True))  # every word is in one
    places = [(int(k), int(f - starts[k]), int(n)) for k, f, n in zip(text, first, size, strict=True)]
    sets = [{tuple(words[k][i : i + 5]) for i in range(p, max(p + 1, p + n - 4))} if n >= 5 else {tuple(words[k][p : p + n])} for k, p, n in places]
    by = defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            by[g].add(i)
    root = list(range(len(places)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in set().union(*(by[g] for g in s)):
            if j < i and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    spans = defaultdict(list)
    for i, (k, p, n) in enumerate(places):
        if find(i) != i:
            spans[k].append((p, p + n))
    seen = {}
    for k, ws in enumerate(words):
        for p in range(len(ws) - least + 1):
            at = seen.setdefault(tuple(ws[p : p + least]), (k, p))
            if at != (k, p):
                a = max(p, at[1] + least) if at[0] == k else p
                if a < p + least:
                    spans[k].append((a, p + least))
    return {docs[k]: joined(v, least) for k, v in spans.items()}


def joined(spans, least):
    words = sorted({i for a, b in spans for i in range(a, b)})
    edges = [k for k in range(len(words)) if k == 0 or words[k] != words[k - 1] + 1] + [len(words)]
    return [(words[x], words[y - 1] + 1) for x, y in zip(edges, edges[1:], strict=False) if y - x >= least]


def test_runs_inside_longer_lines_and_across_lines(spark, tmp_path):
    rng = random.Random(5)
    passages = [made(rng, n) for n in (50, 63, 90)]
    inside = [" ".join(made(rng, 70) + p + made(rng, 60)) for p in passages for _ in range(3)]
    wrapped = ["\n".join([" ".join(made(rng, 7)), *[" ".join(p[k : k + 21]) for k in range(0, len(p), 21)], " ".join(made(rng, 9))]) for p in passages]
    clean = [" ".join(made(rng, 300)), "a heading of nine words that many documents have", "a heading of nine words that many documents have\n" + " ".join(made(rng, 30))]
    texts = [*inside, *wrapped, *clean]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    kept = {r["doc_id"]: r for r in paragraph_dedup.op8_substring_dedup(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        p = passages[i // 3 if i < 9 else i - 9] if i < 12 else None
        first = p is None or i < 9 and i % 3 == 0
        want = text.split() if first else [w for w in text.split() if w not in set(p)]
        left = kept[i]["text"].split()
        # a paragraph at a passage's edge goes whole if it is similar, so a few words beside may go too
        assert set(left) <= set(want) and len(want) - len(left) <= (0 if first else 20)
        assert (kept[i]["n_removed"] == 0) == first and kept[i]["n_spans"] == (not first)
        assert len(text) - len(kept[i]["text"]) == kept[i]["n_removed"]
    assert kept[10]["text"].count("\n") == 1  # lines beside a run stay apart


def test_passages_against_brute_force(spark):
    rng = random.Random(6)
    pool = [made(rng, rng.randint(40, 190)) for _ in range(14)]
    rows = []
    for i in range(90):
        words = [w for _ in range(rng.randint(0, 4)) for w in rng.choice((rng.choice(pool), made(rng, 20), rng.choice(pool)[rng.randint(0, 30) :]))]
        if i % 3 == 0:  # near copies: one word in 60 changed, put in or left out
            words = [w for x in words for w in ((x,) if rng.randrange(60) else rng.choice((("changed",), (x, "more"), ())))]
        rows.append((i // 2 if i % 5 else None, "".join(w + rng.choice((" ", " ", "\n", "\t \n")) for w in words)))
    han = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(80))
    rows += [rows[3], (70, "x y z " * 400), (71, "head " + "y z x " * 30), (72, None), (73, ""), (74, "q " * 49), (75, "q " * 51), (76, han), (77, f"« {han} » é"), (None, None)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, spans string, row_hash int").repartition(4).persist()
    hashed = [(r["doc_id"], r["h"], r["text"]) for r in docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()]
    want = {(None if unnamed else d, t): v for (unnamed, d, _, t), v in spans_by_hand(hashed).items()}
    out = paragraph_dedup.substring_dedup(docs.withColumn("whole", docs["text"]), recall=0.99999, keep=("whole", "spans", "row_hash")).collect()
    assert len(out) == len(rows) and sum(r["n_removed"] > 0 for r in out) > 20
    for r in out:
        told = [(x["a"], x["b"]) for x in r[-1]]
        assert told == want.get((r["doc_id"], r["whole"]), []) and r[2] == "x" and r["row_hash"] == 1
        assert r["text"] == (word_runs.without(r["whole"], told) if told else r["whole"])
        assert r["n_spans"] == len(told) and r["n_removed"] == len(r["whole"] or "") - len(r["text"] or "")


def test_messy_rows_and_nothing(spark, messy, messy_docs, no_docs):
    out = paragraph_dedup.substring_dedup(messy_docs, recall=0.99999, keep=("lang", "key", "n_chars")).collect()
    assert len(out) == len(messy)
    hashed = [(r["doc_id"], r["h"], r["text"]) for r in messy_docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()]
    want = spans_by_hand(hashed)
    told = sorted((r["doc_id"] is None, r["doc_id"] or 0, [(x["a"], x["b"]) for x in r["spans"]]) for r in out)
    assert told == sorted((d is None, d or 0, want.get((d is None, d or 0, h, t), [])) for d, h, t in hashed)
    assert paragraph_dedup.substring_dedup(no_docs).count() == 0


@pytest.mark.parametrize("reach", [24])
def test_passages_hold_alike_paragraphs(reach):
    """A passage is cut alike in other surroundings, from `reach` words after its start to `reach` before its end."""
    rng = random.Random(9)
    passage = made(rng, 400)
    cuts = []
    for n in (0, 3, 70):
        flat, of, starts = word_runs.streams([None, " ".join(made(rng, n) + passage + made(rng, n)), " ".join(made(rng, 9))])
        first, size, text = paragraph_dedup.paragraphs_of(flat, of, starts)
        cuts.append({int(f) - n for f, k in zip(first, text, strict=True) if k == 1 and n + reach <= f - starts[1] < n + 400 - reach - 5})
    assert cuts[0] == cuts[1] == cuts[2] and len(cuts[0]) > 4
    assert np.diff(sorted(cuts[0])).min() > reach


def cuts_against_brute_force(spark, texts, least):
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").persist()
    want = {d: v for (_, d, _, _), v in spans_by_hand([(r["doc_id"], r["h"], r["text"]) for r in docs.selectExpr("*", "xxhash64(text) AS h").collect()], least).items()}
    got = {r["doc_id"]: [(x["a"], x["b"]) for x in r["spans"]] for r in paragraph_dedup.substring_dedup(docs, least).collect()}
    assert {d: v for d, v in got.items() if v} == {d: v for d, v in want.items() if v}
    return want


def test_similar_paragraphs_without_a_common_band_are_linked(spark):
    rng = random.Random(1)
    some = [made(rng, 100) for _ in range(500)]
    flat, of, starts = word_runs.streams([" ".join(w) for w in some])
    _, size, text = paragraph_dedup.paragraphs_of(flat, of, starts)
    base = next(w for k, w in enumerate(some) if size[text == k].tolist() == [50, 50])
    # one word of each paragraph changed, so that no window of 50 words repeats and the similarity is 41 / 51
    near = [" ".join([*base[:25], f"v{k}", *base[26:75], f"u{k}", *base[76:]]) for k in range(3000)]
    flat, of, starts = word_runs.streams([" ".join(base), *near])
    first, size, text = paragraph_dedup.paragraphs_of(flat, of, starts)
    keys = paragraph_dedup.band_keys(word_runs.run_hashes(flat, 5), first, size - 4, *paragraph_dedup.tuned_bands(80))
    held = [(k, keys[text == k]) for k in range(1, 3001) if size[text == k].tolist() == [50, 50]]
    missed = [k for k, own in held if (own != keys[:2]).all(1).any()]
    assert missed
    want = cuts_against_brute_force(spark, [" ".join(base), near[missed[0] - 1]], LEAST)
    assert want[1] == [(0, 100)]


def test_equal_sets_of_few_shingles_are_linked(spark):
    assert cuts_against_brute_force(spark, ["a b c " * 2 + "a", "a b c " * 3], 9)[1] == [(0, 9)]
