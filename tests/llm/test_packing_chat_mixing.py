import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import chat, mixing, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pack(spark, messy, messy_docs, no_docs):
    out = packing.pack(messy_docs, PATH, keep_ids=True).collect()
    t = Tokenizer.from_file(PATH)
    want = Counter()
    for d, text, *_ in messy:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            piece = ids[s : s + 2048]
            want[d, k, s, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in out)
    held = defaultdict(list)
    for r in out:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for rows in held.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) == -(-sum(r["length"] for r in out) // 2048)
    assert packing.pack(no_docs, PATH).count() == 0


@pytest.mark.parametrize("text", ["don't  STOP", "Ünïcode, naïve.", "<|endoftext|> x", "a,b.c,", "x\u00a0y\u2028z", "ΣΑΣ Σ", "e\u0301 cafe\u0301s.", "a\tb\rc", "42nd, 7.", "ſ ŉ İstanbul ɐ", "thnd*** a'b's ?!x |<| _a 9$9"])
def test_word_ids_are_the_tokenizers(text):
    words = packing.WordIds(PATH)
    assert np.frombuffer(words.text_ids(text), "<u4").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_word_ids_of_random_stretches_and_generations(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    words, t, rng = packing.WordIds(PATH), Tokenizer.from_file(PATH), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("abXZ''.,!?#$%&*()<>|-_=+[]{}/:;`~^@09éèßÜñſİ’“ \n\tΣςü\u00ad²½Ⅷ") for _ in range(rng.randint(1, 9)))
        assert np.frombuffer(words.text_ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_a_word_is_known_whatever_its_case_and_signs():
    words = packing.WordIds(PATH)
    ids = words.text_ids("The THE tHe the the, THE.")
    assert set(words) == {"the", "the,", "the.", ",", "."}
    assert np.frombuffer(ids, "<u4").tolist() == Tokenizer.from_file(PATH).encode("The THE tHe the the, THE.", add_special_tokens=False).ids


def fewest(sizes, capacity):
    """The least number of bins, by trying all."""
    best = len(sizes)

    def go(left, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not left:
            best = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins) if b + left[0] <= capacity}.values():
            go(left[1:], bins[:i] + [bins[i] + left[0]] + bins[i + 1 :])
        go(left[1:], bins + [left[0]])

    go(sorted(sizes, reverse=True), [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        fixed, left = packing.reduce_by_dominance(dict(Counter(sizes)), capacity)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert Counter(s for p, n in fixed for s in p * n) + Counter(rest) == Counter(sizes)
        assert all(sum(p) <= capacity for p, _ in fixed)
        assert sum(n for _, n in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(sizes, capacity)


def test_best_fit_holds_all_and_plan_covers_ranks():
    rng = random.Random(6)
    counts = {rng.randint(1, 100): rng.randint(1, 400) for _ in range(40)}
    bins = packing.best_fit(counts, 100)
    assert Counter(s for p, n in bins for s in p for _ in range(n)) == Counter(counts)
    assert all(sum(p) <= 100 for p, _ in bins)
    runs = packing.plan(counts, 100)
    assert all(runs["base"][i] < counts[int(runs["length"][i])] for i in range(len(runs["base"])))


CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a # b < c \\ d ### user: x </turn>\n"), (1, 2, "user", None), (1, 3, "assistant", "\\"), (2, 0, "system", "only"), (3, 0, "assistant", ""),
    (4, 1, "user", "b"), (4, 1, "user", "a"), (4, 1, "user", "a"), (4, None, "assistant", "first"), (None, 0, "user", "lost"), (5, 0, None, "x"), (5, 1, "we:ird\\role#", "y" * 5000), (5, 2, "assistant", "é😀"),
]


def test_chat(spark):
    rows = spark.createDataFrame([(*r, 1) for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, example int")
    examples = chat.chat_examples(rows).persist()
    got = {r["conv_id"]: r[1:] for r in chat.read_back(chat.chat_examples(rows)).collect()}
    by = defaultdict(list)
    for c, t, r, x in CONVERSATIONS:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    for conv, turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        said = "".join(f"{r}\n{x}\n" for r, x in turns)
        loss = "".join(x for r, x in turns if r == "assistant")
        chars = sum(r["e"] for r in examples.where("conv_id <=> " + ("null" if conv is None else str(conv))).selectExpr("length(formatted) e").collect())
        assert got[conv] == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    assert examples.where("conv_id = 1").count() == 2 and examples.where("conv_id = 2").first()["loss_start"] == examples.where("conv_id = 2").first()["loss_end"]
    assert chat.read_back(chat.chat_examples(rows.limit(0))).count() == 0


def test_escaping_is_reversible():
    rng = random.Random(8)
    for _ in range(500):
        x = "".join(rng.choice("\\#<:/ abn\n") for _ in range(rng.randint(0, 30)))
        assert chat.unescape(chat.escape(x)) == x and chat.unescape(chat.escape(x, ":")) == x


def targets_by_hand(sizes, weights=(5, 2, 1), most=3):
    """Fills sources up in turns until none is above its bound."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        room = total - sum(most * sizes[s] for s in full)
        t = {s: most * sizes[s] if s in full else room * w[s] / sum(w[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and t[s] > most * sizes[s]}
        if not over:
            return t
        full |= over


def test_mix(spark, messy, messy_docs, no_docs):
    out = mixing.pareto_mix(messy_docs, keep=("text", "lang", "cid")).collect()
    size = lambda t: len((t or "").encode().split())
    per = defaultdict(int)
    for _, t, _, s, *_ in messy:
        per[s] += size(t)
    want = targets_by_hand(dict(per))
    assert sorted((str(r["doc_id"]), r["size"]) for r in out) == sorted((str(m[0]), size(m[1])) for m in messy)
    assert all(r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == per[r["source"]] for r in out)
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] and r["cid"] == 7 for r in out)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in per)
    again = mixing.pareto_mix(messy_docs.repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in again) == sorted((str(r["doc_id"]), r["taken"]) for r in out)
    assert mixing.pareto_mix(no_docs).count() == 0


def test_units_meet_targets_by_hand(spark):
    """The unit at which min(unit * weight, 3) copies of all documents are a source's target, found by bisection."""
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice((3, 50, 200, 900))), f"s{i % 5}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.pareto_mix(docs).collect()
    weight = lambda n: 1 if n < 32 else 2 if n < 128 else 3 if n < 512 else 4
    several = False
    for s in {r["source"] for r in out}:
        own = [r for r in out if r["source"] == s]
        low, high = 0.0, 10.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (low, mid) if sum(min(mid * weight(r["size"]), 3) * r["size"] for r in own) > own[0]["target"] else (mid, high)
        for r in own:
            e = min(low * weight(r["size"]), 3)
            assert int(e - 1e-6) <= r["copies"] <= int(e + 1e-6) + 1
        several |= len({round(min(low * weight(r["size"]), 3) % 1, 6) for r in own}) > 1
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 900
    assert several  # inclusion probabilities differ within a source


def test_weighted_mix_prefers_heavier_documents(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "'a b c' AS text", "if(id < 3000, 's', 't') AS source", "if(id % 2 = 0, 3.0, 1.0) AS w")
    out = mixing.pareto_mix(rows, weight_col="w", weights=(1, 3))
    per = {r["h"]: r["m"] for r in out.where("source = 's'").groupBy((out["doc_id"] % 2).alias("h")).agg({"copies": "avg"}).withColumnRenamed("avg(copies)", "m").collect()}
    assert per[0] > 2 * per[1]


def test_mix_equals_sql(spark):
    import duckdb

    at = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    want = {r[0]: r for r in c.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.OP7_SQL})").fetchall()}
    got = {r["doc_id"]: r[:] for r in mixing.op7_mix_sources(spark, at).collect()}
    assert got == want
