import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import kv, metrics, models
from palimpsest.plans import cli
from palimpsest.sources import weights
from palimpsest.streaming import rows as streams


@pytest.mark.parametrize("bits", [8, 4])
def test_round_trip_error_is_half_a_step(spark, bits):
    v = np.random.default_rng(1).normal(size=(20, 64)).tolist() + [[0.25] * 64]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, vec array<double>")
    q = kv.quantized(rows, bits).withColumn("back", kv.through(F.col("vec"), bits)).collect()
    for r in q:
        assert max(abs(a - b) for a, b in zip(r["vec"], r["back"], strict=True)) <= r["scale"] / 2 + 1e-12
        assert 0 <= min(r["q"]) and max(r["q"]) <= 2**bits - 1
    assert kv.quantized(rows, bits).where("id = 20").first()["scale"] == 1e-8


def test_packing_is_reversible_and_needs_an_even_count(spark):
    rows = spark.createDataFrame([([1, 15, 0, 9],), ([],)], "q array<smallint>")
    assert [r[:] for r in rows.select(kv.packed(F.col("q")), kv.unpacked(kv.packed(F.col("q")))).collect()] == [([241, 144], [1, 15, 0, 9]), ([], [])]
    with pytest.raises(Exception, match="odd"):
        spark.createDataFrame([([1],)], "q array<smallint>").select(kv.packed(F.col("q"))).collect()


def test_half_precision_is_numpys(spark):
    x = np.random.default_rng(2).normal(size=200).tolist() + [0.0, 1e-5, 1024.5]
    got = spark.createDataFrame([(x,)], "v array<double>").select(kv.half(F.col("v"))).first()[0]
    assert got == np.array(x).astype(np.float16).astype(float).tolist()


def test_bytes(spark):
    assert {r["bits"]: r["bytes_per_token"] for r in kv.bytes_per_token(spark).collect()} == {32: 73728, 16: 36864, 8: 20736, 4: 11520}


def test_cache_appends_in_order_and_tiles(spark):
    a = spark.createDataFrame([("k", 0, 0, t, [float(t)]) for t in (2, 0)], "side string, layer int, head int, token int, vec array<double>")
    b = spark.createDataFrame([("k", 0, 0, 1, [1.0])], a.schema)
    assert kv.sequences(kv.appended(a, b)).first()["vecs"] == [[0.0], [1.0], [2.0]]
    assert spark.range(1).select(kv.tiled(F.array(F.lit(1), F.lit(2)), 5)).first()[0] == [1, 2, 1, 2, 1]


def test_encoder(spark):
    w = models.toy_encoder()
    a = models.encode(["one two", "three", ""], w)
    assert np.allclose(np.linalg.norm(a, axis=1), 1, atol=1e-5)
    assert np.allclose(a[1], models.encode(["three"], w)[0], atol=1e-5)  # padding does not matter
    rows = spark.createDataFrame([(0, "one two"), (1, None)], "id long, t string")
    got = models.encoded(rows, "t", w).orderBy("id").collect()
    assert np.allclose(got[0]["embedding"], a[0], atol=1e-5) and np.allclose(got[1]["embedding"], a[2], atol=1e-5)


def test_cached_decoding_equals_full(spark):
    w = models.toy_decoder()
    ids = [5, 9, 33, 2, 17, 40]
    full = models.decode(ids, w, models.Cache())
    cache = models.Cache()
    step = np.concatenate([models.decode(ids[:3], w, cache)] + [models.decode([t], w, cache, 3 + k) for k, t in enumerate(ids[3:])])
    assert np.allclose(full, step, atol=1e-4)
    x = np.array([1.0, 2.0, 3.0])
    got = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(models.log_softmax_column(F.col("x"))).first()[0]
    assert np.allclose(got, models.log_softmax(x))


def test_sweep(spark):
    rows = {r["bits"]: r for r in cli.kv_table(spark, 24, 8).collect()}
    assert rows[32]["top1_agree"] == 1 and rows[32]["ppl_delta_pct"] == 0 and rows[32]["mem_ratio"] == 1
    assert abs(rows[16]["ppl_delta_pct"]) < 1 and rows[4]["mem_ratio"] < rows[8]["mem_ratio"] < 1


def test_missing_weights(tmp_path):
    with pytest.raises(weights.MissingWeights):
        weights.load(str(tmp_path))


def linear(rng, prefix, a, b, flip):
    return {f"{prefix}.weight": rng.normal(0, 0.2, (b, a) if flip else (a, b)).astype(np.float32), f"{prefix}.bias": rng.normal(0, 0.2, b).astype(np.float32)}


def norms(rng, prefix, n):
    return {f"{prefix}.weight": rng.normal(1, 0.1, n).astype(np.float32), f"{prefix}.bias": rng.normal(0, 0.1, n).astype(np.float32)}


def test_published_names_of_an_encoder():
    rng = np.random.default_rng(1)
    t = {f"embeddings.{n}_embeddings.weight": rng.normal(size=(k, 24)).astype(np.float32) for n, k in (("word", 40), ("position", 64), ("token_type", 2))}
    t |= norms(rng, "embeddings.LayerNorm", 24)
    for k in range(2):
        at = f"encoder.layer.{k}"
        for n in ("attention.self.query", "attention.self.key", "attention.self.value", "attention.output.dense"):
            t |= linear(rng, f"{at}.{n}", 24, 24, True)
        t |= linear(rng, f"{at}.intermediate.dense", 24, 96, True) | linear(rng, f"{at}.output.dense", 96, 24, True)
        t |= norms(rng, f"{at}.attention.output.LayerNorm", 24) | norms(rng, f"{at}.output.LayerNorm", 24)
    w = weights.encoder(t, heads=4)
    assert w["layers"] == 2 and {k: getattr(v, "shape", v) for k, v in w.items() if k.startswith("1.")} == {k: v.shape for k, v in models.toy_encoder(40, 24, 2, 4, 64).items() if k.startswith("1.")}
    out = models.encode(["a b", "c"], w, ids_of=lambda text, n: [1, *(3 + ord(c) % 30 for c in text.split())])  # a tokenizer of one's own
    assert out.shape == (2, 24) and np.allclose(np.linalg.norm(out, axis=1), 1, atol=1e-5)
    assert not np.allclose(out, models.encode(["a b", "c"], weights.encoder(t | {"encoder.layer.0.attention.self.query.weight": np.zeros((24, 24), np.float32)}, 4), ids_of=lambda text, n: [1, *(3 + ord(c) % 30 for c in text.split())]))


def test_published_names_of_a_decoder():
    rng = np.random.default_rng(2)
    t = {"transformer.wte.weight": rng.normal(size=(50, 16)).astype(np.float32), "transformer.wpe.weight": rng.normal(size=(32, 16)).astype(np.float32)} | norms(rng, "transformer.ln_f", 16)
    for k in range(2):
        at = f"transformer.h.{k}"
        t |= linear(rng, f"{at}.attn.c_attn", 16, 48, False) | linear(rng, f"{at}.attn.c_proj", 16, 16, False) | linear(rng, f"{at}.mlp.c_fc", 16, 64, False) | linear(rng, f"{at}.mlp.c_proj", 64, 16, False)
        t |= norms(rng, f"{at}.ln_1", 16) | norms(rng, f"{at}.ln_2", 16)
    w = weights.decoder(t, heads=2)
    ids = [5, 9, 33, 2]
    cache = models.Cache()
    step = np.concatenate([models.decode([i], w, cache, k) for k, i in enumerate(ids)])
    assert w["layers"] == 2 and np.allclose(models.decode(ids, w, models.Cache()), step, atol=1e-4)


@pytest.mark.parametrize("bits, size", [(32, 256), (16, 128), (8, 72), (4, 40)])
def test_cache_holds_codes(bits, size):
    """64 values a vector: payload, and two floats where it is quantized."""
    x = np.random.default_rng(3).normal(size=(2, 40, 64)).astype(np.float32)
    cache = models.Cache(bits)
    for k in range(40):
        back = cache.add(0, "k", x[:, k : k + 1])
    assert back.shape == x.shape and cache.nbytes == 2 * 40 * size
    step = (x.max(-1) - x.min(-1)) / (2 ** min(bits, 16) - 1)
    assert (np.abs(back - x).max(-1) <= (step * 0.51 if bits < 16 else 2e-3)).all()


def test_latency_places(spark):
    rng = np.random.default_rng(5)
    rows = [(None if k % 7 == 0 else f"t{k % 3}", float(rng.integers(0, 9)) if k % 5 else None) for k in range(400)]
    got = {r["t"]: (r["p50"], r["p95"]) for r in metrics.latency(spark.createDataFrame(rows, "t string, v double"), "v", ("t",)).collect()}
    for t in {t for t, _ in rows}:
        v = sorted(x for s, x in rows if s == t and x is not None)
        assert got[t] == (float(np.median(v)), v[len(v) * 95 // 100])
    assert metrics.latency(spark.createDataFrame(rows, "t string, v double"), "v").count() == 1


def test_row_operators_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, "d", "Title", "Sec", "rn 1.5 " * 20, [0.5, float(i)]) for i in range(4)], "id long, doc_id string, doc_title string, section string, text string, embedding array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = streams.read_parquet(spark, str(tmp_path / "in"), rows.schema)
    out = streams.run_once(streams.quantized(streams.canonical_tokens(streams.corrupted(stream, {"ocr": 0.2, "hyphenation": 0.05}))), "t")
    batch = streams.canonical_tokens(streams.corrupted(rows, {"ocr": 0.2, "hyphenation": 0.05}))
    assert {r["id"]: r["tokens"] for r in out.collect()} == {r["id"]: r["tokens"] for r in batch.collect()}


def test_windowed_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,id,0,0) AS ts, 'a' AS event_type, double(id) AS value FROM range(6)")
    rows.write.parquet(str(tmp_path / "in"))
    out = streams.run_once(streams.value_stats(streams.read_parquet(spark, str(tmp_path / "in"), rows.schema)), "w")
    assert all(r["n"] == 1 for r in out.collect())
