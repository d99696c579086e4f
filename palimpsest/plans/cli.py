"""Command line: python -m palimpsest.plans.cli curve [--quick] | kv [--prefill N --decode N] | probe [MODE] | corpus | noise."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import kv, models, noise
from palimpsest.plans import degradation, probe, report
from palimpsest.sources import corpus
from palimpsest.sources.shared import written


def kv_table(spark: SparkSession, prefill: int = 768, decode: int = 64):
    """Perplexity, agreement and memory by bit width, of the toy decoder over the corpus's text."""
    w = models.toy_decoder(longest=prefill + decode + 1)
    size = len(w["word"])
    text = " ".join(r["text"] for r in corpus.chunks(spark).orderBy("id").collect())  # the generated corpus: 132 chunks
    ids = [i % size for i in models.hashed_ids(text, 1 << 16)]
    ids = (ids * (-(-(prefill + decode) // len(ids))))[: prefill + decode]
    rows = spark.createDataFrame([(0, b, ids[:prefill], ids[prefill:]) for b in kv.BITS], "seq_id long, bits int, prefill array<int>, held_out array<int>")
    steps = written(models.decoded_steps(rows.repartition(len(kv.BITS)), w), "kv-steps")
    return kv.summary(steps, steps.groupBy("bits").agg((F.max("bytes") / 1e3).alias("mb")))  # as measured


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("what", choices=["curve", "kv", "probe", "corpus", "noise"])
    parser.add_argument("mode", nargs="?", default="hybrid")
    parser.add_argument("--quick", action="store_true")
    parser.add_argument("--prefill", type=int, default=768)
    parser.add_argument("--decode", type=int, default=64)
    parser.add_argument("--json")
    parser.add_argument("--markdown")
    told = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if told.what == "curve":
        rows = degradation.degradation(spark, quick=told.quick).orderBy("condition", "retriever").persist()
        about = report.meta(spark, chunks=132, questions=132)
        if told.json:
            report.write_json(rows, told.json, about)
        if told.markdown:
            with open(told.markdown, "w") as f:
                f.write(report.markdown(rows, about))
        report.show(rows)
    elif told.what == "kv":
        rows = kv_table(spark, told.prefill, told.decode).orderBy("bits").persist()
        if told.json:
            report.write_json(rows, told.json, report.meta(spark, prefill=told.prefill, decode=told.decode))
        report.show(rows)
    elif told.what == "probe":
        print(probe.probe(spark, told.mode))
    elif told.what == "corpus":
        corpus.generated(spark).orderBy("id").show(5, False)
    else:
        damaged = noise.corrupt_all(corpus.chunks(spark), noise.conditions(spark))
        report.show(noise.mean_error_rate(corpus.chunks(spark), damaged, first=3))


if __name__ == "__main__":
    main()
