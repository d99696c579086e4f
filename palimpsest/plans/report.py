"""Results as JSON, as a Markdown table and on the console."""

from __future__ import annotations

import json
import platform
import resource
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("condition", "retriever", "cer", "recall_at_5", "mrr_at_10", "ans_exact_at_5", "ans_canon_at_5", "p50_ms", "p95_ms", "index_mb")


def peak_rss_mb() -> float:
    used = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    return used / (1 << 20 if sys.platform == "darwin" else 1 << 10)


def meta(spark: SparkSession, **counts) -> dict:
    """Counts, versions, platform and memory of a run."""
    return {**counts, "spark": spark.version, "python": platform.python_version(), "platform": sys.platform, "peak_rss_mb": round(peak_rss_mb(), 1)}


def write_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_json(rows: DataFrame, path: str, about: dict) -> None:
    """One file with the run's meta and its rows; for reports, whose rows are conditions times retrievers."""
    with open(path, "w") as f:
        json.dump({"meta": about, "rows": [r.asDict() for r in rows.collect()]}, f, indent=1)


def markdown(rows: DataFrame, about: dict) -> str:
    have = [c for c in COLUMNS if c in rows.columns]
    cells = [F.coalesce(F.format_string("%.3f", c) if dict(rows.dtypes)[c] in ("double", "float") else F.col(c).cast("string"), F.lit("")) for c in have]
    lines = [r[0] for r in rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))).collect()]
    return "\n".join(["| " + " | ".join(have) + " |", "|" + " --- |" * len(have), *lines, "", "```", json.dumps(about, indent=1), "```", ""])


def show(rows: DataFrame) -> None:
    for r in rows.collect():
        print("  ".join(f"{v:.3f}" if isinstance(v, float) else str(v) for v in r))
