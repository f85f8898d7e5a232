"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sievelab.plans.registry import QUERIES  # noqa: E402
from sievelab.session import local_session  # noqa: E402

HEADLINE = [
    "guard_code",
    "mean_impute",
    "standardize",
    "describe_features",
    "avg_rank_desc",
    "spearman_target",
    "spearman_pairs",
    "mic_grid",
    "mic_optimized",
    "train_test_split",
    "bootstrap_samples",
    "kfold_assign",
    "gram_matrix",
    "lasso_path",
    "step_forward",
    "rf_importance",
    "rf_bootstrap",
    "pair_table",
    "argmax_per_group",
    "status_upsert",
    "sink_importance",
    "feature_selection",
]

LONG = 30  # seconds; such a query runs once


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, app="sievelab-bench")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        first = run(spark, name, sf_dir)  # compiles the plan's code, which matters to short queries only
        seconds[name] = round(first if first > LONG else run(spark, name, sf_dir), 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
                "cpus": int(cores),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
