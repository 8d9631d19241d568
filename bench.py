"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evenkeel import registry  # noqa: E402

HEADLINE = [
    "fairness_report",
    "pr_auc",
    "baseline_fairness",
    "kfold_assign",
    "prepare_model",
    "one_hot",
    "median_impute",
    "scale_standard",
    "stratified_sample",
    "oversample",
    "ipw_weight",
    "kmeans_assign",
    "quadrant_oversample",
    "reweigh",
    "repair_feature",
    "summary_by_group",
    "summary_grouping_sets",
    "best_per_group",
    "tied_best",
    "best_vs_baseline",
    "box_stats",
    "paired_values_events",
    "a12_events",
    "wilcoxon_p_normal",
    "holm_adjust",
    "score_store_load",
    "score_lookup",
    "grid_enumerate",
    "ga_generation",
    "ga_search",
    "train_lr",
    "evaluate_practices",
    "run_grid_evaluated",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("evenkeel-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = registry.queries()
    spark.read.parquet(f"{folder}/region.parquet").count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
