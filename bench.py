"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "m2_macro_env_pcc",
    "m10_split_metrics",
    "m14_run_metrics",
    "m18_env_spearman",
    "m19_spearman",
    "m20_ktau",
    "m21_rank_hinge",
    "d2_split_leo",
    "d7_split_lygo",
    "t5_marker_stats",
    "t7_env_residuals",
    "e1_fit_effects",
    "e8_fit_predict_score",
    "a12_novelty_trajectory",
    "a14_half_sib_counts",
    "a22_fold_similarity",
    "x2_grm",
    "k1_stack_moments",
    "k2_search_weights",
    "v8_rolling_additive",
    "w2_early_stop_trace",
    "b1_env_stratified_plan",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from trialspark.catalog import load_all

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:] if not a.startswith("-")]
    from trialspark.session import configured

    spark = (
        configured(SparkSession.builder.master(f"local[{cpus}]").appName("trialspark-bench"), int(cpus))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    registry["m6_mse"].run(spark, sf).collect()  # start-up and first file listing are not measured
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        begin = time.perf_counter()
        registry[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
