"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "s03_candles_hourly",
    "s03_candles_daily_brand",
    "s08_gap_fill",
    "i01_ema",
    "i14_rolling",
    "i16_volume",
    "i00_all_indicators",
    "k_patterns",
    "e07_bos",
    "e14_sweeps",
    "f04_snapshot_features",
    "d01_window_features",
    "d03_targets",
    "a01_regression_metrics",
    "g05_spearman",
    "m04_cross_validation",
    "r14_recommendation",
    "x04_decision",
    "q04_psi",
    "q16_health",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from sparkwick.plans import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    times = {}
    # the JVM and the code generator are warmed up once; every query is timed from its plan on
    QUERIES["s03_candles_hourly"](spark, sf).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        if only and name not in only:
            continue
        t0 = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
