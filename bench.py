"""Wall time per headline query; prints one JSON line.

Reads ``$BENCH_SF_DIR`` (default sf0.1) on ``local[$BENCH_CPUS]``. Each query is planned and run into a sink
that takes every column of every row. The first, uncounted query warms the JVM.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from evenstep.plans.queries import QUERIES

HEADLINE = [
    "clean_hourly",
    "complete_grid",
    "arrival_disorder",
    "validation_report",
    "chronological_split",
    "calendar_features",
    "lag_features",
    "rolling_features",
    "feature_frame",
    "horizon_targets",
    "gap_segments",
    "window_manifest",
    "sequence_windows",
    "scaled_features",
    "seasonal_naive",
    "rmse_by_step",
    "linear_forecast",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("evenstep-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    run(HEADLINE[0])
    seconds = {name: run(name) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
