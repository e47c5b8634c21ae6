"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (input folder), BENCH_CPUS (local cores), BENCH_RUNS
(runs per query, the fastest counts), BENCH_QUERIES (comma-separated names).
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from indexward.checks import queries
from indexward.sources import drop_scratch
from indexward.sources.bindings import bind_catalog

HEADLINE = (
    "inv_all", "inv_with_partitions_dedup", "plan_bloat_size", "plan_all_code", "plan_fleet", "page_drift_bloat", "waves",
    "waves_hot_tables", "worklist_commands", "integrity", "preflight", "lag_throttle", "lag_series", "state_merge",
    "state_apply", "prepared_run", "attempt_fold", "outcomes", "logbook_report", "log_json_roundtrip",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    seconds: dict[str, float] = {}
    try:
        # Deriving the catalog snapshot from the tables is a step of its own; the queries then read it.
        taken = []
        for _ in range(runs):
            drop_scratch(spark)
            start = time.perf_counter()
            bind_catalog(spark, folder)
            taken.append(time.perf_counter() - start)
        seconds["derive_catalog"] = round(min(taken), 3)
        for name in names:
            taken = []
            for _ in range(runs):
                start = time.perf_counter()
                registered[name](spark, folder).write.format("noop").mode("overwrite").save()
                taken.append(time.perf_counter() - start)
            seconds[name] = round(min(taken), 3)
    finally:
        drop_scratch(spark)
        spark.stop()
    scale = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()
