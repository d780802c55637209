"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``load_snapshot``, ``build_index`` and ``lay_out_entries`` are what a site pays once per scan,
``load_overlapping`` the same for a snapshot with overlapping scans; the other queries run
against the published snapshots and their directory indexes. Every query is run to its last
row into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from grovemeter.plans import catalog
from grovemeter.plans.sample import sample

HEADLINE = (
    "ingest_scan_csv",
    "inode_path",
    "path_string_agg",
    "find",
    "find_filtered",
    "du",
    "du_filtered",
    "find_overlapping_scans",
    "all_dir_usage_overlapping",
    "du_per_root",
    "children_usage",
    "all_dir_usage",
    "all_dir_usage_filtered",
    "top_directories",
    "age_history",
    "access_history",
    "unreadable_dirs",
    "unreadable_notices",
    "project_usage",
    "storage_grants_latest",
    "total_user_storage",
)


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark.read.parquet(f"{folder}/region.parquet"))  # start the engine

    loaded = sample(spark, folder)
    seconds = {
        "load_snapshot": timed(lambda: loaded.entries),
        "build_index": timed(lambda: loaded.bare_index),
        "lay_out_entries": timed(lambda: loaded.index),
        "load_overlapping": timed(lambda: loaded.overlapping_index),
    }
    queries = catalog.queries()
    for name in names or HEADLINE:
        seconds[name] = timed(lambda: run(queries[name](spark, folder)))
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall-clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])
