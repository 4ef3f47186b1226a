"""Times the headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tidewater import queries as core

HEADLINES = ("flagship", "win_multi_frame", "win_ties_running", "sum_cate", "sum_cate_where", "top_n_value_sum_cate_where", "top_value", "topn_frequency", "group_by_multi_column", "readme_features_join", "request_include_current", "tiled_sum_7d", "upsert_latest", "as_of_join", "session_window")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    queries = core.queries()
    for name in HEADLINES:
        runs = []
        for _ in range(4):  # one to warm up, the median of three
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline queries, total of medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
