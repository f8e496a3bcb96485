"""Time every query on one scale of the given tables; print one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default: all)
BENCH_RUNS    timed runs per query after one warm-up, the median counts (default 1)
BENCH_QUERIES comma-separated names (default: the headline queries; "all" for every query)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from topicwise.plans.queries import QUERIES

HEADLINE = (
    "normalize_records",
    "decode_formats",
    "decode_protobuf",
    "schema_lookup",
    "table_view",
    "flatten_payload",
    "filter_predicate",
    "filter_regex",
    "keyword_search",
    "tail_n_per_partition",
    "tail_long_per_partition",
    "lag_by_partition",
    "dlq_diagnose",
    "dlq_by_category",
    "dlq_source_link",
    "redrive_plan",
    "redrive_batch_limit",
    "trace_one",
    "trace_all_hops",
    "trace_one_hot_key",
    "trace_summary",
    "trace_order_hops",
    "trace_many",
    "diff_items",
    "diff_summary",
    "replay_plan",
    "throughput_1s",
    "recent_events",
    "session_roundtrip",
    "stream_tail",
)


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
