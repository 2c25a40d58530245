"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query is written to the
``noop`` sink, so it runs in full and nothing is collected. One unmeasured run comes first, then
the median of three is reported, as the published figures this compares with are medians of
three as well.

``series_100`` is the published plan: 8 tools with 100 float sensors, overview buckets. Its
readings are derived from all order lines and stored once, before timing starts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindings import tables as t
from bindings.queries import QUERIES
from tracewell import configure, shared_dir
from tracewell.operators.downsample import downsample

HEADLINE = (
    "downsample_hour",
    "downsample_day",
    "downsample_wide",
    "downsample_auto_overview",
    "downsample_auto_standard",
    "downsample_full_extent",
    "downsample_zoom",
    "downsample_canonical",
    "raw_count",
    "raw_page_asc",
    "raw_page_deep",
    "raw_page_keyset",
    "focus_stats",
    "sparkline_summary",
    "aligned_wide",
    "coverage_warnings",
    "file_overlap",
    "run_detection",
    "file_index_scan",
    "index_upsert",
    "manifest_diff",
    "seconds_since_exit",
    "saved_set_union",
    "catalog_fallback",
    "mapping_cells",
    "series_status",
    "resolve_plan",
)
RUNS = 3
SERIES = [f"sensor_{i:03d}" for i in range(100)]


def wide_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines as 10 Hz samples of 100 float sensors, stored per tool in time order."""
    lines = t.table(spark, sf_dir, "lineitem")
    tick = F.expr("make_dt_interval(0, 0, 0, (l_orderkey * 8 + l_linenumber) * 0.1)")
    sensors = [
        (F.col(t.WIDE_SENSORS[i % 4]) * (i + 1) + F.col(t.WIDE_SENSORS[(i + 1) % 4]))
        .cast("float")
        .alias(name)
        for i, name in enumerate(SERIES)
    ]
    path = shared_dir(spark, "bench-series")
    (
        lines.select(
            F.expr("concat('tool_', l_suppkey % 8)").alias("tool_id"),
            (F.expr("timestamp_ntz'2026-05-01 00:00:00'") + tick).alias("ts"),
            *sensors,
        )
        .hint("rebalance", "tool_id")
        .sortWithinPartitions("tool_id", "ts")
        .write.partitionBy("tool_id")
        .option("compression", "zstd")
        .parquet(path)
    )
    return spark.read.parquet(path)


def timed(build) -> float:
    started = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def median_of_runs(build) -> float:
    timed(build)
    return round(statistics.median(timed(build) for _ in range(RUNS)), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {name: median_of_runs(lambda: QUERIES[name](spark, sf_dir)) for name in HEADLINE}
    readings = wide_readings(spark, sf_dir)
    values = readings.count() * len(SERIES)
    seconds["series_100"] = median_of_runs(lambda: downsample(readings, SERIES, 3600))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "series_100_values_per_sec": round(values / seconds["series_100"]),
                "runs": f"median of {RUNS} after one warm-up",
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
