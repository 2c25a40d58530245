"""Partitioned Parquet, CSV and JSON outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.functions.time import iso_text_ns
from tracewell.operators.align import as_csv_text
from tracewell.operators.raw import total_order

FOLDER_KEYS = {
    "day": ("tool_id", "year", "month", "day"),
    "hour": ("tool_id", "year", "month", "day", "hour"),
}
CSV_OPTIONS = {
    "header": "true",
    "nullValue": "",
    "emptyValue": "",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_partitioned(
    readings: DataFrame, path: str, *, by: str = "day", replace: bool = False
) -> None:
    """Readings as ``tool_id/year/month/day[/hour]`` folders of zstd files sorted by time.

    Rebalancing gathers each folder's rows in one place, merges small ones into one task and
    splits one too large for a task, so neither idle nor very busy tools set the pace. Hours of
    one tool are a few megabytes at 10 Hz; days give files of a size that scans well.

    With ``replace`` the folders that ``readings`` has rows for are replaced when the write commits,
    and no other is touched.
    """
    keys = FOLDER_KEYS[by]
    parts = {"year": F.year("ts"), "month": F.month("ts"), "day": F.day("ts"), "hour": F.hour("ts")}
    keyed = readings.withColumns({name: parts[name] for name in keys if name in parts})
    writer = (
        keyed.hint("rebalance", *keys)
        .sortWithinPartitions(*keys, "ts")
        .write.partitionBy(*keys)
        .option("compression", "zstd")
    )
    if replace:
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def read_partitioned(
    spark: SparkSession, path: str, sensors: str, *, by: str = "day"
) -> DataFrame:
    """Read such folders back; ``sensors`` is a DDL list of the stored columns.

    The schema is given so that a tool named like a number stays text. Filters on the folder
    keys prune whole folders; add them next to the ``ts`` range.
    """
    folders = ", ".join(f"{k} {'string' if k == 'tool_id' else 'int'}" for k in FOLDER_KEYS[by])
    return spark.read.schema(f"ts timestamp_ntz, {sensors}, {folders}").parquet(path)


def write_chart_csv(aligned: DataFrame, path: str) -> None:
    """An aligned wide table as CSV part files in time order."""
    as_csv_text(aligned.orderBy("ts")).write.options(**CSV_OPTIONS).csv(path)


def write_table_csv(rows: DataFrame, path: str) -> None:
    """Raw rows as CSV part files in total order, written by one sorted job without paging.

    Nanosecond rows carry ``ts_ns``; it orders them and gives the nine-digit text.
    """
    if "ts_ns" not in rows.columns:
        as_csv_text(rows.orderBy(*total_order(rows))).write.options(**CSV_OPTIONS).csv(path)
        return
    cells = [c for c in rows.columns if c not in ("tool_id", "ts", "ts_ns")]
    ordered = rows.orderBy("ts_ns", "tool_id", *[F.col(f"`{c}`") for c in cells])
    text = ordered.select(
        "tool_id", iso_text_ns(F.col("ts_ns")).alias("ts"), *[F.col(f"`{c}`") for c in cells]
    )
    as_csv_text(text).write.options(**CSV_OPTIONS).csv(path)


def write_report_json(report: DataFrame, path: str) -> None:
    report.write.json(path)
