"""Process runs inside the readings, and the per-tool volume report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.functions.time import epoch_micros, floor_div, micros_to_ts
from tracewell.session import stored

# Idle gaps in seconds between wafers, between lots and during maintenance.
GAP_CLASSES = {"wafer": (15, 30), "lot": (5 * 60, 45 * 60), "maintenance": (4 * 3600, 12 * 3600)}
SLOTS_PER_CHUNK = 4096


def detect_runs(readings: DataFrame, gap_seconds: int) -> DataFrame:
    """Runs of readings per tool, split wherever the tool is silent longer than the gap.

    No window sees more than one chunk of readings, however many one tool has, and the readings are
    scanned once:

    1. readings shrink to one row per tool and slot of the gap's width (two readings in one slot
       are never further apart than the gap), combined on the map side;
    2. slots are looked at in chunks of 4096 slots, and each chunk's pieces of runs are written;
    3. per chunk, first and last reading tell whether its first piece goes on from the chunk
       before, and the number of runs begun earlier numbers its pieces; pieces of one run are put
       together in an aggregate.
    """
    gap = int(gap_seconds) * 1_000_000
    ts = epoch_micros(F.col("ts"))
    slots = (
        readings.where(F.col("ts").isNotNull())
        .select("tool_id", ts.alias("us"), floor_div(ts, gap).alias("slot"))
        .groupBy("tool_id", "slot")
        .agg(
            F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("rows")
        )
        .withColumn("chunk", floor_div(F.col("slot"), SLOTS_PER_CHUNK))
    )
    in_chunk = Window.partitionBy("tool_id", "chunk").orderBy("slot")
    silence = F.col("first_us") - F.lag("last_us").over(in_chunk)
    pieces = stored(
        slots.withColumn("silence_us", silence)
        .withColumn("starts", F.coalesce((F.col("silence_us") > gap).cast("long"), F.lit(1)))
        .withColumn("number", F.sum("starts").over(in_chunk))
        .groupBy("tool_id", "chunk", "number")
        .agg(
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.sum("rows").alias("rows"),
            F.max(F.when(F.col("silence_us") > gap, F.col("silence_us"))).alias("silence_us"),
        ),
        "run-pieces",
    )
    in_tool = Window.partitionBy("tool_id").orderBy("chunk")
    earlier = in_tool.rowsBetween(Window.unboundedPreceding, -1)
    goes_on = F.coalesce((F.col("idle_us") <= gap).cast("long"), F.lit(0))
    chunks = (
        pieces.groupBy("tool_id", "chunk")
        .agg(
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.max("number").alias("n"),
        )
        .withColumn("idle_us", F.col("first_us") - F.lag("last_us").over(in_tool))
        .withColumn("goes_on", goes_on)
        .select(
            F.col("tool_id").alias("_tool"),
            F.col("chunk").alias("_chunk"),
            F.when(F.col("idle_us") > gap, F.col("idle_us")).alias("idle_us"),
            (
                F.coalesce(F.sum(F.col("n") - F.col("goes_on")).over(earlier), F.lit(0))
                - F.col("goes_on")
            ).alias("begun"),
        )
    )
    same = F.col("tool_id").eqNullSafe(F.col("_tool")) & (F.col("chunk") == F.col("_chunk"))
    before = F.when(F.col("number") == 1, F.col("idle_us")).otherwise(F.col("silence_us"))
    runs = (
        pieces.join(chunks, same)
        .groupBy("tool_id", (F.col("begun") + F.col("number")).alias("run_no"))
        .agg(
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.sum("rows").alias("rows"),
            F.max(before).alias("silence_us"),
        )
    )
    return runs.select(
        "tool_id",
        "run_no",
        micros_to_ts(F.col("first_us")).alias("run_start"),
        micros_to_ts(F.col("last_us")).alias("run_end"),
        "rows",
        ((F.col("last_us") - F.col("first_us")) / 1_000_000).alias("duration_s"),
        (F.col("silence_us") / 1_000_000).alias("gap_before_s"),
    ).withColumn("gap_class", gap_class(F.col("gap_before_s")))


def gap_class(gap_seconds: Column) -> Column:
    """Kind of idle gap before a run; ``first`` without one, ``other`` outside all ranges."""
    label = F.lit("other")
    for name, (shortest, longest) in GAP_CLASSES.items():
        label = F.when(gap_seconds.between(shortest, longest), name).otherwise(label)
    return F.when(gap_seconds.isNull(), "first").otherwise(label)


def volume_report(
    readings: DataFrame, files: DataFrame, groups: DataFrame, *, gap_seconds: int,
    window_hours: float, sample_hz: float = 10,
) -> DataFrame:
    """Runs, rows, files, bytes and utilisation per tool, with the tool's process group."""
    per_tool = detect_runs(readings, gap_seconds).groupBy("tool_id").agg(
        F.count("*").alias("runs"), F.sum("rows").alias("rows")
    )
    stored = files.groupBy("tool_id").agg(
        F.count("*").alias("files"), F.sum("size_bytes").alias("bytes")
    )
    capacity = window_hours * 3600 * sample_hz
    return (
        per_tool.join(stored, "tool_id", "left")
        .join(groups, "tool_id", "left")
        .withColumn("utilisation_pct", F.col("rows") / F.lit(capacity) * 100)
        .select(
            "tool_id", "prc_group_id", "runs", "rows",
            F.coalesce("files", F.lit(0)).alias("files"),
            F.coalesce("bytes", F.lit(0)).alias("bytes"),
            "utilisation_pct",
        )
    )
