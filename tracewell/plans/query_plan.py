"""From selections to resolved columns per tool.

A selection row holds ``selection_id, tools, sensors_raw, sensors_canonical, start, end, mode``
with array-valued tools and sensors. Expansion is two explodes of the row's own arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewell.functions.time import epoch_micros
from tracewell.plans.resolution import bucket_seconds_column


def expand_selection(selections: DataFrame) -> DataFrame:
    """One row per selection, tool and named sensor.

    ``ord`` is the place of the sensor in the request: raw names first, then canonical ones.
    """
    per_tool = selections.select(
        "selection_id",
        F.posexplode("tools").alias("tool_ord", "tool_id"),
        F.size("sensors_raw").alias("n_raw"),
        F.concat("sensors_raw", "sensors_canonical").alias("names"),
    )
    return per_tool.select(
        "selection_id", "tool_id", "tool_ord", "n_raw", F.posexplode("names").alias("ord", "name")
    ).select(
        "selection_id",
        "tool_id",
        "tool_ord",
        "name",
        F.when(F.col("ord") < F.col("n_raw"), "raw").otherwise("canonical").alias("source"),
        "ord",
    )


def resolve_columns(wanted: DataFrame, mapping: DataFrame) -> DataFrame:
    """Attach the tool's own column to every wanted sensor.

    Raw names stand for themselves, canonical names go through ``mapping`` (unique on
    ``tool_id, canonical_name``); ``raw_name`` stays NULL where the tool has no mapping.
    """
    keyed = mapping.select("tool_id", F.col("canonical_name").alias("name"), "raw_name")
    canonical = (
        wanted.where(F.col("source") == "canonical")
        .join(keyed, ["tool_id", "name"], "left")
        .select(*wanted.columns, "raw_name")
    )
    raw = wanted.where(F.col("source") == "raw").withColumn("raw_name", F.col("name"))
    return raw.unionByName(canonical)


def plan_columns(resolved: DataFrame) -> DataFrame:
    """Columns to read per selection and tool, each once, at its first requested place."""
    return (
        resolved.where(F.col("raw_name").isNotNull())
        .groupBy("selection_id", "tool_id", "raw_name")
        .agg(F.min("tool_ord").alias("tool_ord"), F.min("ord").alias("ord"))
    )


def missing_mappings(resolved: DataFrame) -> DataFrame:
    """Canonical sensors a tool has no column for, with the warning shown to the user."""
    return resolved.where(F.col("raw_name").isNull()).select(
        "selection_id",
        "tool_id",
        F.col("name").alias("canonical_name"),
        F.concat(
            "tool_id", F.lit(": no mapping for '"), "name", F.lit("'; chart will show no data.")
        ).alias("warning"),
    )


def displayed_columns(plan: DataFrame) -> DataFrame:
    """Sorted union of the raw columns over all tools of a selection."""
    return plan.groupBy("selection_id").agg(
        F.array_sort(F.collect_set("raw_name")).alias("columns")
    )


def plan_metrics(selections: DataFrame, plan: DataFrame) -> DataFrame:
    """Numbers reported for a query run: tools, distinct sensors, range and bucket width."""
    sensors = plan.groupBy("selection_id").agg(F.countDistinct("raw_name").alias("sensor_count"))
    span = epoch_micros(F.col("end")) - epoch_micros(F.col("start"))
    return (
        selections.select(
            "selection_id",
            F.size("tools").alias("tool_count"),
            (span / 1_000_000).cast("long").alias("range_seconds"),
            bucket_seconds_column(F.col("start"), F.col("end"), F.col("mode")).alias(
                "resolution_seconds"
            ),
        )
        .join(sensors, "selection_id", "left")
        .withColumn("sensor_count", F.coalesce("sensor_count", F.lit(0)))
    )
