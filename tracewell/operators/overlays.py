"""Charts that lay several series over each other: per sensor, per tool, or one series each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewell.functions.numeric import is_finite

# What grouping_id(tool_id, sensor) says of the columns that are left.
GROUPINGS = {0: "both", 1: "tool", 2: "sensor"}
SCALE_RATIO = 100.0  # largest over smallest magnitude in a chart above which its scales differ


def overlay_groups(series: DataFrame, scale_ratio: float = SCALE_RATIO) -> DataFrame:
    """One row per chart of every way to group: ``group_by, tool_id, sensor`` and its statistics.

    Takes series (``tool_id, sensor, bucket, avg, min, max``). ``group_by`` is ``sensor`` (all tools
    overlaid), ``tool`` (all its sensors overlaid) or ``both`` (a series of its own). The column
    that a chart does not fix is NULL. Statistics are over buckets with a finite average: number
    of series and points, lowest and highest value, and the plain mean of the bucket means.

    ``scale_ratio`` is the largest over the smallest magnitude of the chart's series, a series'
    magnitude being its largest absolute value; series that are 0 throughout have none.
    ``scales_differ`` warns where that is above ``scale_ratio``, in charts of one tool only, since
    one sensor's scale is its own. The readings are aggregated once, per series; charts are
    grouping sets over these rows.
    """
    finite = series.where(is_finite(F.col("avg")))
    per_series = finite.groupBy("tool_id", "sensor").agg(
        F.count("*").alias("points"),
        F.min("min").alias("low"),
        F.max("max").alias("high"),
        F.sum("avg").alias("total"),
    )
    magnitude = F.nullif(F.greatest(F.abs("low"), F.abs("high")), F.lit(0.0))
    charts = (
        per_series.withColumn("magnitude", magnitude)
        .groupingSets([["tool_id", "sensor"], ["tool_id"], ["sensor"]], "tool_id", "sensor")
        .agg(
            F.grouping_id("tool_id", "sensor").alias("id"),
            F.count("*").alias("series"),
            F.sum("points").alias("points"),
            F.min("low").alias("min_value"),
            (F.sum("total") / F.sum("points")).alias("mean_value"),
            F.max("high").alias("max_value"),
            (F.max("magnitude") / F.min("magnitude")).alias("scale_ratio"),
        )
    )
    kind = F.lit(None).cast("string")
    for number, name in GROUPINGS.items():
        kind = F.when(F.col("id") == number, name).otherwise(kind)
    warn = (F.col("group_by") == "tool") & (F.col("scale_ratio") > scale_ratio)
    return charts.withColumn("group_by", kind).select(
        "group_by",
        "tool_id",
        "sensor",
        "series",
        "points",
        "min_value",
        "mean_value",
        "max_value",
        "scale_ratio",
        F.coalesce(warn, F.lit(False)).alias("scales_differ"),
    )
