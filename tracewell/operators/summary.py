"""Summaries of down-sampled series: focus statistics, sparklines, status and caps.

A series frame holds ``tool_id, sensor, bucket, avg, min, max``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.functions.numeric import is_finite

# Charts shown per view; overview shows every series.
SERIES_CAP = {"focus": 4, "standard": 50}
DEFAULT_SERIES_CAP = 50
# Relative tolerance for a flat line and the share of padding around it.
FLAT_TOLERANCE = 1e-9
FLAT_PADDING = 0.05


def focus_stats(series: DataFrame) -> DataFrame:
    """Lowest minimum, mean of the bucket means and highest maximum over finite buckets.

    The mean is not weighted by the rows in a bucket.
    """
    return (
        series.where(is_finite(F.col("avg")))
        .groupBy("tool_id", "sensor")
        .agg(
            F.min("min").alias("min_value"),
            F.avg("avg").alias("mean_value"),
            F.max("max").alias("max_value"),
        )
    )


def sparkline_summary(series: DataFrame) -> DataFrame:
    """Latest finite average, padded value range and time range of every series."""
    finite = F.when(is_finite(F.col("avg")), F.col("avg"))
    stats = series.groupBy("tool_id", "sensor").agg(
        F.max_by("avg", F.when(finite.isNotNull(), F.col("bucket"))).alias("latest"),
        F.min(finite).alias("low"),
        F.max(finite).alias("high"),
        F.min("bucket").alias("x_start"),
        F.max("bucket").alias("x_end"),
    )
    low, high = F.col("low"), F.col("high")
    scale = F.greatest(F.abs(low), F.abs(high))
    flat = F.abs(low - high) <= scale * FLAT_TOLERANCE
    pad = F.when(flat, F.greatest(F.abs(low), F.lit(1.0)) * FLAT_PADDING).otherwise(0.0)
    return stats.where(low.isNotNull()).select(
        "tool_id",
        "sensor",
        "latest",
        (low - pad).alias("y_min"),
        (high + pad).alias("y_max"),
        "x_start",
        "x_end",
    )


def series_status(
    plan: DataFrame, series: DataFrame, tools: DataFrame, catalog: DataFrame | None = None
) -> DataFrame:
    """``error``, ``no_data`` or ``data`` for every planned ``(tool_id, raw_name)``.

    ``tools`` is the result of ``tool_status``; an unreadable tool is an error for all of its
    series, a column that ``catalog(tool_id, raw_name)`` lacks for its own series alone. A
    series with points is never an error.
    """
    points = series.groupBy("tool_id", F.col("sensor").alias("raw_name")).agg(
        F.count_if(is_finite(F.col("avg"))).alias("points")
    )
    failed = tools.select(
        "tool_id", F.col("status").isin("unreadable", "missing_column").alias("failed")
    )
    status = (
        F.when(F.coalesce("points", F.lit(0)) > 0, "data")
        .when(F.col("failed") | ~F.col("present"), "error")
        .otherwise("no_data")
    )
    asked = plan.select("tool_id", "raw_name").distinct()
    if catalog is None:
        asked = asked.withColumn("present", F.lit(True))
    else:
        known = catalog.select("tool_id", "raw_name", F.lit(True).alias("known")).distinct()
        asked = asked.join(known, ["tool_id", "raw_name"], "left").select(
            "tool_id", "raw_name", F.col("known").isNotNull().alias("present")
        )
    return (
        asked
        .join(points, ["tool_id", "raw_name"], "left")
        .join(failed, "tool_id", "left")
        .select(
            "tool_id",
            "raw_name",
            status.alias("status"),
            F.coalesce("points", F.lit(0)).alias("points"),
        )
    )


def series_cap(mode: Column) -> Column:
    """Series shown for a view; NULL means all of them."""
    cap = F.lit(DEFAULT_SERIES_CAP)
    for name, shown in SERIES_CAP.items():
        cap = F.when(mode == name, F.lit(shown)).otherwise(cap)
    return F.when(mode == "overview", F.lit(None).cast("int")).otherwise(cap)


def shown_series(plan: DataFrame, modes: DataFrame) -> DataFrame:
    """First series of every selection in tool, then column order, up to the view's cap.

    A selection's own arrays bound its rows, so ranking inside one stays small.
    """
    in_order = Window.partitionBy("selection_id").orderBy("tool_ord", "ord", "raw_name")
    cap = series_cap(F.col("mode"))
    return (
        plan.withColumn("position", F.row_number().over(in_order))
        .join(modes.select("selection_id", "mode"), "selection_id")
        .where(cap.isNull() | (F.col("position") <= cap))
        .select("selection_id", "tool_id", "raw_name", "position")
    )
