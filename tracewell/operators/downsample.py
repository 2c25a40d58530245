"""Time-bucket down-sampling: average, minimum and maximum per sensor and bucket."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.time import bucket_start, bucket_start_by, in_range
from tracewell.plans.resolution import bucket_seconds, extent_seconds_column


def downsample(
    readings: DataFrame,
    sensors: list[str],
    width_seconds: int,
    *,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    keys: tuple[str, ...] = ("tool_id",),
) -> DataFrame:
    """Wide result ``keys, bucket, {sensor}_avg, {sensor}_min, {sensor}_max``.

    All tools go through the same hash aggregate: rows shrink to one per tool and bucket on the
    map side, so a tool holding a third of the readings costs no more shuffle than any other.

    It is one aggregate whatever the number of sensors. Rows without a tool or time form groups
    of their own.
    """
    scoped = readings.where(in_range(F.col("ts"), start, end)).withColumn(
        "bucket", bucket_start(F.col("ts"), width_seconds)
    )
    if not sensors:
        return scoped.select(*keys, "bucket").where(F.lit(False))
    return _aggregate(scoped, keys, sensors)


def _aggregate(scoped: DataFrame, keys: tuple[str, ...], sensors: list[str]) -> DataFrame:
    """The aggregate as SQL text: a single call however many columns there are."""
    key_list = ", ".join([*map(_name, keys), "bucket"])
    cells = ", ".join(
        f"{function}({_name(s)}) AS {_name(f'{s}_{function}')}"
        for s in sensors
        for function in ("avg", "min", "max")
    )
    return scoped.sparkSession.sql(
        f"SELECT {_braced(key_list)}, {_braced(cells)} FROM {{rows}} GROUP BY {_braced(key_list)}",
        rows=scoped,
    )


def downsample_auto(
    readings: DataFrame, sensors: list[str], start: datetime, end: datetime, mode: str
) -> DataFrame:
    """As :func:`downsample`, with the ladder width for the range and view."""
    return downsample(readings, sensors, bucket_seconds(start, end, mode), start=start, end=end)


def downsample_long(
    readings: DataFrame,
    width_seconds: int,
    *,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    keys: tuple[str, ...] = ("tool_id", "sensor"),
) -> DataFrame:
    """Long result ``keys, bucket, avg, min, max, n`` for readings with one value per row."""
    bucket = bucket_start(F.col("ts"), width_seconds)
    scoped = readings.where(in_range(F.col("ts"), start, end)).select(
        *keys, bucket.alias("bucket"), "value"
    )
    return scoped.groupBy(*keys, "bucket").agg(*_long_aggregates())


def downsample_extent(
    readings: DataFrame, points: int, extents: DataFrame | None = None
) -> DataFrame:
    """Each tool over its own full extent, at ``max(1, round(span / points))`` seconds.

    ``extents`` holds ``tool_id, earliest, latest``; pass the file index's ``tool_extents`` to
    spare the pass over the readings that finds them otherwise. It is one row per tool; Spark
    broadcasts it at run time when it turns out small, and splits busy tools when not.
    """
    if extents is None:
        extents = readings.groupBy("tool_id").agg(
            F.min("ts").alias("earliest"), F.max("ts").alias("latest")
        )
    extents = extents.select(
        "tool_id",
        extent_seconds_column(F.col("earliest"), F.col("latest"), points).alias("width"),
    )
    bucketed = readings.join(extents, "tool_id").select(
        "tool_id",
        "sensor",
        "width",
        bucket_start_by(F.col("ts"), F.col("width")).alias("bucket"),
        "value",
    )
    return bucketed.groupBy("tool_id", "sensor", "width", "bucket").agg(*_long_aggregates())


def downsample_zoom(
    readings: DataFrame, start: datetime, end: datetime, points: int = 2000
) -> DataFrame:
    """One range for all tools at a free width instead of a ladder step."""
    width = max(1, round((end - start).total_seconds() / points))
    return downsample_long(readings, width, start=start, end=end)


def downsample_plan(
    readings: DataFrame,
    plan: DataFrame,
    width_seconds: int,
    *,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
) -> DataFrame:
    """Down-sample exactly the ``(tool_id, raw_name)`` pairs of a resolved plan, in one job.

    The pairs filter the rows before the aggregate, in a join that Spark broadcasts at run time
    when they turn out few. No job runs while the query is being built.
    """
    pairs = plan.select("tool_id", F.col("raw_name").alias("sensor")).distinct()
    wanted = readings.where(in_range(F.col("ts"), start, end)).join(
        pairs, ["tool_id", "sensor"], "left_semi"
    )
    return downsample_long(wanted, width_seconds)


def downsample_plan_wide(
    readings: DataFrame,
    plan: DataFrame,
    width_seconds: int,
    *,
    sensors: list[str] | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
) -> DataFrame:
    """The pairs of a resolved plan from wide readings: ``tool_id, sensor, bucket, avg, min, max``.

    Tools that the plan doesn't name leave before the aggregate. The pairs then choose among the
    buckets, which are few. ``sensors`` narrows the columns read; all by default.
    """
    columns = sensors or [c for c in readings.columns if c not in ("tool_id", "ts", "ts_ns")]
    pairs = plan.select("tool_id", F.col("raw_name").alias("sensor")).distinct()
    asked = readings.join(pairs.select("tool_id").distinct(), "tool_id", "left_semi")
    series = series_of(downsample(asked, columns, width_seconds, start=start, end=end), columns)
    return series.join(pairs, ["tool_id", "sensor"], "left_semi").select(*series.columns)


def downsample_wanted(
    readings: DataFrame,
    wanted: dict[str, list[str]],
    width_seconds: int,
    *,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
) -> DataFrame:
    """Series of wide readings for each tool's own sensor list.

    Tools with the same list share one aggregate of just these sensors; other tools' rows and
    other columns leave before it. Sensors no file holds give no rows, like tools without
    readings; ``tool_status`` names them.
    """
    present = set(readings.columns)
    tools_by_list: dict[tuple[str, ...], list[str]] = {}
    for tool, names in wanted.items():
        if own := tuple(sorted(set(names) & present)):
            tools_by_list.setdefault(own, []).append(tool)
    parts = []
    for names, tools in tools_by_list.items():
        scoped = readings.where(F.col("tool_id").isin(tools))
        result = downsample(scoped, list(names), width_seconds, start=start, end=end)
        parts.append(series_of(result, list(names)))
    if not parts:
        empty = "tool_id string, sensor string, bucket timestamp_ntz, avg double, min double, max double"
        return readings.sparkSession.createDataFrame([], empty)
    return reduce(DataFrame.unionByName, parts)


def to_long(readings: DataFrame, sensors: list[str]) -> DataFrame:
    """Wide readings to ``tool_id, ts, sensor, value``."""
    values = [F.col(_name(s)).cast("double").alias(s) for s in sensors]
    return readings.select("tool_id", "ts", *values).unpivot(
        ["tool_id", "ts"], [_name(s) for s in sensors], "sensor", "value"
    )


def series_of(wide: DataFrame, sensors: list[str]) -> DataFrame:
    """A wide down-sampled result as ``tool_id, sensor, bucket, avg, min, max``.

    Runs on buckets, so its fan-out is over the already small result.
    """
    stats = F.array(
        *[
            F.struct(
                F.lit(s).alias("sensor"),
                *[
                    F.col(_name(f"{s}_{kind}")).cast("double").alias(kind)
                    for kind in ("avg", "min", "max")
                ],
            )
            for s in sensors
        ]
    )
    return wide.select("tool_id", "bucket", F.inline(stats))


def _long_aggregates() -> list[Column]:
    return [
        F.avg("value").alias("avg"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("value").alias("n"),
    ]


def _name(column: str) -> str:
    escaped = column.replace("`", "``")
    return f"`{escaped}`"


def _quoted(column: str) -> Column:
    return F.col(_name(column))


def _braced(text: str) -> str:
    """Column names may hold braces, which mark parameters in SQL text."""
    return text.replace("{", "{{").replace("}", "}}")
