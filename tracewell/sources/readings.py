"""Sensor readings from Parquet, whatever the files' time unit and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tracewell.functions.time import ns_to_ts
from tracewell.sources.layout import relative_path, tool_of
from tracewell.sources.sinks import read_partitioned


def read_readings(
    spark: SparkSession,
    paths: list[str],
    sensors: list[str],
    *,
    root: str,
    time_column: str = "ts",
    time_type: str = "timestamp[us]",
    column_types: dict[str, str] | None = None,
    tool_id: Column | None = None,
    tolerant: bool = False,
) -> DataFrame:
    """``tool_id, ts`` and the sensors as doubles from files that share their types.

    The schema is given, not merged: a column some file lacks reads as NULL and float files
    widen to double. ``column_types`` has the stored types of sensors that aren't floating:
    integers, decimals and booleans (1 and 0) become doubles, text and nested columns read as
    NULL. ``ts_ns`` is kept for nanosecond files, whose ``ts`` rounds down. ``paths`` may be
    folders, such as whole tools, which keeps the list short for bulk reads.

    With ``tolerant`` the scan skips what it can't read of a file, or a file that went away, and
    rows carry the ``file_id`` they come from, so that lost rows can be told.
    """
    stored = {s: _spark_type((column_types or {}).get(s, "double")) for s in sensors}
    schema = T.StructType([T.StructField(time_column, _spark_time_type(time_type))])
    for sensor, kind in stored.items():
        if kind is not None:
            schema.add(sensor, kind)
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true")
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    rows = reader.parquet(*paths)
    tool = tool_id if tool_id is not None else tool_of(relative_path(plain_path(), root))
    cells = [
        (F.lit(None) if stored[s] is None else _quoted(s)).cast("double").alias(s) for s in sensors
    ]
    if tolerant:
        cells.append(relative_path(plain_path(), root).alias("file_id"))
    return normalise_time(
        rows.select(tool.alias("tool_id"), time_column, *cells), time_column, time_type
    )


def plain_path() -> Column:
    """The row's file as the file scan names it; Spark gives it percent-encoded here."""
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(encoded)


def normalise_time(rows: DataFrame, time_column: str, time_type: str) -> DataFrame:
    """Replace the file's time column by ``ts`` in UTC, plus ``ts_ns`` for nanosecond files."""
    time = _quoted(time_column)
    rest = [_quoted(c) for c in rows.columns if c not in (time_column, "tool_id")]
    if _is_nanos(time_type):
        ts = [ns_to_ts(time).alias("ts"), time.alias("ts_ns")]
    else:
        ts = [time.cast("timestamp_ntz").alias("ts")]
    return rows.select("tool_id", *ts, *rest)


def read_by_index(
    spark: SparkSession,
    files: DataFrame,
    sensors: list[str],
    *,
    root: str,
    tolerant: bool = False,
) -> DataFrame:
    """Readings of the given index rows, one scan per kind of file, united by name.

    ``files`` should already be pruned to the tools and range wanted: a Spark scan needs its
    paths on the driver. To read all there is, pass folders to :func:`read_readings` instead.
    A kind is a time type and the types of the sensors asked for; other columns make no kinds.
    """
    asked = F.array(*[F.lit(s) for s in sensors]).cast("array<string>")
    types = F.transform(asked, lambda s: F.col("column_types")[s])
    kinds: dict[tuple, list[str]] = {}
    for path, time_column, time_type, found in files.select(
        "path", "time_column", "time_type", types
    ).collect():
        kinds.setdefault((time_column, time_type, tuple(found)), []).append(path)
    united = None
    for (time_column, time_type, found), paths in kinds.items():
        part = read_readings(
            spark,
            paths,
            sensors,
            root=root,
            time_column=time_column,
            time_type=time_type,
            column_types={s: kind for s, kind in zip(sensors, found) if kind},
            tolerant=tolerant,
        )
        united = part if united is None else united.unionByName(part, allowMissingColumns=True)
    if united is not None:
        return united
    fields = ["tool_id string", "ts timestamp_ntz", *[f"`{s}` double" for s in sensors]]
    return spark.createDataFrame([], ", ".join(fields + ["file_id string"] * tolerant))


def read_selected(
    spark: SparkSession, path: str, selections: DataFrame, sensors: str, *, most_days: int = 100_000
) -> DataFrame:
    """Readings of every selection from day folders: ``selection_id, tool_id, ts`` and the sensors.

    ``path`` is what ``write_partitioned`` wrote by day, ``sensors`` a DDL list of its columns and
    ``selections`` has ``selection_id, tool_id, start, end`` (half-open; a NULL bound or a start
    not before the end selects nothing). No path comes to the driver: the selected days are a small
    table that Spark broadcasts and also uses to prune the folders of tools and days at run time.
    Above ``most_days`` selected (selection, tool, day) rows they are joined by a shuffle instead.
    """
    last = F.col("end") - F.expr("INTERVAL 1 MICROSECOND")
    days = F.sequence(F.to_date("start"), F.to_date(last))
    wanted = selections.where("start < end").select(
        "selection_id", "tool_id", "start", "end", F.explode(days).alias("_day")
    )
    wanted = wanted.select(
        "selection_id",
        "start",
        "end",
        F.col("tool_id").alias("_tool"),
        F.year("_day").alias("_year"),
        F.month("_day").alias("_month"),
        F.day("_day").alias("_dom"),
    )
    if wanted.count() <= most_days:
        wanted = F.broadcast(wanted)
    rows = read_partitioned(spark, path, sensors)
    cells = [F.col(f"`{c}`") for c in rows.columns if c not in ("tool_id", "ts", "year", "month", "day")]
    meets = (
        (F.col("tool_id") == F.col("_tool"))
        & (F.col("year") == F.col("_year"))
        & (F.col("month") == F.col("_month"))
        & (F.col("day") == F.col("_dom"))
        & (F.col("ts") >= F.col("start"))
        & (F.col("ts") < F.col("end"))
    )
    return rows.join(wanted, meets).select("selection_id", "tool_id", "ts", *cells)


def _spark_time_type(time_type: str) -> T.DataType:
    if _is_nanos(time_type):
        return T.LongType()
    return T.TimestampType() if "tz=" in time_type else T.TimestampNTZType()


def _spark_type(stored: str) -> T.DataType | None:
    """How Spark reads a column of this stored type, or None for one that is no number."""
    if stored.startswith(("int", "uint")):
        return T.DecimalType(20, 0) if stored == "uint64" else T.LongType()
    if stored.startswith("decimal"):
        precision, scale = stored[stored.index("(") + 1 : -1].split(",")
        return T.DecimalType(int(precision), int(scale))
    if stored == "bool":
        return T.BooleanType()
    return T.DoubleType() if stored in ("float", "double", "halffloat") else None


def _is_nanos(time_type: str) -> bool:
    return time_type.startswith("timestamp[ns") or time_type == "int64"


def _quoted(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")
