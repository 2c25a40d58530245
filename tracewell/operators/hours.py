"""Upkeep of stored hours: regeneration where content changed, and rows that come late.

Hours (or days, ``by``) are the folders that ``write_partitioned`` writes. Rows are compared whole,
as sets: a row that is there already changes nothing, so every job may be run again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewell.session import stored
from tracewell.sources.sinks import read_partitioned, write_partitioned

FOLDERS = ("year", "month", "day", "hour")
HALF = 1 << 32


def period_of(ts: Column, by: str = "hour") -> Column:
    """Start of the hour or day, UTC, that ``ts`` belongs to."""
    return F.date_trunc(by, ts).cast("timestamp_ntz")


def fingerprints(readings: DataFrame, by: str = "hour") -> DataFrame:
    """``tool_id, period, rows, mix, total`` of each tool's hours or days.

    ``mix`` and ``total`` fold the rows' hashes, so the order of rows and of columns is of no
    matter, while a value, a NULL or the number of equal rows is. Hashes are combined on the map
    side; a tool with a third of all rows costs one row per hour and task.
    """
    names = sorted(c for c in readings.columns if c not in FOLDERS)
    cells = [F.col(f"`{c}`") for c in names]
    # NULLs leave a hash as it is, so where they are is hashed as well
    row = F.xxhash64(*cells, *[c.isNull() for c in cells])
    keyed = readings.select("tool_id", period_of(F.col("ts"), by).alias("period"), row.alias("_row"))
    low = F.pmod("_row", F.lit(HALF))
    return keyed.groupBy("tool_id", "period").agg(
        F.count("*").alias("rows"),
        F.bit_xor("_row").alias("mix"),
        F.sum(low).alias("total"),
    )


def changed_periods(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """``tool_id, period, state`` of two sets of fingerprints: ``new``, ``changed``, ``same`` or ``missing``."""
    old, new = known.alias("o"), fresh.alias("n")
    both = F.col("o.tool_id").eqNullSafe(F.col("n.tool_id")) & F.col("o.period").eqNullSafe(
        F.col("n.period")
    )
    same = F.lit(True)
    for fact in ("rows", "mix", "total"):
        same = same & (F.col(f"o.{fact}") == F.col(f"n.{fact}"))
    state = (
        F.when(F.col("o.rows").isNull(), "new")
        .when(F.col("n.rows").isNull(), "missing")
        .when(same, "same")
        .otherwise("changed")
    )
    return old.join(new, both, "full_outer").select(
        F.coalesce("n.tool_id", "o.tool_id").alias("tool_id"),
        F.coalesce("n.period", "o.period").alias("period"),
        state.alias("state"),
    )


def regenerate(
    spark: SparkSession, fresh: DataFrame, path: str, sensors: str, *, by: str = "hour"
) -> DataFrame:
    """Replace the stored hours that ``fresh`` has other rows for; the others keep their files.

    ``fresh`` has whole hours of ``tool_id, ts`` and the columns of the DDL list ``sensors``. It is
    staged once, compared with what the folders hold, and only new and changed hours are
    written, each folder replaced when the write commits. Stored hours that ``fresh`` has no row
    of stay. Rows without a time or tool have no hour and are left out. Returns the states of all
    hours of ``fresh``.
    """
    staged = stored(fresh.where("ts IS NOT NULL AND tool_id IS NOT NULL"), "hours-staged")
    prints = fingerprints(staged, by)
    periods = prints.select("tool_id", "period").distinct()
    states = stored(
        changed_periods(fingerprints(_rows_of(spark, path, sensors, periods, by), by), prints),
        "hours-states",
    )
    todo = states.where("state IN ('new', 'changed')").select(
        F.col("tool_id").alias("_tool"), F.col("period").alias("_period")
    )
    of = (F.col("tool_id") == F.col("_tool")) & (period_of(F.col("ts"), by) == F.col("_period"))
    write_partitioned(staged.join(todo, of, "left_semi"), path, by=by, replace=True)
    return states


def ingest(
    spark: SparkSession,
    incoming: DataFrame,
    path: str,
    sensors: str,
    *,
    window_hours: int,
    by: str = "hour",
) -> DataFrame:
    """Take rows into stored hours as long as these are open; later ones go to a table of their own.

    A tool's hours are sealed once they ended ``window_hours`` before its newest reading of all
    earlier calls. Rows of open hours are united with what is stored and change their hour's files
    only if they bring something new. Rows of sealed hours that aren't stored already are appended
    to the late table. Below ``path`` are ``hours``, ``late`` and ``sealed``; the last one only
    grows, its highest row per tool holds, and it is written last, so a call that was cut off, or
    is made twice, ends in the same tables. Usable on each batch of a stream. Returns the states
    of the hours written to.
    """
    columns = ["tool_id", "ts", *_names(spark, sensors)]
    ddl = f"tool_id string, ts timestamp_ntz, {sensors}"
    rows = stored(
        incoming.where("ts IS NOT NULL AND tool_id IS NOT NULL").select(*columns).distinct(),
        "ingest-incoming",
    )
    sealed = sealed_before(spark, path).select(F.col("tool_id").alias("_tool"), "sealed_before")
    period = period_of(F.col("ts"), by)
    marked = rows.join(sealed, F.col("tool_id") == F.col("_tool"), "left").withColumn(
        "_late", F.coalesce(period < F.col("sealed_before"), F.lit(False))
    )
    open_ = marked.where(~F.col("_late")).select(*columns)
    late = marked.where("_late").select(*columns)

    periods = open_.select("tool_id", period.alias("period")).distinct()
    there = _rows_of(spark, f"{path}/hours", sensors, periods, by).select(*columns)
    states = regenerate(spark, open_.union(there).distinct(), f"{path}/hours", sensors, by=by)

    closed = late.select("tool_id", period.alias("period")).distinct()
    known = _rows_of(spark, f"{path}/hours", sensors, closed, by).select(*columns)
    known = known.union(_read(spark, f"{path}/late", ddl).select(*columns))
    stored(late.subtract(known), "ingest-late").write.mode("append").parquet(f"{path}/late")

    until = F.max("ts") - F.expr(f"INTERVAL '{int(window_hours)}' HOUR")
    marks = rows.groupBy("tool_id").agg(period_of(until, by).alias("sealed_before"))
    marks.write.mode("append").parquet(f"{path}/sealed")
    return states


def sealed_before(spark: SparkSession, path: str) -> DataFrame:
    """``tool_id, sealed_before``: hours that begin earlier take no more rows."""
    marks = _read(spark, f"{path}/sealed", "tool_id string, sealed_before timestamp_ntz")
    return marks.groupBy("tool_id").agg(F.max("sealed_before").alias("sealed_before"))


def late_rows(spark: SparkSession, path: str, sensors: str) -> DataFrame:
    """Rows that came for hours sealed already."""
    return _read(spark, f"{path}/late", f"tool_id string, ts timestamp_ntz, {sensors}")


def _rows_of(spark: SparkSession, path: str, sensors: str, periods: DataFrame, by: str) -> DataFrame:
    """Stored rows of the given tools' periods; folder keys let Spark prune at run time."""
    keys = FOLDERS[: FOLDERS.index(by) + 1]
    parts = {"year": F.year, "month": F.month, "day": F.day, "hour": F.hour}
    asked = periods.select("tool_id", *[parts[k]("period").cast("int").alias(k) for k in keys])
    try:
        rows = read_partitioned(spark, path, sensors, by=by)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame(
            [], f"ts timestamp_ntz, {sensors}, tool_id string, " + ", ".join(f"{k} int" for k in keys)
        )
    return rows.join(asked, ["tool_id", *keys], "left_semi").drop(*keys)


def _read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def _names(spark: SparkSession, ddl: str) -> list[str]:
    return [f"`{c}`" for c in spark.createDataFrame([], ddl).columns]
