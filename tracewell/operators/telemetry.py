"""Usage events: typed payloads, daily counts and time between sessions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracewell.functions.time import epoch_micros, floor_div
from tracewell.session import stored

# Payload fields of every event type, with their Spark types.
EVENT_FIELDS = {
    "query_run": {
        "tool_count": "bigint",
        "sensor_count": "bigint",
        "range_seconds": "bigint",
        "resolution_seconds": "double",
        "latency_ms": "bigint",
    },
    "query_failed": {"error_type": "string", "partial_results": "boolean"},
    "download_started": {"file_id": "string", "resuming": "boolean", "existing_bytes": "bigint"},
    "download_failed": {"file_id": "string", "error_type": "string", "partial_bytes": "bigint"},
    "download_completed": {"file_id": "string", "bytes_written": "bigint"},
    "update_check": {"cache_hit": "boolean"},
    "app_start": {
        "app_version": "string",
        "platform": "string",
        "platform_release": "string",
        "python_version": "string",
        "seconds_since_last_exit": "double",
    },
    "app_exit": {
        "app_version": "string",
        "platform": "string",
        "platform_release": "string",
        "python_version": "string",
    },
    "error": {"error_type": "string", "traceback": "string", "thread": "string"},
}


def parse_event_lines(lines: DataFrame) -> DataFrame:
    """JSON lines ``{"type", "data", "created_at"}`` in ``value`` to typed event rows.

    Lines that are no JSON object with a text type are dropped.
    """
    doc = F.col("doc")
    return (
        lines.select(F.try_parse_json("value").alias("doc"))
        .select(
            F.try_variant_get(doc, "$.type", "string").alias("type"),
            F.try_variant_get(doc, "$.created_at", "timestamp")
            .cast("timestamp_ntz")
            .alias("created_at"),
            F.try_variant_get(doc, "$.data", "variant").alias("payload"),
        )
        .where(F.col("type").isNotNull())
    )


def event_fields(events: DataFrame, event_type: str) -> DataFrame:
    """One event type's rows with its payload fields as typed columns."""
    fields = [
        F.try_variant_get("payload", f"$.{name}", kind).alias(name)
        for name, kind in EVENT_FIELDS[event_type].items()
    ]
    keep = [c for c in events.columns if c not in ("type", "payload")]
    return events.where(F.col("type") == event_type).select(*keep, *fields)


def event_texts(events: DataFrame) -> DataFrame:
    """``type, created_at, fields`` of all events, the fields of their type as one text.

    Fields are joined by ``|`` in the order of ``EVENT_FIELDS``, ``-`` for one that is absent. One
    scan for all types: a row reads only the fields of its own type. Unknown types are left out.
    """
    text = F.lit(None).cast("string")
    for kind, fields in EVENT_FIELDS.items():
        cells = [
            F.coalesce(F.try_variant_get("payload", f"$.{name}", of).cast("string"), F.lit("-"))
            for name, of in fields.items()
        ]
        text = F.when(F.col("type") == kind, F.concat_ws("|", *cells)).otherwise(text)
    return events.where(F.col("type").isin(*EVENT_FIELDS)).select(
        "type", "created_at", text.alias("fields")
    )


def dated_lines(lines: DataFrame) -> DataFrame:
    """Event lines with the UTC ``day`` they were created on; lines without one have NULL."""
    created = F.try_variant_get(F.try_parse_json("value"), "$.created_at", "timestamp")
    return lines.select(*[c for c in lines.columns if c != "day"], F.to_date(created).alias("day"))


def archive_days(spark: SparkSession, dated: DataFrame, path: str, *, before: str) -> None:
    """Bring the lines of all days before ``before`` into day folders below ``path``.

    A folder is rewritten from what it holds and what is live, equal lines being one, and replaced
    when the write commits. So a run that is made twice, or again after one that was cut off,
    leaves the same folders, and nothing archived is lost when its live rows are gone already.
    Days without live rows aren't touched. Drop live rows (:func:`live_lines`) only after this
    returned; lines without a day stay live.
    """
    old = stored(dated.where(F.col("day") < F.lit(before).cast("date")), "archive-live")
    days = old.select("day").distinct()
    there = archived_lines(spark, path, dated).join(days, "day", "left_semi")
    whole = stored(old.unionByName(there.select(*old.columns)).distinct(), "archive-whole")
    whole.repartition("day").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("day").parquet(path)


def live_lines(dated: DataFrame, *, before: str) -> DataFrame:
    """Lines that stay live once all days before ``before`` are archived."""
    return dated.where(F.col("day").isNull() | (F.col("day") >= F.lit(before).cast("date")))


def archived_lines(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Archived lines with the columns of ``like``; none if there is no archive yet."""
    try:
        return spark.read.schema(like.schema).parquet(path).select(*like.columns)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], like.schema)


def counts_per_day(events: DataFrame) -> DataFrame:
    return events.groupBy("type", F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("events")
    )


def seconds_since_last_exit(
    events: DataFrame, *, client: str = "client", chunk_hours: int = 1
) -> DataFrame:
    """For every ``app_start``, seconds since the client's latest earlier ``app_exit``.

    NULL before the first exit, never negative, three decimals. A client's events are cut into
    hours: the exit is looked up inside the hour, and failing that carried over from the hours
    before, of which there is one row each. No task gathers all events of one client.
    """
    ends = F.when(F.col("type") == "app_exit", F.col("created_at"))
    life = events.where(F.col("type").isin("app_start", "app_exit")).select(
        "id",
        F.col(client).alias("client"),
        "type",
        "created_at",
        ends.alias("exit_ts"),
        floor_div(epoch_micros(F.col("created_at")), chunk_hours * 3_600_000_000).alias("chunk"),
    )
    hours = life.groupBy("client", "chunk").agg(F.max("exit_ts").alias("last_exit"))
    before = Window.partitionBy("client").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = hours.select("client", "chunk", F.max("last_exit").over(before).alias("carried"))
    inside = Window.partitionBy("client", "chunk").orderBy("created_at", "id").rowsBetween(
        Window.unboundedPreceding, -1
    )
    found = life.withColumn("near", F.max("exit_ts").over(inside)).where(
        F.col("type") == "app_start"
    )
    return found.join(carried, ["client", "chunk"], "left").select(
        "id",
        "client",
        "created_at",
        _seconds_between(F.coalesce("near", "carried"), F.col("created_at")).alias(
            "seconds_since_last_exit"
        ),
    )


def _seconds_between(start: Column, end: Column) -> Column:
    micros = epoch_micros(end) - epoch_micros(start)
    return F.bround(F.when(micros < 0, 0).otherwise(micros) / 1_000_000, 3)
