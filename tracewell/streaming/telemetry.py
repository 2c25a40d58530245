"""Usage events as they arrive: the one append-only feed among the inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.operators.telemetry import parse_event_lines


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New JSON line files in ``folder`` as typed events."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return parse_event_lines(lines)


def ingest_events(events: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Append everything available to a Parquet table partitioned by day, then stop.

    The checkpoint makes a repeated or restarted run append each file once.
    """
    return (
        events.withColumn("payload", F.to_json("payload"))
        .withColumn("day", F.to_date("created_at"))
        .writeStream.format("parquet")
        .option("path", table_path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("day")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
