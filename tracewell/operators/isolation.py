"""Down-sampling that outlives files which break or go away after they were indexed.

The scan skips what it can't read, and the same pass counts the rows that each file gave. A file
that gave another number than the index has for it makes its tool unreadable; the other tools'
buckets are what they would be without it.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.functions.time import bucket_start_by, in_range
from tracewell.session import stored
from tracewell.sources.files import list_parquet
from tracewell.sources.readings import read_by_index

MEASURES = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


class Isolated(NamedTuple):
    """Buckets of the tools that could be read, and how every tool and file fared."""

    buckets: DataFrame
    tools: DataFrame
    files: DataFrame


def isolated_downsample(
    spark: SparkSession,
    files: DataFrame,
    sensors: list[str],
    seconds: int,
    *,
    root: str,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
) -> Isolated:
    """Average, minimum and maximum per tool and bucket, tool by tool.

    ``files`` are index rows, pruned to what is wanted. Each file is read once and whole, so that
    its rows can be counted, and only rows in ``[start, end)`` reach the buckets; a file cut by the
    range costs its rows outside it. What the scan finds is written once as partial sums per file
    and bucket; ``buckets``, ``tools`` and ``files`` all come from there. Files that went away or
    have another size than indexed are not opened at all.

    ``tools``: ``tool_id, status, message``, status ``ok``, ``unreadable`` or ``empty`` (no row in
    the range). ``files``: ``file_id, tool_id, row_count, rows_read, status``, status ``ok``,
    ``gone``, ``changed`` (another size, or more rows than indexed) or ``unreadable`` (fewer rows).
    Any but ``ok`` makes the file's tool unreadable, since its result would lack rows. Damage that
    leaves every row readable isn't seen; the checksum audit finds it.
    """
    now = list_parquet(spark, root).select("path", F.col("length").alias("_now"))
    indexed = stored(files.join(now, "path", "left"), "isolation-files")
    readings = read_by_index(
        spark, indexed.where("_now = size_bytes"), sensors, root=root, tolerant=True
    )
    bucket = bucket_start_by(F.col("ts"), F.lit(max(1, int(seconds))))
    partial = stored(
        readings.groupBy(
            "tool_id", "file_id", F.when(in_range(F.col("ts"), start, end), bucket).alias("bucket")
        ).agg(
            F.count("*").alias("n"),
            *[f(f"`{s}`").alias(f"{s}_{m}") for s in sensors for m, f in MEASURES.items()],
        ),
        "isolation-partial",
    )
    ledger = _ledger(indexed, partial)
    tools = _tool_outcomes(ledger)
    broken = tools.where("status = 'unreadable'").select(F.col("tool_id").alias("_tool"))
    whole = partial.where("bucket IS NOT NULL").join(
        broken, F.col("tool_id").eqNullSafe(F.col("_tool")), "left_anti"
    )
    merged = []
    for s in sensors:
        total, n = F.sum(f"`{s}_sum`"), F.sum(f"`{s}_count`")
        merged.append(F.when(n > 0, total / n).alias(f"{s}_avg"))
        merged += [F.min(f"`{s}_min`").alias(f"{s}_min"), F.max(f"`{s}_max`").alias(f"{s}_max")]
    buckets = whole.groupBy("tool_id", "bucket").agg(F.sum("n").alias("n"), *merged)
    return Isolated(buckets, tools, ledger.drop("wanted", "reason"))


def _ledger(indexed: DataFrame, partial: DataFrame) -> DataFrame:
    """Rows that each file gave against those the index has for it."""
    read = partial.groupBy("file_id").agg(
        F.sum("n").alias("rows_read"),
        F.sum(F.when(F.col("bucket").isNotNull(), F.col("n"))).alias("wanted"),
    )
    given = F.coalesce("rows_read", F.lit(0))
    status = (
        F.when(F.col("_now").isNull(), "gone")
        .when((F.col("_now") != F.col("size_bytes")) | (given > F.col("row_count")), "changed")
        .when(given < F.col("row_count"), "unreadable")
        .otherwise("ok")
    )
    # The wording of the messages.
    reason = (
        F.when(status == "gone", F.concat("file_id", F.lit(" is gone")))
        .when(status == "changed", F.concat("file_id", F.lit(" changed since it was indexed")))
        .when(
            status == "unreadable",
            F.concat("file_id", F.lit(" gave "), given, F.lit(" of "), "row_count", F.lit(" rows")),
        )
    )
    return indexed.join(read, "file_id", "left").select(
        "file_id",
        "tool_id",
        "row_count",
        given.alias("rows_read"),
        F.coalesce("wanted", F.lit(0)).alias("wanted"),
        status.alias("status"),
        reason.alias("reason"),
    )


def _tool_outcomes(ledger: DataFrame) -> DataFrame:
    per_tool = ledger.groupBy("tool_id").agg(
        F.min("reason").alias("reason"), F.sum("wanted").alias("wanted")
    )
    status = (
        F.when(F.col("reason").isNotNull(), "unreadable")
        .when(F.col("wanted") == 0, "empty")
        .otherwise("ok")
    )
    return per_tool.select(
        "tool_id", status.alias("status"), F.coalesce("reason", F.lit("")).alias("message")
    )
