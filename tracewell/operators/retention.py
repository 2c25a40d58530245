"""Which files are to go, by age and by the room they take."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.functions.time import utc_literal
from tracewell.session import stored


def running_total(rows: DataFrame, weight: str, order: list[Column], name: str) -> DataFrame:
    """Sum of ``weight`` over all rows up to each, without one task seeing them all.

    Rows are dealt by range and summed inside their part; what the parts before hold is added from
    one row per part.
    """
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranged = stored(
        rows.repartitionByRange(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_inside", F.sum(weight).over(inside)),
        "running-total",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ranged.groupBy("_part")
        .agg(F.sum(weight).alias("_sum"))
        .select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    )
    return (
        ranged.join(F.broadcast(carried), "_part")  # one row per part
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_part", "_inside", "_before")
    )


def retention(
    files: DataFrame, now: datetime | str | Column, *, max_age_days: int, budget_bytes: int
) -> DataFrame:
    """Every index row with ``drop``: ``age``, ``size`` or NULL for what stays, and ``bytes_kept``.

    Files whose newest reading lies ``max_age_days`` or more before ``now`` go first. Of the rest
    the newest stay, until the next one would take more than ``budget_bytes`` together with the
    pinned ones; pinned files always stay, archived ones count like others. A file without a size
    takes no room, one without times is the oldest and goes for its age.
    ``bytes_kept`` is the room taken by the pinned files and the newest ones up to this.
    """
    limit = utc_literal(now) - F.expr(f"INTERVAL '{int(max_age_days)}' DAY")
    room = F.coalesce("size_bytes", F.lit(0)).cast("long")
    old = F.coalesce(F.col("max_ts") <= limit, F.lit(True)) & ~F.col("pinned")
    marked = files.withColumn("_room", room).withColumn("_old", old)
    pinned = marked.where("pinned").agg(F.coalesce(F.sum("_room"), F.lit(0)).alias("_pinned"))
    order = [F.col("max_ts").desc(), F.col("file_id").asc()]
    rest = running_total(marked.where("NOT pinned AND NOT _old"), "_room", order, "_newest")
    full = F.col("_newest") + F.col("_pinned")
    kept = rest.crossJoin(F.broadcast(pinned)).select(  # one row
        *files.columns, F.when(full > budget_bytes, "size").alias("drop"), full.alias("bytes_kept")
    )
    others = marked.where("pinned OR _old").select(
        *files.columns, F.when(F.col("_old"), "age").alias("drop"), F.lit(None).cast("long").alias("bytes_kept")
    )
    return kept.unionByName(others)
