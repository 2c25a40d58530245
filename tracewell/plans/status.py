"""Per-tool outcome decided before the shared job runs, so one bad tool cannot fail it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def tool_status(
    tools: DataFrame, plan: DataFrame, catalog: DataFrame, files: DataFrame, quarantine: DataFrame
) -> DataFrame:
    """``ok``, ``empty``, ``missing_column`` or ``unreadable`` with a message for every tool.

    A tool with readable files keeps its result: bad files beside them, or some absent columns,
    only show in the message. ``unreadable`` has bad files alone, ``missing_column`` none of the
    columns asked for.

    ``tools(tool_id)``, ``plan(tool_id, raw_name)``, ``catalog(tool_id, raw_name)``,
    ``files(tool_id)`` of readable files and ``quarantine(tool_id, reason)``.
    """
    asked = plan.select("tool_id", "raw_name").distinct()
    known = catalog.select("tool_id", "raw_name", F.lit(True).alias("known")).distinct()
    columns = (
        asked.join(known, ["tool_id", "raw_name"], "left")
        .groupBy("tool_id")
        .agg(
            F.count("*").alias("n_columns"),
            F.count_if(F.col("known").isNull()).alias("n_absent"),
            F.min(F.when(F.col("known").isNull(), F.col("raw_name"))).alias("first_absent"),
        )
    )
    readable = files.groupBy("tool_id").agg(F.count("*").alias("n_files"))
    bad = quarantine.groupBy("tool_id").agg(F.min("reason").alias("reason"))
    absent = F.concat(F.lit("no column '"), "first_absent", F.lit("' in this tool's files"))
    status = (
        F.when(F.col("n_files").isNull() & F.col("reason").isNotNull(), "unreadable")
        .when(F.col("n_files").isNull() | F.col("n_columns").isNull(), "empty")
        .when(F.col("n_absent") == F.col("n_columns"), "missing_column")
        .otherwise("ok")
    )
    message = (
        F.when(status == "empty", F.lit(""))
        .when(status == "missing_column", absent)
        .otherwise(F.coalesce("reason", absent, F.lit("")))
    )
    return (
        tools.select("tool_id")
        .distinct()
        .join(columns, "tool_id", "left")
        .join(readable, "tool_id", "left")
        .join(bad, "tool_id", "left")
        .select("tool_id", status.alias("status"), message.alias("message"))
    )
