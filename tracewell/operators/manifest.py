"""The server's manifest against the file index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def to_download(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries the index lacks, holds with another checksum, or holds without one."""
    local = files.select(
        "file_id", F.col("sha256").alias("local_sha"), F.lit(True).alias("present")
    )
    wanted = (
        F.when(F.col("present").isNull(), "absent")
        .when(F.col("sha256").isNotNull() & F.col("local_sha").isNull(), "no_local_checksum")
        .when(F.col("sha256") != F.col("local_sha"), "changed")
    )
    return (
        manifest.join(local, "file_id", "left")
        .withColumn("why", wanted)
        .where(F.col("why").isNotNull())
        .select("file_id", "tool_id", "url", "sha256", "size_bytes", "why")
    )


def not_in_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Indexed files the manifest no longer lists."""
    return files.join(manifest.select("file_id"), "file_id", "left_anti")


def bytes_per_tool(downloads: DataFrame) -> DataFrame:
    return downloads.groupBy("tool_id").agg(
        F.count("*").alias("files"), F.sum("size_bytes").alias("bytes")
    )


def update_summary(downloads: DataFrame, gone: DataFrame) -> DataFrame:
    """Counts of both lists in one row."""
    return (
        downloads.select(F.lit(1).alias("down"), F.lit(0).alias("gone"))
        .unionByName(gone.select(F.lit(0).alias("down"), F.lit(1).alias("gone")))
        .agg(
            F.coalesce(F.sum("down"), F.lit(0)).alias("to_download"),
            F.coalesce(F.sum("gone"), F.lit(0)).alias("archived_locally"),
        )
    )
