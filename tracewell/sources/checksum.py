"""SHA-256 of stored files and their audit against a manifest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.sources.files import _locate, list_parquet
from tracewell.sources.layout import relative_path, tool_of

CHUNK_BYTES = 1024 * 1024
HASH_FIELDS = pa.schema([("path", pa.string()), ("length", pa.int64()), ("sha256", pa.string())])


def file_checksums(spark: SparkSession, root: str) -> DataFrame:
    """``file_id, tool_id, size_bytes, sha256`` of every Parquet file below ``root``.

    Executors read each file as a stream, so no file has to fit in memory.
    """
    hashed = list_parquet(spark, root).select("path", "length").mapInArrow(
        _hash_streams, "path string, length bigint, sha256 string"
    )
    relative = relative_path(F.col("path"), root)
    return hashed.select(
        relative.alias("file_id"),
        tool_of(relative).alias("tool_id"),
        F.col("length").alias("size_bytes"),
        "sha256",
    )


def audit_checksums(stored: DataFrame, manifest: DataFrame) -> DataFrame:
    """``ok``, ``mismatch``, ``missing`` or ``unchecked`` (no checksum) per manifest entry."""
    actual = stored.select("file_id", F.col("sha256").alias("actual_sha256"))
    status = (
        F.when(F.col("actual_sha256").isNull(), "missing")
        .when(F.col("sha256").isNull(), "unchecked")
        .when(F.col("sha256") == F.col("actual_sha256"), "ok")
        .otherwise("mismatch")
    )
    return manifest.join(actual, "file_id", "left").select(
        "file_id", "tool_id", "sha256", "actual_sha256", status.alias("status")
    )


def _hash_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for entry in batch.to_pylist():
            filesystem, inner = _locate(entry["path"])
            digest = hashlib.sha256()
            with filesystem.open_input_stream(inner) as stream:
                while chunk := stream.read(CHUNK_BYTES):
                    digest.update(chunk)
            rows.append({**entry, "sha256": digest.hexdigest()})
        yield pa.RecordBatch.from_pylist(rows, schema=HASH_FIELDS)
