"""File listing, footer scan, quarantine and the raw sensor catalog."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.functions.time import micros_to_ts
from tracewell.sources.layout import hour_bucket_of, relative_path, tool_of

# Field metadata keys that may hold the units of a sensor.
UNIT_KEYS = (b"units", b"unit")
TICKS_PER_SECOND = {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}

FOOTER_FIELDS = pa.schema(
    [
        ("path", pa.string()),
        ("length", pa.int64()),
        ("modified_us", pa.int64()),
        ("time_column", pa.string()),
        ("time_type", pa.string()),
        ("column_types", pa.map_(pa.string(), pa.string())),
        ("min_us", pa.int64()),
        ("max_us", pa.int64()),
        ("row_count", pa.int64()),
        ("reason", pa.string()),
    ]
)
FOOTER_DDL = (
    "path string, length bigint, modified_us bigint, time_column string, time_type string,"
    " column_types map<string, string>,"
    " min_us bigint, max_us bigint, row_count bigint, reason string"
)
COLUMN_FIELDS = pa.schema(
    [
        ("tool_id", pa.string()),
        ("raw_name", pa.string()),
        ("units", pa.string()),
        ("numeric", pa.bool_()),
        ("position", pa.int32()),
    ]
)
COLUMN_DDL = "tool_id string, raw_name string, units string, numeric boolean, position int"


def list_parquet(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, modified_us`` of every Parquet file below ``root``; no content is read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length", F.unix_micros("modificationTime").alias("modified_us"))
    )


def scan_files(
    spark: SparkSession, root: str, time_columns: tuple[str, ...] = ("ts",)
) -> DataFrame:
    """Footer facts of every file; ``reason`` tells why a file cannot be used, else NULL.

    Executors read the footers only, a few kilobytes per file. The first of ``time_columns``
    a file has is its time column. The result, stored, is what :func:`scan_changed` goes on from.
    """
    return _scan_listed(list_parquet(spark, root), root, time_columns)


def scan_changed(
    spark: SparkSession, root: str, known: DataFrame, time_columns: tuple[str, ...] = ("ts",)
) -> DataFrame:
    """The same as :func:`scan_files`, opening only files that ``known`` doesn't have as they are.

    ``known`` is the stored result of an earlier scan with the same ``time_columns``. A file counts
    as unchanged when its path, size and time of change are equal; its row is taken over, with the
    reason if it is quarantined. Files that went away have no row. The listing meets the known rows
    in one join before any footer is opened.
    """
    listed = list_parquet(spark, root)
    same = listed.withColumnRenamed("length", "size_bytes")
    kept = known.join(same, ["path", "size_bytes", "modified_us"], "left_semi")
    before = known.select("path", F.col("size_bytes").alias("length"), "modified_us")
    changed = listed.join(before, ["path", "length", "modified_us"], "left_anti")
    opened = _scan_listed(changed, root, time_columns)
    return opened.unionByName(kept)


def scan_one(
    spark: SparkSession, root: str, file_id: str, time_columns: tuple[str, ...] = ("ts",)
) -> DataFrame:
    """The scan row of a single file below ``root``, such as one that was just downloaded."""
    return _scan_listed(list_parquet(spark, f"{root.rstrip('/')}/{file_id}"), root, time_columns)


def _scan_listed(listed: DataFrame, root: str, time_columns: tuple[str, ...]) -> DataFrame:
    scanned = listed.mapInArrow(_footer_reader(time_columns), FOOTER_DDL)
    relative = relative_path(F.col("path"), root)
    return scanned.select(
        relative.alias("file_id"),
        tool_of(relative).alias("tool_id"),
        hour_bucket_of(relative).alias("hour_bucket"),
        "path",
        micros_to_ts(F.col("min_us")).alias("min_ts"),
        micros_to_ts(F.col("max_us")).alias("max_ts"),
        "row_count",
        F.col("length").alias("size_bytes"),
        "modified_us",
        "time_column",
        "time_type",
        "column_types",
        "reason",
    )


def index_of(scanned: DataFrame) -> DataFrame:
    """Usable files of a scan in the shape of the file index."""
    return scanned.where(F.col("reason").isNull()).select(
        "file_id",
        "tool_id",
        "path",
        "hour_bucket",
        "min_ts",
        "max_ts",
        "row_count",
        F.lit(None).cast("string").alias("sha256"),
        F.lit(False).alias("pinned"),
        F.lit(False).alias("archived"),
        "size_bytes",
        "time_column",
        "time_type",
        "column_types",
    )


def quarantine_of(scanned: DataFrame) -> DataFrame:
    """Files of a scan that cannot be used, each with the reason."""
    return scanned.where(F.col("reason").isNotNull()).select("file_id", "tool_id", "reason")


def sensor_catalog(index: DataFrame) -> DataFrame:
    """Columns and units of each tool's oldest active file, in file order, without its time.

    A file that went away or broke since the scan gives no columns; the next scan sees it.
    """
    first = (
        index.where(~F.col("archived"))
        .groupBy("tool_id")
        .agg(F.min(F.struct("min_ts", "file_id", "path", "time_column")).alias("f"))
        .select("tool_id", "f.path", "f.time_column")
    )
    return first.mapInArrow(_read_columns, COLUMN_DDL)


def _footer_reader(time_columns: tuple[str, ...]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"path": path, "length": length, "modified_us": modified, **_footer_facts(path, time_columns)}
                for path, length, modified in zip(*(c.to_pylist() for c in batch.columns))
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=FOOTER_FIELDS)

    return read


def _footer_facts(path: str, time_columns: tuple[str, ...]) -> dict:
    try:
        filesystem, inner = _locate(path)
        footer = pq.read_metadata(inner, filesystem=filesystem)
        schema = footer.schema.to_arrow_schema()
    except (OSError, ValueError, pa.ArrowException) as error:
        return {"reason": f"unreadable footer: {str(error).splitlines()[0]}"}
    column = next((name for name in time_columns if name in schema.names), None)
    if column is None:
        return {"reason": f"no time column {' or '.join(time_columns)}"}
    if footer.num_row_groups == 0:
        return {"reason": "no row groups"}
    time_type = schema.field(column).type
    if not (pa.types.is_timestamp(time_type) or time_type == pa.int64()):
        return {"reason": f"time column {column} has type {time_type}"}
    try:
        place = [footer.schema.column(i).path for i in range(len(footer.schema))].index(column)
        groups = [footer.row_group(g).column(place) for g in range(footer.num_row_groups)]
        stats = [group.statistics for group in groups]
        if any(s is None or not s.has_min_max for s in stats):
            return {"reason": f"no statistics on {column}"}
        to_micros = _micros_from(time_type.unit if time_type != pa.int64() else "ns")
        low, high = min(s.min_raw for s in stats), max(s.max_raw for s in stats)
        extent = {"min_us": to_micros(low), "max_us": to_micros(high)}
    except (OSError, ValueError, TypeError, pa.ArrowException) as error:
        return {"reason": f"unreadable statistics: {str(error).splitlines()[0]}"}
    return {
        "time_column": column,
        "time_type": str(time_type),
        "column_types": [(f.name, str(f.type)) for f in schema if f.name != column],
        "row_count": footer.num_rows,
        **extent,
    }


def _read_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for entry in batch.to_pylist():
            try:
                filesystem, inner = _locate(entry["path"])
                schema = pq.read_schema(inner, filesystem=filesystem)
            except (OSError, ValueError, pa.ArrowException):
                continue
            for position, field in enumerate(schema):
                if field.name != entry["time_column"]:
                    rows.append(
                        {
                            "tool_id": entry["tool_id"],
                            "raw_name": field.name,
                            "units": _units_of(field),
                            "numeric": _is_number(field.type),
                            "position": position,
                        }
                    )
        yield pa.RecordBatch.from_pylist(rows, schema=COLUMN_FIELDS)


def _units_of(field: pa.Field) -> str | None:
    metadata = field.metadata or {}
    return next((metadata[key].decode() for key in UNIT_KEYS if key in metadata), None)


def _is_number(kind: pa.DataType) -> bool:
    return (
        pa.types.is_integer(kind)
        or pa.types.is_floating(kind)
        or pa.types.is_decimal(kind)
        or pa.types.is_boolean(kind)
    )


def _micros_from(unit: str):
    ticks = TICKS_PER_SECOND[unit]
    return lambda raw: raw * 1_000_000 // ticks


def _locate(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
