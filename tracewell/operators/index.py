"""The file index: pruning, coverage, extents, upsert and clean-up.

An index row holds ``file_id, tool_id, hour_bucket, min_ts, max_ts, row_count, size_bytes,
sha256, pinned, archived``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.time import epoch_micros, floor_div, iso_text, utc_literal

MEASURED = ("tool_id", "hour_bucket", "min_ts", "max_ts", "row_count", "size_bytes")


def active(files: DataFrame) -> DataFrame:
    return files.where(~F.col("archived"))


def archived(files: DataFrame) -> DataFrame:
    return files.where(F.col("archived"))


def active_tools(files: DataFrame) -> DataFrame:
    return active(files).select("tool_id").distinct()


def files_for(files: DataFrame, tool_id: str, start: datetime, end: datetime) -> DataFrame:
    """Files of one tool that touch ``[start, end]``, both ends included, oldest first."""
    return (
        active(files)
        .where(
            (F.col("tool_id") == tool_id)
            & (F.col("min_ts") <= utc_literal(end))
            & (F.col("max_ts") >= utc_literal(start))
        )
        .orderBy("min_ts", "file_id")
    )


def overlapping_files(selections: DataFrame, files: DataFrame, bin_days: int = 31) -> DataFrame:
    """Files overlapping each ``selection_id, tool_id, start, end`` row, both ends included.

    ``bin_days`` should be near the usual length of a requested range. Ranges are laid over
    day-aligned bins and joined on tool and bin, so only neighbours in time ever meet. A pair
    sharing several bins is kept in the first of them alone, which makes a distinct unnecessary.
    """
    ranges = _binned(selections, bin_days)
    bins = F.when(F.col("start") <= F.col("end"), F.sequence("start_bin", "end_bin"))
    return _touching(ranges.withColumn("bin", F.explode(bins)), files, bin_days).select(
        "selection_id", "tool_id", "file_id", "min_ts", "max_ts"
    )


def _bin_of(ts: Column, bin_days: int) -> Column:
    return floor_div(epoch_micros(ts), bin_days * 86_400_000_000)


def _binned(selections: DataFrame, bin_days: int) -> DataFrame:
    return selections.select(
        "selection_id",
        "tool_id",
        "start",
        "end",
        _bin_of(F.col("start"), bin_days).alias("start_bin"),
        _bin_of(F.col("end"), bin_days).alias("end_bin"),
    )


def _touching(ranges: DataFrame, files: DataFrame, bin_days: int) -> DataFrame:
    """Join ranges, one row per bin, with the files they overlap in that bin for the first time."""
    file_bin = _bin_of(F.col("min_ts"), bin_days)
    spans = active(files).select(
        F.col("tool_id").alias("file_tool"),
        "file_id",
        "min_ts",
        "max_ts",
        file_bin.alias("file_bin"),
        F.explode(F.sequence(file_bin, _bin_of(F.col("max_ts"), bin_days))).alias("span_bin"),
    )
    meets = (
        (F.col("tool_id") == F.col("file_tool"))
        & (F.col("bin") == F.col("span_bin"))
        & (F.col("min_ts") <= F.col("end"))
        & (F.col("max_ts") >= F.col("start"))
        & (F.col("bin") == F.greatest("start_bin", "file_bin"))
    )
    return ranges.join(spans, meets)


def coverage(selections: DataFrame, files: DataFrame, bin_days: int = 31) -> DataFrame:
    """Earliest and latest overlapping data per selection and tool, with the warnings shown.

    A file that begins in a bin strictly inside the range overlaps it for certain, so such bins
    count as one summary row each; only the two bins that the range cuts meet single files.
    """
    ranges = _binned(selections, bin_days)
    valid = F.col("start") <= F.col("end")
    keys = ["selection_id", "tool_id", "start", "end"]
    cut = F.when(valid, F.array_distinct(F.array("start_bin", "end_bin")))
    at_ends = _touching(ranges.withColumn("bin", F.explode(cut)), files, bin_days).select(
        *keys, "min_ts", "max_ts", F.lit(1).cast("long").alias("n")
    )
    summary = (
        active(files)
        .groupBy(F.col("tool_id").alias("file_tool"), _bin_of(F.col("min_ts"), bin_days).alias("file_bin"))
        .agg(F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"), F.count("*").alias("n"))
    )
    first, last = F.col("start_bin") + 1, F.col("end_bin") - 1
    inner = F.when(valid & (first <= last), F.sequence(first, last))
    inside = (
        ranges.withColumn("bin", F.explode(inner))
        .join(summary, (F.col("tool_id") == F.col("file_tool")) & (F.col("bin") == F.col("file_bin")))
        .select(*keys, "min_ts", "max_ts", "n")
    )
    nothing = ranges.select(
        *keys,
        F.lit(None).cast("timestamp_ntz").alias("min_ts"),
        F.lit(None).cast("timestamp_ntz").alias("max_ts"),
        F.lit(0).cast("long").alias("n"),
    )
    found = (
        nothing.union(at_ends)
        .union(inside)
        .groupBy(*keys)
        .agg(
            F.min("min_ts").alias("earliest"),
            F.max("max_ts").alias("latest"),
            F.sum("n").alias("files"),
        )
    )
    # The wording of the warnings.
    none = F.concat(
        F.lit("No local data for "), F.col("tool_id"), F.lit(" in the requested range.")
    )
    late = F.concat(
        F.col("tool_id"), F.lit(": range starts before local data (earliest "),
        iso_text(F.col("earliest")), F.lit(")."),
    )
    early = F.concat(
        F.col("tool_id"), F.lit(": range ends after local data (latest "),
        iso_text(F.col("latest")), F.lit(")."),
    )
    warnings = F.when(F.col("earliest").isNull(), F.array(none)).otherwise(
        F.array_compact(
            F.array(
                F.when(F.col("earliest") > F.col("start"), late),
                F.when(F.col("latest") < F.col("end"), early),
            )
        )
    )
    return found.select(
        "selection_id", "tool_id", "earliest", "latest", "files", warnings.alias("warnings")
    )


def tool_extents(files: DataFrame) -> DataFrame:
    """File count and time extent of every tool with files that are not archived."""
    return (
        active(files)
        .groupBy("tool_id")
        .agg(
            F.count("*").alias("files"),
            F.min("min_ts").alias("earliest"),
            F.max("max_ts").alias("latest"),
        )
    )


def global_extent(files: DataFrame) -> DataFrame:
    return files.agg(F.min("min_ts").alias("earliest"), F.max("max_ts").alias("latest"))


def library_size(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


def vanished(indexed: DataFrame, seen: DataFrame) -> DataFrame:
    """Files indexed earlier that the new scan no longer finds."""
    return indexed.join(seen.select("file_id"), "file_id", "left_anti")


def upsert(indexed: DataFrame, scanned: DataFrame) -> DataFrame:
    """The next index snapshot: new measurements, old ``pinned`` and ``archived`` flags.

    A known checksum stays as long as size and extents are unchanged. Files the scan did not
    find keep their row.
    """
    return _merged(indexed, scanned, "full_outer")


def rescan(indexed: DataFrame, scanned: DataFrame) -> DataFrame:
    """The same for a complete scan: files it did not find leave the index."""
    return _merged(indexed, scanned, "right_outer")


def _merged(indexed: DataFrame, scanned: DataFrame, how: str) -> DataFrame:
    old, new = indexed.alias("o"), scanned.alias("n")
    is_new = F.col("n.file_id").isNotNull()
    unchanged = (
        (F.col("o.size_bytes") == F.col("n.size_bytes"))
        & (F.col("o.min_ts") == F.col("n.min_ts"))
        & (F.col("o.max_ts") == F.col("n.max_ts"))
    )
    sha = F.coalesce("n.sha256", F.when(~is_new | unchanged, F.col("o.sha256")))
    return old.join(new, F.col("o.file_id") == F.col("n.file_id"), how).select(
        F.coalesce("n.file_id", "o.file_id").alias("file_id"),
        *[
            F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in MEASURED
        ],
        sha.alias("sha256"),
        F.coalesce("o.pinned", F.lit(False)).alias("pinned"),
        F.coalesce("o.archived", F.lit(False)).alias("archived"),
    )


def archive_unlisted(indexed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Set ``archived`` on files the manifest doesn't list, in one join."""
    listed = manifest.select("file_id", F.lit(True).alias("listed")).distinct()
    return indexed.join(listed, "file_id", "left").select(
        *[c for c in indexed.columns if c != "archived"],
        (F.col("archived") | F.col("listed").isNull()).alias("archived"),
    )
