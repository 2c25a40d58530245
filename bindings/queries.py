"""Every registered query: an operator applied to whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from bindings import tables as t
from tracewell import configure, shared_dir, stored
from tracewell.operators import (
    align,
    catalog,
    downsample,
    hours,
    index,
    indicators,
    isolation,
    manifest,
    overlays,
    raw,
    retention,
    runs,
    saved_sets,
    summary,
    telemetry,
)
from tracewell.functions.time import hour_floor
from tracewell.plans import (
    bucket_seconds_column,
    displayed_columns,
    expand_selection,
    missing_mappings,
    plan_columns,
    plan_metrics,
    resolve_columns,
    tool_status,
)
from tracewell.plans.resolution import bucket_seconds
from tracewell.sources import payloads, sinks
from tracewell.sources.checksum import audit_checksums
from tracewell.sources.files import (
    index_of,
    quarantine_of,
    scan_changed,
    scan_files,
    sensor_catalog,
)
from tracewell.sources.readings import read_by_index, read_selected
from tracewell.sources.sinks import read_partitioned, write_partitioned

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TIME_COLUMNS = ("ts", "l_shipdate", "o_orderdate")


def query(build: Query) -> Query:
    """Register a query under its function's name, with the session configured first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(configure(spark), sf_dir)

    QUERIES[build.__name__] = run
    return run


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Averages depend on the order of additions in the last digits.

    The number of digits keeps clear of exact halves: with values of two decimals, a mean of n
    ends in a half at six digits when n is a multiple of 32, at seven when of 64.
    """
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})


# Down-sampling


@query
def downsample_second(spark, sf_dir):
    return rounded(downsample.downsample_long(t.long(spark, sf_dir), 1), "avg")


@query
def downsample_hour(spark, sf_dir):
    return rounded(downsample.downsample_long(t.long(spark, sf_dir), 3600), "avg")


@query
def downsample_day(spark, sf_dir):
    result = downsample.downsample(t.wide(spark, sf_dir), t.WIDE_SENSORS, 86400)
    return rounded(result, *[f"{s}_avg" for s in t.WIDE_SENSORS])


def _auto(spark, sf_dir, mode):
    width = bucket_seconds(t.EVENTS_START, t.EVENTS_END, mode)
    result = downsample.downsample_long(
        t.long(spark, sf_dir), width, start=t.EVENTS_START, end=t.EVENTS_END
    )
    return rounded(result, "avg")


@query
def downsample_auto_overview(spark, sf_dir):
    return _auto(spark, sf_dir, "overview")


@query
def downsample_auto_standard(spark, sf_dir):
    return _auto(spark, sf_dir, "standard")


@query
def downsample_auto_focus(spark, sf_dir):
    return _auto(spark, sf_dir, "focus")


@query
def downsample_full_extent(spark, sf_dir):
    return rounded(downsample.downsample_extent(t.long(spark, sf_dir), 2000), "avg")


@query
def downsample_zoom(spark, sf_dir):
    return rounded(
        downsample.downsample_zoom(t.long(spark, sf_dir), t.ZOOM_START, t.ZOOM_END), "avg"
    )


@query
def downsample_wide(spark, sf_dir):
    result = downsample.downsample(t.sparse(spark, sf_dir), t.EVENT_SENSORS, 3600)
    return rounded(result, *[f"{s}_avg" for s in t.EVENT_SENSORS])


@query
def downsample_canonical(spark, sf_dir):
    mapping = catalog.latest_mapping(
        payloads.parse_mappings(t.signal_mapping_payloads(spark, sf_dir))
    )
    selection = (
        t.long(spark, sf_dir)
        .select("tool_id")
        .distinct()
        .select(
            F.lit(0).alias("selection_id"),
            F.array("tool_id").alias("tools"),
            F.array().cast("array<string>").alias("sensors_raw"),
            F.array(*[F.lit(f"signal_{i}") for i in range(0, 10, 2)]).alias("sensors_canonical"),
        )
    )
    plan = plan_columns(resolve_columns(expand_selection(selection), mapping))
    return rounded(downsample.downsample_plan(t.long(spark, sf_dir), plan, 3600), "avg")


@query
def downsample_wanted(spark, sf_dir):
    wanted = {tool: t.WIDE_SENSORS[i % 3 : i % 3 + 2] + ["absent"] for i, tool in enumerate(t.TOOLS)}
    wanted["tool_9"] = ["l_tax"]
    return rounded(downsample.downsample_wanted(t.wide(spark, sf_dir), wanted, 86400), "avg")


@query
def downsample_plan_wide(spark, sf_dir):
    plan = plan_columns(_resolved(spark, sf_dir))
    return rounded(
        downsample.downsample_plan_wide(t.wide(spark, sf_dir), plan, 86400, sensors=t.WIDE_SENSORS),
        "avg",
    )


@query
def downsample_wide_groups(spark, sf_dir):
    """More sensors than generated code holds."""
    names = [f"s{i}" for i in range(t.MANY_SENSORS)]
    rows = t.wide(spark, sf_dir).select(
        "tool_id", "ts", *[(F.col("l_quantity") * i - 25).alias(s) for i, s in enumerate(names)]
    )
    return rounded(downsample.downsample(rows, names, 70 * 86400), *[f"{s}_avg" for s in names])


@query
def downsample_index_extent(spark, sf_dir):
    extents = index.tool_extents(t.file_index(spark, sf_dir))
    readings = downsample.to_long(t.wide(spark, sf_dir), ["l_quantity", "l_tax"])
    return rounded(downsample.downsample_extent(readings, 500, extents), "avg")


@query
def downsample_from_files(spark, sf_dir):
    files = index_of(scan_files(spark, sf_dir, ("ts", "l_shipdate")))
    readings = read_by_index(spark, files, ["l_quantity", "value"], root=sf_dir)
    result = downsample.downsample(readings, ["l_quantity", "value"], 86400)
    return rounded(result, "l_quantity_avg", "value_avg")


def _tool_files(spark, sf_dir):
    """Order lines written as one file per tool."""
    path = shared_dir(spark, "tool-files")
    t.wide(spark, sf_dir).repartition("tool_id").write.partitionBy("tool_id").parquet(path)
    return path


@query
def tool_outcome_at_read(spark, sf_dir):
    """tool_2 is written anew, with half of its rows, between the scan and the query."""
    path = _tool_files(spark, sf_dir)
    files = index_of(stored(scan_files(spark, path), "scan"))
    half = t.wide(spark, sf_dir).where("tool_id = 'tool_2' AND l_quantity > 25").drop("tool_id")
    half.write.mode("overwrite").parquet(f"{path}/tool_id=tool_2")
    found = isolation.isolated_downsample(spark, files, ["l_quantity", "l_tax"], 86400, root=path)
    per_tool = found.buckets.groupBy("tool_id").agg(
        F.count("*").alias("buckets"),
        F.sum("n").alias("rows"),
        F.sum("l_tax_avg").alias("tax_means"),
        F.max("l_quantity_max").alias("most"),
    )
    result = found.tools.select("tool_id", "status").join(per_tool, "tool_id", "left")
    return rounded(result, "tax_means", digits=5)


@query
def index_incremental(spark, sf_dir):
    """Orders come as new files beside those of the order lines, one tool among them new."""
    path = _tool_files(spark, sf_dir)
    known = stored(scan_files(spark, path), "scan")
    t.table(spark, sf_dir, "orders").selectExpr(
        "concat('tool_', o_custkey % 9) AS tool_id", "o_orderdate AS ts", "o_totalprice"
    ).repartition("tool_id").write.mode("append").partitionBy("tool_id").parquet(path)
    return index_of(scan_changed(spark, path, known)).groupBy("tool_id").agg(
        F.count("*").alias("files"),
        F.sum("row_count").alias("rows"),
        F.min("min_ts").alias("earliest"),
        F.max("max_ts").alias("latest"),
    )


@query
def selected_readings(spark, sf_dir):
    """What each selection of a table selects from day folders, pruned at run time."""
    path = shared_dir(spark, "readings")
    write_partitioned(t.long(spark, sf_dir), path)
    rows = read_selected(spark, path, t.day_selections(spark, sf_dir), "sensor string, value double")
    return rows.groupBy("selection_id", "tool_id", "sensor").agg(
        F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("value").alias("top")
    )


# Stored hours


@query
def hour_changes(spark, sf_dir):
    """Days of which a second delivery has other rows: long orders lost, some taxes corrected."""
    first = t.wide(spark, sf_dir)
    second = t.second_delivery(spark, sf_dir)
    return hours.changed_periods(hours.fingerprints(first, "day"), hours.fingerprints(second, "day"))


@query
def late_arrivals(spark, sf_dir):
    """Every tenth event comes after the others."""
    path = shared_dir(spark, "ingested")
    rows, ddl = t.long(spark, sf_dir), "sensor string, value double"
    last = t.table(spark, sf_dir, "events").where("event_id % 10 = 0").selectExpr(
        "concat('tool_', user_id % 8) AS tool_id", "ts", "event_type AS sensor", "value"
    )
    for batch in (rows.exceptAll(last), last):
        hours.ingest(spark, batch, path, ddl, window_hours=36, by="day")
    kept = read_partitioned(spark, f"{path}/hours", ddl).groupBy("tool_id").agg(
        F.count("*").alias("rows"), F.max("ts").alias("newest")
    )
    late = hours.late_rows(spark, path, ddl).groupBy("tool_id").agg(F.count("*").alias("late"))
    return kept.join(late, "tool_id", "left").join(hours.sealed_before(spark, path), "tool_id", "left")


@query
def retention_plan(spark, sf_dir):
    """Two fifths of the library's room, and the five years before its newest reading."""
    files = t.file_index(spark, sf_dir)
    room, newest = files.agg(F.sum("size_bytes"), F.max("max_ts")).first()
    return retention.retention(
        files, newest, max_age_days=1826, budget_bytes=room * 2 // 5
    ).select("file_id", "tool_id", "size_bytes", "pinned", "drop", "bytes_kept")


# Plans


def _mapping(spark, sf_dir):
    return catalog.latest_mapping(payloads.parse_mappings(t.mapping_payloads(spark, sf_dir)))


def _mapping_and_groups(spark, sf_dir):
    """Both from one parse of the documents."""
    entries = payloads.parse_mapping_entries(t.mapping_payloads(spark, sf_dir))
    entries = stored(entries, "mapping-entries")
    return (
        catalog.latest_mapping(payloads.mappings_of(entries)),
        catalog.tool_groups(payloads.tool_groups_of(entries)),
    )


def _resolved(spark, sf_dir):
    wanted = expand_selection(t.selections(spark, sf_dir))
    return resolve_columns(wanted, _mapping(spark, sf_dir))


@query
def resolution_choice(spark, sf_dir):
    width = bucket_seconds_column(F.col("start"), F.col("end"), F.col("mode"))
    return t.selections(spark, sf_dir).select(
        "selection_id", "mode", width.cast("long").alias("resolution_seconds")
    )


@query
def resolve_plan(spark, sf_dir):
    plan = plan_columns(_resolved(spark, sf_dir))
    return plan.select(
        "selection_id",
        "tool_id",
        "raw_name",
        F.col("tool_ord").cast("long").alias("tool_ord"),
        F.col("ord").cast("long").alias("ord"),
    )


@query
def missing_mapping_warnings(spark, sf_dir):
    return missing_mappings(_resolved(spark, sf_dir))


@query
def displayed_column_sets(spark, sf_dir):
    sets = displayed_columns(plan_columns(_resolved(spark, sf_dir)))
    return sets.select("selection_id", F.array_join("columns", ",").alias("columns"))


@query
def query_run_metrics(spark, sf_dir):
    metrics = plan_metrics(t.selections(spark, sf_dir), plan_columns(_resolved(spark, sf_dir)))
    return metrics.select("selection_id", *[
        F.col(c).cast("long").alias(c)
        for c in ("tool_count", "sensor_count", "range_seconds", "resolution_seconds")
    ])


@query
def series_cap(spark, sf_dir):
    plan = plan_columns(_resolved(spark, sf_dir))
    shown = summary.shown_series(plan, t.selections(spark, sf_dir))
    return shown.withColumn("position", F.col("position").cast("long"))


@query
def tool_outcome(spark, sf_dir):
    return tool_status(*t.status_inputs(spark, sf_dir))


# Raw rows


@query
def raw_count(spark, sf_dir):
    return raw.raw_counts(t.wide(spark, sf_dir), start="1996-01-01", end="2001-01-01")


@query
def raw_rows_padded(spark, sf_dir):
    wanted = {tool: t.WIDE_SENSORS[i % 3 : i % 3 + 2] for i, tool in enumerate(t.TOOLS)}
    wanted["tool_9"] = ["a_ghost"]
    return raw.raw_rows(t.wide(spark, sf_dir), wanted)


@query
def raw_union_padded(spark, sf_dir):
    return raw.union_padded([t.wide(spark, sf_dir), t.sparse(spark, sf_dir)])


@query
def raw_page_asc(spark, sf_dir):
    return raw.page(t.wide(spark, sf_dir), offset=500, limit=250)


@query
def raw_page_desc(spark, sf_dir):
    return raw.page(t.wide(spark, sf_dir), offset=500, limit=250, order="desc")


@query
def raw_page_deep(spark, sf_dir):
    rows = t.undated(spark, sf_dir)
    return raw.page(rows, offset=rows.count() * 3 // 4, limit=250, direct_rows=1000)


@query
def raw_page_undated(spark, sf_dir):
    """A page over the border between rows with and without a time."""
    rows = t.undated(spark, sf_dir)
    dated = rows.where("ts IS NOT NULL").count()
    return raw.page(rows, offset=dated - 100, limit=250, order="desc", direct_rows=100)


@query
def raw_page_keyset(spark, sf_dir):
    return raw.page_after(
        t.wide(spark, sf_dir), last_ts="1999-06-15", last_tool="tool_3", limit=250
    )


# Summaries


def _daily_series(spark, sf_dir):
    daily = downsample.downsample(t.wide(spark, sf_dir), t.WIDE_SENSORS, 86400)
    return downsample.series_of(daily, t.WIDE_SENSORS)


@query
def focus_stats(spark, sf_dir):
    return rounded(summary.focus_stats(_daily_series(spark, sf_dir)), "mean_value")


@query
def sparkline_summary(spark, sf_dir):
    lines = summary.sparkline_summary(_daily_series(spark, sf_dir))
    return rounded(lines, "latest", "y_min", "y_max")


@query
def series_status(spark, sf_dir):
    tools, plan, sensors, files, bad = t.status_inputs(spark, sf_dir)
    status = tool_status(tools, plan, sensors, files, bad)
    return summary.series_status(plan, _daily_series(spark, sf_dir), status, sensors)


@query
def aligned_wide(spark, sf_dir):
    daily = downsample.downsample(t.wide(spark, sf_dir), t.WIDE_SENSORS, 86400)
    result = align.align_wide(daily, t.ALIGNED)
    return rounded(result, *[c for c in result.columns if c.endswith("_avg")], digits=7)


@query
def csv_text_rows(spark, sf_dir):
    rows = t.table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("whole_ts"),
        "value",
        (F.col("value") * 1e14).alias("large"),
        (F.col("value") / 1e6).alias("small"),
        (-F.col("value") / 3).alias("thirds"),
        F.when(F.col("value") > 50, F.col("value")).alias("gaps"),
    )
    return align.as_csv_text(rows)


# Runs and volume


@query
def run_detection(spark, sf_dir):
    return rounded(runs.detect_runs(t.long(spark, sf_dir), 7200), "duration_s", "gap_before_s")


@query
def utilisation(spark, sf_dir):
    readings = t.long(spark, sf_dir)
    groups = catalog.tool_groups(payloads.parse_tool_groups(t.mapping_payloads(spark, sf_dir)))
    report = runs.volume_report(
        readings, t.file_index(spark, sf_dir), groups,
        gap_seconds=7200, window_hours=720, sample_hz=0.01,
    )
    return rounded(report, "utilisation_pct")


# File index


@query
def file_index_scan(spark, sf_dir):
    return index_of(scan_files(spark, sf_dir, TIME_COLUMNS)).select(
        "file_id", "tool_id", "hour_bucket", "min_ts", "max_ts", "row_count", "time_column"
    )


@query
def quarantine(spark, sf_dir):
    return quarantine_of(scan_files(spark, sf_dir, TIME_COLUMNS))


@query
def schema_catalog(spark, sf_dir):
    return sensor_catalog(index_of(scan_files(spark, sf_dir, TIME_COLUMNS))).select(
        "tool_id", "raw_name", "units", "numeric", F.col("position").cast("long").alias("position")
    )


@query
def file_overlap(spark, sf_dir):
    return index.overlapping_files(
        t.tool_ranges(spark, sf_dir), t.file_index(spark, sf_dir), bin_days=90
    )


@query
def coverage_warnings(spark, sf_dir):
    found = index.coverage(
        t.tool_ranges(spark, sf_dir), t.file_index(spark, sf_dir), bin_days=90
    )
    return found.withColumn("warnings", F.array_join("warnings", "|"))


@query
def tool_extents(spark, sf_dir):
    return index.tool_extents(t.file_index(spark, sf_dir))


@query
def global_extent(spark, sf_dir):
    return index.global_extent(t.file_index(spark, sf_dir))


@query
def active_tools(spark, sf_dir):
    return index.active_tools(t.file_index(spark, sf_dir))


@query
def archived_files(spark, sf_dir):
    return index.archived(t.file_index(spark, sf_dir))


@query
def library_size(spark, sf_dir):
    return index.library_size(t.file_index(spark, sf_dir))


@query
def index_upsert(spark, sf_dir):
    return index.upsert(t.file_index(spark, sf_dir), t.scanned_index(spark, sf_dir))


@query
def index_rescan(spark, sf_dir):
    return index.rescan(t.file_index(spark, sf_dir), t.scanned_index(spark, sf_dir))


@query
def index_vanished(spark, sf_dir):
    return index.vanished(t.file_index(spark, sf_dir), t.scanned_index(spark, sf_dir))


# Manifest


@query
def manifest_parse(spark, sf_dir):
    return payloads.parse_manifest(t.manifest_payloads(spark, sf_dir)).drop("ord", "pos")


def _downloads(spark, sf_dir):
    listed = payloads.parse_manifest(t.manifest_payloads(spark, sf_dir)).drop("ord", "pos")
    return manifest.to_download(listed, t.file_index(spark, sf_dir))


@query
def manifest_diff(spark, sf_dir):
    return _downloads(spark, sf_dir)


def _gone(spark, sf_dir):
    listed = payloads.parse_manifest(t.manifest_payloads(spark, sf_dir))
    return manifest.not_in_manifest(t.file_index(spark, sf_dir), listed)


@query
def manifest_archived(spark, sf_dir):
    listed = payloads.parse_manifest(t.manifest_payloads(spark, sf_dir))
    return index.archive_unlisted(t.file_index(spark, sf_dir), listed)


@query
def manifest_tool_bytes(spark, sf_dir):
    return manifest.bytes_per_tool(_downloads(spark, sf_dir))


@query
def update_summary(spark, sf_dir):
    return manifest.update_summary(_downloads(spark, sf_dir), _gone(spark, sf_dir))


@query
def checksum_audit(spark, sf_dir):
    stored = t.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page_"), "page_id").alias("file_id"), F.sha2("html", 256).alias("sha256")
    )
    listed = t.table(spark, sf_dir, "pages").selectExpr(
        "concat('page_', page_id + page_id % 5 * 1000000 * int(page_id % 7 = 3)) AS file_id",
        "concat('tool_', page_id % 8) AS tool_id",
        "CASE page_id % 3 WHEN 0 THEN sha2(html, 256) WHEN 1 THEN sha2(url, 256) END AS sha256",
    )
    return audit_checksums(stored, listed)


# Catalogs


@query
def mapping_parse(spark, sf_dir):
    return payloads.parse_mappings(t.mapping_payloads(spark, sf_dir)).drop("pos")


@query
def mapping_latest(spark, sf_dir):
    return _mapping(spark, sf_dir)


def _groups(spark, sf_dir):
    return catalog.tool_groups(payloads.parse_tool_groups(t.mapping_payloads(spark, sf_dir)))


@query
def tool_process_group(spark, sf_dir):
    return _groups(spark, sf_dir)


@query
def process_groups(spark, sf_dir):
    return catalog.process_groups(_groups(spark, sf_dir))


def _canonical(spark, sf_dir):
    return payloads.parse_canonical(t.canonical_payloads(spark, sf_dir))


@query
def canonical_parse(spark, sf_dir):
    return _canonical(spark, sf_dir).drop("pos")


@query
def category_parse(spark, sf_dir):
    return catalog.latest_categories(
        payloads.parse_categories(t.category_payloads(spark, sf_dir))
    )


@query
def sensor_parse(spark, sf_dir):
    return payloads.parse_sensors(t.sensor_payloads(spark, sf_dir)).select(
        "tool_id", "raw_name", "units"
    )


def _cells(spark, sf_dir):
    mapping, groups = _mapping_and_groups(spark, sf_dir)
    return catalog.mapping_cells(_canonical(spark, sf_dir), groups, mapping)


@query
def mapping_cells(spark, sf_dir):
    return _cells(spark, sf_dir)


@query
def mapping_matrix(spark, sf_dir):
    return catalog.mapping_matrix(_canonical(spark, sf_dir), _mapping(spark, sf_dir), t.TOOLS)


@query
def mapping_lines(spark, sf_dir):
    return catalog.mapping_lines(_cells(spark, sf_dir))


def _labels(spark, sf_dir):
    categories = catalog.latest_categories(
        payloads.parse_categories(t.category_payloads(spark, sf_dir))
    )
    return catalog.canonical_labels(_canonical(spark, sf_dir), categories)


@query
def catalog_labels(spark, sf_dir):
    return _labels(spark, sf_dir)


def _picker(spark, sf_dir):
    return catalog.picker(
        index.active_tools(t.file_index(spark, sf_dir)),
        stored(_groups(spark, sf_dir), "tool-groups"),  # one row per tool, used twice
        _labels(spark, sf_dir),
        t.raw_catalog(spark, sf_dir),
    )


@query
def catalog_fallback(spark, sf_dir):
    return _picker(spark, sf_dir)


@query
def sensor_search(spark, sf_dir):
    return catalog.search_results(_picker(spark, sf_dir), " RinG")


@query
def sensor_search_count(spark, sf_dir):
    return catalog.search_count(_picker(spark, sf_dir), " RinG")


@query
def catalog_ordered(spark, sf_dir):
    """Each tool's sensors with their place in the picker."""
    rows = _picker(spark, sf_dir)
    place = Window.partitionBy("tool_id").orderBy(*catalog.picker_order())
    return rows.select("tool_id", "category", "sensor", F.row_number().over(place).cast("long").alias("place"))


@query
def index_ordered(spark, sf_dir):
    """Each tool's active files with their place in time."""
    place = Window.partitionBy("tool_id").orderBy("min_ts", "file_id")
    files = index.active(t.file_index(spark, sf_dir))
    return files.select("tool_id", "file_id", F.row_number().over(place).cast("long").alias("place"))


@query
def hours_with_data(spark, sf_dir):
    hours = t.long(spark, sf_dir).groupBy("tool_id", hour_floor(F.col("ts")).alias("hour"))
    return hours.agg(F.count("*").alias("rows"))


@query
def selection_counts(spark, sf_dir):
    chosen = t.table(spark, sf_dir, "lineitem").selectExpr(
        "concat('tool_', l_suppkey % 8) AS tool_id",
        "'canonical' AS kind",
        "concat('part_', l_partkey) AS sensor",
    )
    return catalog.selection_counts(_picker(spark, sf_dir), chosen)


# Usage events and saved sets


@query
def telemetry_parse(spark, sf_dir):
    events = telemetry.parse_event_lines(t.event_lines(spark, sf_dir))
    return telemetry.event_fields(events, "query_run")


@query
def telemetry_all_types(spark, sf_dir):
    """All fields of every event type, as text."""
    events = telemetry.parse_event_lines(t.all_event_lines(spark, sf_dir))
    return telemetry.event_texts(events)


@query
def telemetry_counts(spark, sf_dir):
    return telemetry.counts_per_day(telemetry.parse_event_lines(t.event_lines(spark, sf_dir)))


@query
def seconds_since_exit(spark, sf_dir):
    return telemetry.seconds_since_last_exit(t.app_events(spark, sf_dir))


def _joined_text(df):
    return df.select(*[
        F.array_join(c, ",").alias(c) if kind.startswith("array") else F.col(c)
        for c, kind in df.dtypes
    ])


@query
def saved_set_parse(spark, sf_dir):
    return _joined_text(saved_sets.parse_saved_sets(t.saved_set_rows(spark, sf_dir)))


@query
def saved_set_roundtrip(spark, sf_dir):
    sets = saved_sets.parse_saved_sets(t.saved_set_rows(spark, sf_dir))
    return _joined_text(saved_sets.parse_saved_sets(saved_sets.encode_saved_sets(sets)))


@query
def saved_set_pairs(spark, sf_dir):
    return saved_sets.tool_sensor_pairs(
        saved_sets.parse_saved_sets(t.saved_set_rows(spark, sf_dir))
    )


@query
def saved_set_union(spark, sf_dir):
    sets = saved_sets.parse_saved_sets(t.saved_set_rows(spark, sf_dir))
    return _joined_text(saved_sets.add_set(t.current_choice(spark, sf_dir), sets))


@query
def saved_set_replace(spark, sf_dir):
    sets = saved_sets.parse_saved_sets(t.saved_set_rows(spark, sf_dir))
    return _joined_text(saved_sets.replace_with_set(t.current_choice(spark, sf_dir), sets))


@query
def telemetry_archive(spark, sf_dir):
    """Events archived by day up to a cutoff, in two runs of which the second takes more days."""
    path = shared_dir(spark, "event-archive")
    events = t.event_lines(spark, sf_dir).select("event_id", "value")
    dated = telemetry.dated_lines(events)
    telemetry.archive_days(spark, dated, path, before="2024-01-12")
    telemetry.archive_days(spark, dated, path, before="2024-01-20")
    kept = telemetry.live_lines(dated, before="2024-01-20").select(F.lit("live").alias("place"), "day")
    moved = telemetry.archived_lines(spark, path, dated).select(F.lit("archive").alias("place"), "day")
    return kept.union(moved).groupBy("place", "day").agg(F.count("*").alias("events"))


# Overlays and indicators


@query
def overlay_groups(spark, sf_dir):
    return rounded(overlays.overlay_groups(_daily_series(spark, sf_dir)), "mean_value", "scale_ratio")


@query
def mapping_indicators(spark, sf_dir):
    mapping, groups = _mapping_and_groups(spark, sf_dir)
    canonical = _canonical(spark, sf_dir)
    cells = catalog.mapping_cells(canonical, groups, mapping)
    return indicators.cell_indicators(cells, canonical, t.raw_units(spark, sf_dir))


@query
def canonical_indicators(spark, sf_dir):
    mapping, groups = _mapping_and_groups(spark, sf_dir)
    canonical = _canonical(spark, sf_dir)
    cells = catalog.mapping_cells(canonical, groups, mapping)
    return indicators.canonical_indicators(cells, canonical, t.raw_units(spark, sf_dir))


# Sinks


def _written(spark, path):
    """Data lines of CSV part files, each with whether it comes after a later time."""
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    ).where("NOT startswith(line, 'ts,')")
    time = F.substring_index("line", ",", 1)
    here = Window.partitionBy("file").orderBy("block", "at")
    inside = F.coalesce((F.lag(time).over(here) > time).cast("long"), F.lit(0))
    files = lines.groupBy("file").agg(F.min(time).alias("low"), F.max(time).alias("high"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    across = files.select("file", (F.max("high").over(before) > F.col("low")).cast("long").alias("across"))
    placed = lines.withColumn("inside", inside).join(across, "file")
    return placed.select("line", (F.col("inside") + F.coalesce("across", F.lit(0))).alias("out_of_order"))


@query
def chart_csv_lines(spark, sf_dir):
    """The chart CSV as it is written: text of every line, and its order by time."""
    path = shared_dir(spark, "chart")
    daily = downsample.downsample(t.wide(spark, sf_dir), t.WIDE_SENSORS, 86400)
    aligned = align.align_wide(daily, {k: v[:3] for k, v in list(t.ALIGNED.items())[:2]})
    exact = [c for c in aligned.columns if not c.endswith("_avg")]
    sinks.write_chart_csv(aligned.select(*[F.col(f"`{c}`") for c in exact]), path)
    return _written(spark, path)


@query
def table_csv_lines(spark, sf_dir):
    path = shared_dir(spark, "table")
    rows = t.wide(spark, sf_dir).select("ts", "tool_id", "l_quantity", "l_tax")
    sinks.write_table_csv(rows, path)
    return _written(spark, path).groupBy(F.substring("line", 1, 10).alias("day")).agg(
        F.count("*").alias("lines"),
        F.min("line").alias("first_line"),
        F.max("line").alias("last_line"),
        F.sum(F.char_length("line")).alias("chars"),
        F.sum("out_of_order").alias("out_of_order"),
    )


@query
def partitioned_order(spark, sf_dir):
    """Rows of each stored file that come before an earlier one: none."""
    path = shared_dir(spark, "readings")
    write_partitioned(t.long(spark, sf_dir), path)
    rows = read_partitioned(spark, path, "sensor string, value double").select(
        "tool_id", "day", "ts", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")
    )
    here = Window.partitionBy("file").orderBy("at")
    late = rows.withColumn("late", F.lag("ts").over(here) > F.col("ts"))
    return late.groupBy("tool_id", F.col("day").cast("long").alias("day")).agg(
        F.count("*").alias("rows"), F.count_if("late").alias("out_of_order")
    )


@query
def partitioned_roundtrip(spark, sf_dir):
    path = shared_dir(spark, "readings")
    write_partitioned(t.long(spark, sf_dir), path)
    stored = read_partitioned(spark, path, "sensor string, value double")
    result = stored.groupBy("tool_id", "month", "day", "sensor").agg(
        F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("value").alias("top")
    )
    return result.withColumns({c: F.col(c).cast("long") for c in ("month", "day")})
