import json
import math
from datetime import datetime

from pyspark.sql import functions as F

from tracewell.operators import catalog, manifest, saved_sets
from tracewell.plans import (
    displayed_columns, expand_selection, missing_mappings, plan_columns, plan_metrics,
    resolve_columns, tool_status,
)
from tracewell.sources import payloads

START, END = datetime(2026, 1, 1), datetime(2026, 1, 1, 1)


def documents(spark, *docs):
    return spark.createDataFrame(
        [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)],
        "ord int, payload string")


def mapping_doc(group, *entries):
    return {"prc_group_id": group, "mappings": [dict(zip(("tool_id", "canonical_name", "raw_name"), e)) for e in entries]}


def selection(spark, tools, raw, canonical):
    return spark.createDataFrame(
        [(1, tools, raw, canonical, START, END, "standard")],
        "selection_id int, tools array<string>, sensors_raw array<string>, sensors_canonical array<string>,"
        " start timestamp_ntz, end timestamp_ntz, mode string")


def test_canonical_expansion_order_and_missing(spark):
    mapping = catalog.latest_mapping(payloads.parse_mappings(documents(
        spark,
        mapping_doc("g", ("etch_a1", "chamber_pressure", "old"), ("etch_a2", "chamber_pressure", "PCham_torr")),
        mapping_doc("g", ("etch_a1", "chamber_pressure", "ChamberPressure_torr")))))
    chosen = selection(spark, ["etch_a1", "etch_a2", "etch_a3"], ["ChamberPressure_torr", "rf_power"], ["chamber_pressure"])
    resolved = resolve_columns(expand_selection(chosen), mapping)
    plan = plan_columns(resolved)
    columns = {}
    for r in plan.orderBy("tool_ord", "ord").collect():
        columns.setdefault(r["tool_id"], []).append(r["raw_name"])
    assert columns == {
        "etch_a1": ["ChamberPressure_torr", "rf_power"],
        "etch_a2": ["ChamberPressure_torr", "rf_power", "PCham_torr"],
        "etch_a3": ["ChamberPressure_torr", "rf_power"]}
    assert [tuple(r) for r in missing_mappings(resolved).collect()] == [
        (1, "etch_a3", "chamber_pressure", "etch_a3: no mapping for 'chamber_pressure'; chart will show no data.")]
    assert displayed_columns(plan).first()["columns"] == ["ChamberPressure_torr", "PCham_torr", "rf_power"]
    metrics = plan_metrics(chosen, plan).first().asDict()
    assert metrics == {"selection_id": 1, "tool_count": 3, "range_seconds": 3600, "resolution_seconds": 10, "sensor_count": 3}


def test_metrics_without_any_column(spark):
    chosen = selection(spark, ["a"], [], ["x"])
    plan = plan_columns(resolve_columns(expand_selection(chosen), spark.createDataFrame([], "tool_id string, canonical_name string, raw_name string")))
    assert plan.count() == 0
    assert plan_metrics(chosen, plan).first()["sensor_count"] == 0


def test_payloads_survive_bad_elements(spark):
    sensors = documents(spark, [{"name": "a", "units": "Pa"}, {"name": "b", "units": ""}, {"name": 5}, 7, None, {"units": "x"}, {"name": ""}, {"name": "9"}, {"name": "true"}, {"name": True}, {"name": ["x"]}], {"name": "no list"}, "broken {").withColumn("tool_id", F.lit("t"))
    got = payloads.parse_sensors(sensors).orderBy("pos").collect()
    assert [(r["raw_name"], r["units"]) for r in got] == [("a", "Pa"), ("b", None), ("", None), ("9", None), ("true", None)]
    canonical = documents(spark, {"prc_group_id": "g", "sensors": [{"name": "p", "description": "d", "units": 3, "category_id": ""}, "x"]}, {"sensors": "x"}, [1])
    assert [tuple(r)[:6] for r in payloads.parse_canonical(canonical).select("prc_group_id", "canonical_name", "description", "units", "category_id", "ord").collect()] == [("g", "p", "d", None, None, 0)]
    cats = documents(spark, {"categories": [{"id": "c", "name": "C", "parent_id": None}, {"id": "d"}, {"id": "e", "name": "E", "parent_id": "c"}, {"id": 4, "name": "x"}]})
    assert [(r["category_id"], r["parent_id"]) for r in payloads.parse_categories(cats).orderBy("pos").collect()] == [("c", None), ("e", "c")]


def test_groups_first_wins_even_from_invalid_entries(spark):
    docs = documents(spark, mapping_doc("g1", ("a", "x", "")), {"prc_group_id": 4, "mappings": [{"tool_id": "b"}]}, mapping_doc("g2", ("a", "x", "r"), ("b", "y", "s")))
    groups = catalog.tool_groups(payloads.parse_tool_groups(docs))
    assert {r["tool_id"]: r["prc_group_id"] for r in groups.collect()} == {"a": "g1", "b": "g2"}
    assert {tuple(r) for r in catalog.latest_mapping(payloads.parse_mappings(docs)).collect()} == {("a", "x", "r"), ("b", "y", "s")}


def test_manifest_rules(spark):
    files = [
        {"file_id": "x.parquet", "tool_id": "t"},
        {"path": "/p/y.parquet", "tool_id": "t", "url": 5, "sha256": "", "size_bytes": 12.9},
        {"file_id": "", "path": "z", "tool_id": "t", "size_bytes": True},
        {"file_id": 0, "path": "w", "tool_id": "t", "size_bytes": "9"},
        {"file_id": 3, "path": "v", "tool_id": "t"},
        {"file_id": "u", "tool_id": 7}, "junk", None,
        {"file_id": "s", "tool_id": "t", "url": "http://h/s", "sha256": "ab", "size_bytes": 10},
    ]
    got = payloads.parse_manifest(documents(spark, {"version": 1, "files": files}, {"files": 3}, "nope")).orderBy("pos").collect()
    assert [tuple(r)[:5] for r in got] == [
        ("x.parquet", "t", "/v1/data/x.parquet", None, 0),
        ("/p/y.parquet", "t", "/v1/data/p/y.parquet", None, 12),
        ("z", "t", "/v1/data/z", None, 1),
        ("w", "t", "/v1/data/w", None, 0),
        ("s", "t", "http://h/s", "ab", 10)]


def test_manifest_diff_cases(spark):
    listed = spark.createDataFrame([(n, "t", "u", s, 5) for n, s in [("absent", "1"), ("same", "1"), ("other", "1"), ("unsummed", "1"), ("nosha", None)]], "file_id string, tool_id string, url string, sha256 string, size_bytes long")
    local = spark.createDataFrame([("same", "1"), ("other", "2"), ("unsummed", None), ("nosha", "1"), ("gone", "3")], "file_id string, sha256 string")
    assert {r["file_id"]: r["why"] for r in manifest.to_download(listed, local).collect()} == {"absent": "absent", "other": "changed", "unsummed": "no_local_checksum"}
    assert [r["file_id"] for r in manifest.not_in_manifest(local, listed).collect()] == ["gone"]


def test_matrix_lines_and_search(spark):
    canonical = payloads.parse_canonical(documents(spark, {"prc_group_id": "g", "sensors": [{"name": "p", "units": "Pa", "category_id": "c1"}, {"name": "q", "description": "Straße", "category_id": "c9"}, {"name": "r"}]}))
    groups = spark.createDataFrame([("t1", "g"), ("t2", "g"), ("t3", "h")], "tool_id string, prc_group_id string")
    mapping = spark.createDataFrame([("t1", "p", "P_1"), ("t2", "q", "Q_2")], "tool_id string, canonical_name string, raw_name string")
    matrix = catalog.mapping_matrix(canonical, mapping, ["t1", "t2"]).orderBy("canonical_name").collect()
    assert [tuple(r) for r in matrix] == [("p", "P_1", "—"), ("q", "—", "Q_2"), ("r", "—", "—")]
    lines = {r["canonical_name"]: r["lines"] for r in catalog.mapping_lines(catalog.mapping_cells(canonical, groups, mapping)).collect()}
    assert lines["p"] == "t1 → P_1\nt2 → (no mapping)"
    categories = spark.createDataFrame([("c1", "Pressure", None)], "category_id string, name string, parent_id string")
    labels = catalog.canonical_labels(canonical, categories)
    raw = spark.createDataFrame([("t3", "z", "W"), ("t1", "hidden", None)], "tool_id string, raw_name string, units string")
    rows = catalog.picker(groups, groups, labels, raw)
    shown = [(r["tool_id"], r["category"], r["label"]) for r in rows.orderBy(*catalog.picker_order()).collect()]
    assert shown == [
        ("t1", "Pressure", "p (Pa)"), ("t1", "c9", "q"), ("t1", "Other", "r"),
        ("t2", "Pressure", "p (Pa)"), ("t2", "c9", "q"), ("t2", "Other", "r"),
        ("t3", "All sensors (raw)", "z (W)")]
    hits = catalog.search_results(rows, "  STRASSE ").collect()
    assert {r["breadcrumb"] for r in hits} == {"t1  /  c9  /  q", "t2  /  c9  /  q"}
    assert catalog.search(rows, " ").count() == 7 and catalog.search_results(rows, " ").count() == 0
    chosen = spark.createDataFrame([("t1", "canonical", "p"), ("t3", "raw", "z"), ("t3", "canonical", "z")], "tool_id string, kind string, sensor string")
    counts = {r["tool_id"]: (r["selected"], r["total"]) for r in catalog.selection_counts(rows, chosen).collect()}
    assert counts == {"t1": (1, 3), "t2": (0, 3), "t3": (1, 1), None: (2, 7)}


def test_tool_status(spark):
    def frame(rows, ddl):
        return spark.createDataFrame(rows, ddl)
    got = tool_status(
        frame([("ok",), ("none",), ("lacks",), ("bad",), ("idle",), ("part",), ("blank",)], "tool_id string"),
        frame([("ok", "p"), ("none", "p"), ("lacks", "p"), ("lacks", "q"), ("bad", "p"), ("part", "p"), ("blank", "x"), ("blank", "y")], "tool_id string, raw_name string"),
        frame([("ok", "p"), ("lacks", "p"), ("part", "p"), ("blank", "p")], "tool_id string, raw_name string"),
        frame([("ok",), ("lacks",), ("idle",), ("blank",)] + [("part",)] * 99, "tool_id string"),
        frame([("bad", "unreadable footer"), ("part", "one bad page"), ("ok", None)], "tool_id string, reason string"))
    assert {r["tool_id"]: (r["status"], r["message"]) for r in got.collect()} == {
        "ok": ("ok", ""), "none": ("empty", ""), "idle": ("empty", ""), "bad": ("unreadable", "unreadable footer"),
        "lacks": ("ok", "no column 'q' in this tool's files"), "part": ("ok", "one bad page"),
        "blank": ("missing_column", "no column 'x' in this tool's files")}


def test_saved_sets(spark):
    rows = spark.createDataFrame([(1, "b", '{"tools":["t2","t1"],"sensors_raw":["r"]}'), (2, "A", "{}")], "set_id int, name string, payload string")
    sets = saved_sets.parse_saved_sets(rows)
    assert [r["name"] for r in sets.orderBy(*saved_sets.by_name()).collect()] == ["A", "b"]
    current = spark.createDataFrame([(7, 1, ["t3", "t1"], ["c"], ["r", "a"])], "selection_id int, set_id int, tools array<string>, sensors_canonical array<string>, sensors_raw array<string>")
    assert tuple(saved_sets.add_set(current, sets).first()) == (7, ["t1", "t2", "t3"], ["c"], ["a", "r"])
    assert tuple(saved_sets.replace_with_set(current, sets).first()) == (7, ["t2", "t1"], [], ["r"])
    assert {tuple(r) for r in saved_sets.tool_sensor_pairs(sets).collect()} == {(1, "t2", "raw", "r"), (1, "t1", "raw", "r")}
