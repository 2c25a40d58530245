"""Overlays, mapping indicators, one parse of mapping documents, the event archive."""

import json
import random
from collections import Counter
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tracewell import stored
from tracewell.operators import catalog, indicators, overlays, telemetry
from tracewell.sources import payloads

DAY = datetime(2026, 3, 1)


def test_overlays_of_series_of_different_scales(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", "p", 1.0, 0.5, 2.0), ("a", "p", 3.0, -4.0, 3.5), ("a", "q", 900.0, 1.0, 1000.0), ("b", "p", 7.0, 7.0, 7.0), ("b", "z", 0.0, 0.0, 0.0), ("b", "n", nan, nan, nan), ("b", "i", inf, 1.0, inf), ("b", "m", None, None, None)]
    series = spark.createDataFrame([(t, s, DAY, *v) for t, s, *v in rows], "tool_id string, sensor string, bucket timestamp_ntz, avg double, min double, max double")
    got = {(r.group_by, r.tool_id, r.sensor): r for r in overlays.overlay_groups(series).collect()}
    assert Counter(k[0] for k in got) == {"both": 4, "tool": 2, "sensor": 3}
    a = got["tool", "a", None]
    assert (a.series, a.points, a.min_value, a.max_value, a.scale_ratio, a.scales_differ) == (2, 3, -4.0, 1000.0, 250.0, True)
    assert a.mean_value == (1 + 3 + 900) / 3
    b, p = got["tool", "b", None], got["sensor", None, "p"]
    assert (b.series, b.scale_ratio, b.scales_differ) == (2, 1.0, False)
    assert (p.series, p.min_value, p.max_value, p.scales_differ) == (2, -4.0, 7.0, False)
    assert got["both", "b", "z"].scale_ratio is None and not got["both", "b", "z"].scales_differ
    assert overlays.overlay_groups(series, scale_ratio=250.0).where("scales_differ").count() == 0
    assert overlays.overlay_groups(series.where("false")).count() == 0


def test_indicators(spark):
    canonical = spark.createDataFrame(
        [("g", "temp", "hot", "C", 1, 0), ("g", "press", None, None, 1, 1), ("g", "flow", "f", None, 1, 2), ("g", "tie", "t", None, 1, 3), ("h", "temp", None, "K", 1, 4)],
        "prc_group_id string, canonical_name string, description string, units string, ord long, pos int",
    )
    cells = spark.createDataFrame(
        [("g", "temp", "t1", "x"), ("g", "temp", "t2", "y"), ("g", "press", "t1", "p"), ("g", "press", "t2", "p"), ("g", "press", "t3", "p"),
         ("g", "flow", "t1", None), ("g", "flow", "t2", None), ("g", "tie", "t1", "m"), ("g", "tie", "t2", "m"), ("g", "tie", "t3", "p"), ("h", "temp", "t4", "x")],
        "prc_group_id string, canonical_name string, tool_id string, raw_name string",
    )
    units = spark.createDataFrame(
        [("t1", "x", "C"), ("t2", "y", "K"), ("t1", "p", "Pa"), ("t2", "p", "Pa"), ("t3", "p", "bar"), ("t1", "m", "b"), ("t2", "m", "a"), ("t2", "m", ""), ("t4", "x", None), ("t9", "x", "C")],
        "tool_id string, raw_name string, units string",
    )
    got = {(r.prc_group_id, r.canonical_name, r.tool_id): r for r in indicators.cell_indicators(cells, canonical, units).collect()}
    assert len(got) == 11
    state = lambda *k: got[k].state
    assert state("g", "temp", "t1") == "ok" and state("g", "temp", "t2") == "units_mismatch"
    assert got["g", "press", "t1"].expected == "Pa" and state("g", "press", "t1") == "ok"
    assert state("g", "press", "t3") == state("g", "tie", "t3") == "duplicate"  # t3's p is mapped twice
    assert state("g", "flow", "t1") == "empty" and state("h", "temp", "t4") == "ok"
    assert got["g", "tie", "t1"].expected == "a" and state("g", "tie", "t1") == "units_mismatch"
    per = {(r.prc_group_id, r.canonical_name): r for r in indicators.canonical_indicators(cells, canonical, units).collect()}
    assert per["g", "flow"].unmapped and not per["g", "temp"].unmapped and per["g", "press"].no_description
    assert (per["g", "press"].tools, per["g", "press"].duplicate, per["g", "press"].ok) == (3, 1, 2)
    alone = indicators.canonical_indicators(cells.where("false"), canonical, units).collect()
    assert len(alone) == 5 and all(r.unmapped and r.tools == 0 for r in alone)


def test_entries_hold_mappings_and_groups(spark):
    docs = [
        {"prc_group_id": "g1", "mappings": [{"tool_id": "t", "canonical_name": "c", "raw_name": "r"}, {"tool_id": "u", "canonical_name": 5, "raw_name": "r"}, {"tool_id": 4, "canonical_name": "c", "raw_name": "r"}, 7, None, {"tool_id": "v", "canonical_name": "c", "raw_name": ""}]},
        {"mappings": [{"tool_id": "t", "canonical_name": "", "raw_name": "r2"}]},
        {"prc_group_id": 3, "mappings": [{"tool_id": "w", "canonical_name": "c", "raw_name": 6}, {"tool_id": "9", "canonical_name": "[c", "raw_name": "-1"}]},
        {"prc_group_id": "", "mappings": [{"tool_id": "x", "canonical_name": "c", "raw_name": "r"}]},
    ]
    texts = [(json.dumps(d), k) for k, d in enumerate(docs)] + [("no json", 9), (None, 10), ("[]", 11)]
    frame = spark.createDataFrame(texts, "payload string, ord int")
    entries = stored(payloads.parse_mapping_entries(frame), "entries")
    columns = ["tool_id", "canonical_name", "raw_name", "ord", "pos"]
    rows = lambda df, cols: sorted(map(str, df.select(*cols).collect()))
    assert rows(payloads.mappings_of(entries), columns) == rows(payloads.parse_mappings(frame), columns)
    groups = ["prc_group_id", "tool_id", "ord", "pos"]
    assert rows(payloads.tool_groups_of(entries), groups) == rows(payloads.parse_tool_groups(frame), groups)
    assert payloads.mappings_of(entries).count() == 4 and payloads.tool_groups_of(entries).count() == 4


def test_groups_parse_each_document_once(spark):
    frame = spark.createDataFrame([("{}", 1)], "payload string, ord int")
    plan = catalog.tool_groups(payloads.parse_tool_groups(frame))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") == 1, plan


def test_archive_runs_twice_and_after_a_break(spark, tmp_path):
    rng = random.Random(6)
    days = [date(2026, 3, 1) + timedelta(days=k) for k in range(6)]
    made = [(k, json.dumps({"type": "error", "created_at": f"{rng.choice(days)}T10:00:00+00:00", "data": {"k": k}})) for k in range(60)]
    made += [(100, "no json"), (101, None), (102, json.dumps({"type": "x"}))]
    lines = spark.createDataFrame(made, "id long, value string")
    live, path = telemetry.dated_lines(lines), str(tmp_path / "archive")
    cut = "2026-03-04"

    def kept():
        return sorted(r.id for r in telemetry.archived_lines(spark, path, live).collect())

    want = sorted(r.id for r in live.where("day < date'2026-03-04'").collect())
    telemetry.archive_days(spark, live, path, before=cut)
    assert kept() == want and len(want) > 10
    telemetry.archive_days(spark, live, path, before=cut)  # again
    assert kept() == want
    rest = stored(telemetry.live_lines(live, before=cut), "rest")
    assert sorted([*want, *(r.id for r in rest.collect())]) == sorted(k for k, _ in made)
    telemetry.archive_days(spark, rest, path, before=cut)  # its live rows are gone: nothing is lost
    assert kept() == want
    half = live.where("id % 2 = 0")  # a run that was cut off after some rows had gone
    telemetry.archive_days(spark, half, path, before="2026-03-06")
    later = {r.id for r in half.where("day < date'2026-03-06'").collect()}
    assert kept() == sorted({*want, *later})
    stamps = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "archive").rglob("*.parquet")}
    before = stamps()
    telemetry.archive_days(spark, rest.where("false"), path, before=cut)
    assert stamps() == before


def test_one_scan_reads_all_event_types(spark):
    made = [json.dumps({"type": kind, "created_at": "2026-03-01T00:00:00Z", "data": {name: 1 for name in fields}}) for kind, fields in telemetry.EVENT_FIELDS.items()]
    events = telemetry.parse_event_lines(spark.createDataFrame([(x,) for x in [*made, json.dumps({"type": "other"})]], "value string"))
    texts = telemetry.event_texts(events)
    assert texts.count() == len(telemetry.EVENT_FIELDS)
    for kind, fields in telemetry.EVENT_FIELDS.items():
        row = telemetry.event_fields(events, kind).select(*fields).first()
        text = texts.where(F.col("type") == kind).first().fields
        assert len(text.split("|")) == len(row)
