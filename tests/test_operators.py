import json
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell.operators import align, downsample, index, raw, runs, summary, telemetry
from tracewell.sources import sinks
from tracewell.streaming import event_stream, ingest_events

START = datetime(2026, 1, 1)


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def readings(spark, rows):
    return frame(spark, rows, "tool_id string, ts timestamp_ntz, a double, b double")


def test_nulls_nans_and_empty_selection(spark):
    t = START
    rows = readings(spark, [("t", t, 1.0, None), ("t", t, math.nan, None), ("t", t, None, None), ("t", t + timedelta(minutes=5), 4.0, 2.0)])
    got = downsample.downsample(rows, ["a", "b"], 60).orderBy("bucket").collect()
    assert got[0].asDict() | {"a_avg": 0, "a_max": 0} == {"tool_id": "t", "bucket": t, "a_avg": 0, "a_min": 1.0, "a_max": 0, "b_avg": None, "b_min": None, "b_max": None}
    assert math.isnan(got[0]["a_avg"]) and math.isnan(got[0]["a_max"])
    assert len(got) == 2 and got[1]["b_avg"] == 2.0
    assert downsample.downsample(rows, [], 60).count() == 0


def test_very_many_sensors_and_rows_without_a_tool(spark):
    names = [f"odd {{{i}}}" for i in range(129)] + ["tick`s"]
    values = ", ".join(f"id * {i} AS `{n.replace('`', '``')}`" for i, n in enumerate(names))
    rows = spark.sql(f"SELECT if(id % 3 = 0, NULL, concat('t', id % 3)) AS tool_id, timestamp_ntz'2026-01-01 00:00:00' AS ts, {values.replace('{', '{{').replace('}', '}}')} FROM range(30)".replace("{{", "{").replace("}}", "}"))
    got = {r["tool_id"]: r for r in downsample.downsample(rows, names, 7).collect()}
    assert set(got) == {None, "t1", "t2"}
    assert all(got["t2"][f"{n}_max"] == 29 * i and got[None][f"{n}_min"] == 0 for i, n in enumerate(names))


def test_each_tool_reads_its_own_sensors(spark):
    rows = readings(spark, [("x", START, 1.0, 2.0), ("y", START, 3.0, 4.0), ("z", START, 5.0, 6.0)])
    got = downsample.downsample_wanted(rows, {"x": ["a"], "y": ["b", "a"], "gone": ["a"], "z": ["none"]}, 60)
    want = {("x", "a", 1.0), ("y", "a", 3.0), ("y", "b", 4.0)}
    assert {(r["tool_id"], r["sensor"], r["avg"]) for r in got.collect()} == want
    plan = frame(spark, [(t, s) for t, s, _ in want] + [("z", "none")], "tool_id string, raw_name string")
    assert {(r["tool_id"], r["sensor"], r["avg"]) for r in downsample.downsample_plan_wide(rows, plan, 60).collect()} == want
    assert downsample.downsample_wanted(rows, {"z": ["none"]}, 60).count() == 0


def test_range_is_half_open_and_first_label_may_precede_it(spark):
    rows = readings(spark, [("t", START + timedelta(seconds=s), float(s), None) for s in range(0, 30)])
    got = downsample.downsample(rows, ["a"], 10, start=START + timedelta(seconds=5), end=START + timedelta(seconds=25))
    assert [(r["bucket"].second, r["a_min"], r["a_max"]) for r in got.orderBy("bucket").collect()] == [(0, 5.0, 9.0), (10, 10.0, 19.0), (20, 20.0, 24.0)]


def test_raw_rows_pad_what_was_not_asked_for(spark):
    rows = readings(spark, [("x", START, 1.0, 2.0), ("y", START, 3.0, 4.0), ("z", START, 5.0, 6.0)])
    got = raw.raw_rows(rows, {"x": ["a"], "y": ["b", "a"], "gone": ["alpha"]})
    assert got.columns == ["tool_id", "ts", "a", "alpha", "b"]
    assert {tuple(r) for r in got.collect()} == {("x", START, 1.0, None, None), ("y", START, 3.0, None, 4.0)}
    counts = raw.raw_counts(rows, tools=["x", "y"], start=START, end=START + timedelta(seconds=1))
    assert {tuple(r) for r in counts.collect()} == {("x", 1), ("y", 1)}


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_deep_pages_equal_slices_of_the_sorted_rows(spark, order):
    rng = random.Random(3)
    stamps = [START + timedelta(days=rng.choice([0, 0, 0, 1, 40]), seconds=rng.choice([0, 0, 0, 0, 5, 3600, 90000]), microseconds=rng.choice([0, 0, 7])) for _ in range(1500)]
    data = [(f"t{rng.randrange(3)}", s, float(i), None) for i, s in enumerate(stamps)]
    rows = readings(spark, data).cache()
    data.sort(key=lambda r: (r[0], r[2]))
    data.sort(key=lambda r: r[1], reverse=order == "desc")
    for offset, limit in [(0, 10), (700, 50), (1490, 50), (1600, 10), (333, 400)]:
        got = [tuple(r) for r in raw.page(rows, offset=offset, limit=limit, order=order, direct_rows=20).collect()]
        assert got == data[offset : offset + limit], (offset, limit)


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_with_undated_rows_agree_at_every_depth(spark, order):
    stamps = [None] * 60 + [START + timedelta(seconds=i // 5) for i in range(90)]
    rows = readings(spark, [(f"t{i % 4}" if i % 9 else None, s, float(i), None) for i, s in enumerate(stamps)]).cache()
    whole = [tuple(r) for r in rows.orderBy(*raw.total_order(rows, order)).collect()]
    for offset, limit in [(0, 7), (10, 5), (55, 10), (59, 70), (60, 5), (85, 10), (100, 60), (145, 9), (150, 3)]:
        for direct in (0, 10, 1000):
            got = [tuple(r) for r in raw.page(rows, offset=offset, limit=limit, order=order, direct_rows=direct).collect()]
            assert got == whole[offset : offset + limit], (offset, limit, direct)


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_keyset_pages_walk_everything_once(spark, order):
    data = [(f"t{i:03d}", None if i < 20 else START + timedelta(seconds=i // 3), float(i), None) for i in range(60)]
    rows = readings(spark, data)
    whole = [r["a"] for r in rows.orderBy(*raw.total_order(rows, order)).collect()]
    seen, last = [], (None, "") if order == "asc" else ("2100-01-01", "")
    while True:
        got = raw.page_after(rows, last_ts=last[0], last_tool=last[1], limit=7, order=order).collect()
        if not got:
            break
        seen += [r["a"] for r in got]
        last = (got[-1]["ts"], got[-1]["tool_id"])
    assert seen == whole


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_keyset_pages_go_on_inside_rows_of_one_time_and_tool(spark, order):
    data = [(f"t{i // 15}", None if i < 20 else START + timedelta(seconds=i // 30), float(i // 2), None) for i in range(60)]
    rows = readings(spark, data)
    whole = [tuple(r) for r in rows.orderBy(*raw.total_order(rows, order)).collect()]
    seen, last, given = [], ((None, "") if order == "asc" else ("2100-01-01", "")), 0
    while True:
        got = raw.page_after(rows, last_ts=last[0], last_tool=last[1], limit=7, order=order, given=given).collect()
        if not got:
            break
        seen += [tuple(r) for r in got]
        place = (got[-1]["ts"], got[-1]["tool_id"])
        tied = sum((r["ts"], r["tool_id"]) == place for r in got)
        given, last = tied + (given if place == last else 0), place
    assert seen == whole


def series(spark, rows):
    return frame(spark, [("t", s, START + timedelta(minutes=i), avg, lo, hi) for s, i, avg, lo, hi in rows],
                 "tool_id string, sensor string, bucket timestamp_ntz, avg double, min double, max double")


def test_focus_and_sparkline(spark):
    rows = series(spark, [("p", 0, 2.0, 1.0, 9.0), ("p", 1, math.nan, -50.0, 50.0), ("p", 2, 4.0, 3.0, 5.0), ("p", 3, None, None, None),
                          ("flat", 0, 10.0, 10.0, 10.0), ("flat", 1, 10.0, 10.0, 10.0), ("zero", 0, 0.0, 0.0, 0.0), ("void", 0, math.inf, 0.0, 0.0)])
    focus = {r["sensor"]: tuple(r)[2:] for r in summary.focus_stats(rows).collect()}
    assert focus["p"] == (1.0, 3.0, 9.0) and "void" not in focus
    lines = {r["sensor"]: r for r in summary.sparkline_summary(rows).collect()}
    assert set(lines) == {"p", "flat", "zero"}
    assert (lines["p"]["latest"], lines["p"]["y_min"], lines["p"]["y_max"]) == (4.0, 2.0, 4.0)
    assert (lines["p"]["x_start"], lines["p"]["x_end"]) == (START, START + timedelta(minutes=3))
    assert (lines["flat"]["y_min"], lines["flat"]["y_max"]) == (9.5, 10.5)
    assert (lines["zero"]["y_min"], lines["zero"]["y_max"]) == (-0.05, 0.05)


def test_series_status_and_caps(spark):
    plan = frame(spark, [(1, "t", f"s{i}", 0, i) for i in range(60)], "selection_id int, tool_id string, raw_name string, tool_ord int, ord int")
    points = series(spark, [("s0", 0, 1.0, 1.0, 1.0), ("s1", 0, math.nan, None, None)])
    ok = frame(spark, [("t", "ok", "")], "tool_id string, status string, message string")
    status = {r["raw_name"]: r["status"] for r in summary.series_status(plan, points, ok).collect()}
    assert (status["s0"], status["s1"], status["s2"]) == ("data", "no_data", "no_data")
    bad = ok.withColumn("status", F.lit("unreadable"))
    failed = {r["raw_name"]: r["status"] for r in summary.series_status(plan, points, bad).collect()}
    assert failed.pop("s0") == "data" and set(failed.values()) == {"error"}
    known = frame(spark, [("t", "s0"), ("t", "s1")], "tool_id string, raw_name string")
    status = {r["raw_name"]: r["status"] for r in summary.series_status(plan, points, ok, known).collect()}
    assert (status["s0"], status["s1"], status["s2"]) == ("data", "no_data", "error")
    for mode, shown in (("overview", 60), ("standard", 50), ("focus", 4)):
        modes = frame(spark, [(1, mode)], "selection_id int, mode string")
        assert summary.shown_series(plan, modes).count() == shown


def brute_runs(times, gap):
    out = []
    for t in sorted(times):
        if out and (t - out[-1][1]).total_seconds() <= gap:
            out[-1][1], out[-1][2] = t, out[-1][2] + 1
        else:
            out.append([t, t, 1])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("gap", [1, 15, 300])
def test_runs_equal_a_plain_scan(spark, gap, monkeypatch):
    monkeypatch.setattr(runs, "SLOTS_PER_CHUNK", 4)
    rng = random.Random(gap)
    data = {}
    for tool in ("hot", "cold"):
        t, times = START - timedelta(days=20000), []
        for _ in range(800 if tool == "hot" else 40):
            t += timedelta(seconds=rng.choice([0, 0.1, gap * 0.9, gap, gap + 0.000001, gap * 3, 20, 400, 20000]))
            times.append(t)
        data[tool] = times
    rows = frame(spark, [(k, t) for k, ts in data.items() for t in ts], "tool_id string, ts timestamp_ntz").repartition(5)
    got = runs.detect_runs(rows, gap).orderBy("tool_id", "run_no").collect()
    for tool, times in data.items():
        mine = [r for r in got if r["tool_id"] == tool]
        want = brute_runs(times, gap)
        assert [(r["run_start"], r["run_end"], r["rows"]) for r in mine] == want
        assert [r["run_no"] for r in mine] == list(range(1, len(want) + 1))
        gaps = [None] + [(b[0] - a[1]).total_seconds() for a, b in zip(want, want[1:])]
        assert [r["gap_before_s"] for r in mine] == pytest.approx(gaps)


def test_gap_classes(spark):
    rows = frame(spark, [(g,) for g in (None, 20.0, 400.0, 20000.0, 100.0, 15.0, 2700.0, 50000.0)], "g double")
    assert [r[0] for r in rows.select(runs.gap_class(F.col("g"))).collect()] == ["first", "wafer", "lot", "maintenance", "other", "wafer", "lot", "other"]


def test_overlap_and_coverage_equal_brute_force(spark):
    rng = random.Random(9)
    def at(): return START + timedelta(hours=rng.randrange(0, 24 * 200))
    files = [(f"f{i}", f"t{rng.randrange(3)}", s, s + timedelta(hours=rng.choice([0, 1, 24, 24 * 70])), rng.random() < 0.1) for i, s in ((i, at()) for i in range(150))]
    wanted = [(i, f"t{rng.randrange(4)}", s, s + timedelta(hours=rng.choice([-1, 0, 5, 24 * 90]))) for i, s in ((i, at()) for i in range(150))]
    index_df = frame(spark, files, "file_id string, tool_id string, min_ts timestamp_ntz, max_ts timestamp_ntz, archived boolean")
    chosen = frame(spark, wanted, "selection_id int, tool_id string, start timestamp_ntz, end timestamp_ntz")
    want = {(w[0], f[0]) for w in wanted for f in files if w[1] == f[1] and not f[4] and w[2] <= w[3] and f[2] <= w[3] and f[3] >= w[2]}
    for days in (1, 31):
        got = index.overlapping_files(chosen, index_df, days).collect()
        assert len(got) == len(want) and {(r["selection_id"], r["file_id"]) for r in got} == want
    covered = {r["selection_id"]: r for r in index.coverage(chosen, index_df).collect()}
    assert len(covered) == 150
    for w in wanted:
        hits = [f for f in files if (w[0], f[0]) in want]
        texts = covered[w[0]]["warnings"]
        if not hits:
            assert texts == [f"No local data for {w[1]} in the requested range."]
            continue
        first, last = min(f[2] for f in hits), max(f[3] for f in hits)
        expected = []
        if first > w[2]:
            expected.append(f"{w[1]}: range starts before local data (earliest {first.isoformat()}+00:00).")
        if last < w[3]:
            expected.append(f"{w[1]}: range ends after local data (latest {last.isoformat()}+00:00).")
        assert texts == expected


INDEX = "file_id string, tool_id string, hour_bucket string, min_ts timestamp_ntz, max_ts timestamp_ntz, row_count long, size_bytes long, sha256 string, pinned boolean, archived boolean"


def test_upsert_keeps_flags_and_known_checksums(spark):
    t = START
    old = frame(spark, [("same", "t", "h", t, t, 1, 10, "aa", True, False), ("grown", "t", "h", t, t, 1, 10, "bb", False, True), ("gone", "t", "h", t, t, 1, 10, "cc", True, True)], INDEX)
    new = frame(spark, [("same", "t", "h", t, t, 1, 10, None, False, False), ("grown", "t", "h", t, t, 2, 20, None, False, False), ("new", "t", "h", t, t, 3, 30, "dd", False, False)], INDEX)
    got = {r["file_id"]: (r["row_count"], r["sha256"], r["pinned"], r["archived"]) for r in index.upsert(old, new).collect()}
    assert got == {"same": (1, "aa", True, False), "grown": (2, None, False, True), "gone": (1, "cc", True, True), "new": (3, "dd", False, False)}
    assert {r["file_id"] for r in index.rescan(old, new).collect()} == {"same", "grown", "new"}
    assert [r["file_id"] for r in index.vanished(old, new).collect()] == ["gone"]
    assert index.library_size(old.limit(0)).first()[0] == 0


def test_last_exit_equals_a_plain_scan(spark):
    rng = random.Random(4)
    events, t = [], START
    for i in range(600):
        t += timedelta(seconds=rng.choice([0, 0.0004, 1, 60, 5000]))
        events.append((i, f"c{rng.choice([0, 0, 0, 1])}", rng.choice(["app_start", "app_exit", "query_run"]), t))
    rows = frame(spark, events, "id int, client string, type string, created_at timestamp_ntz")
    got = {r["id"]: r["seconds_since_last_exit"] for r in telemetry.seconds_since_last_exit(rows).collect()}
    last, want = {}, {}
    for i, client, kind, at in events:
        if kind == "app_start":
            want[i] = round((at - last[client]).total_seconds(), 3) if client in last else None
        elif kind == "app_exit":
            last[client] = at
    assert got == want


def event_lines(n):
    lines = [json.dumps({"type": "query_run", "created_at": f"2026-01-0{1 + i % 3}T00:00:0{i % 10}+00:00", "data": {"tool_count": i, "latency_ms": "x"}}) for i in range(n)]
    return lines + ["not json", "[1]", json.dumps({"type": "update_check", "created_at": "2026-01-01T00:00:00.5+00:00", "data": {"cache_hit": True}})]


def test_event_parsing(spark):
    events = telemetry.parse_event_lines(frame(spark, [(l,) for l in event_lines(6)], "value string"))
    assert {tuple(r) for r in telemetry.counts_per_day(events).collect()} == {("query_run", (START + timedelta(days=d)).date(), 2) for d in range(3)} | {("update_check", START.date(), 1)}
    got = telemetry.event_fields(events, "query_run").orderBy("tool_count").collect()
    assert [r["tool_count"] for r in got] == list(range(6)) and got[0]["latency_ms"] is None
    assert telemetry.event_fields(events, "update_check").first()["cache_hit"] is True


def test_event_stream_appends_each_file_once(spark, tmp_path):
    feed, table, mark = tmp_path / "feed", str(tmp_path / "table"), str(tmp_path / "mark")
    feed.mkdir()
    for name in ("a", "b"):
        (feed / f"{name}.jsonl").write_text("\n".join(event_lines(6)))
        for _ in range(2):
            ingest_events(event_stream(spark, str(feed)), table, mark).awaitTermination()
    stored = spark.read.parquet(table)
    assert stored.count() == 14
    assert stored.where("type = 'query_run'").selectExpr("sum(get_json_object(payload, '$.tool_count'))").first()[0] == 30


def csv_lines(path):
    files = sorted(path.glob("part-*.csv"))
    lines = [f.read_text(encoding="utf-8").splitlines() for f in files]
    assert len({l[0] for l in lines}) == 1
    return [lines[0][0]] + [line for l in lines for line in l[1:]]


def test_chart_csv_text(spark, tmp_path):
    half = timedelta(minutes=30)
    rows = [("oven", START, 7.25, -1.0), ("oven", START + half, 8.5, None), ("pump", START + half, None, 0.5), ("pump", START + 2 * half, 3.0, 0.75)]
    result = frame(spark, rows, "tool_id string, bucket timestamp_ntz, heat_avg double, flow_avg double")
    sinks.write_chart_csv(align.align_wide(result, {"pump": ["flow_avg"], "oven": ["heat_avg"]}), str(tmp_path / "two"))
    assert csv_lines(tmp_path / "two") == ["ts,oven.heat_avg,pump.flow_avg", "2026-01-01T00:00:00+00:00,7.25,", "2026-01-01T00:30:00+00:00,8.5,0.5", "2026-01-01T01:00:00+00:00,,0.75"]
    sinks.write_chart_csv(align.align_wide(result, {"oven": ["heat_avg", "flow_avg"]}), str(tmp_path / "one"))
    assert csv_lines(tmp_path / "one") == ["ts,oven.heat_avg,oven.flow_avg", "2026-01-01T00:00:00+00:00,7.25,-1.0", "2026-01-01T00:30:00+00:00,8.5,"]
    sinks.write_chart_csv(frame(spark, [], "ts timestamp_ntz"), str(tmp_path / "none"))
    assert csv_lines(tmp_path / "none") == ["ts"]


def test_aligned_names_do_not_clash(spark):
    rows = frame(spark, [("t", START, 1.0, 2.0), ("t_a", START, 3.0, 4.0)], "tool_id string, bucket timestamp_ntz, a_x_avg double, x_avg double")
    got = align.align_wide(rows, ["t", "t_a"]).first().asDict()
    assert got == {"ts": START, "t.a_x_avg": 1.0, "t.x_avg": 2.0, "t_a.a_x_avg": 3.0, "t_a.x_avg": 4.0}


def test_table_csv_text(spark, tmp_path):
    rows = readings(spark, [("b", START, 1.5, None), ("a", START, 2.0, 1e16), ("a", START + timedelta(microseconds=500000), math.nan, 1e-5)])
    sinks.write_table_csv(rows, str(tmp_path / "t"))
    assert csv_lines(tmp_path / "t") == ["tool_id,ts,a,b", "a,2026-01-01T00:00:00+00:00,2.0,1e+16", "b,2026-01-01T00:00:00+00:00,1.5,", "a,2026-01-01T00:00:00.500000+00:00,nan,1e-05"]
    sinks.write_table_csv(rows.limit(0), str(tmp_path / "none"))
    assert csv_lines(tmp_path / "none") == ["tool_id,ts,a,b"]
    nanos = frame(spark, [("t\"1,", START, 1_767_225_600_000_000_007, 1.0), ("t", START, 1_767_225_600_000_000_001, 2.0)], "tool_id string, ts timestamp_ntz, ts_ns long, a double")
    sinks.write_table_csv(nanos, str(tmp_path / "n"))
    assert csv_lines(tmp_path / "n") == ["tool_id,ts,a", "t,2026-01-01T00:00:00.000000001+00:00,2.0", '"t""1,",2026-01-01T00:00:00.000000007+00:00,1.0']


def test_report_json(spark, tmp_path):
    report = runs.volume_report(
        frame(spark, [("t", START + timedelta(seconds=i)) for i in range(36)], "tool_id string, ts timestamp_ntz"),
        frame(spark, [("t", 5), ("t", 6)], "tool_id string, size_bytes long"),
        frame(spark, [("t", "g")], "tool_id string, prc_group_id string"), gap_seconds=15, window_hours=1)
    sinks.write_report_json(report, str(tmp_path / "r"))
    got = spark.read.json(str(tmp_path / "r")).first().asDict()
    assert got == {"tool_id": "t", "prc_group_id": "g", "runs": 1, "rows": 36, "files": 2, "bytes": 11, "utilisation_pct": 0.1}
