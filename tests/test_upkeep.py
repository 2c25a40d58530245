"""Files that break or change, stored hours, late rows, retention."""

import os
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_sources import START, write
from tracewell import stored
from tracewell.operators import hours, retention
from tracewell.operators.isolation import isolated_downsample
from tracewell.sources.files import index_of, quarantine_of, scan_changed, scan_files, scan_one
from tracewell.sources.readings import read_selected
from tracewell.sources.sinks import write_partitioned

ROWS = "tool_id string, ts timestamp_ntz, value double"


def tools(tmp_path):
    for k, tool in enumerate(("a", "b", "c", "d", "e", "f")):
        for hour in range(3):
            write(tmp_path / tool / f"h{hour}.parquet", {"p": pa.float64(), "q": pa.float32()}, rows=20_000, start=START + timedelta(hours=hour), seed=10 * k + hour)


def test_a_file_damaged_after_the_scan_marks_only_its_tool(spark, tmp_path):
    tools(tmp_path)
    root = str(tmp_path)
    files = index_of(stored(scan_files(spark, root), "scan"))
    before = isolated_downsample(spark, files, ["p", "q"], 60, root=root)
    assert {r.status for r in before.tools.collect()} == {"ok"}
    whole = sorted(map(tuple, before.buckets.collect()))
    assert sum(r[2] for r in whole) == 6 * 3 * 20_000

    damaged = tmp_path / "b" / "h1.parquet"  # same size, broken pages
    raw = bytearray(damaged.read_bytes())
    raw[len(raw) // 3 : len(raw) // 3 * 2] = bytes(len(raw) // 3)
    damaged.write_bytes(bytes(raw))
    (tmp_path / "c" / "h2.parquet").unlink()
    (tmp_path / "d" / "h0.parquet").write_bytes(b"short")
    write(tmp_path / "e" / "h0.parquet", {"p": pa.string()}, rows=7)  # other rows and types
    found = isolated_downsample(spark, files, ["p", "q"], 60, root=root)
    told = {r.tool_id: (r.status, r.message) for r in found.tools.collect()}
    assert {t: s for t, (s, _) in told.items()} == {"a": "ok", "b": "unreadable", "c": "unreadable", "d": "unreadable", "e": "unreadable", "f": "ok"}
    assert told["c"][1] == "c/h2.parquet is gone" and "changed" in told["d"][1] and "of 20000 rows" in told["b"][1]
    assert sorted(map(tuple, found.buckets.collect())) == [r for r in whole if r[0] in "af"]
    ledger = {r.file_id: r.status for r in found.files.collect()}
    assert len(ledger) == 18 and ledger["b/h0.parquet"] == "ok" and ledger["b/h1.parquet"] == "unreadable"


def test_isolated_range_and_nothing_in_it(spark, tmp_path):
    tools(tmp_path)
    root = str(tmp_path)
    files = index_of(scan_files(spark, root)).where("tool_id IN ('a', 'b')")
    start, end = START + timedelta(minutes=10), START + timedelta(minutes=20)
    got = isolated_downsample(spark, files, ["p"], 60, root=root, start=start, end=end)
    assert got.buckets.agg(F.sum("n"), F.min("bucket"), F.max("bucket")).first() == (12_000, start, end - timedelta(minutes=1))
    far = isolated_downsample(spark, files, ["p"], 60, root=root, start=START + timedelta(days=9))
    assert {r.status for r in far.tools.collect()} == {"empty"} and not far.buckets.count()
    none = isolated_downsample(spark, files.where("false"), ["p"], 60, root=root)
    assert not none.tools.count() and not none.buckets.count()


def test_second_scan_opens_only_changed_files(spark, tmp_path):
    tools(tmp_path)
    (tmp_path / "bad.parquet").write_bytes(b"not parquet at all")
    root = str(tmp_path)
    first = stored(scan_files(spark, root), "scan")
    untouched = tmp_path / "a" / "h0.parquet"  # content lost, size and time kept: seen only if it is opened
    was = untouched.stat()
    untouched.write_bytes(bytes(was.st_size))
    os.utime(untouched, ns=(was.st_atime_ns, was.st_mtime_ns))
    write(tmp_path / "b" / "h1.parquet", {"p": pa.float64()}, rows=5, start=START + timedelta(days=2))
    write(tmp_path / "new.parquet", {"p": pa.float64()}, rows=6)
    (tmp_path / "c" / "h2.parquet").unlink()
    second = stored(scan_changed(spark, root, first), "scan")
    got = {r.file_id: r for r in second.collect()}
    assert got["a/h0.parquet"].row_count == 20_000 and got["b/h1.parquet"].row_count == 5 and got["new.parquet"].row_count == 6
    assert "c/h2.parquet" not in got and got["bad.parquet"].reason and len(got) == 19
    untouched.unlink()
    write(untouched, {"p": pa.float64(), "q": pa.float32()}, rows=20_000)
    full = {tuple(map(str, r)) for r in scan_files(spark, root).collect()}
    assert {tuple(map(str, r)) for r in scan_changed(spark, root, second).collect()} == full
    assert [r.file_id for r in quarantine_of(second).collect()] == ["bad.parquet"]
    assert scan_one(spark, root, "b/h1.parquet").first().row_count == 5


def random_rows(n, seed, days=4):
    rng = random.Random(seed)
    return [(f"t{rng.randrange(3)}", START + timedelta(seconds=rng.randrange(days * 86400)), rng.choice([None, 1.0, 2.5, float(k)])) for k in range(n)]


def test_selected_days_prune_the_scan(spark, tmp_path):
    rows = random_rows(800, 1)
    write_partitioned(spark.createDataFrame(rows, ROWS), str(tmp_path / "r"))
    at = lambda h: START + timedelta(hours=h)
    asked = [(1, "t0", at(0), at(30)), (2, "t1", at(10), at(10)), (3, "t1", at(40), at(39)), (4, "t9", at(0), at(90)), (5, "t0", at(16), at(17)), (6, "t2", None, at(3)), (7, "t2", at(-99), at(999))]
    selections = spark.createDataFrame(asked, "selection_id long, tool_id string, start timestamp_ntz, end timestamp_ntz")
    got = read_selected(spark, str(tmp_path / "r"), selections, "value double")
    want = [(s, t, ts, v) for s, tool, a, b in asked if a is not None for t, ts, v in rows if tool == t and a <= ts < b]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert "dynamicpruning" in got._jdf.queryExecution().toString().lower().replace(" ", "")
    large = read_selected(spark, str(tmp_path / "r"), selections, "value double", most_days=0)
    assert large.count() == len(want)


def test_regeneration_keeps_files_of_unchanged_hours(spark, tmp_path):
    rows = random_rows(300, 2, days=1)
    path = str(tmp_path / "hours")
    fresh = spark.createDataFrame(rows, ROWS)
    first = hours.regenerate(spark, fresh, path, "value double")
    n = first.count()
    assert first.where("state = 'new'").count() == n
    stamps = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "hours").rglob("*.parquet")}
    before = stamps()
    again = hours.regenerate(spark, fresh.repartition(5), path, "value double")
    assert {r.state for r in again.collect()} == {"same"} and stamps() == before
    tool, ts, _ = rows[0]
    edited = spark.createDataFrame([(t, x, 99.0 if (t, x) == (tool, ts) else v) for t, x, v in rows], ROWS)
    third = {(r.tool_id, r.period): r.state for r in hours.regenerate(spark, edited, path, "value double").collect()}
    hour = ts.replace(minute=0, second=0, microsecond=0)
    assert third.pop((tool, hour)) == "changed" and set(third.values()) == {"same"}
    mine = f"tool_id={tool}/year={hour.year}/month={hour.month}/day={hour.day}/hour={hour.hour}/"
    assert {p for p in before if p not in stamps()} == {p for p in before if mine in p}


def test_fingerprints_tell_what_matters(spark):
    one = lambda rows: hours.fingerprints(spark.createDataFrame(rows, "tool_id string, ts timestamp_ntz, a double, b double")).first()[2:]
    base = one([("t", START, 1.0, None), ("t", START, 2.0, 3.0)])
    assert base == one([("t", START, 2.0, 3.0), ("t", START, 1.0, None)])
    assert base != one([("t", START, None, 1.0), ("t", START, 2.0, 3.0)])
    assert one([("t", START, 1.0, 1.0)] * 2) != one([("t", START, 2.0, 2.0)] * 2)


def test_late_rows_and_replays(spark, tmp_path):
    path, ddl = str(tmp_path / "in"), "value double"
    at = lambda h: START + timedelta(hours=h)
    first = [("a", at(0), 1.0), ("a", at(50), 2.0), ("b", at(0), 3.0), ("b", None, 4.0), (None, at(1), 5.0)]
    second = [("a", at(1), 6.0), ("a", at(30), 7.0), ("b", at(-2), 8.0), ("a", at(0), 1.0), ("a", at(30), 7.0)]
    frame = lambda rows: spark.createDataFrame(rows, ROWS)

    def state():
        kept = hours._read(spark, f"{path}/hours", "ts timestamp_ntz, value double, tool_id string")
        late = hours.late_rows(spark, path, ddl)
        return sorted((r.tool_id, r.ts, r.value) for r in kept.collect()), sorted(map(tuple, late.collect()))

    hours.ingest(spark, frame(first), path, ddl, window_hours=24)
    assert state() == ([r for r in sorted(first[:3])], [])
    hours.ingest(spark, frame(second), path, ddl, window_hours=24)
    want = sorted([*first[:3], ("a", at(30), 7.0), ("b", at(-2), 8.0)]), [("a", at(1), 6.0)]
    assert state() == want
    for batch in (second, first, second):
        hours.ingest(spark, frame(batch), path, ddl, window_hours=24)
        assert state() == want
    sealed = {r.tool_id: r.sealed_before for r in hours.sealed_before(spark, path).collect()}
    assert sealed == {"a": at(26), "b": at(-24)}


@pytest.mark.parametrize("parts", ["1", "7"])
def test_retention_equals_a_plain_loop(spark, parts):
    rng = random.Random(4)
    now = datetime(2026, 6, 1)
    rows = [(f"f{k}", now - timedelta(days=rng.randrange(200)), rng.choice([None, 10, 300, 40]), rng.random() < 0.1) for k in range(120)]
    rows += [("none", None, 50, False), ("pinned", None, 50, True), ("edge", now - timedelta(days=100), 5, False)]
    files = spark.createDataFrame(rows, "file_id string, max_ts timestamp_ntz, size_bytes long, pinned boolean")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.file_id: r["drop"] for r in retention.retention(files, now, max_age_days=100, budget_bytes=4000).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want, total = {}, sum(s or 0 for _, _, s, p in rows if p)
    young = [r for r in rows if not r[3] and r[1] is not None and r[1] > now - timedelta(days=100)]
    want = {f: None if p else "age" for f, _, _, p in rows}
    for f, ts, size, _ in sorted(young, key=lambda r: (-r[1].timestamp(), r[0])):
        total += size or 0
        want[f] = "size" if total > 4000 else None
    assert got == want and {"age", "size", None} <= set(got.values())
    none = retention.retention(files.where("false"), now, max_age_days=1, budget_bytes=1)
    assert not none.count()
