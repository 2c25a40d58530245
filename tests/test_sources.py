import hashlib
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracewell.operators import index
from tracewell.operators.downsample import downsample, downsample_long, to_long
from tracewell.sources.checksum import audit_checksums, file_checksums
from tracewell.sources.files import index_of, quarantine_of, scan_files, sensor_catalog
from tracewell.sources.readings import read_by_index
from tracewell.sources.sinks import read_partitioned, write_partitioned

START = datetime(2026, 1, 1, 8)


def write(path, columns, *, rows=100, hz=10, start=START, time_type=pa.timestamp("ns"), name="ts", seed=1):
    rng = np.random.default_rng(seed)
    stamps = [start + timedelta(seconds=i / hz) for i in range(rows)]
    arrays = {name: pa.array(stamps, type=time_type)}
    for column, kind in columns.items():
        values = rng.random(rows) * 100
        arrays[column] = pa.array(values.astype("int64") if pa.types.is_integer(kind) else values).cast(kind)
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(arrays), path)


def test_index_layouts(spark, tmp_path):
    write(tmp_path / "kiln_1.parquet", {"p": pa.float64()})
    write(tmp_path / "kiln_2" / "2026-03-09T21.parquet", {"p": pa.float64()})
    write(tmp_path / "kiln_3" / "2026" / "11" / "30" / "00.parquet", {"p": pa.float32()})
    rows = {r["file_id"]: r for r in index_of(scan_files(spark, str(tmp_path))).collect()}
    flat = rows["kiln_1.parquet"]
    assert (flat["tool_id"], flat["hour_bucket"], flat["row_count"]) == ("kiln_1", None, 100)
    assert (flat["min_ts"], flat["max_ts"]) == (START, START + timedelta(seconds=9.9))
    assert flat["size_bytes"] == (tmp_path / "kiln_1.parquet").stat().st_size
    assert rows["kiln_2/2026-03-09T21.parquet"]["hour_bucket"] == "2026-03-09T21"
    assert rows["kiln_3/2026/11/30/00.parquet"]["hour_bucket"] == "2026-11-30T00"
    assert not flat["archived"] and not flat["pinned"]


def test_bad_files_are_quarantined_with_reasons(spark, tmp_path):
    write(tmp_path / "good.parquet", {"p": pa.float64()})
    (tmp_path / "bad.parquet").write_bytes(bytes(range(40)))
    write(tmp_path / "other.parquet", {"p": pa.float64()}, name="timestamp")
    pq.write_table(pa.table({"ts": pa.array([], type=pa.timestamp("us"))}), tmp_path / "none.parquet")
    pq.write_table(
        pa.table({"ts": pa.array([START], type=pa.timestamp("us"))}),
        tmp_path / "nostats.parquet", write_statistics=False,
    )
    scanned = scan_files(spark, str(tmp_path))
    assert [r["tool_id"] for r in index_of(scanned).collect()] == ["good"]
    reasons = {r["tool_id"]: r["reason"] for r in quarantine_of(scanned).collect()}
    assert reasons["bad"].startswith("unreadable footer")
    assert reasons["other"] == "no time column ts"
    assert reasons["nostats"] == "no statistics on ts"
    assert reasons["none"] in ("no row groups", "no statistics on ts")


def test_other_time_column_on_request(spark, tmp_path):
    write(tmp_path / "gen.parquet", {"p": pa.float32()}, name="timestamp", time_type=pa.timestamp("us", tz="UTC"))
    files = index_of(scan_files(spark, str(tmp_path), ("ts", "timestamp")))
    rows = read_by_index(spark, files, ["p"], root=str(tmp_path))
    assert rows.agg(F.min("ts"), F.count("p")).first() == (START, 100)


def test_catalog_of_oldest_file_with_units(spark, tmp_path):
    def one(path, start, names):
        fields = [pa.field("ts", pa.timestamp("ns"))] + [
            pa.field(n, pa.float64(), metadata={key: unit} if key else None) for n, key, unit in names
        ]
        path.parent.mkdir(exist_ok=True)
        columns = [pa.array([start])] + [pa.array([1.0])] * len(names)
        pq.write_table(pa.Table.from_arrays(columns, schema=pa.schema(fields)), path)

    one(tmp_path / "t" / "b.parquet", START, [("x", b"units", b"Pa"), ("y", b"unit", b"W"), ("z", None, None)])
    one(tmp_path / "t" / "a.parquet", START + timedelta(days=1), [("late", None, None)])
    got = sensor_catalog(index_of(scan_files(spark, str(tmp_path)))).orderBy("position").collect()
    assert [(r["tool_id"], r["raw_name"], r["units"]) for r in got] == [("t", "x", "Pa"), ("t", "y", "W"), ("t", "z", None)]


def test_mixed_units_and_columns_read_as_one_table(spark, tmp_path):
    write(tmp_path / "t" / "1.parquet", {"p": pa.float64(), "q": pa.float32()})
    write(tmp_path / "t" / "2.parquet", {"p": pa.float32()}, start=START + timedelta(hours=1), time_type=pa.timestamp("us"))
    write(tmp_path / "u.parquet", {"p": pa.int64(), "note": pa.string()}, time_type=pa.timestamp("us", tz="UTC"))
    write(tmp_path / "v.parquet", {"p": pa.int32()}, time_type=pa.timestamp("ms"))
    files = index_of(scan_files(spark, str(tmp_path)))
    rows = read_by_index(spark, files, ["p", "q", "note"], root=str(tmp_path))
    got = {r["tool_id"]: r for r in rows.groupBy("tool_id").agg(
        F.count("*").alias("n"), F.count("p").alias("p"), F.count("q").alias("q"), F.min("ts").alias("first")).collect()}
    assert {t: (r["n"], r["p"], r["q"], r["first"]) for t, r in got.items()} == {
        "t": (200, 200, 100, START), "u": (100, 100, 0, START), "v": (100, 100, 0, START)}
    assert rows.schema["p"].dataType.typeName() == "double"


def test_odd_time_columns_are_quarantined(spark, tmp_path):
    write(tmp_path / "good.parquet", {"p": pa.float64()})
    write(tmp_path / "ns.parquet", {"p": pa.float64()}, time_type=pa.timestamp("ns"))
    for name, kind, value in (("text", pa.string(), "2026-01-01"), ("day", pa.date32(), START.date()), ("real", pa.float64(), 1.5)):
        pq.write_table(pa.table({"ts": pa.array([value], type=kind)}), tmp_path / f"{name}.parquet")
    scanned = scan_files(spark, str(tmp_path))
    reasons = {r["tool_id"]: r["reason"] for r in quarantine_of(scanned).collect()}
    assert reasons == {"text": "time column ts has type string", "day": "time column ts has type date32[day]", "real": "time column ts has type double"}
    assert {r["tool_id"]: r["min_ts"] for r in index_of(scanned).collect()} == {"good": START, "ns": START}


@pytest.mark.parametrize("tool", ["tool a", "50%", "a+b", "k=v", "ü"])
def test_tools_keep_their_spelling(spark, tmp_path, tool):
    write(tmp_path / tool / "2026-01-01T08.parquet", {"p": pa.float64()})
    files = index_of(scan_files(spark, str(tmp_path)))
    rows = read_by_index(spark, files, ["p"], root=str(tmp_path))
    assert files.first()["tool_id"] == tool and rows.first()["tool_id"] == tool and rows.count() == 100


def test_decimals_and_booleans_are_numbers(spark, tmp_path):
    columns = {"ts": pa.array([START] * 3, type=pa.timestamp("us")), "money": pa.array([1, 2, None], type=pa.decimal128(10, 2)), "on": pa.array([True, False, None]), "big": pa.array([2**63, 1, None], type=pa.uint64())}
    pq.write_table(pa.table(columns), tmp_path / "t.parquet")
    files = index_of(scan_files(spark, str(tmp_path)))
    got = read_by_index(spark, files, ["money", "on", "big"], root=str(tmp_path)).agg(*[F.sum(c) for c in ("money", "on", "big")]).first()
    assert tuple(got) == (3.0, 1.0, 2.0**63)
    assert all(r["numeric"] for r in sensor_catalog(files).collect())


def test_other_columns_make_no_kinds_of_files(spark, tmp_path):
    for i, extra in enumerate(({"x": pa.int64()}, {"y": pa.float32()}, {})):
        write(tmp_path / f"t{i}.parquet", {"v": pa.float64(), **extra}, time_type=pa.timestamp("us"))
    rows = read_by_index(spark, index_of(scan_files(spark, str(tmp_path))), ["v"], root=str(tmp_path))
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1 and rows.count() == 300


def test_catalog_skips_a_file_that_went_away(spark, tmp_path):
    write(tmp_path / "a.parquet", {"p": pa.float64()})
    write(tmp_path / "b.parquet", {"q": pa.float64()})
    files = index_of(scan_files(spark, str(tmp_path))).cache()
    assert files.count() == 2
    (tmp_path / "a.parquet").unlink()
    assert [r["raw_name"] for r in sensor_catalog(files).collect()] == ["q"]


def test_no_files_read_as_empty_table(spark, tmp_path):
    write(tmp_path / "t.parquet", {"p": pa.float64()})
    files = index_of(scan_files(spark, str(tmp_path))).where("tool_id = 'absent'")
    rows = read_by_index(spark, files, ["p"], root=str(tmp_path))
    assert rows.columns == ["tool_id", "ts", "p"] and rows.count() == 0


def test_schema_drift_downsample_matches_duckdb(spark, tmp_path):
    write(tmp_path / "t" / "1.parquet", {"p": pa.float64(), "q": pa.float64()}, rows=120, hz=1)
    write(tmp_path / "t" / "2.parquet", {"p": pa.float64()}, rows=120, hz=1, start=START + timedelta(minutes=2), seed=2)
    files = index_of(scan_files(spark, str(tmp_path)))
    rows = read_by_index(spark, files, ["p", "q"], root=str(tmp_path))
    end = START + timedelta(minutes=3, seconds=3)
    got = downsample(rows, ["p", "q"], 7, start=START, end=end).orderBy("bucket").collect()
    want = duckdb.execute(
        f"""SELECT time_bucket(INTERVAL '7 seconds', ts) b, avg(p), min(p), max(p), avg(q), min(q), max(q)
        FROM read_parquet('{tmp_path}/t/*.parquet', union_by_name = true)
        WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{end}' GROUP BY b ORDER BY b"""
    ).fetchall()
    assert len(got) == len(want)
    for mine, theirs in zip(got, want):
        assert mine["bucket"] == theirs[0]
        assert list(mine)[2:] == pytest.approx(list(theirs[1:]), nan_ok=True) or None in theirs
        assert [v is None for v in list(mine)[2:]] == [v is None for v in theirs[1:]]


def test_wide_and_long_agree(spark, tmp_path):
    write(tmp_path / "t.parquet", {"p": pa.float64(), "weird `name`": pa.float64()})
    rows = read_by_index(spark, index_of(scan_files(spark, str(tmp_path))), ["p", "weird `name`"], root=str(tmp_path))
    wide = downsample(rows, ["p", "weird `name`"], 1).orderBy("bucket").collect()
    long = downsample_long(to_long(rows, ["p", "weird `name`"]), 1).orderBy("bucket").collect()
    for sensor in ("p", "weird `name`"):
        assert [(r["bucket"], r[f"{sensor}_min"]) for r in wide] == [(r["bucket"], r["min"]) for r in long if r["sensor"] == sensor]


def test_files_for_range(spark, tmp_path):
    for day in (1, 2, 3):
        write(tmp_path / "tool_x" / f"2026-01-0{day}T08.parquet", {"p": pa.float64()}, start=datetime(2026, 1, day, 8))
    files = index_of(scan_files(spark, str(tmp_path)))
    got = index.files_for(files, "tool_x", datetime(2026, 1, 2), datetime(2026, 1, 2, 23, 59)).collect()
    assert [r["hour_bucket"] for r in got] == ["2026-01-02T08"]
    touching = index.files_for(files, "tool_x", datetime(2026, 1, 1), datetime(2026, 1, 1, 8)).collect()
    assert [r["hour_bucket"] for r in touching] == ["2026-01-01T08"]


def test_range_and_columns_reach_the_scan(spark, tmp_path):
    write(tmp_path / "t.parquet", {"p": pa.float64(), "q": pa.float64()}, time_type=pa.timestamp("us"))
    files = index_of(scan_files(spark, str(tmp_path)))
    rows = read_by_index(spark, files, ["p", "q"], root=str(tmp_path))
    plan = downsample(rows, ["p"], 10, start=START, end=START + timedelta(seconds=5))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,p:double>" in plan


def test_checksums_of_streamed_files(spark, tmp_path):
    write(tmp_path / "a.parquet", {"p": pa.float64()})
    write(tmp_path / "b" / "x.parquet", {"p": pa.float64()}, rows=5000)
    want = {f"{n}": hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ("a.parquet", "b/x.parquet")}
    stored = file_checksums(spark, str(tmp_path))
    assert {r["file_id"]: r["sha256"] for r in stored.collect()} == want
    manifest = spark.createDataFrame(
        [("a.parquet", "a", want["a.parquet"]), ("b/x.parquet", "b", "0" * 64), ("c", "c", None)],
        "file_id string, tool_id string, sha256 string")
    got = {r["file_id"]: r["status"] for r in audit_checksums(file_checksums(spark, str(tmp_path)), manifest).collect()}
    assert got == {"a.parquet": "ok", "b/x.parquet": "mismatch", "c": "missing"}


@pytest.mark.parametrize("by", ["day", "hour"])
def test_partitioned_folders(spark, tmp_path, by):
    rows = spark.range(5000).select(
        F.concat(F.lit("00"), F.col("id") % 3).alias("tool_id"),
        (F.expr("timestamp_ntz'2026-01-01 22:00:00' + make_dt_interval(0, 0, 0, cast(id * 7 % 20011 as decimal(18,6)))")).alias("ts"),
        F.col("id").cast("double").alias("p"))
    write_partitioned(rows, str(tmp_path / "out"), by=by)
    back = read_partitioned(spark, str(tmp_path / "out"), "p double", by=by)
    assert back.select("tool_id", "ts", "p").exceptAll(rows).count() == 0 and back.count() == 5000
    folder = tmp_path / "out" / "tool_id=000" / "year=2026" / "month=1" / "day=1"
    folder = folder / "hour=23" if by == "hour" else folder
    for file in folder.glob("*.parquet"):
        table = pq.ParquetFile(file)
        assert table.metadata.row_group(0).column(0).compression == "ZSTD"
        stamps = table.read(["ts"])["ts"].to_pylist()
        assert stamps == sorted(stamps) and stamps
