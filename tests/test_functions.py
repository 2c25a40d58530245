import math
from datetime import datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewell.functions import (
    bucket_start, bucket_start_by, display_label, fold_case, is_finite, iso_text, iso_text_ns,
    ns_to_ts, utc_literal,
)
from tracewell.operators.align import as_csv_text
from tracewell.plans import bucket_seconds, bucket_seconds_column

MOMENTS = [
    "1969-12-31 23:59:59.999999", "1970-01-01 00:00:00", "1999-12-31 12:00:00.5",
    "2000-01-02 23:59:59", "2000-01-03 00:00:00", "2024-02-29 10:20:30.123456",
    "2026-01-01 08:00:00.1",
]


def moments(spark):
    return spark.createDataFrame([(m,) for m in MOMENTS], "m string").select(
        F.col("m").cast("timestamp_ntz").alias("ts")
    )


@pytest.mark.parametrize("width", [1, 10, 60, 259, 300, 1260, 3600, 86400, 604800])
def test_buckets_match_time_bucket(spark, width):
    rows = moments(spark).select(
        "ts", bucket_start(F.col("ts"), width).alias("a"),
        bucket_start_by(F.col("ts"), F.lit(width)).alias("b"),
    ).collect()
    for ts, a, b in rows:
        want = duckdb.execute(
            f"SELECT time_bucket(INTERVAL '{width} seconds', TIMESTAMP '{ts}')"
        ).fetchone()[0]
        assert a == b == want


@pytest.mark.parametrize(
    "span, want",
    [
        (timedelta(seconds=60), 1), (timedelta(seconds=1800), 1), (timedelta(seconds=3600), 10),
        (timedelta(hours=12), 60), (timedelta(hours=24), 60), (timedelta(days=7), 3600),
        (timedelta(days=30), 3600), (timedelta(days=365), 86400), (timedelta(days=9999), 86400),
        (timedelta(seconds=-5), 1), (timedelta(seconds=2000), 1),
        (timedelta(seconds=2000, microseconds=1), 10),
    ],
)
def test_ladder(spark, span, want):
    start = datetime(2026, 1, 1)
    assert bucket_seconds(start, start + span, "standard") == want
    row = spark.range(1).select(
        bucket_seconds_column(
            utc_literal(start), utc_literal(start + span), F.lit("standard")
        ).alias("w")
    ).first()
    assert row["w"] == want


def test_modes_refine_the_bucket():
    start, end = datetime(2026, 1, 1), datetime(2026, 1, 1, 1)
    widths = [bucket_seconds(start, end, m) for m in ("overview", "standard", "focus", "else")]
    assert widths == [60, 10, 1, 10]


def test_aware_bounds_become_utc(spark):
    aware = datetime(2026, 1, 1, 9, tzinfo=timezone(timedelta(hours=9)))
    assert spark.range(1).select(utc_literal(aware).alias("t")).first()["t"] == datetime(2026, 1, 1)


def test_iso_text(spark):
    got = [r[0] for r in moments(spark).select(iso_text(F.col("ts"))).collect()]
    assert got == [
        datetime.fromisoformat(m).replace(tzinfo=timezone.utc).isoformat() for m in MOMENTS
    ]


def test_nanoseconds(spark):
    ns = [0, 1, -1, 1_767_225_600_123_456_789, 1_767_225_600_000_000_999]
    rows = spark.createDataFrame([(n,) for n in ns], "n bigint").select(
        iso_text_ns(F.col("n")).alias("t"), ns_to_ts(F.col("n")).alias("ts")
    ).collect()
    assert [r["t"] for r in rows] == [
        "1970-01-01T00:00:00.000000000+00:00", "1970-01-01T00:00:00.000000001+00:00",
        "1969-12-31T23:59:59.999999999+00:00", "2026-01-01T00:00:00.123456789+00:00",
        "2026-01-01T00:00:00.000000999+00:00",
    ]
    assert rows[2]["ts"] == datetime(1969, 12, 31, 23, 59, 59, 999999)
    assert rows[4]["ts"] == datetime(2026, 1, 1)


FLOATS = [
    0.0, -0.0, 1.0, -1.5, 100.0, 0.1, 1 / 3, 1e-3, 9.99e-4, 1e-4, 1e-5, 1.25e-7, 123456.789, 1e6,
    9999999.0, 1e7, 12345678.0, 1e15, 123456789012345.6, 1e16, 1.2345678901234567e18,
    2.12010303354537293e18, 1e22, 1e23, 2e23, 1e100, 1.5e-300, 1.7976931348623157e308,
    math.inf, -math.inf, math.nan, 0.10000000149011612, 2.0 ** 60,
]


def test_csv_float_text_equals_repr(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(FLOATS)] + [(99, None)], "i int, v double")
    got = {r["i"]: r["v"] for r in as_csv_text(rows).collect()}
    assert got == {str(i): repr(v) for i, v in enumerate(FLOATS)} | {"99": ""}


def test_csv_text_of_other_types(spark):
    row = spark.sql(
        "SELECT float(0.1) AS f, true AS b, bigint(7) AS n, 'x,\"y' AS s, cast(null AS string) AS z"
    )
    assert tuple(as_csv_text(row).first()) == ("0.10000000149011612", "True", "7", 'x,"y', "")


def test_small_text_helpers(spark):
    row = spark.createDataFrame([("a", "Pa", "", None, "STRAßE ΣΑΣ ﬁeld ẞ µ")], "n string, u string, e string, z string, w string")
    got = row.select(
        display_label(F.col("n"), F.col("u")).alias("a"), display_label(F.col("n"), F.col("e")).alias("b"),
        display_label(F.col("n"), F.col("z")).alias("c"), fold_case(F.col("w")).alias("d"),
    ).first()
    assert tuple(got) == ("a (Pa)", "a", "a", "strasse σασ field ss μ")


def test_is_finite(spark):
    rows = spark.createDataFrame([(v,) for v in (1.0, None, math.nan, math.inf, -math.inf)], "v double")
    assert [r[0] for r in rows.select(is_finite(F.col("v"))).collect()] == [True, False, False, False, False]
