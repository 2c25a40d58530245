"""Compare every registered query with its SQL on DuckDB: ``python tests/oracle_check.py [sf] [names]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = Path("/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float, decimal.Decimal)):
        return (2, f"{float(value):.9g}" if not isinstance(value, int) else f"{value:.9g}")
    if isinstance(value, (dt.datetime, dt.date)):
        return (3, value.isoformat())
    return (4, str(value))


def normalised(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, build, sql: str, sf_dir: str) -> str | None:
    """None when equal, else the first difference."""
    result = build(spark, sf_dir)
    got_columns, got = normalised(result.columns, [tuple(r) for r in result.collect()])
    relation = con.execute(sql)
    want_columns, want = normalised([d[0] for d in relation.description], relation.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if not want:
        return "no rows to compare"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for mine, theirs in zip(got, want):
        if mine != theirs:
            return f"{mine}\n   != {theirs}"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = set(sys.argv[2:])
    sf_dir = str(DATA / f"sf{sf}")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, checks, failed = connect(sf_dir), entry.oracle_sql(), []
    for name, build in entry.queries().items():
        if only and name not in only:
            continue
        started = time.time()
        try:
            if name in checks:
                problem = compare(spark, con, name, build, checks[name], sf_dir)
            else:
                problem = None if build(spark, sf_dir).count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - started:.2f}s", flush=True)
        if problem:
            failed.append(name)
            print(f"   {problem}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
