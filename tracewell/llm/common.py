"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracewell.session import shared_dir

WORDS = r"[^\x20\x09-\x0D]+"

# Over the bytes of UTF-8: A-Z lower-cased, and everything but ASCII letters, digits and bytes of
# other characters made a space.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
TERM_END = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
PORTION = 1 << 20  # bytes of one text that are split into terms at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage is cut, the size is known."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` with a common beginning that no column of ``df`` has."""
    taken, start = {c.lower() for c in df.columns}, "_"
    while any((start + n).lower() in taken for n in names):
        start += "_"
    return [start + n for n in names]


def word_count(text: Column) -> Column:
    """Words between ASCII white space; NULL counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """Lower-cased terms of a UTF-8 text, a bounded portion of it at a time."""
    at = 0
    while at < len(raw):
        end = at + PORTION
        if end < len(raw):  # not within a term
            cut = TERM_END.search(raw, end)
            end = cut.start() if cut else len(raw)
        yield raw[at:end].translate(TERM_BYTES).split()
        at = end


def numbered(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """Number all rows from 0 in ``order`` without one task seeing them all.

    Rows are dealt by range, numbered inside each partition, and shifted by the rows of the
    partitions before; only one count per partition meets in one place.
    """
    inside = Window.partitionBy("_part").orderBy(*order)
    ranged = materialise(
        df.repartitionByRange(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.row_number().over(inside) - 1),
        label,
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return (
        ranged.join(F.broadcast(starts), "_part")  # one row per partition of the range shuffle
        .withColumn(name, (F.col("_row") + F.col("_start")).cast("long"))
        .drop("_part", "_row", "_start")
    )


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component), the smallest node named.

    Alternating large-star and small-star steps; every step is a grouped minimum and a join, and
    the minima are written first so that a join on a much-linked node can be split at run time.
    A node without edges isn't returned.
    """
    current = materialise(edges.where("a <> b").select("a", "b").distinct(), f"{label}-edges")
    state = None
    while True:
        for large in (True, False):
            if large:
                pairs = current.union(current.select(F.col("b"), F.col("a"))).toDF("u", "v")
            else:
                pairs = current.select(
                    F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
                )
            least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            joined = pairs.join(materialise(least, f"{label}-least"), "u")
            if large:
                linked = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            else:
                linked = joined.select(
                    F.inline(F.expr("array(struct(v AS a, m AS b), struct(u AS a, m AS b))"))
                )
            current = materialise(linked.where("a <> b").distinct(), f"{label}-edges")
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(current.select("b", "b")).distinct()
