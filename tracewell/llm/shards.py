"""Sharding by K-d tree partitioning, with DataFrame functions only.

A node of the tree is the range of leaves it still has to become. Each level finds every node's
widest metadata dimension and the weighted quantile on it that gives both children bytes in
proportion to their leaves. Quantiles come from histograms: rows are counted per (node, bin) with
map-side combining, a window over a node's bins finds the one that holds the quantile, and the
next pass counts inside that bin. Rows of equal value are split by id, and rows of equal id by
their place in the written table, so that no group of ties is too large to split.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.llm.common import materialise

BINS = 4096
SLOT_ROWS = 4096
LAST = (1 << 63) - 1
BROADCAST_NODES = 100_000


@dataclass
class Node:
    """A range of leaves, and the search for the key that splits it."""

    first: int
    leaves: int
    dim: int = 0
    stage: int = 0  # 0: the dimension's value, 1: the id, 2: the row's number
    fixed: list[int] = field(default_factory=list)
    low: int = 0
    high: int = 0
    before: int = 0
    goal: float = 0.0
    slack: float = 0.0
    ids: tuple[int, int] = (0, 0)
    split: tuple[int, int, int] | None = None

    @property
    def left(self) -> int:
        return self.leaves // 2


def position(column: Column, kind: str) -> Column:
    """A dimension as a number: text by its hash, which keeps equal values together."""
    return F.crc32(F.encode(column, "utf-8")) if kind == "string" else column.cast("long")


def prepared(docs: DataFrame, dims: list[str]) -> DataFrame:
    """One narrow row per document: id, size, checksum, dimensions, number. NULLs come lowest."""
    kinds = dict(docs.dtypes)
    text = F.coalesce(F.col("text"), F.lit(""))
    values = [F.coalesce(position(F.col(d), kinds[d]), F.lit(-1)) for d in dims]
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.array(*values).alias("d"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-LAST - 1)).alias("id"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def _per_node(rows: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """Join rows to their node's row. The nodes of a level are no more than the shards asked for."""
    return rows.join(F.broadcast(nodes) if count <= BROADCAST_NODES else nodes, "node")


def _describe(rows: DataFrame, open_nodes: list[Node], spans: list[int], width: int) -> None:
    """Set each node's widest dimension, its range, and the bytes its left side should hold."""
    found = rows.groupBy("node").agg(
        F.sum("size").alias("mass"),
        *[F.min(F.col("d")[i]).alias(f"lo{i}") for i in range(width)],
        *[F.max(F.col("d")[i]).alias(f"hi{i}") for i in range(width)],
        F.min("id").alias("lo_id"),
        F.max("id").alias("hi_id"),
    )
    seen = {r.node: r for r in found.collect()}
    for node in open_nodes:
        row = seen.get(node.first)
        if row is None:  # no rows: any split will do
            node.split = (LAST, LAST, LAST)
            continue
        relative = [(row[f"hi{i}"] - row[f"lo{i}"]) / (spans[i] or 1) for i in range(width)]
        node.dim = relative.index(max(relative))
        node.low, node.high = row[f"lo{node.dim}"], row[f"hi{node.dim}"]
        node.goal = row.mass * node.left / node.leaves
        node.slack = row.mass / node.leaves * 0.0005
        node.ids = (row.lo_id, row.hi_id)
        _settle(node, row.mass)


def _settle(node: Node, mass: int) -> None:
    """A range of one value is fixed, and the search goes on with the next part of the key.

    A single row, of ``mass`` bytes, goes to the side that leaves the smaller error.
    """
    while node.split is None and node.low == node.high:
        node.fixed.append(node.low)
        node.stage += 1
        if node.stage == 3:
            over = 2 * (node.goal - node.before) < mass
            node.split = (*node.fixed[:2], node.fixed[2] - over)
            return
        node.low, node.high = node.ids if node.stage == 1 else (0, LAST)


def _refine(rows: DataFrame, searching: list[Node]) -> None:
    """One histogram pass for all nodes without a split."""
    spark = rows.sparkSession
    table = spark.createDataFrame(
        [
            (n.first, n.dim, n.stage, (n.fixed + [0, 0])[:2], n.low, n.high, math.ceil((n.high - n.low + 1) / BINS), n.before, n.goal)
            for n in searching
        ],
        "node long, dim int, stage int, fixed array<long>, low long, high long, step long, before long, goal double",
    )
    value = F.element_at("d", F.col("dim") + 1)
    key = F.when(F.col("stage") == 0, value).when(F.col("stage") == 1, F.col("id")).otherwise(F.col("row_no"))
    inside = (
        ((F.col("stage") < 1) | (value == F.col("fixed")[0]))
        & ((F.col("stage") < 2) | (F.col("id") == F.col("fixed")[1]))
        & key.between(F.col("low"), F.col("high"))
    )
    wide = "decimal(20, 0)"  # the difference of two longs may pass 63 bits
    place = (key.cast(wide) - F.col("low").cast(wide)) / F.col("step").cast(wide)
    bins = (
        _per_node(rows, table, len(searching))
        .where(inside)
        .withColumn("key", key)
        .groupBy("node", F.floor(place).cast("long").alias("bin"), "before", "goal")
        .agg(F.sum("size").alias("mass"), F.min("key").alias("low"), F.max("key").alias("high"))
    )
    upto = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        bins.withColumn("end", F.sum("mass").over(upto) + F.col("before"))
        .where("end >= goal")
        .groupBy("node")
        .agg(F.min_by(F.struct("low", "high", "mass", "end"), "bin").alias("at"))
    )
    at = {r.node: r["at"] for r in found.collect()}
    for node in searching:
        bin_ = at[node.first]
        tail = (LAST,) * (2 - node.stage)
        if abs(bin_["end"] - node.goal) <= node.slack:
            node.split = (*node.fixed, bin_["high"], *tail)
        elif abs(bin_["end"] - bin_["mass"] - node.goal) <= node.slack:
            node.split = (*node.fixed, bin_["low"] - 1, *tail)
        else:
            node.low, node.high = bin_["low"], bin_["high"]
            node.before = bin_["end"] - bin_["mass"]
            _settle(node, bin_["mass"])


def _divide(rows: DataFrame, nodes: list[Node]) -> DataFrame:
    splits = rows.sparkSession.createDataFrame(
        [(n.first, n.first + n.left, n.dim, *n.split) for n in nodes],
        "node long, right long, dim int, s0 long, s1 long, s2 long",
    )
    value = F.element_at("d", F.col("dim") + 1)
    above = (value > F.col("s0")) | (
        (value == F.col("s0"))
        & ((F.col("id") > F.col("s1")) | ((F.col("id") == F.col("s1")) & (F.col("row_no") > F.col("s2"))))
    )
    small = F.broadcast(splits) if len(nodes) <= BROADCAST_NODES else splits
    return rows.join(small, "node", "left").select(
        F.when(F.col("right").isNotNull() & above, F.col("right")).otherwise(F.col("node")).alias("node"),
        "doc_id", "size", "text_crc32", "d", "id", "row_no",
    )


def kd_shards(
    docs: DataFrame,
    dims: list[str],
    shards: int | None = None,
    target_bytes: int | None = None,
    label: str = "shards",
) -> DataFrame:
    """Documents in shards of near-equal bytes.

    Give the number of ``shards``, or ``target_bytes`` for a shard. ``dims`` are metadata columns,
    numbers or text. Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, shard,
    slot (gapless from 0 in each shard). A NULL text has size 8 and checksum 0; a NULL dimension
    or id counts as lower than any other. Repeated rows get places of their own. No rows give no
    rows. Other columns are ignored. The driver holds one row per shard, never one per document.
    """
    rows = materialise(prepared(docs, dims), f"{label}-rows")
    width = len(dims)
    total, n, *ends = rows.agg(
        F.sum("size"), F.count("*"),
        *[F.min(F.col("d")[i]) for i in range(width)], *[F.max(F.col("d")[i]) for i in range(width)],
    ).first()
    leaves = shards or max(1, math.ceil((total or 0) / (target_bytes or 1)))
    spans = [(hi or 0) - (lo or 0) for lo, hi in zip(ends[:width], ends[width:])]
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    open_nodes = [Node(0, leaves)] if leaves > 1 and n else []
    while open_nodes:
        _describe(rows, open_nodes, spans, width)
        while searching := [x for x in open_nodes if x.split is None]:
            _refine(rows, searching)
        rows = materialise(_divide(rows, open_nodes), f"{label}-level")
        children = [Node(x.first, x.left) for x in open_nodes]
        children += [Node(x.first + x.left, x.leaves - x.left) for x in open_nodes]
        open_nodes = [x for x in children if x.leaves > 1]
    return _slots(rows.withColumnRenamed("node", "shard"), n, leaves)


def _slots(rows: DataFrame, n: int, leaves: int) -> DataFrame:
    """Number each shard's rows from 0: inside buckets of a shard, after the buckets before."""
    buckets = max(1, math.ceil(n / leaves / SLOT_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "row_no"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "bucket")
        .agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "row_no")
    return (
        rows.withColumn("nth", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("nth") + F.col("start")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
