"""Prefix trie of conversations by ROLLUP over positional turn columns.

A conversation is cut into blocks of BLOCK turns. A block is one row: its number, the digest of all
turns before it, which names the trie node that it continues, and its turns' ids as columns
t1 to tB. ROLLUP over these columns gives one row for every prefix of every block at once, and
grouping_id says how many columns the prefix has. So all nodes of all depths come from one
aggregate, however long the conversations are, and equal conversations are combined before they
are shuffled.

Sums over subtrees are a second ROLLUP. Every node belongs to its smallest member; the nodes of one
conversation are then the deepest ones on its path, from some depth on. What a conversation owns
at or below a depth is a running sum along it, and a node's subtree is the sum of these over its
members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.llm.common import materialise

BLOCK = 8
TURNS = [f"t{j}" for j in range(1, BLOCK + 1)]
PACK = 256  # ids of one node that are joined into one text before they meet
LANES = ("a", "b")  # two halves of a prefix's digest
NO_ENDS = hashlib.sha256(b"").hexdigest()


def carried(df: DataFrame, key: str, order: list[Column], totals: dict[str, Column], fold: str, label: str) -> DataFrame:
    """Running totals along the rows of each ``key``, up to and with the row itself.

    ``totals`` are new columns and what is added up for them, ``fold`` is "sum" or "bit_xor". Rows
    are dealt by range of key and order, so a key with very many rows is in many parts; each part's
    totals are carried into the next ones. Only keys that several parts share need that, so what is
    carried has at most two rows for each part.
    """
    folded = {"sum": F.sum, "bit_xor": F.bit_xor}[fold]
    ranged = df.repartitionByRange(F.col(key), *order).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    rows = materialise(
        ranged.select(*df.columns, "_part", *[folded(c).over(inside).alias(n) for n, c in totals.items()],
                      *[c.alias(f"_{n}") for n, c in totals.items()]),
        label,
    )
    parts = rows.groupBy(key, "_part").agg(*[folded(f"_{n}").alias(f"_{n}") for n in totals])
    split = parts.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    carry = parts.join(split, key).select(
        F.col(key).alias("_key"), F.col("_part").alias("_of"), *[folded(f"_{n}").over(before).alias(f"_before_{n}") for n in totals]
    )
    add = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}[fold]
    return rows.join(
        F.broadcast(materialise(carry, f"{label}-carried")),  # two rows for each part at most
        (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_of")),
        "left",
    ).select(
        *df.columns,
        *[add(F.col(n), F.coalesce(f"_before_{n}", F.lit(0))).alias(n) for n in totals],
    )


def turn_id(role: Column, text: Column) -> Column:
    """Code points of the text, then a digest of role and text; NULL counts as empty."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))
    framed = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.char_length(text).cast("string"), F.lit(":"), F.md5(framed.cast("binary")))


def ordered_turns(conversations: DataFrame, label: str = "trie") -> DataFrame:
    """Turns (conv_id, pos, turn_id), numbered from 1 in each conversation.

    By turn number, NULL first, turns of equal number by their digest. Rows without a conv_id are
    left out.
    """
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        turn_id(F.col("role"), F.col("text")).alias("turn_id"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("turn_id").asc()]
    one = {"pos": F.lit(1).cast("long")}
    return carried(turns, "conv_id", order, one, "sum", f"{label}-turns").drop("turn")


def shared_openings(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the opening of the first conversation of their hundred.

    Conversation c begins with the first h turns of conversation c - c % group, h being the CRC-32
    of c's decimal digits modulo ``most``; its own turns after its first h follow. The remainder has
    the sign of c, as in SQL. Returns turns (conv_id, pos, turn_id) and conversations (conv_id,
    n_turns), also those left without a turn.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    sizes = materialise(sizes.withColumn("base", F.expr(f"conv_id - conv_id % {group}")), "trie-sizes")
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    plan = materialise(
        sizes.withColumn("h", h)
        .join(bases, "base", "left")
        .withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
        .withColumn("own", F.greatest(F.col("n") - F.col("h"), F.lit(0)))
        .select("conv_id", "base", "h", "taken", (F.col("taken") + F.col("own")).alias("n_turns")),
        "trie-plan",
    )
    own = (
        turns.join(plan.select("conv_id", "h", "taken"), "conv_id")
        .where("pos > h")
        .select("conv_id", F.expr("pos - h + taken").alias("pos"), "turn_id")
    )
    openings = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "turn_id")
    opened = (
        plan.where("taken > 0")
        .join(openings, "base")  # fewer than ``most`` turns of each base
        .where("pos <= taken")
        .select("conv_id", "pos", "turn_id")
    )
    return own.union(opened), plan.select("conv_id", "n_turns")


def _mixed(lane: str, pos: Column, turn: Column) -> Column:
    """What a turn at a place adds to one half of the digest of a prefix."""
    return F.xxhash64(turn, pos) if lane == "a" else F.xxhash64(pos, F.lit(lane), turn)


def _blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Rows (conv_id, block, t1 to tB, a, b): a and b name the node before the block.

    A conversation without turns has a block 0 without any. end_a and end_b name the node behind
    the block, in the last block of a conversation that of the whole conversation.
    """
    at = F.col("pos") - 1
    placed = turns.select(
        "conv_id",
        F.floor(at / BLOCK).cast("long").alias("block"),
        (at % BLOCK).alias("slot"),
        "turn_id",
        *[_mixed(x, F.col("pos").cast("long"), F.col("turn_id")).alias(x) for x in LANES],
    )
    rows = placed.groupBy("conv_id", "block").agg(  # BLOCK rows at most
        *[F.max(F.when(F.col("slot") == j, F.col("turn_id"))).alias(t) for j, t in enumerate(TURNS)],
        *[F.bit_xor(x).alias(f"in_{x}") for x in LANES],
    )
    bare = convs.where("n_turns = 0").select("conv_id", F.lit(0).cast("long").alias("block"))
    rows = rows.unionByName(bare, allowMissingColumns=True).fillna(0, [f"in_{x}" for x in LANES])
    running = {f"end_{x}": F.col(f"in_{x}") for x in LANES}
    return carried(rows, "conv_id", [F.col("block").asc()], running, "bit_xor", "trie-blocks").select(
        "conv_id",
        "block",
        *TURNS,
        *[F.col(f"end_{x}").bitwiseXOR(F.col(f"in_{x}")).alias(x) for x in LANES],
        *[f"end_{x}" for x in LANES],
    )


def _rolled(rows: DataFrame, measures: list[str]) -> DataFrame:
    """One row for each prefix in ``rows``: depth, its digest, its parent's, its last turn.

    ``measures`` are aggregates as SQL text over the columns of ``rows``.
    """
    ts = ", ".join(TURNS)
    rolled = rows.sparkSession.sql(
        f"""SELECT block, a, b, {ts}, {BLOCK} - bit_count(grouping_id()) AS level, {', '.join(measures)}
        FROM {{rows}} GROUP BY block, a, b, ROLLUP ({ts})""",
        rows=rows,
    )
    last = F.lit(None).cast("string")
    for j, t in enumerate(TURNS):
        last = F.when(F.col("level") == j + 1, F.col(t)).otherwise(last)

    def digest(lane: str, less: int) -> Column:
        value = F.col(lane)
        for j, t in enumerate(TURNS):
            pos = F.col("block") * BLOCK + j + 1
            own = F.when(F.col("level") - less > j, _mixed(lane, pos, F.col(t))).otherwise(F.lit(0))
            value = value.bitwiseXOR(own)
        return value

    # a prefix whose last column is empty belongs to a shorter conversation; without columns it is
    # the last prefix of the block before, but for the root
    return rolled.withColumn("turn", last).where("turn IS NOT NULL OR level = 0 AND block = 0").select(
        (F.col("block") * BLOCK + F.col("level")).alias("depth"),
        *[digest(x, 0).alias(x) for x in LANES],
        *[F.when(F.col("level") > 0, digest(x, 1)).alias(f"up_{x}") for x in LANES],
        F.coalesce(F.substring_index("turn", ":", 1).cast("long"), F.lit(0)).alias("chars"),
        "level",
        *[m.rsplit(" AS ", 1)[1] for m in measures],
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of at most PACK ids of one node, joined by commas. Rows come by node and id."""
    node, ids, done = None, [], []

    def out() -> pa.RecordBatch:
        columns = list(zip(*done))
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["depth", "a", "b", "first", "ids"]
        )

    for batch in batches:
        for *own, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if ids and (own != node or len(ids) == PACK):
                done.append((*node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = own
            ids.append(conv)
        if done:
            yield out()
            done = []
    if ids:
        done = [(*node, ids[0], ",".join(map(str, ids)))]
        yield out()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's packs, one after the other. Rows come by node and first id."""
    node, digest = None, None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["depth", "a", "b", "ends"]
        )

    for batch in batches:
        done = []
        for *own, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
            if own != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = own, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield out(done)
    if node is not None:
        yield out([(*node, digest.hexdigest())])


def _ends(ended: DataFrame) -> DataFrame:
    """Per node (depth, a, b) the digest of the ids of conversations that end there.

    A hash goes through its input in order, so the ids of one node meet in the end; but sorted and
    joined by many tasks before, and streamed through without being held.
    """
    place = ["depth", "a", "b"]
    packs = (
        ended.repartitionByRange(*place, "conv_id")
        .sortWithinPartitions(*place, "conv_id")
        .mapInArrow(_packed, "depth long, a long, b long, first long, ids string")
    )
    return (
        materialise(packs, "trie-packs")
        .repartition(*place)
        .sortWithinPartitions(*place, "first")
        .mapInArrow(_hashed, "depth long, a long, b long, ends string")
    )


def _owned(nodes: DataFrame) -> DataFrame:
    """Per conversation and block what it owns at or below each depth: (conv_id, block, s1 to sB)."""
    value = (F.col("n_convs") - 1) * F.col("chars")
    rows = nodes.where("depth > 0").select("conv_id", "depth", value.alias("value"))
    running = carried(rows, "conv_id", [F.col("depth").desc()], {"below": F.col("value")}, "sum", "trie-owned")
    at = F.col("depth") - 1
    return running.groupBy("conv_id", F.floor(at / BLOCK).cast("long").alias("block")).agg(
        *[F.max(F.when(at % BLOCK == j, F.col("below"))).alias(f"s{j + 1}") for j in range(BLOCK)]
    )


def trie_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of conversations.

    Takes turns (conv_id, pos, turn_id), numbered from 1 without gaps, and conversations
    (conv_id, n_turns). Returns, per distinct prefix, all long but the last: conv_id (smallest
    member), depth, parent_conv_id (NULL for the root), n_convs, n_children, n_leaves,
    saved_tokens, and ends_sha256.
    """
    place, ups = ["depth", *LANES], [f"up_{x}" for x in LANES]
    blocks = _blocks(turns, convs)
    nodes = materialise(_rolled(blocks, ["min(conv_id) AS conv_id", "count(*) AS n_convs"]), "trie-nodes")
    under = nodes.where("depth > 0").select(F.expr("depth - 1 AS depth"), *[F.col(u).alias(u[3:]) for u in ups])
    children = materialise(under.groupBy(*place).agg(F.count("*").alias("n_children")), "trie-children")
    nodes = materialise(nodes.join(children, place, "left").fillna(0, ["n_children"]), "trie-nodes")

    # whole: all that a conversation owns, for depths above its own nodes
    whole = nodes.groupBy("conv_id").agg(
        F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("whole"),
        F.sum((F.col("n_children") == 0).cast("long")).alias("leaf"),
    )
    parts = blocks.join(whole, "conv_id").join(_owned(nodes), ["conv_id", "block"], "left")
    below = [F.coalesce(f"s{j}", "whole").alias(f"s{j}") for j in range(1, BLOCK + 1)]
    parts = parts.select("block", *LANES, *TURNS, "leaf", "whole", *below)
    sums = ["sum(leaf) AS n_leaves", "sum(whole) AS whole", *[f"sum(s{j}) AS s{j}" for j in range(1, BLOCK + 1)]]
    saved = F.col("whole")
    for j in range(1, BLOCK + 1):
        saved = F.when(F.col("level") == j, F.col(f"s{j}")).otherwise(saved)
    subtrees = _rolled(parts, sums).select(*place, "n_leaves", saved.alias("saved_tokens"))

    ended = blocks.join(convs, "conv_id").where(
        f"block = if(n_turns = 0, 0, (n_turns - 1) div {BLOCK})"
    )
    ends = _ends(ended.select(F.col("n_turns").alias("depth"), F.col("end_a").alias("a"), F.col("end_b").alias("b"), "conv_id"))

    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"),
        *[F.col(x).alias(f"up_{x}") for x in LANES],
        F.col("conv_id").alias("parent_conv_id"),
    )
    found = materialise(nodes.join(subtrees, place).join(ends, place, "left"), "trie-subtrees")
    return found.join(parents, ["depth", *ups], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.col("n_children").cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Trie of the conversations as they are: rows as in ``trie_nodes``.

    Takes (conv_id, turn, role, text); other columns are ignored. Turns go by turn number, NULL
    first, those of one number by the digest of role and text, so the order of rows never matters;
    repeated rows are repeated turns. NULL role or text count as empty. Rows without a conv_id
    belong to no conversation. No conversations have no nodes, not even a root. Very long texts
    are read once, for their digest; very long conversations are spread over tasks by turn.
    """
    turns = ordered_turns(conversations)
    return trie_nodes(turns, turns.groupBy("conv_id").agg(F.count("*").alias("n_turns")))


def opened_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of the conversations rebuilt by ``shared_openings``."""
    turns, convs = shared_openings(ordered_turns(conversations))
    return trie_nodes(turns, convs)
