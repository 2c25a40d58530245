"""N-gram Jaccard join with signature trees.

A document is the set of its word shingles. Equal sets are one class. Classes are hung into
trees, and each tree is joined with itself: nodes hold the OR of their documents' shingle bitmaps
and the range of their sizes, and a dual traversal from the root drops every pair of nodes whose
largest possible overlap is too small for the threshold. What reaches the leaves is compared
exactly, shingle by shingle.

Which documents share a tree is decided by minimum hashes: a class hangs in several trees, each
named by one or two minimum hashes of its shingles. Their number follows from the threshold, so
that two documents just at it miss each other in all trees with a probability of at most MISS: at
0.9 with two minima it takes 12 trees, (1 - 0.9^2)^12, at 0.8 it takes 20. More similar documents
miss each other yet more rarely. A tree that grows too large is cut by size range and hash into blocks, and all pairs
of blocks in reach of each other are traversed, so no document is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm.common import components, materialise, unused

SHINGLE = 3
PERCENT = 90
MISS = 2.5e-9  # largest probability that a pair just at the threshold shares no tree
MOST_TREES = 48  # trees of two minima; if it took more, they are named by one
BLOCK = 1024  # classes of one block; a larger tree is cut into blocks
FANOUT = 4
BITS = 1 << 29  # of all bitmaps of one unit of work
REMEMBERED = 400_000
SEED = 20_240_607


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted hashes of a text's distinct word shingles."""

    def __init__(self, width: int = SHINGLE):
        self.width, self.known = width, {}

    def _word(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[word] = xxhash.xxh64_intdigest(word)
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8").lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        h = np.fromiter(map(self._word, words), dtype=np.uint64, count=len(words))
        width = min(self.width, len(words))
        n = len(words) - width + 1
        found = np.full(n, width, dtype=np.uint64)
        for k in range(width):
            found = mix(found + h[k : k + n])
        return np.unique(found)


def tree_count(percent: int) -> tuple[int, int]:
    """How many trees a set hangs in, and how many minimum hashes name each."""
    if percent >= 100:
        return 1, 2  # equal sets share every tree
    if percent <= 0:
        raise ValueError("the threshold must be above 0 percent")
    for minima in (2, 1):
        trees = math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** minima)))
        if trees <= MOST_TREES:
            break
    return trees, minima


class TreeNames:
    """The trees that a set hangs in, one number each."""

    def __init__(self, percent: int = PERCENT):
        self.trees, self.minima = tree_count(percent)
        seeds = np.random.default_rng(SEED)
        n = self.trees * self.minima
        self.offsets = seeds.integers(0, 1 << 63, n, dtype=np.uint64)
        self.factors = seeds.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        least = np.empty(self.trees * self.minima, dtype=np.uint64)
        for k in range(len(least)):
            least[k] = ((shingles ^ self.offsets[k]) * self.factors[k]).min()
        name = np.arange(self.trees, dtype=np.uint64)
        for part in least.reshape(self.trees, self.minima).T:
            name = mix(name + part)
        return name.view(np.int64)


def _set_name(shingles: np.ndarray) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(shingles.tobytes())
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(value >> 64), signed(value & (1 << 64) - 1)


def _describe(percent: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, tree_names = Shingler(width), TreeNames(percent)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = shingle(text.as_py())
                names = tree_names(found) if len(found) else None
                rows.append((*_set_name(found), len(found), names))
            columns = list(zip(*rows)) or [()] * 4
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "set_hi", "set_lo", "n_shingles", "trees"],
            )

    return run


class Tree:
    """Nodes level by level, the documents first: OR bitmaps, size ranges, most hidden shingles."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        maps = np.zeros((len(sets), bits // 8), dtype=np.uint8)
        for row, shingles in zip(maps, sets):
            place = (shingles & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(row, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
        size = np.array([len(s) for s in sets], dtype=np.int64)
        maps = maps.view(np.uint64)
        # shingles that share a bit with another one of their document
        hidden = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, size, size, hidden)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, hidden = self.levels[-1]
            at = np.arange(0, len(maps), FANOUT)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(maps, at, axis=0),
                    np.minimum.reduceat(low, at),
                    np.maximum.reduceat(high, at),
                    np.maximum.reduceat(hidden, at),
                )
            )


def possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes (i of a, j of b) may hold a pair at the threshold.

    No two documents share more shingles than their nodes share bits, and those hidden behind
    shared bits; a Jaccard of p percent needs p / (100 + p) of both sizes together.
    """
    maps_a, low_a, high_a, hidden_a = a
    maps_b, low_b, high_b, hidden_b = b
    fits = (100 * high_a[i] >= percent * low_b[j]) & (100 * high_b[j] >= percent * low_a[i])
    keep = np.flatnonzero(fits)
    step = max(1, (1 << 22) // max(1, maps_a.shape[1]))
    for at in range(0, len(keep), step):
        k = keep[at : at + step]
        shared = np.bitwise_count(maps_a[i[k]] & maps_b[j[k]]).sum(axis=1, dtype=np.int64)
        most = np.minimum(shared + np.minimum(hidden_a[i[k]], hidden_b[j[k]]), np.minimum(high_a[i[k]], high_b[j[k]]))
        fits[k] = (100 + percent) * most >= percent * (low_a[i[k]] + low_b[j[k]])
    return fits


def _children(nodes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Children below each node, and whose they are; ``n`` nodes exist on their level."""
    child = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    owner = np.repeat(np.arange(len(nodes)), FANOUT)
    return child[child < n], owner[child < n]


def traverse(a: Tree, b: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of documents that the bounds leave, in portions. With ``a is b``, i < j only."""
    same = a is b
    depth = max(len(a.levels), len(b.levels)) - 1
    level = lambda t, d: t.levels[min(d, len(t.levels) - 1)]
    stack = [(depth, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        d, i, j = stack.pop()
        fits = possible(level(a, d), level(b, d), i, j, percent)
        i, j = i[fits], j[fits]
        if not len(i):
            continue
        if d == 0:
            yield (i[i < j], j[i < j]) if same else (i, j)
            continue
        for at in range(0, len(i), 4096):
            pi, pj = i[at : at + 4096], j[at : at + 4096]
            if d < len(a.levels):
                ci, owner = _children(pi, len(a.levels[d - 1][0]))
                pi, pj = ci, pj[owner]
            if d < len(b.levels):
                cj, owner = _children(pj, len(b.levels[d - 1][0]))
                pi, pj = pi[owner], cj
            if same:
                pi, pj = pi[pi <= pj], pj[pi <= pj]
            stack.append((d - 1, pi, pj))


class Forest:
    """Disjoint sets over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links between documents at the threshold, as many as it takes to connect all that belong
    together. Numbers of the right side go on from those of the left one; no right side: itself."""
    every = left + (right or [])
    most = max(len(s) for s in every)
    bits = max(64, 1 << int(4 * most - 1).bit_length())
    while bits > 64 and bits * len(every) > BITS:
        bits //= 2  # a looser bound, and the same links
    order_a = sorted(range(len(left)), key=lambda k: len(left[k]))
    a = Tree([left[k] for k in order_a], bits)
    if right is None:
        b, order_b = a, order_a
    else:
        order_b = sorted(range(len(right)), key=lambda k: len(right[k]))
        b = Tree([right[k] for k in order_b], bits)
        order_b = [k + len(left) for k in order_b]
    forest, found = Forest(len(every)), []
    for i, j in traverse(a, b, percent):
        for x, y in zip(i.tolist(), j.tolist()):
            x, y = order_a[x], order_b[y]
            if forest.root(x) == forest.root(y):
                continue  # connected already, so this pair decides nothing
            common = len(np.intersect1d(every[x], every[y], assume_unique=True))
            if 100 * common >= percent * (len(every[x]) + len(every[y]) - common):
                forest.join(x, y)
                found.append((x, y))
    return found


def _join_unit(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids, sides = table.column("rep").to_pylist(), table.column("side").to_pylist()
        raw = table.column("shingles").to_pylist()
        sets = [np.frombuffer(x, dtype="<u8") for x in raw]
        order = sorted(range(len(ids)), key=lambda k: (sides[k], ids[k]))
        ids, sides, sets = ([x[k] for k in order] for x in (ids, sides, sets))
        cut = sides.count(0)
        if cut == 0 or (cut == len(ids) and sides and table.column("crossed")[0].as_py()):
            found = []  # one side of a pair of blocks alone
        else:
            found = links(sets[:cut], sets[cut:] or None, percent)
        return pa.table(
            {
                "a": pa.array([ids[x] for x, _ in found], pa.int64()),
                "b": pa.array([ids[y] for _, y in found], pa.int64()),
            }
        )

    return run


def _units(members: DataFrame, percent: int) -> DataFrame:
    """Deal the members (tree, size, rep, n) of trees to units of work: + unit, side, crossed.

    A small tree is one unit. A larger one is cut by size range, so that documents in reach of
    each other are in the same or in neighbouring ranges, and by hash into blocks; each pair of
    blocks of the same or neighbouring ranges is a unit.
    """
    small = members.where(F.col("size") <= BLOCK).select(
        "rep", F.struct("tree", *[F.lit(0).alias(c) for c in ("r", "x", "y")]).alias("unit"),
        F.lit(0).alias("side"), F.lit(False).alias("crossed"),
    )
    large = members.where(F.col("size") > BLOCK).withColumn(
        "r", F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    )
    ranges = materialise(
        large.groupBy("tree", "r").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")),
        "join-ranges",
    )
    own = ranges.select("tree", "r", "blocks")
    above = ranges.select("tree", (F.col("r") - 1).alias("r"), F.col("blocks").alias("above"))
    below = ranges.select("tree", (F.col("r") + 1).alias("r"), F.col("blocks").alias("below"))
    plan = own.join(above, ["tree", "r"], "left").join(below, ["tree", "r"], "left")
    placed = large.join(materialise(plan, "join-plan"), ["tree", "r"]).withColumn(
        "x", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    )

    def pairs(first: Column, last: Column, unit: Column) -> Column:
        listed = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(listed, lambda k: unit(k))

    def cell(r: Column, x: Column, y: Column, side: Column, crossed: Column) -> Column:
        return F.struct(
            F.struct("tree", r.cast("int").alias("r"), x.cast("int").alias("x"), y.cast("int").alias("y")).alias("unit"),
            side.cast("int").alias("side"),
            crossed.alias("crossed"),
        )

    r, x, yes, no, zero, one = F.col("r"), F.col("x"), F.lit(True), F.lit(False), F.lit(0), F.lit(1)
    # inside a range: y = x is a block with itself; neighbouring ranges: x of r, y of r + 1,
    # told apart from the former by a negative second number
    inside_low = pairs(zero, x - 1, lambda k: cell(r, k, x, one, yes))
    inside = F.array(cell(r, x, x, zero, no))
    inside_high = pairs(x + 1, F.col("blocks") - 1, lambda k: cell(r, x, k, zero, yes))
    upward = pairs(zero, F.coalesce("above", zero) - 1, lambda k: cell(r, x, -1 - k, zero, yes))
    downward = pairs(zero, F.coalesce("below", zero) - 1, lambda k: cell(r - 1, k, -1 - x, one, yes))
    cells = F.concat(inside_low, inside, inside_high, upward, downward)
    return small.unionByName(placed.select("rep", F.inline(cells)))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """Documents with the smallest doc_id that links lead to: (doc_id, n_shingles, component_id).

    Takes (doc_id, text); other columns are ignored. Words are lower-cased (A-Z) and end at ASCII
    white space; a text of fewer words than ``width`` is one shingle; a NULL, empty or blank text
    has none and links with nothing. Two documents link when percent or more of their shingles
    are common. One row out per row in. A row without an id takes no part and has no component.
    Repeated rows are of one class. No rows give no rows.
    """
    rows = docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text")
    described = materialise(
        rows.mapInArrow(
            _describe(percent, width),
            "doc_id long, set_hi long, set_lo long, n_shingles long, trees array<long>",
        ),
        "join-sets",
    )
    classes = materialise(
        described.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_hi", "set_lo")
        .agg(
            F.min("doc_id").alias("rep"),
            F.first("n_shingles").alias("n"),
            F.first("trees").alias("trees"),
        ),
        "join-classes",
    )
    hung = classes.select("rep", "n", F.explode("trees").alias("tree"))
    trees = (
        hung.groupBy("tree")
        .agg(
            F.count("*").alias("size"),
            F.bit_xor(F.xxhash64("rep")).alias("x"),
            F.sum(F.xxhash64(F.lit(1), "rep") % (1 << 40)).alias("s"),
        )
        .where("size > 1")
        .groupBy("size", "x", "s")  # of trees with the same classes, one is enough
        .agg(F.min("tree").alias("tree"))
    )
    members = materialise(hung.join(materialise(trees, "join-trees"), "tree"), "join-members")
    units = materialise(
        _units(members, percent).groupBy("rep").agg(F.collect_list(F.struct("unit", "side", "crossed")).alias("units")),
        "join-units",
    )
    # dealt by id at every size: how many texts have company grows with the corpus
    wanted = rows.join(units.hint("merge"), F.col("doc_id") == F.col("rep")).select("rep", "text", "units")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            found = [shingle(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.binary()), batch.column(2)],
                ["rep", "shingles", "units"],
            )

    kind = units.schema["units"].dataType.simpleString()
    edges = (
        wanted.mapInArrow(sets, f"rep long, shingles binary, units {kind}")
        .where("length(shingles) > 0")
        .select("rep", "shingles", F.inline("units"))
        .groupBy("unit")
        .applyInArrow(_join_unit(percent), "a long, b long")
    )
    found = components(edges, "join")
    named = materialise(
        classes.join(found, F.col("rep") == F.col("node"), "left").select(
            "set_hi", "set_lo", F.coalesce("component", "rep").alias("component_id")
        ),
        "join-named",
    )
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return described.join(named, ["set_hi", "set_lo"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id")
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose id names its component; rows without an id stay.

    Components are those of :func:`jaccard_components` with the same ``percent`` and ``width``.
    """
    (name,) = unused(docs, "gone")
    gone = jaccard_components(docs, percent, width).where("component_id < doc_id").select(F.col("doc_id").alias(name))
    gone = gone.distinct().hint("merge")  # grows with the corpus
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
