"""Embedding near-duplicates with a robust-pruned flat graph.

Vectors of one label are clustered on a bounded sample. Each vector belongs to the cell of its
nearest centroid and, for the index, also to every cell whose centroid is nearly as near. In each
cell a graph is built: vectors are inserted in batches by greedy search, and each keeps diverse
neighbours only (robust pruning). A vector's adjacency lists from all of its cells are united.
Every vector is then looked up in its home cell by a greedy search from the cell's medoid, which
goes on to expand whatever lies within range until nothing new is found. All links are verified
in double precision. A task tells which of its vectors belong together, one row each, instead of
all their links; these make components, and inside a component links are counted block by block,
so what is written grows with the vectors and never with the square of a cluster. Recall is audited
against brute force on a bounded sample; while it is
too low, the search is repeated with wider beams and more overlap, and at last without graphs: then
every cell holds all vectors that may link with its own, and they are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.llm.common import components, materialise

THRESHOLD = 0.98
CELL_ROWS = 1_000  # vectors of a cell aimed at
MOST_CENTROIDS = 64  # per label; cells that stay larger than a block are cut into blocks
SAMPLE_PER_CENTROID = 32
BLOCK_ROWS = 4_096
SALT_ROWS = 8_192
DEGREE = 16
BEAM = 32
MARGIN = 0.12  # how much farther a centroid may be, in cosine, for its cell to index a vector
ALPHA = 1.2
RANGE_SLACK = 0.05  # vectors this much below the threshold are still expanded
BATCH = 256
AUDIT_ROWS = 256  # vectors of all, and as many with a link, that the audit looks up by brute force
RECALL = 0.95
ROUNDS = 3


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cluster(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of a sample; starts from rows that are far apart."""
    chosen = [0]
    nearest = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            total = x[near == c].sum(axis=0)
            if (length := np.linalg.norm(total)) > 0:
                centres[c] = total / length
    return centres


class Graph:
    """Adjacency of a block of vectors, padded with -1."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM):
        self.x, self.degree, self.beam = x, degree, beam
        self.room = degree * 2
        self.adjacent = np.full((len(x), self.room), -1, dtype=np.int64)
        self.filled = np.zeros(len(x), dtype=np.int64)
        self.medoid = int((x @ x.mean(axis=0)).argmax())

    @classmethod
    def of_lists(cls, x: np.ndarray, lists: list[np.ndarray], beam: int) -> Graph:
        graph = cls(x, beam=beam)
        widest = max([1, *map(len, lists)])
        graph.adjacent = np.full((len(x), widest), -1, dtype=np.int64)
        for row, found in zip(graph.adjacent, lists):
            row[: len(found)] = found
        # for the expansion an edge leads both ways, so that no vector is without a way in
        tail, head = np.nonzero(graph.adjacent >= 0)[0], graph.adjacent[graph.adjacent >= 0]
        edges = np.unique(np.concatenate([tail * len(x) + head, head * len(x) + tail]))
        graph.head = edges % len(x)
        graph.first = np.searchsorted(edges, np.arange(len(x) + 1) * len(x))
        return graph

    def around(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours of ``nodes``, edges taken both ways, and whose they are."""
        count = self.first[nodes + 1] - self.first[nodes]
        owner = np.repeat(np.arange(len(nodes)), count)
        skip = np.cumsum(count) - count
        return owner, self.head[np.arange(len(owner)) - skip[owner] + self.first[nodes][owner]]

    def search(
        self, queries: np.ndarray, starts: np.ndarray, at_least: float = np.inf
    ) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Greedy beam search for all queries at once.

        Returns the beams' ids, what was seen, and all (query, node, cosine) with a cosine of
        ``at_least`` that were met on the way, those that fell out of the beam included.
        """
        n, rows = len(queries), np.arange(len(queries))[:, None]
        seen = np.zeros((n, len(self.x)), dtype=bool)
        ids = np.full((n, self.beam), -1, dtype=np.int64)
        near = np.full((n, self.beam), -np.inf)
        done = np.zeros((n, self.beam), dtype=bool)
        width = starts.shape[1]
        ids[:, :width], near[:, :width] = starts, np.einsum("bsd,bd->bs", self.x[starts], queries)
        same = (starts[:, 1:] == starts[:, :-1]) if width > 1 else np.zeros((n, 0), dtype=bool)
        near[:, 1:width][same] = -np.inf
        seen[rows, starts] = True
        q, k = np.nonzero(near >= at_least)
        met = [(q, ids[q, k], near[q, k])]
        while True:
            open_ = np.where(done | np.isinf(near), -np.inf, near)
            pick = open_.argmax(axis=1)
            live = np.flatnonzero(open_[rows[:, 0], pick] > -np.inf)
            if not len(live):
                return ids, seen, met
            done[live, pick[live]] = True
            next_ = self.adjacent[ids[live, pick[live]]]
            fresh = (next_ >= 0) & ~seen[live[:, None], next_]
            seen[live[:, None], np.where(fresh, next_, ids[live, pick[live]][:, None])] = True
            cosine = np.einsum("brd,bd->br", self.x[next_], queries[live])
            cosine[~fresh] = -np.inf
            q, k = np.nonzero(cosine >= at_least)
            met.append((live[q], next_[q, k], cosine[q, k]))
            all_near = np.concatenate([near[live], cosine], axis=1)
            best = np.argpartition(-all_near, self.beam - 1, axis=1)[:, : self.beam]
            ids[live] = np.take_along_axis(np.concatenate([ids[live], next_], axis=1), best, axis=1)
            flags = np.concatenate([done[live], np.zeros(next_.shape, dtype=bool)], axis=1)
            done[live] = np.take_along_axis(flags, best, axis=1)
            near[live] = np.take_along_axis(all_near, best, axis=1)

    def within(self, queries: np.ndarray, starts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) at the threshold: those met, then all that expanding them leads to."""
        _, seen, met = self.search(queries, starts, threshold - RANGE_SLACK)
        q, node, cosine = (np.concatenate([m[k] for m in met]) for k in range(3))
        found = [(q[cosine >= threshold], node[cosine >= threshold])]
        while len(q):
            more_q, more_node = [], []
            for part in range(0, len(q), 4096):
                owner, next_ = self.around(node[part : part + 4096])
                pq = q[part : part + 4096][owner]
                pairs = np.unique((pq * len(self.x) + next_)[~seen[pq, next_]])
                fq, fn = pairs // len(self.x), pairs % len(self.x)
                seen[fq, fn] = True
                cosine = np.concatenate(
                    [np.empty(0)]
                    + [
                        np.einsum("pd,pd->p", self.x[fn[k : k + 65536]], queries[fq[k : k + 65536]])
                        for k in range(0, len(fn), 65536)
                    ]
                )
                hit = cosine >= threshold
                found.append((fq[hit], fn[hit]))
                go = cosine >= threshold - RANGE_SLACK
                more_q.append(fq[go])
                more_node.append(fn[go])
            q, node = np.concatenate(more_q), np.concatenate(more_node)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def pruned(self, p: int, candidates: np.ndarray, alpha: float) -> np.ndarray:
        """Robust pruning: nearest first, and none that a chosen one is much nearer to."""
        candidates = np.unique(candidates[(candidates >= 0) & (candidates != p)])
        if len(candidates) <= 1:
            return candidates
        v = self.x[candidates]
        far = 1.0 - v @ self.x[p]
        between = 1.0 - v @ v.T
        live, chosen = np.ones(len(candidates), dtype=bool), []
        for k in np.argsort(far, kind="stable"):
            if not live[k]:
                continue
            chosen.append(k)
            if len(chosen) == self.degree:
                break
            live &= alpha * between[k] > far
        return candidates[chosen]

    def _set(self, p: int, neighbours: np.ndarray) -> None:
        self.adjacent[p] = -1
        self.adjacent[p, : len(neighbours)] = neighbours
        self.filled[p] = len(neighbours)

    def build(self) -> Graph:
        """Insert all vectors twice; the second time they find those of their own batch as well."""
        order = np.random.default_rng(len(self.x)).permutation(len(self.x))
        order = np.concatenate([[self.medoid], order[order != self.medoid]])
        for alpha in (1.0, ALPHA):
            at, size = 1, 1
            while at < len(order):
                batch = order[at : at + size]
                starts = np.full((len(batch), 1), self.medoid, dtype=np.int64)
                ids, _, _ = self.search(self.x[batch], starts)
                for p, found in zip(batch.tolist(), ids):
                    self._set(p, self.pruned(p, np.concatenate([found, self.adjacent[p]]), alpha))
                for p in batch.tolist():
                    for v in self.adjacent[p, : self.filled[p]].tolist():
                        if p in self.adjacent[v, : self.filled[v]]:
                            continue
                        if self.filled[v] == self.room:
                            self._set(v, self.pruned(v, np.append(self.adjacent[v], p), alpha))
                        else:
                            self.adjacent[v, self.filled[v]] = p
                            self.filled[v] += 1
                at, size = at + len(batch), min(size * 2, BATCH)
        return self


def _vectors(table: pa.Table) -> np.ndarray:
    return unit(table.column("vec").to_pylist())


def _assign(margin: float, angle: float | None):
    """Cells of each vector: those nearly as near as the nearest one.

    With an ``angle``, all whose centroid is at most that much farther in angle. Two vectors whose
    angle is A have nearest centroids at most A apart in distance, so an angle of 2 A puts every
    vector into the home cell of each vector that it may link with.
    """

    def run(members: pa.Table, centres: pa.Table) -> pa.Table:
        if members.num_rows == 0 or centres.num_rows == 0:
            return pa.table({c: pa.array([], k) for c, k in (("rep", pa.int64()), ("cell", pa.int32()), ("home", pa.bool_()))})
        near = _vectors(members) @ np.array(centres.column("centre").to_pylist(), dtype=np.float64).T
        if angle is None:
            inside = near >= near.max(axis=1, keepdims=True) - margin
        else:
            away = np.arccos(np.clip(near, -1.0, 1.0))
            inside = away <= away.min(axis=1, keepdims=True) + angle
        row, k = np.nonzero(inside)
        reps = np.array(members.column("rep").to_pylist(), dtype=np.int64)
        cells = np.array(centres.column("cell").to_pylist(), dtype=np.int32)
        return pa.table(
            {
                "rep": pa.array(reps[row]),
                "cell": pa.array(cells[k]),
                "home": pa.array(near.argmax(axis=1)[row] == k),
            }
        )

    return run


def _centres(table: pa.Table) -> pa.Table:
    order = np.argsort(np.array(table.column("rep").to_pylist(), dtype=np.int64))
    x = _vectors(table)[order]
    centres = cluster(x, table.column("k")[0].as_py())
    first = table.slice(0, 1)
    n = len(centres)
    return pa.table(
        {
            "space": pa.array([first.column("space")[0].as_py()] * n, table.schema.field("space").type),
            "cell": pa.array(range(n), pa.int32()),
            "centre": pa.array(centres.tolist(), pa.list_(pa.float64())),
        }
    )


def _build(beam: int):
    def run(table: pa.Table) -> pa.Table:
        x = _vectors(table)
        reps = np.array(table.column("rep").to_pylist(), dtype=np.int64)
        order = np.argsort(reps)
        graph = Graph(x[order], beam=beam).build()
        reps = reps[order]
        lists = [reps[row[:k]].tolist() for row, k in zip(graph.adjacent, graph.filled)]
        return pa.table({"rep": pa.array(reps), "near": pa.array(lists, pa.list_(pa.int64()))})

    return run


def _reach(x: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows reach the threshold, a bounded number of them at a time."""
    parts = [
        np.einsum("pd,pd->p", x[i[k : k + 65536]], x[j[k : k + 65536]]) >= threshold
        for k in range(0, len(i), 65536)
    ]
    return np.concatenate([np.zeros(0, dtype=bool), *parts])


def _alike(x: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether rows ``i`` and ``j`` reach the threshold, each with each; close cases are summed pair by pair."""
    cosine = x[i] @ x[j].T
    near = cosine >= threshold
    p, q = np.nonzero(np.abs(cosine - threshold) < 1e-9)
    near[p, q] = _reach(x, i[p], j[q], threshold)
    return near


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the sets of ``a[k]`` and ``b[k]`` are united; a set's label is its smallest member."""
    while True:
        while (label[label] != label).any():
            label = label[label]
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        if not apart.any():
            return label
        label[high[apart]] = low[apart]  # of several for one set the last stays, the others come again


def _search(beam: int, threshold: float, exact: bool):
    """Rows (a, b): a vector that links with others of the task, and the smallest one it is joined to."""

    def run(table: pa.Table) -> pa.Table:
        member = np.array(table.column("member").to_pylist(), dtype=bool)
        home = np.array(table.column("home").to_pylist(), dtype=bool)
        x = _vectors(table)
        reps = np.array(table.column("rep").to_pylist(), dtype=np.int64)
        near = table.column("near").to_pylist()
        inside = np.flatnonzero(member)
        inside = inside[np.argsort(reps[inside])]
        place = {r: k for k, r in enumerate(reps[inside].tolist())}
        lists = [
            np.array([place[r] for r in sorted(set(near[i] or ())) if r in place], dtype=np.int64)
            for i in inside.tolist()
        ]
        asked = np.flatnonzero(home)
        names, name = np.unique(reps, return_inverse=True)
        label = np.arange(len(names))
        graph = Graph.of_lists(x[inside], lists, beam) if len(inside) and len(asked) and not exact else None
        for at in range(0, len(asked) if len(inside) else 0, BATCH):
            q = asked[at : at + BATCH]
            if graph is None:
                i, j = np.nonzero(_alike(x, q, inside, threshold))
            else:
                # from the medoid, and from the query's own place where it is indexed here
                own = np.array([place.get(r, graph.medoid) for r in reps[q].tolist()])
                starts = np.stack([np.full(len(q), graph.medoid), own], axis=1)
                i, j = graph.within(x[q], starts, threshold)
                real = _reach(x, q[i], inside[j], threshold)
                i, j = i[real], j[real]
            label = merged(label, name[q[i]], name[inside[j]])
        joined = np.flatnonzero(label != np.arange(len(names)))
        return pa.table({"a": pa.array(names[joined]), "b": pa.array(names[label[joined]])})

    return run


def _count(threshold: float):
    """Links of the asked vectors with the indexed ones of their component, copies counted."""

    def run(table: pa.Table) -> pa.Table:
        asks, indexed = (np.array(table.column(c).to_pylist(), dtype=bool) for c in ("asks", "indexed"))
        component, rep, m = (np.array(table.column(c).to_pylist(), dtype=np.int64) for c in ("component", "rep", "m"))
        x = _vectors(table)
        links = np.zeros(len(rep), dtype=np.int64)
        order = np.argsort(component, kind="stable")
        _, first = np.unique(component[order], return_index=True)
        for part in np.split(order, first[1:]):
            asked, inside = part[asks[part]], part[indexed[part]]
            for at in range(0, len(asked), BATCH):
                q = asked[at : at + BATCH]
                near = _alike(x, q, inside, threshold) & (rep[q][:, None] != rep[inside][None, :])
                links[q] = near @ m[inside]
        return pa.table({"rep": pa.array(rep[asks]), "links": pa.array(links[asks])})

    return run


def _counted(classes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """Rows (rep, component, links) of the vectors that ``edges`` join.

    Vectors link only inside a component. Many small components share a group; a component of more
    than a block is cut into blocks, which meet pairwise, so that no task holds more than two.
    """
    found = components(edges, "graph")
    rows = materialise(
        classes.join(found, F.col("rep") == F.col("node")).select("component", "rep", "vec", "m"), "graph-members"
    )
    sizes = materialise(
        rows.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")), "graph-sizes"
    )
    groups = max(1, -(-rows.count() // BLOCK_ROWS))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    owned = rows.join(sizes, "component").withColumn("own", own).withColumn("other", every)
    one = owned.select(
        "component", "rep", "vec", "m", "blocks", F.col("own").alias("block"), F.col("other").alias("asked"),
        F.lit(True).alias("indexed"), (F.col("own") == F.col("other")).alias("asks"),
    )
    two = owned.where("own <> other").select(
        "component", "rep", "vec", "m", "blocks", F.col("other").alias("block"), F.col("own").alias("asked"),
        F.lit(False).alias("indexed"), F.lit(True).alias("asks"),
    )
    small = F.col("blocks") == 1
    placed = one.union(two).select(
        F.when(~small, F.col("component")).alias("large"),
        F.when(small, F.pmod(F.xxhash64("component"), F.lit(groups)).cast("int")).otherwise(F.col("block")).alias("block"),
        "asked", "component", "rep", "vec", "m", "indexed", "asks",
    )
    links = (
        placed.groupBy("large", "block", "asked").applyInArrow(_count(threshold), "rep long, links long")
        .groupBy("rep").agg(F.sum("links").alias("links"))
    )
    return materialise(rows.select("rep", "component").join(links, "rep"), "graph-links")


def _classes(vectors: DataFrame) -> DataFrame:
    """One row per different vector of a label: its smallest id and how many rows have it."""
    x = F.col("embedding")
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(x, lambda v: v != 0)
    )
    return materialise(
        vectors.where(usable)
        .groupBy("label", "embedding")
        .agg(F.min(F.col("vec_id").cast("long")).alias("rep"), F.count("*").alias("m"))
        .withColumn("space", F.struct("label", F.size("embedding").alias("dim")))
        .withColumnRenamed("embedding", "vec"),
        "graph-classes",
    )


def _linked(
    classes: DataFrame, spaces: DataFrame, threshold: float, beam: int, margin: float, exact: bool = False
) -> DataFrame:
    """Rows (rep, component, links) of the vectors that link with others; ``exact`` uses no graphs."""
    angle = 2 * float(np.arccos(min(threshold, 1.0))) + 1e-6 if exact else None
    sample = classes.join(spaces, "space").where(
        F.pmod(F.xxhash64("rep"), F.col("n")) < F.col("k") * SAMPLE_PER_CENTROID
    )
    space = classes.schema["space"].dataType.simpleString()
    centres = materialise(
        sample.select("space", "rep", "vec", "k").groupBy("space").applyInArrow(
            _centres, f"space {space}, cell int, centre array<double>"
        ),
        "graph-centres",
    )
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    salted = classes.join(spaces, "space").withColumn("salt", F.pmod(F.xxhash64("rep"), salts).cast("int"))
    spread = centres.join(spaces, "space").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    assigned = materialise(
        salted.select("space", "salt", "rep", "vec").groupBy("space", "salt")
        .cogroup(spread.select("space", "salt", "cell", "centre").groupBy("space", "salt"))
        .applyInArrow(_assign(margin, angle), "rep long, cell int, home boolean")
        .join(classes.select("rep", "space"), "rep"),
        "graph-assigned",
    )
    blocks = materialise(
        assigned.groupBy("space", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")),
        "graph-blocks",
    )
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    # a cell's index blocks and its blocks of queries meet pairwise, so that no task holds more
    # than two blocks; a vector is indexed in its own block and, at home, asked for in all
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    owned = assigned.join(blocks, ["space", "cell"]).withColumn("own", own)
    indexed = owned.withColumn("asked", every).select(
        "rep", "space", "cell", F.col("own").alias("block"), "asked", F.lit(True).alias("member"),
        (F.col("home") & (F.col("own") == F.col("asked"))).alias("home"),
    )
    queried = owned.where("home").withColumn("block", every).where("block <> own").select(
        "rep", "space", "cell", "block", F.col("own").alias("asked"), F.lit(False).alias("member"), "home"
    )
    placed = materialise(
        indexed.union(queried).join(classes.select("rep", "vec"), "rep"), "graph-placed"
    )
    keys = ["space", "cell", "block"]
    if exact:
        ready = placed.withColumn("near", F.lit(None).cast("array<long>"))
    else:
        adjacency = materialise(
            placed.where("member AND asked = block").select(*keys, "rep", "vec").groupBy(*keys)
            .applyInArrow(_build(beam), "rep long, near array<long>")
            .groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")),
            "graph-adjacency",
        )
        ready = placed.join(adjacency, "rep", "left")
    edges = ready.select(*keys, "asked", "rep", "vec", "member", "home", "near").groupBy(*keys, "asked").applyInArrow(
        _search(beam, threshold, exact), "a long, b long"
    )
    return _counted(classes, edges, threshold)


def audit(classes: DataFrame, linked: DataFrame, threshold: float, rows: int = AUDIT_ROWS) -> float | None:
    """Share of a vector's true links that were found, averaged over audited vectors that have any.

    Audited are ``rows`` vectors of all and ``rows`` of those with a link found, each compared with
    all of its label. Copies of a vector count once, and each vector as much as any other, so
    isolated pairs weigh no less than large clusters. None when no audited vector has a link.
    """
    drawn = [F.xxhash64(F.lit(3), "rep"), F.col("rep")]
    told = linked.select("rep").orderBy(*drawn).limit(rows)
    chosen = classes.select("rep").orderBy(*drawn).limit(rows).union(told).distinct()
    asked = classes.join(F.broadcast(chosen), "rep").select("space", "rep", "vec").collect()
    by_space: dict[tuple, list] = {}
    for r in asked:
        by_space.setdefault(tuple(r.space), []).append(r)
    queries = {s: (np.array([r.rep for r in rs]), unit([r.vec for r in rs])) for s, rs in by_space.items()}

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            spaces = [tuple(s.values()) for s in table.column("space").to_pylist()]
            for space, (ids, q) in queries.items():
                rows_ = np.flatnonzero([s == space for s in spaces])
                if not len(rows_):
                    continue
                part = table.take(pa.array(rows_))
                hit = (q @ _vectors(part).T) >= threshold
                reps = np.array(part.column("rep").to_pylist())
                hit &= ids[:, None] != reps[None, :]
                for i, n in zip(ids.tolist(), (hit * np.array(part.column("m").to_pylist())).sum(axis=1).tolist()):
                    total[i] = total.get(i, 0) + n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["rep", "n"]
        )

    true = classes.select("space", "rep", "vec", "m").mapInArrow(brute, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    share = F.least(F.coalesce("links", F.lit(0)) / F.col("n"), F.lit(1.0))
    return true.where("n > 0").join(linked, "rep", "left").agg(F.avg(share)).first()[0]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links and components of near-equal vectors of equal label.

    Takes (vec_id, embedding, label). Returns one row per input row: vec_id, n_links (other rows
    linked directly), component_id (smallest vec_id that links lead to), kept (whether that is the
    row's own id), audited_recall (of the audit's sample; the same in all rows, NULL when no audited
    vector has a link). Where the audit stays too low, links come from an exact search. A vector that is
    NULL, empty, zero, or holds a NULL or non-finite number, and one with a NULL label, links with
    nothing; nor does a vector with one of another length. Equal vectors are indexed once and
    count as often as they occur. A row without an id has no links and no component, and is kept.
    Other columns are ignored. No rows give no rows.
    """
    classes = _classes(vectors)
    spaces = materialise(
        classes.groupBy("space").agg(F.count("*").alias("n")).withColumn(
            "k", F.least(F.ceil(F.col("n") / CELL_ROWS), F.lit(MOST_CENTROIDS)).cast("int")
        ),
        "graph-spaces",
    )
    beam, margin = BEAM, MARGIN
    for _ in range(ROUNDS):
        linked = _linked(classes, spaces, threshold, beam, margin)
        recall = audit(classes, linked, threshold)
        if recall is None or recall >= RECALL:
            break
        beam, margin = beam * 2, margin * 1.5
    else:
        linked = _linked(classes, spaces, threshold, beam, margin, exact=True)
        recall = audit(classes, linked, threshold)
    named = materialise(
        classes.select("label", "vec", "rep", "m")
        .join(linked, "rep", "left")
        .select(
            F.col("label").alias("_label"), F.col("vec").alias("_vec"),
            (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("_links"),
            F.coalesce("component", "rep").alias("_component"),
        ),
        "graph-named",
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("_component", "vec_id"))
    return rows.join(
        named, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_vec")), "left"
    ).select(
        "vec_id",
        F.when(F.col("vec_id").isNotNull(), F.coalesce("_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
        F.lit(recall).cast("double").alias("audited_recall"),
    )
