"""Ranked lexical search by best positions.

Documents are dealt into shards of bounded size. A shard has one impact list per query term: its
documents by falling contribution of that term. A query walks the lists of its terms together. The
next unseen position of each list is read by direct access, every document met is scored at once
by looking its position up in all other lists, and those positions count as seen too. The best
position of a list is the last one up to which all are seen; no unseen document can score more
than the contributions next behind the best positions together. The walk stops when the k-th score
is strictly above that sum, so equal scores are all found and go by document id. The best of all
shards are then ranked per query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tracewell.llm.common import materialise, terms

TOP = 50
QUERY_TERMS = 4096  # different terms that one scan of the documents looks for, about
CELLS = 1 << 25  # terms times documents of a shard: its table of positions
SHARD_DOCS = 1 << 16
SHARD_POSTINGS = 1 << 21
STEP = 8  # positions read from each list before the first test of the threshold, then twice as many
SPREAD = 64  # first groups in which the shards' results of one query meet
SCORED = "item_id long, doc_id long, score long"


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Impact lists of a few documents over the terms 0 to ``n_terms`` - 1."""

    def __init__(self, ids: list[int | None], n_terms: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        # the order of equal contributions is free: the threshold holds for any
        order = np.lexsort((-impact, term))
        self.ids, self.doc, self.impact = ids, doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.place = np.full((n_terms, len(ids)), -1, dtype=np.int32)
        at = np.arange(len(order)) - self.start[term[order]]
        self.place[term[order], self.doc] = at
        self.precedence = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0))
        self.rank = np.empty(len(ids), dtype=np.int64)
        self.rank[self.precedence] = np.arange(len(ids))

    def search(self, query: np.ndarray, top: int) -> tuple[list[tuple[int, int]], int]:
        """The best (position in ids, score) for the terms ``query``, and the documents scored."""
        n_docs, width = len(self.ids), len(query)
        start, length = self.start[query], self.start[query + 1] - self.start[query]
        place = self.place[query]
        met = np.zeros(n_docs, dtype=bool)
        unseen = [np.ones(n + 1, dtype=bool) for n in length]  # one more, never seen
        best = np.zeros(width, dtype=np.int64)  # positions before it are all seen
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        scored, step = 0, STEP
        while True:
            fresh = []
            for i in range(width):  # direct access to the next positions of each list
                if best[i] < length[i]:
                    ahead = unseen[i][best[i] : min(best[i] + step, length[i])]
                    fresh.append(self.doc[start[i] + best[i] + np.flatnonzero(ahead)])
            if not fresh:
                break
            step *= 2
            new = np.unique(np.concatenate(fresh))
            new = new[~met[new]]
            met[new] = True
            scored += len(new)
            gained = np.zeros(len(new), dtype=np.int64)
            threshold = 0
            for i in range(width):  # direct access to the documents met, in all lists
                at = place[i][new]
                there = at >= 0
                at = at[there]
                gained[there] += self.impact[start[i] + at]
                unseen[i][at] = False
                best[i] += np.argmax(unseen[i][best[i] :])  # to the first one not seen
                if best[i] < length[i]:
                    threshold += int(self.impact[start[i] + best[i]])
            above = gained > 0
            docs = np.concatenate([docs, new[above]])
            scores = np.concatenate([scores, gained[above]])
            if len(docs) > top:
                keep = np.lexsort((self.rank[docs], -scores))[:top]
                docs, scores = docs[keep], scores[keep]
            if len(docs) == top and scores.min() > threshold:
                break
        order = np.lexsort((self.rank[docs], -scores))
        return [(int(docs[k]), int(scores[k])) for k in order], scored


def _counter(numbers: dict[bytes, int]) -> Callable:
    """Per document: the number of its terms, and which query terms it has how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                counts, found, often = [], [], []
                for raw in part.column(1):
                    total: Counter[bytes] = Counter()
                    for portion in terms(raw.as_py() or b""):
                        total.update(portion)
                    own = [(numbers[t], c) for t, c in total.items() if t in numbers]
                    counts.append(total.total())
                    found.append([t for t, _ in own])
                    often.append([c for _, c in own])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(counts, pa.int64()),
                        pa.array(found, pa.list_(pa.int32())),
                        pa.array(often, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_terms", "terms", "often"],
                )

    return run


def _searcher(queries: list[tuple[int | None, list[int]]], weights: list[int], n_docs: int, n_all: int, top: int) -> Callable:
    """Answer all queries on shards of the documents that a task reads."""
    n_terms = len(weights)
    most = min(SHARD_DOCS, max(1, CELLS // max(1, n_terms)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = np.array(weights, dtype=np.int64)
        asked = [(item, np.array(sorted(set(q)), dtype=np.int64)) for item, q in queries]

        def answers(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts)
            ids = rows.column("doc_id").to_pylist()
            lists = rows.column("terms").combine_chunks()
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            often = rows.column("often").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            length = [50 + 50 * n * n_docs // n_all for n in rows.column("n_terms").to_pylist()]
            doc = np.repeat(np.arange(len(ids)), size)
            m = np.repeat(np.array(length, dtype=np.int64), size)
            impact = worth[term] * ((1_000_000_000 * often) // (1000 * often + 20 * m))
            shard = Shard(ids, n_terms, doc, term, impact)
            found = [(item, *hit) for item, query in asked for hit in shard.search(query, top)[0]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([item for item, _, _ in found], pa.int64()),
                    pa.array([ids[k] for _, k, _ in found], pa.int64()),
                    pa.array([score for _, _, score in found], pa.int64()),
                ],
                ["item_id", "doc_id", "score"],
            )

        held: list[pa.RecordBatch] = []
        size = postings = 0
        for batch in batches:
            while batch.num_rows:
                ends = postings + np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
                fits = min(most - size, int(np.searchsorted(ends, SHARD_POSTINGS, side="right")))
                if not fits and held:
                    yield answers(held)
                    held, size, postings = [], 0, 0
                    continue
                part = batch.slice(0, max(1, fits))
                held.append(part)
                size, postings = size + part.num_rows, int(ends[part.num_rows - 1])
                batch = batch.slice(part.num_rows)
        if held:
            yield answers(held)

    return run


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for raw in batch.column(1):
            own: set[bytes] = set()
            for portion in terms(raw.as_py() or b""):
                own.update(portion)
            rows.append(sorted(own))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows, pa.list_(pa.binary()))], ["item_id", "terms"]
        )


def ranked_search(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best documents of each query: rows (item_id, rank, doc_id, score).

    Takes documents (doc_id, text) and queries (item_id, text). Terms are runs of ASCII letters
    (A-Z count as a-z), digits and characters beyond ASCII. A term of a query weighs
    w = floor(1000 ln((2 N + 2) / (2 df + 1))), N documents having any term and df this one; in a
    document of n terms, L in all documents, it adds w ((10^9 tf) div (1000 tf + 20 m)) with
    m = 50 + (50 n N) div L, once per query. Only scores above 0 are ranked, equal ones by
    ascending doc_id, documents without an id first.

    NULL and empty texts have no terms and are in no result. Every row is a document of its own,
    so repeated documents take as many ranks; queries with equal ids are one, of all their terms;
    queries without an id are one. Other columns are ignored. No documents or no queries give no
    rows. Counts cover all documents. Queries are worked on in blocks of about QUERY_TERMS
    different terms, each with one scan of the texts; the driver and the tasks hold one block.
    """
    asked = materialise(
        queries.selectExpr("CAST(item_id AS long) AS item_id", "CAST(text AS binary) AS text")
        .mapInArrow(_distinct_terms, "item_id long, terms array<binary>")
        .select("item_id", F.explode("terms").alias("term"))
        .distinct(),
        "search-queries",
    )
    pairs, different = asked.agg(F.count("*"), F.count_distinct("term")).first()
    blocks = 1 if different <= QUERY_TERMS else -(-pairs // QUERY_TERMS)
    texts = docs.selectExpr("CAST(doc_id AS long) AS doc_id", "CAST(text AS binary) AS text")
    best = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        answered = _search_block(texts, own.collect(), top)  # about QUERY_TERMS rows per block
        best = answered if best is None else best.union(answered)
    return best.select("item_id", "rank", "doc_id", "score")


def _search_block(texts: DataFrame, pairs: list, top: int) -> DataFrame:
    """Answers to the queries of ``pairs`` (item_id, term)."""
    words = sorted({bytes(p.term) for p in pairs})
    numbers = {t: k for k, t in enumerate(words)}
    by_item: dict[int | None, list[int]] = {}
    for p in pairs:
        by_item.setdefault(p.item_id, []).append(numbers[bytes(p.term)])
    counted = materialise(
        texts.mapInArrow(_counter(numbers), "doc_id long, n_terms long, terms array<int>, often array<long>"),
        "search-postings",
    )
    n_docs, n_all = counted.where("n_terms > 0").agg(F.count("*"), F.sum("n_terms")).first()
    df = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weights = [weight(n_docs, df.get(k, 0)) for k in range(len(words))]
    queries = sorted(by_item.items(), key=lambda q: (q[0] is not None, q[0] or 0))
    answers = counted.where("size(terms) > 0").mapInArrow(
        _searcher(queries, weights, n_docs or 0, n_all or 1, top), SCORED
    )
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    # a query's results of all shards meet in two steps, so that no task takes them all
    spread = Window.partitionBy("item_id", "part").orderBy(*order)
    first = (
        answers.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SPREAD)))
        .withColumn("rank", F.row_number().over(spread))
        .where(F.col("rank") <= top)
    )
    return first.withColumn(
        "rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    ).where(F.col("rank") <= top)
