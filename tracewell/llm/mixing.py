"""Mixing sources to target weights by pivotal dependent rounding.

A source's rate is its target over its size, in words. Each document gets the whole part of the
rate as copies, and one more with the fractional part as probability. The fractions are rounded
dependently: two documents exchange probability, weighted by their sizes so that the expected
words of the pair stay the same, until one of them is 0 or 1; the other goes on to the next
document. Each bucket of a source ends with at most one open fraction, and the open ones meet in
a tree of buckets, so that a source's words differ from its target by less than one document. The
last open document is settled by a draw; the words this adds or takes are made up for by shorter
settled documents, so the difference that stays is about the shortest document of the last bucket.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.llm.common import materialise, numbered, unused, word_count

BUCKET_ROWS = 4096
FAN_IN = 256
SOLID = 1e-12
SLICE = 1024  # rows with equal id and size that share a bucket
ROUNDED = "rank long, buckets long, bucket long, key long, doc_id long, size long, p double, extra int"


def source_targets(sources: DataFrame, cap: float = 3.0, label: str = "mix") -> DataFrame:
    """Add ``weight`` and ``target`` to sources (source, source_size).

    Sources weigh 1, 2, 3, repeating in code-point order, NULL last, and share all words by
    weight. A target stops at ``cap`` times the source's size; what is above is shared again by
    weight among the others, which comes to one common level per weight for all of these.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranked = numbered(sources, order, "rank", f"{label}-ranks").withColumn(
        "weight", (F.col("rank") % 3 + 1).cast("double")
    )
    total, level = ranked.agg(F.sum("source_size"), F.sum("source_size") / F.sum("weight")).first()
    while total:
        full = F.col("source_size") * cap <= F.col("weight") * level
        capped, free = ranked.agg(
            F.sum(F.when(full, F.col("source_size") * cap)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        again = (total - (capped or 0.0)) / free if free else level
        if not free or again <= level:
            break
        level = again
    return ranked.withColumn(
        "target", F.least(F.col("source_size") * cap, F.col("weight") * (level or 0.0))
    )


def exchange(p: float, size: int, q: float, other: int, draw: float) -> tuple[float, float]:
    """Move probability between two documents until one is whole; expected words are kept."""
    up = min((1 - p) * size, q * other)
    down = min(p * size, (1 - q) * other)
    if draw * (up + down) < down:
        return p + up / size, q - up / other
    return p - down / size, q + down / other


def _whole(p: float) -> int | None:
    return 0 if p <= SOLID else 1 if p >= 1 - SOLID else None


def _round_bucket(key: tuple, rows: pd.DataFrame, seed: str, last: bool) -> pd.DataFrame:
    rows = rows.sort_values(["size", "key", "doc_id"], ascending=[False, True, True], ignore_index=True)
    rng = random.Random(f"{seed}:{key[0]}:{key[1]}")
    p, size = rows["p"].tolist(), rows["size"].tolist()
    extra = [_whole(x) for x in p]
    held = None
    for i, done in enumerate(extra):
        if done is not None:
            continue
        if held is None:
            held = i
            continue
        p[held], p[i] = exchange(p[held], size[held], p[i], size[i], rng.random())
        extra[held], extra[i] = _whole(p[held]), _whole(p[i])
        held = held if extra[held] is None else i if extra[i] is None else None
    if last and held is not None:
        extra[held] = int(rng.random() < p[held])
        over = (extra[held] - p[held]) * size[held]  # words taken beyond the expected ones
        for i in range(len(extra)):  # long ones first; one that is too long to help stays
            if i != held and extra[i] == (over > 0) and size[i] <= abs(over):
                extra[i] = 1 - extra[i]
                over += (2 * extra[i] - 1) * size[i]
    rows["bucket"] = key[1]
    rows["p"] = p
    rows["extra"] = pd.array(extra, dtype="Int32")
    return rows


def _level(rows: DataFrame, bucket: Column, seed: str) -> DataFrame:
    """One round in all buckets; where a source has one bucket left, its last document is settled."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return _round_bucket(key, group, seed, last=group["buckets"].iloc[0] == 1)

    return (
        rows.withColumn("bucket", bucket.cast("long"))
        .select("rank", "buckets", "bucket", "key", "doc_id", "size", "p", F.lit(None).cast("int").alias("extra"))
        .groupBy("rank", "bucket")
        .applyInPandas(run, ROUNDED)
    )


def mix_sources(docs: DataFrame, cap: float = 3.0, seed: int = 17, label: str = "mix") -> DataFrame:
    """Copies of each document so that sources come to their targets.

    Takes (doc_id, text, source); other columns are ignored. Returns one row per input row:
    doc_id, source, size (words; NULL or empty text has none), source_size, target, copies, taken
    (copies times size). Texts without words are never taken. Repeated rows are rounded one by
    one. A NULL source is a source of its own. No rows give no rows. The same rows give the same
    result whatever their partitions.
    """
    sized = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")
        ),
        f"{label}-sizes",
    )
    sources = materialise(
        source_targets(
            sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")),
            cap,
            label,
        ),
        f"{label}-sources",
    )
    most = sources.agg(F.max("n")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    equal = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times"))
    slices = equal.withColumn("slice", F.explode(F.expr(f"sequence(0, (times - 1) div {SLICE})")))
    own = F.least(F.lit(SLICE), F.col("times") - F.col("slice") * SLICE).cast("int")
    rows = (
        slices.withColumn("_nth", F.explode(F.sequence(F.lit(1), own)))
        .withColumnRenamed("source", "_source")
        .join(sources, F.col("_source").eqNullSafe(F.col("source")))
        .withColumn("rate", rate)
        .withColumn("base", F.floor(F.col("rate") + SOLID).cast("long"))
        .withColumn("p", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
        .withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size"))
    )
    # a row repeated very often is in many buckets
    salted = F.when(F.col("slice") == 0, F.col("key")).otherwise(F.xxhash64("key", "slice"))
    opened = rows.where("size > 0").withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS))
    level = materialise(
        _level(opened, F.pmod(salted, "buckets"), f"{seed}:0"), f"{label}-rounded"
    )
    buckets, depth, parts = -(-most // BUCKET_ROWS), 0, [level.where("extra IS NOT NULL")]
    while buckets > 1:
        buckets, depth = -(-buckets // FAN_IN), depth + 1
        still = level.where("extra IS NULL").withColumn("buckets", F.ceil(F.col("buckets") / FAN_IN))
        level = materialise(
            _level(still, F.floor(F.col("bucket") / FAN_IN), f"{seed}:{depth}"), f"{label}-rounded"
        )
        parts.append(level.where("extra IS NOT NULL"))
    rounded = parts[0]
    for part in parts[1:]:
        rounded = rounded.union(part)
    empty = sized.where("size = 0").select("doc_id", "source", "size")
    taken = (
        rounded.select("rank", "doc_id", "size", "extra")
        .join(sources.select("rank", "source", "source_size", "target"), "rank")
        .withColumn("rate", rate)
        .withColumn("copies", F.floor(F.col("rate") + SOLID).cast("long") + F.col("extra"))
    )
    untaken = (
        empty.withColumnRenamed("source", "_source")
        .join(sources, F.col("_source").eqNullSafe(F.col("source")))
        .withColumn("copies", F.lit(0).cast("long"))
    )
    columns = ["doc_id", "source", "size", "source_size", "target", "copies"]
    return (
        taken.select(columns)
        .union(untaken.select(columns))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def mixed_documents(docs: DataFrame, cap: float = 3.0, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns.

    Takes (doc_id, text, source). Copies are matched by id, size and source, so each source gets
    its own; rows alike in all three take theirs in the order of their texts' hashes. Rows without
    words, NULL texts among them, are never taken; a NULL id or source is a value like any other.
    No rows give no rows.
    """
    names = "size row hash id words of nth times copy".split()
    size, row, hash_, id_, words, of, nth, times, copy = unused(docs, *names)
    known = materialise(
        docs.withColumn(size, word_count(F.col("text")))
        .where(F.col(size) > 0)
        .withColumn(row, F.monotonically_increasing_id()),
        "mix-rows",
    )
    alike = Window.partitionBy("doc_id", size, "source").orderBy(hash_, row)
    mine = known.select("doc_id", size, "source", row, F.xxhash64("text").alias(hash_)).select(
        row,
        F.col("doc_id").cast("long").alias(id_),
        F.col(size).alias(words),
        F.col("source").alias(of),
        F.row_number().over(alike).alias(nth),
    )
    same = Window.partitionBy("doc_id", "size", "source").orderBy("copies")
    counted = (
        mix_sources(docs, cap, seed)
        .where("size > 0")
        .select("doc_id", "size", "source", F.row_number().over(same).alias("nth"), "copies")
        .where("copies > 0")
    )
    taken = mine.join(
        counted,
        F.col(id_).eqNullSafe(F.col("doc_id"))
        & (F.col(words) == F.col("size"))
        & F.col(of).eqNullSafe(F.col("source"))
        & (F.col(nth) == F.col("nth")),
    ).select(F.col(row), F.col("copies").cast("int").alias(times))
    return (
        known.join(taken, row)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
        .select(*docs.columns)
    )
