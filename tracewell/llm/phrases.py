"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases: each phrase is the shortest string from where the last
one ended that isn't a phrase yet. The fingerprint is the smallest hash values of the set of
phrases, and two fingerprints are compared as minimum-hash signatures: the share of common values
among the smallest of both. Texts that would compress well together have phrases in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

WIDTH = 64
ROWS_PER_PART = 20_000
LOWEST = -(1 << 63)
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def parse(text: str, phrases: set[str], open_phrase: str = "") -> str:
    """Add the phrases of ``text`` to ``phrases``; returns what is left of the last one."""
    add = phrases.add
    for char in text:
        open_phrase += char
        if open_phrase not in phrases:
            add(open_phrase)
            open_phrase = ""
    return open_phrase


def hashes(phrases: set[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh32_intdigest, phrases), dtype=np.uint32, count=len(phrases))


def signature(values: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The ``width`` smallest distinct values, in order."""
    values = np.unique(values)
    return values[:width]


def likeness(a: np.ndarray, b: np.ndarray, width: int = WIDTH) -> float:
    """Estimated Jaccard similarity of two phrase sets; exact when both have few phrases."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    joint = np.union1d(a, b)[:width]
    return float(np.isin(joint, np.intersect1d(a, b, assume_unique=True)).sum() / len(joint))


def written(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


class Parsed:
    """A text's phrases up to where an edit may begin, and its own fingerprint."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.moved = len(text) // 4
        self.kept = text[: len(text) - self.moved]
        self.phrases: set[str] = set()
        self.open_phrase = parse(self.kept, self.phrases)
        self.values = hashes(self.phrases)
        self.own = self.with_tail(text[len(self.kept) :])

    def with_tail(self, tail: str) -> np.ndarray:
        """Fingerprint of the kept part followed by ``tail``."""
        phrases = set(self.phrases)
        parse(tail, phrases, self.open_phrase)
        return signature(np.concatenate([self.values, hashes(phrases - self.phrases)]))

    def row(self, after: Parsed) -> tuple:
        tail = after.text[: self.moved]
        edited = self.with_tail(tail)
        digest = hashlib.sha256((self.kept + tail).encode("utf-8")).hexdigest()
        return (
            self.doc_id, len(self.text), digest, written(self.own), written(edited),
            likeness(self.own, edited), likeness(self.own, after.own),
        )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """One row per document of the part; the guest at the end only serves as a successor."""
    held, done = None, False
    for batch in batches:
        ids, texts, guests = (batch.column(k) for k in range(3))
        for i in range(0 if done else batch.num_rows):
            now = Parsed(ids[i].as_py(), texts[i].as_py() or "")
            if held is not None:
                yield held.row(now)
            held = now
            if done := guests[i].as_py():
                break


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2
    block: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*block), kinds)], names
        )

    for row in _rows(batches):
        block.append(row)
        if len(block) == 1000:
            yield out()
            block.clear()
    if block:
        yield out()


def fingerprint_documents(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Phrase fingerprints of every whole text and of its edited form.

    The edited text ends in the beginning of the next document's text (ascending doc_id, NULL
    first, equal ids by text; after the last comes the first) in place of its own last quarter.
    Takes (doc_id, text); other columns are ignored. A NULL text counts as empty, which has an
    empty fingerprint; two empty ones are alike (1.0), an empty and another aren't (0.0). Equal
    texts have equal fingerprints. A table of one row is its own successor; no rows give none.

    Documents are dealt once by ranges of doc_id. Each range also gets the first document of the
    next one as a guest, so that no part waits for another.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    ids = rows.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("id"))
    n, least = ids.agg(F.count("*"), F.min("id")).first()
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_PER_PART))
    shares = [k / parts for k in range(1, parts)]
    cuts = ids.agg(F.percentile_approx("id", shares or [0.5])).first()[0] if shares else []
    bounds = np.array(sorted({c for c in cuts or [] if c > least}), dtype=np.int64)
    count = len(bounds) + 1

    @F.pandas_udf("int")
    def part_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, doc_id.to_numpy(), side="right").astype(np.int32))

    own = part_of(F.coalesce("doc_id", F.lit(LOWEST)))
    # the lower bound of a range is an id that exists: its row also goes to the range before
    begins = F.coalesce("doc_id", F.lit(LOWEST)).isin([least, *bounds.tolist()])
    here = F.struct(F.col("own").alias("part"), F.lit(False).alias("guest"))
    before = F.struct(
        F.pmod(F.col("own") - 1, F.lit(count)).alias("part"), F.lit(True).alias("guest")
    )
    return (
        rows.withColumn("own", own)
        .withColumn("to", F.when(begins, F.array(here, before)).otherwise(F.array(here)))
        .select("doc_id", "text", F.explode("to").alias("to"))
        .select("doc_id", "text", "to.guest", "to.part")
        .repartitionById(count, F.col("part"))
        .sortWithinPartitions("guest", F.col("doc_id").asc_nulls_first(), "text")
        .select("doc_id", "text", "guest")
        .mapInArrow(_run, SCHEMA)
    )
