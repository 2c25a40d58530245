"""Benchmark decontamination by Wu-Manber search for many word windows at once.

Texts and benchmark items are sequences of words. Windows of one length are searched together. A
table says for each block of words how far the search may go on before a window can end there, so
most words of a clean text are never looked at. Where a block ends some window, its hash bucket
has the windows to compare, and only equal words make an occurrence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.llm.common import materialise, terms

WINDOW = 10
BLOCK = 2  # words that look up a shift
PIECE_WORDS = 1024  # longer items are cut into overlapping pieces
PATTERN_BYTES = 1 << 21  # benchmark text that one scan of the documents searches for
FOUND = "doc_id long, n_words long, spans array<struct<start: long, stop: long>>, items array<string>"


class Searcher:
    """All windows of one length, each with the number it is reported by."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], int]):
        self.length, self.block = length, min(BLOCK, length)
        self.default = length - self.block + 1  # a block that no window has
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.ending: dict[tuple[bytes, ...], dict[tuple[bytes, ...], int]] = {}
        for window, number in windows.items():
            for end in range(self.block, length + 1):
                block = window[end - self.block : end]
                self.shift[block] = min(length - end, self.shift.get(block, self.default))
            self.ending.setdefault(window[length - self.block :], {})[window] = number

    def occurrences(self, words: list[bytes], behind: int) -> Iterator[tuple[int, int]]:
        """(start, window number) of occurrences that end after the first ``behind`` words."""
        length, block, default, shift = self.length, self.block, self.default, self.shift
        end = max(length, behind + 1)
        while end <= len(words):
            key = tuple(words[end - block : end])
            far = shift.get(key, default)
            if far == 0:
                number = self.ending[key].get(tuple(words[end - length : end]))
                if number is not None:
                    yield end - length, number
                far = 1
            end += far


def windows_of(words: list[bytes], length: int) -> Iterator[tuple[bytes, ...]]:
    """Runs of ``length`` words; fewer words are one run, none have none."""
    for i in range(max(1, len(words) - length + 1) if words else 0):
        yield tuple(words[i : i + length])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order."""
    whole: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if whole and start <= whole[-1][1]:
            whole[-1] = whole[-1][0], max(stop, whole[-1][1])
        else:
            whole.append((start, stop))
    return whole


class Scan:
    """Search texts for the windows of benchmark pieces (item, words joined by spaces)."""

    def __init__(self, pieces: list[tuple[str, bytes]], window: int):
        self.items: list[set[str]] = []
        by_length: dict[int, dict[tuple[bytes, ...], int]] = {}
        for item, text in pieces:
            for found in windows_of(text.split(), window):
                same = by_length.setdefault(len(found), {})
                if found not in same:
                    same[found] = len(self.items)
                    self.items.append(set())
                self.items[same[found]].add(item)
        self.searchers = [Searcher(n, windows) for n, windows in sorted(by_length.items())]
        self.tail = max(by_length, default=1) - 1

    def text(self, raw: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of a text, spans of words inside occurrences, items with occurrences."""
        total, words, numbers = 0, [], set()
        spans: list[list[tuple[int, int]]] = [[] for _ in self.searchers]
        for portion in terms(raw or b""):
            behind = words[-self.tail :] if self.tail else []
            words = behind + portion
            first = total - len(behind)
            for searcher, own in zip(self.searchers, spans):
                for start, number in searcher.occurrences(words, len(behind)):
                    start += first
                    numbers.add(number)
                    if own and start <= own[-1][1]:
                        own[-1] = own[-1][0], start + searcher.length
                    else:
                        own.append((start, start + searcher.length))
            total += len(portion)
        items = set().union(*(self.items[n] for n in numbers))
        return total, merged([s for own in spans for s in own]), items


def _scanner(pieces: list[tuple[str, bytes]], window: int, texts: bool) -> Callable:
    """Add what one block of pieces finds to the spans and items found before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(pieces, window)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                counts, spans, items = [], [], []
                before = zip(part.column(2).to_pylist(), part.column(3).to_pylist())
                for raw, (was, had) in zip(part.column(1), before):
                    n, own, names = scan.text(raw.as_py())
                    counts.append(n)
                    own = merged(own + [(s["start"], s["stop"]) for s in was or ()])
                    spans.append([{"start": a, "stop": b} for a, b in own])
                    items.append(sorted(names.union(had or ())))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1) if texts else pa.array(counts, pa.int64()),
                        pa.array(spans, kind),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    ["doc_id", "text" if texts else "n_words", "spans", "items"],
                )

    return run


def pieces_of(raw: bytes, window: int) -> Iterator[list[bytes]]:
    """Runs of an item's words, of bounded length, that have all its windows between them."""
    words: list[bytes] = []
    whole = True  # nothing handed out so far
    for portion in terms(raw):
        words += portion
        while len(words) >= PIECE_WORDS + window:
            yield words[:PIECE_WORDS]
            words, whole = words[PIECE_WORDS - window + 1 :], False
    if len(words) >= window or words and whole:
        yield words


def _pieces(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                for words in pieces_of(raw.as_py() or b"", window):
                    columns = [pa.array([item], pa.string()), pa.array([b" ".join(words)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["item", "words"])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Where benchmark items occur in documents: rows (doc_id, n_words, spans, items).

    Takes documents (doc_id, text) and items (item_id, text); one row out per document. Words are
    runs of ASCII letters (A-Z count as a-z), digits and characters beyond ASCII. An item is
    searched for by each run of ``window`` words, an item with fewer words as a whole. ``spans``
    are the document's words inside occurrences, [start, stop) counted from 0, merged and in
    order; ``items`` the ids, as text and so sorted, of items with an occurrence.

    NULL and empty texts have no words; such items occur nowhere. Items with equal ids are one,
    items without an id are one whose name is the empty text. Repeated documents give repeated
    rows; other columns are ignored; no documents give no rows. Long texts are split into words by
    portions. Every document is searched whole, and no step shuffles documents. The items are
    searched for in blocks of about PATTERN_BYTES, one scan each, so tasks and the driver hold one
    block whatever the size of the benchmark.
    """
    pieces = materialise(
        benchmark.select(
            F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
            F.col("text").cast("binary").alias("raw"),
        )
        .mapInArrow(_pieces(window), "item string, words binary")
        .distinct(),
        "contamination-pieces",
    )
    size = pieces.agg(F.sum(F.octet_length("words") + 8)).first()[0] or 0
    blocks = max(1, -(-size // PATTERN_BYTES))
    found = docs.selectExpr(
        "CAST(doc_id AS long) AS doc_id",
        "CAST(text AS binary) AS text",
        "CAST(NULL AS array<struct<start: long, stop: long>>) AS spans",
        "CAST(NULL AS array<string>) AS items",
    )
    for block in range(blocks):
        own = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block)
        rows = sorted((r.item, bytes(r.words)) for r in own.collect())  # about PATTERN_BYTES
        last = block == blocks - 1
        schema = FOUND if last else FOUND.replace("n_words long", "text binary")
        found = found.mapInArrow(_scanner(rows, window, not last), schema)
        if not last:
            found = materialise(found, "contamination-block")
    return found


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``find_contamination`` in numbers: rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return find_contamination(docs, benchmark, window).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
