"""SentencePiece encoding and decoding by a streaming Viterbi search.

The vocabulary is an existing one. Its file holds merge ranks as scores; a piece of rank r gets
the log probability of a Zipf law in r, in whole units so that sums are exact and ties are ties.
A space is the mark U+2581, a character after which no piece can end is written as its UTF-8
bytes, and no text is normalised, so decoding gives the very text that was encoded.

The search keeps scores for as many positions as the longest piece has characters. Ids are
committed as soon as every surviving path runs through one boundary: either no piece reaches over
it, or the backpointers of all open positions meet there. No piece has a mark behind another
character than a mark, so the place before the first mark of a run of marks is always such a
boundary; what lies between two of them, a run of spaces and the word behind it, is searched once
and remembered.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
LITERAL = "\ud800"  # stands for a mark that the text itself holds; no valid text has it
RUN = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")  # a run of marks and what follows, up to the next
UNIT = 1 << 16
UNUSED = -1e8  # lower scores are no ranks; of such pieces only runs of spaces are produced
NO_PATH = -(1 << 62)
TRACE_EVERY = 64
PORTION = 4096  # characters fed at a time
REMEMBERED = 400_000
MODEL = "piece_bpe_32k.model"


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[int | None]  # None: not a piece of text
    byte_ids: list[int]

    def __post_init__(self):
        usable = [s for s in self.scores if s is not None]
        self.byte_score = min(usable) - 4 * UNIT
        self.longest = max(len(p) for p, s in zip(self.pieces, self.scores) if s is not None)
        # whether a mark ends what came before, so that texts may be cut before a run of marks
        self.cuts = not any(
            MARK in p.lstrip(MARK) for p, s in zip(self.pieces, self.scores) if s is not None
        )
        # a tree of characters: each leads to (what follows, id or -1, score)
        self.tree: dict[str, tuple[dict, int, int]] = {}
        for i, (piece, score) in enumerate(zip(self.pieces, self.scores)):
            if score is None:
                continue
            level = self.tree
            for char in piece[:-1]:
                level = level.setdefault(char, ({}, -1, 0))[0]
            level[piece[-1]] = (level.get(piece[-1], ({},))[0], i, score)

    def spelled(self, char: str) -> list[int]:
        raw = {LITERAL: MARK, MARK: " "}.get(char, char).encode("utf-8")
        return [self.byte_ids[b] for b in raw]


def load_vocabulary(path: str | None = None, runs: bool = True) -> Vocabulary:
    """Read a SentencePiece model file; by default the installed public one.

    ``runs`` says whether pieces of several spaces belong to it; single words need none. The
    model merges them last and gives them no rank, so their place among the pieces stands for it.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    spaces = [runs and len(p) > 1 and not p.strip(MARK) for p in pieces]
    text = [
        not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        and (spaces[i] if MARK in pieces[i][1:] else model.get_score(i) > UNUSED)
        for i in range(n)
    ]
    ranked = [i for i in range(n) if text[i] and model.get_score(i) > UNUSED]
    first = min((i + model.get_score(i) for i in ranked), default=0.0)  # the place of rank 0
    rank = lambda i: -model.get_score(i) if model.get_score(i) > UNUSED else max(0.0, i - first)
    ranks = [rank(i) + 10 if text[i] else 0.0 for i in range(n)]
    whole = math.log(sum(1 / r for r in ranks if r))
    scores = [round(-(math.log(r) + whole) * UNIT) if r else None for r in ranks]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Vocabulary(pieces, scores, byte_ids)


class StreamingViterbi:
    """Best segmentation of a stream of characters, with a bounded window of scores.

    Characters stay only as long as a piece may still begin at them. For positions whose paths
    haven't met yet, what the best path ends with is kept as numbers: the length of its last piece
    and the piece, or -1 less the code point of a character that goes as bytes.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.text, self.at = "", 0  # characters not begun with; the position of the first
        self.best, self.step, self.piece = array("q", [0]), array("i", [0]), array("i", [0])
        self.traced, self.wait = 0, TRACE_EVERY

    def _path(self, to: int) -> list[int]:
        """Ids of the path from the last commit to position ``to``."""
        ids: list[int] = []
        while to:
            i = self.piece[to]
            if i >= 0:
                ids.append(i)
            else:
                ids.extend(reversed(self.vocabulary.spelled(chr(-1 - i))))
            to -= self.step[to]
        ids.reverse()
        return ids

    def _commit(self, to: int) -> list[int]:
        """Hand out the path to position ``to`` and forget what lies before."""
        ids = self._path(to)
        del self.best[:to], self.step[:to], self.piece[:to]
        return ids

    def _meeting(self, at: int) -> int:
        """The last boundary that the paths to all open positions, ``at`` and beyond, share."""
        open_ = {p for p in range(at, len(self.best)) if self.best[p] != NO_PATH}
        while len(open_) > 1:
            furthest = max(open_)
            open_.remove(furthest)
            open_.add(furthest - self.step[furthest])
        return open_.pop()

    def feed(self, chars: str, last: bool = False) -> list[int]:
        """Take more characters; returns the ids that are certain by now."""
        text, at, ids = self.text + chars, self.at, []
        vocabulary, best, step, piece = self.vocabulary, self.best, self.step, self.piece
        tree, byte_score = vocabulary.tree, vocabulary.byte_score
        n = len(text)
        certain = n if last else n - vocabulary.longest
        i = 0
        while i < certain:
            here = at + i
            score, reach = best[here], len(best)
            if reach == here + 1:  # the next position has no path yet
                best.append(NO_PATH)
                step.append(0)
                piece.append(0)
                reach += 1
            level = tree
            for k in range(i, n):
                found = level.get(text[k])
                if found is None:
                    break
                level, number, gain = found
                if number >= 0:
                    to = at + k + 1
                    while reach <= to:
                        best.append(NO_PATH)
                        step.append(0)
                        piece.append(0)
                        reach += 1
                    if score + gain > best[to]:
                        best[to], step[to], piece[to] = score + gain, k + 1 - i, number
            i, here = i + 1, here + 1
            if best[here] == NO_PATH:  # no piece ends here: the character goes as bytes
                char = text[i - 1]
                best[here] = score + byte_score * len(vocabulary.spelled(char))
                step[here], piece[here] = 1, -1 - ord(char)
            if here - self.traced >= self.wait:
                if met := self._meeting(here):
                    ids += self._commit(met)
                    at, here = at - met, here - met
                # where paths don't meet for long, the way back is walked in growing distances
                self.traced, self.wait = here, max(TRACE_EVERY, here)
        self.text, self.at = text[i:], at + i
        return ids

    def finish(self) -> list[int]:
        ids = self.feed("", last=True)
        return ids + self._path(self.at)


class Encoder:
    """Encode texts, remembering the ids of what stands between two certain boundaries."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.vocabulary, self.remembered = vocabulary, remembered
        self.known: dict[str, bytes] = {}

    def _direct(self, part: str) -> bytes:
        """The search of a part that is no longer than a window needs to be."""
        vocabulary, n = self.vocabulary, len(part)
        tree = vocabulary.tree
        best: list[int | None] = [0] + [None] * n
        back: list[tuple[int, int] | None] = [None] * (n + 1)  # where from, and the id (-1: bytes)
        for i in range(n):
            score, level = best[i], tree
            for k in range(i, n):
                found = level.get(part[k])
                if found is None:
                    break
                level, number, gain = found
                if number >= 0:
                    gain += score
                    if best[k + 1] is None or gain > best[k + 1]:
                        best[k + 1], back[k + 1] = gain, (i, number)
            if best[i + 1] is None:  # no piece ends here: the character goes as bytes
                best[i + 1] = score + vocabulary.byte_score * len(vocabulary.spelled(part[i]))
                back[i + 1] = i, -1
        ids: list[int] = []
        while n:
            n, number = back[n]
            if number >= 0:
                ids.append(number)
            else:
                ids.extend(reversed(vocabulary.spelled(part[n])))
        ids.reverse()
        return array("i", ids).tobytes()

    def _search(self, part: str) -> bytes:
        if len(part) <= TRACE_EVERY:
            return self._direct(part)
        search = StreamingViterbi(self.vocabulary)
        found = [
            np.array(search.feed(part[at : at + PORTION]), dtype="<i4").tobytes()
            for at in range(0, len(part), PORTION)
        ]
        return b"".join(found) + np.array(search.finish(), dtype="<i4").tobytes()

    def segment(self, part: str) -> bytes:
        found = self.known.get(part)
        if found is None:
            found = self._search(part)
            if len(part) <= 64:
                if len(self.known) >= self.remembered:
                    self.known.clear()
                self.known[part] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. What a run of spaces begins depends on nothing before it."""
        marked = text.replace(MARK, LITERAL).replace(" ", MARK)
        if not self.vocabulary.cuts:
            return np.frombuffer(self.segment(marked), dtype="<i4")
        known, segment = self.known, self.segment
        parts = [known.get(part) or segment(part) for part in RUN.findall(marked)]
        return np.frombuffer(b"".join(parts), dtype="<i4")


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.raw = [p.replace(MARK, " ").encode("utf-8") for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.byte_ids):
            self.raw[i] = bytes([b])

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Piece ids of every whole text: rows (doc_id, n_chars, n_pieces, ids, exact).

    Takes (doc_id, text), one row out per row in. ``exact`` says that decoding the ids gives the
    text again. A NULL text has NULL ids, no characters, no pieces and is exact; an empty text
    has an empty list. Repeated rows give repeated rows, other columns are ignored, no rows give
    none. Long texts and long runs without a space are searched by portions, in time in proportion
    to their length. The vocabulary travels with the task; its size is fixed. There is no shuffle.
    """
    vocabulary = vocabulary or load_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield _encoded(batch.slice(at, 1024), encoder, decoder)

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, n_pieces long, ids array<int>, exact boolean"
    )


def _encoded(batch: pa.RecordBatch, encoder: Encoder, decoder: Decoder) -> pa.RecordBatch:
    texts = batch.column(1).to_pylist()
    ids = [encoder.encode(t or "") for t in texts]
    counts = np.array([len(x) for x in ids], dtype=np.int64)
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    values = np.concatenate([np.empty(0, "<i4"), *ids]).astype(np.int32)
    lists = pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(values), mask=pa.array([t is None for t in texts], pa.bool_())
    )
    exact = [decoder.decode(x) == (t or "") for x, t in zip(ids, texts)]
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pa.array([len(t or "") for t in texts], pa.int64()),
            pa.array(counts, pa.int64()),
            lists,
            pa.array(exact, pa.bool_()),
        ],
        ["doc_id", "n_chars", "n_pieces", "ids", "exact"],
    )


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Texts (doc_id, text) of rows (doc_id, ids). NULL ids give a NULL text, no ids an empty one.

    Repeated rows give repeated rows, other columns are ignored, no rows give none.
    """
    vocabulary = vocabulary or load_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary)
        for batch in batches:
            texts = [
                None if x is None else decoder.decode(np.array(x, dtype="<i4"))
                for x in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"]
            )

    return encoded.selectExpr("CAST(doc_id AS long) AS doc_id", "ids").mapInArrow(
        run, "doc_id long, text string"
    )
