"""Language-model scores from a subword lattice, beside an add-one word model.

The model draws pieces of an existing vocabulary one after the other until the end piece; a text's
probability is the sum over all of its segmentations, found by a forward recursion over each
word's lattice. Piece probabilities start from the vocabulary's own scores (a Zipf law in the
merge rank) and are updated with how often the pieces occur in the training texts.

Both models need counts over all training texts. Words that a sample shows to be frequent are
counted in one vector per task. All other words travel as packed arrays of (hash, document, times),
dealt by hash; each part counts its words and hands back sums per document. The sample decides
which way a word takes and nothing else.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tracewell.llm.common import materialise
from tracewell.llm.pieces import MARK, MODEL, Vocabulary, load_vocabulary

FREQUENT = 50_000  # words counted by vector, chosen on a sample; bounds what is broadcast
SAMPLE_DOCUMENTS = 2_000
BLOCK_ROWS = 2_048
ROWS_PER_PART = 20_000
REMEMBERED = 400_000
TINY = 1e-200
PACKED = "part int, hashes binary, keys binary, times binary, train binary, counts array<long>"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words between ASCII white space."""
    return (text or "").encode("utf-8").lower().split()


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def row_key(doc_id: int | None, text: str | None) -> int:
    """Names a row by its id and text; rows equal in both have equal results."""
    return xxhash.xxh64_intdigest(f"{doc_id}\0{text or ''}".encode("utf-8"))


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def frequent_words(docs: DataFrame, most: int = FREQUENT, rows: int = SAMPLE_DOCUMENTS) -> list[bytes]:
    """Words often seen in a sample of ``rows`` documents, at most ``most``."""
    chosen = docs.select(F.col("doc_id").alias("_id")).distinct()
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(words_of(text.as_py()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"]
        )

    found = (
        docs.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("_id")))
        .select("text")
        .mapInArrow(count, "word binary, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(most)
        .collect()
    )
    return [bytes(r.word) for r in found]


def _gather(frequent: list[bytes], parts: int, model_path: str):
    """Count frequent words, and pack the others, task by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        place = {w: k for k, w in enumerate(frequent)}
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        f = len(frequent)
        # frequent words, then training tokens and documents, then pieces of the other words
        counts = np.zeros(f + 2 + model.get_piece_size(), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                yield from block(batch.slice(at, BLOCK_ROWS), place, counts, model.encode, f)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([-1], pa.int32()),
                *[pa.array([None], pa.binary())] * 4,
                pa.array([counts.tolist()], pa.list_(pa.int64())),
            ],
            [x.split()[0] for x in PACKED.split(", ")],
        )

    def block(batch, place, counts, encode, f) -> Iterator[pa.RecordBatch]:
        hashes, keys, times, train = [], [], [], []
        spelled: Counter = Counter()
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            learn = not held_out(doc_id)
            if learn:
                counts[f] += len(words) + 1
                counts[f + 1] += 1
                known = [place[w] for w in words if w in place]
                np.add.at(counts, np.array(known, dtype=np.int64), 1)
            other = Counter([w for w in words if w not in place])
            if other:
                key = row_key(doc_id, text)
                hashes.extend(map(word_hash, other))
                times.extend(other.values())
                keys.extend([key] * len(other))
                train.extend([learn] * len(other))
                if learn:
                    spelled.update(other)
        if spelled:
            pieces = encode([w.decode("utf-8") for w in spelled], num_threads=1)
            sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
            flat = np.fromiter(chain.from_iterable(pieces), dtype=np.int64, count=int(sizes.sum()))
            weight = np.repeat(np.fromiter(spelled.values(), dtype=np.int64, count=len(pieces)), sizes)
            counts[f + 2 :] += np.bincount(flat, weights=weight, minlength=len(counts) - f - 2).astype(np.int64)
        if not hashes:
            return
        h = np.array(hashes, dtype=np.uint64)
        columns = [h, np.array(keys, dtype=np.uint64), np.array(times, dtype=np.uint32), np.array(train, dtype=bool)]
        part = (h % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        present, starts = np.unique(part[order], return_index=True)
        packed = [[a.tobytes() for a in np.split(c[order], starts[1:])] for c in columns]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(present, pa.int32()),
                *[pa.array(c, pa.binary()) for c in packed],
                pa.nulls(len(present), pa.list_(pa.int64())),
            ],
            [x.split()[0] for x in PACKED.split(", ")],
        )

    return run


def _unpack(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)


def _count_part(parts: int):
    """One part's words: how many are known, and what each document gets from them."""

    def run(table: pa.Table) -> pa.Table:
        hashes, keys = _unpack(table, "hashes", "<u8"), _unpack(table, "keys", "<u8")
        times, train = _unpack(table, "times", "<u4"), _unpack(table, "train", "?")
        words, place = np.unique(hashes, return_inverse=True)
        c = np.bincount(place, weights=times * train, minlength=len(words))
        # rows equal in id and text share a key; their words count for each, their sums once
        pair = np.lexsort((keys, place))
        first = np.ones(len(pair), dtype=bool)
        first[1:] = (np.diff(place[pair]) != 0) | (np.diff(keys[pair]) != 0)
        pair = pair[first]
        own, index = np.unique(keys[pair], return_inverse=True)
        t, n = times[pair].astype(np.float64), c[place[pair]]
        logs = np.bincount(index, weights=t * np.log10(n + 1), minlength=len(own))
        known = np.bincount(index, weights=t * (n > 0), minlength=len(own)).astype(np.uint32)
        to = (own % np.uint64(parts)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        present, starts = np.unique(to[order], return_index=True)
        split = [[a.tobytes() for a in np.split(x[order], starts[1:])] for x in (own, logs, known)]
        vocabulary = [int((c > 0).sum())] + [0] * (len(present) - 1)
        return pa.table(
            {
                "to": pa.array(present, pa.int32()),
                "keys": pa.array(split[0], pa.binary()),
                "logs": pa.array(split[1], pa.binary()),
                "known": pa.array(split[2], pa.binary()),
                "vocabulary": pa.array(vocabulary, pa.int64()),
            }
        )

    return run


def _sum_part(table: pa.Table) -> pa.Table:
    """Sums per document of what the parts have handed back."""
    keys, logs = _unpack(table, "keys", "<u8"), _unpack(table, "logs", "<f8")
    known = _unpack(table, "known", "<u4")
    own, index = np.unique(keys, return_inverse=True)
    return pa.table(
        {
            "_key": pa.array(own.view(np.int64)),
            "rare_log": pa.array(np.bincount(index, weights=logs, minlength=len(own))),
            "rare_known": pa.array(
                np.bincount(index, weights=known, minlength=len(own)).astype(np.int64), pa.int64()
            ),
        }
    )


@dataclass
class PieceModel:
    """Probabilities of pieces, of bytes, and of the end."""

    tree: dict  # character: (what follows, probability or 0)
    byte_p: list[float]
    end: float

    @classmethod
    def of(cls, vocabulary: Vocabulary, counts: np.ndarray, ends: int) -> PieceModel:
        """Counts on top of a prior as strong as one occurrence per piece."""
        usable = [k for k, s in enumerate(vocabulary.scores) if s is not None]
        prior = np.zeros(len(vocabulary.pieces) + 1)
        prior[usable] = [math.exp(vocabulary.scores[k] / 65536) for k in usable]
        prior[vocabulary.byte_ids] = prior[usable].min() / 4
        prior[-1] = prior[usable].min()
        prior /= prior.sum()
        seen = np.append(np.where(prior[:-1] > 0, counts, 0), ends)
        p = (seen + len(usable) * prior) / (seen.sum() + len(usable))
        tree: dict = {}
        for k in usable:
            level = tree
            piece = vocabulary.pieces[k]
            for char in piece[:-1]:
                level = level.setdefault(char, ({}, 0.0))[0]
            level[piece[-1]] = (level.get(piece[-1], ({},))[0], float(p[k]))
        return cls(tree, [float(p[i]) for i in vocabulary.byte_ids], float(p[-1]))

    def log10(self, word: str) -> float:
        """Probability of a word behind its mark, over all segmentations.

        The recursion runs on plain numbers with a logarithmic offset: as soon as the open
        positions become tiny they are scaled up, so a word of any length keeps its precision.
        """
        text = MARK + word
        n, offset = len(text), 0.0
        alpha = [0.0] * (n + 1)
        alpha[0] = 1.0
        for i in range(n):
            a = alpha[i]
            if a < TINY:
                end = min(n, i + 32)
                top = max(alpha[i : end + 1])
                if top == 0.0:
                    continue
                if top < TINY:
                    for k in range(i, end + 1):
                        alpha[k] /= top
                    offset += math.log10(top)
                    a = alpha[i]
            level = self.tree
            for k in range(i, n):
                step = level.get(text[k])
                if step is None:
                    break
                level, p = step
                if p:
                    alpha[k + 1] += a * p
            spelled = a
            for b in (" " if i == 0 else text[i]).encode("utf-8"):
                spelled *= self.byte_p[b]
            alpha[i + 1] += spelled
        return math.log10(alpha[n]) + offset


def _score(frequent: list[bytes], word_counts: np.ndarray, model: PieceModel):
    """Second pass: frequent words' share of the word model, and the lattice score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = {w: (math.log10(c + 1), c > 0) for w, c in zip(frequent, word_counts.tolist())}
        known: dict[bytes, float] = {}
        end = math.log10(model.end)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                log_sum, n_known, score = 0.0, 0, end
                for w in words:
                    own = logs.get(w)
                    if own is not None:
                        log_sum += own[0]
                        n_known += own[1]
                    value = known.get(w)
                    if value is None:
                        value = model.log10(w.decode("utf-8"))
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[w] = value
                    score += value
                key = row_key(doc_id, text)
                rows.append(
                    (doc_id, key - (1 << 64) if key >> 63 else key, held_out(doc_id), len(words) + 1, log_sum, n_known, score)
                )
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "key", "held_out", "n_tokens", "log_sum", "n_known", "score"],
            )

    return run


def score_documents(docs: DataFrame, model_path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """Word-model and lattice scores of every whole text, both learned from the training texts.

    A text is learned from unless crc32 of its doc_id as text, modulo 7, is 2. Takes (doc_id,
    text), one row out per row in; other columns are ignored. Returns doc_id, held_out, n_tokens
    (words and one end), n_known, train_tokens, base_score (add-one, log10), score (lattice,
    log10). A NULL text counts as empty and is one end; a NULL doc_id counts as an empty id.
    Repeated rows are learned from as often as they occur. No rows give no rows.
    """
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path(MODEL)
    vocabulary = load_vocabulary(model_path, runs=False)
    rows = docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text")
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_PART))
    words = frequent_words(rows, frequent)
    packed = materialise(rows.mapInArrow(_gather(words, parts, model_path), PACKED), "lm-packed")
    counts = np.zeros(len(words) + 2 + len(vocabulary.pieces), dtype=np.int64)
    vectors = packed.where("part < 0").select(F.posexplode("counts").alias("k", "n")).where("n > 0")
    for k, n in vectors.groupBy("k").agg(F.sum("n")).collect():  # bounded by FREQUENT and the vocabulary
        counts[k] = n
    f = len(words)
    tokens, documents = int(counts[f]), int(counts[f + 1])
    back = materialise(
        packed.where("part >= 0")
        .groupBy("part")
        .applyInArrow(_count_part(parts), "to int, keys binary, logs binary, known binary, vocabulary long"),
        "lm-counted",
    )
    rare = back.agg(F.sum("vocabulary")).first()[0] or 0
    distinct = rare + int((counts[:f] > 0).sum()) + (documents > 0)
    pieces = counts[f + 2 :] + _pieces_of(words, counts[:f], model_path, len(vocabulary.pieces))
    model = PieceModel.of(vocabulary, pieces, documents)
    sums = back.groupBy("to").applyInArrow(_sum_part, "_key long, rare_log double, rare_known long")
    scored = rows.mapInArrow(
        _score(words, counts[:f], model),
        "doc_id long, key long, held_out boolean, n_tokens long, log_sum double, n_known long, score double",
    )
    room = math.log10(tokens + distinct + 1)
    known = F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + int(documents > 0)
    base = (
        F.col("log_sum") + F.coalesce("rare_log", F.lit(0.0)) + math.log10(documents + 1)
        - F.col("n_tokens") * room
    )
    return scored.join(sums, F.col("key") == F.col("_key"), "left").select(
        "doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )


def _pieces_of(words: list[bytes], counts: np.ndarray, model_path: str, size: int) -> np.ndarray:
    """Pieces of the frequent words, as often as the words were counted."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    found = np.zeros(size, dtype=np.int64)
    for pieces, n in zip(model.encode([w.decode("utf-8") for w in words]), counts.tolist()):
        for i in pieces:
            found[i] += n
    return found
