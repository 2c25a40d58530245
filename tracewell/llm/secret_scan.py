"""Secret scans: fixed patterns, and novelty under dictionary-primed zstandard.

A candidate is a long token behind a word that announces a secret. Its novelty is the number of
bytes it adds to a zstandard frame that already holds the text around it and is primed with a
dictionary of code and of the identifiers that the most texts of the whole table have: names, words
and repeated values add few bytes, random keys add nearly all of theirs.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex", "novel")
CONTEXT = re.compile(
    r"(?ai:passphrase|passwd|password|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key"
    r"|client[_-]?key|credential|bearer|authorization|signature)"
)
LEAST = 16  # code points of a candidate
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=~-]{{{LEAST},}}")
REACH = 48  # most code points between the announcing word and the candidate
AROUND = 1024  # code points of surrounding text on either side
LEAST_NOVELTY = 0.62  # added bytes per byte of the candidate
# whole runs of letters; keys have digits or marks, so none gets into the dictionary
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9+/_=~-])[A-Za-z_]{4,40}(?![A-Za-z0-9+/_=~-])")
LEAST_TEXTS = 3  # texts that have an identifier of the dictionary
DICTIONARY_BYTES = 32_768  # trained part of the dictionary
HELD = 1 << 18  # identifiers that a task counts before it passes their counts on
PRIMER = """
import export from return function class public private protected static final void string
int long double float boolean true false null none self this new def lambda async await const
let var package include require config settings default value values key keys name names user
users username account email address host hostname port url uri path file filename directory
index count length size type types data database table column row rows query request response
header headers body content message error exception warning debug info logger logging level
version client server service session cookie cache memory thread process queue event handler
callback listener context environment production development staging test testing example sample
placeholder changeme your_api_key your_token_here YOUR_SECRET_KEY xxxxxxxxxxxxxxxx
0123456789abcdef ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz access_token refresh_token
client_id client_secret private_key public_key ssh-rsa BEGIN END CERTIFICATE RSA PRIVATE KEY
Authorization Bearer Basic Content-Type application/json text/html charset utf-8 https http www
getElementById addEventListener createElement toString hashCode equals System.out.println
"""
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"


class Novelty:
    """Marginal compressed bytes of a candidate within its surroundings."""

    def __init__(self, primer: str = PRIMER, level: int = 9):
        primed = zstandard.ZstdCompressionDict(
            primer.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )
        primed.precompute_compress(level=level)
        self.compressor = zstandard.ZstdCompressor(
            level=level, dict_data=primed, write_content_size=False, write_checksum=False
        )

    def __call__(self, around: str, candidate: str) -> float:
        """Added bytes per byte of the candidate, the surroundings being known."""
        known = around.encode("utf-8", "surrogatepass")
        added = candidate.encode("utf-8", "surrogatepass")
        alone = len(self.compressor.compress(known))
        return max(0, len(self.compressor.compress(known + added)) - alone) / max(1, len(added))


def base_spans(text: str) -> list[tuple[int, str]]:
    """Spans (start, kind, end) of the fixed patterns, ends exclusive, in code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def mixed(token: str) -> bool:
    """Whether a token has letters and digits, as keys do and words don't."""
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def merged(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """The spans' (start, end) in order, overlapping ones as one."""
    whole: list[list[int]] = []
    for start, _, end in sorted(spans):
        if whole and start < whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], end)
        else:
            whole.append([start, end])
    return whole


def novel_spans(text: str, taken: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Incompressible strings behind an announcing word, none meeting a span already ``taken``.

    Candidates and taken spans are walked together in text order.
    """
    found, done = [], 0
    covered = merged(taken)
    at = 0
    for word in CONTEXT.finditer(text):
        last = word.end() + REACH
        for m in CANDIDATE.finditer(text, max(done, word.end()), min(len(text), last + LEAST)):
            if m.start() > last:
                break
            whole = CANDIDATE.match(text, m.start())
            start, end = whole.start(), whole.end()
            done = max(done, end)
            while at < len(covered) and covered[at][1] <= start:
                at += 1
            if not mixed(whole[0]) or (at < len(covered) and covered[at][0] < end):
                continue
            around = text[max(0, start - AROUND) : start] + text[end : end + AROUND]
            if novelty(around, whole[0]) >= LEAST_NOVELTY:
                found.append((start, 3, end))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan_text(text: str | None, novelty: Novelty) -> tuple[int, int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    extra = novel_spans(text, base, novelty)
    counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
    digest = hashlib.sha256(joined(base).encode()).hexdigest()
    return (*counts, len(extra), digest, joined(base + extra))


def trained_primer(docs: DataFrame, rows: int | None = None) -> str:
    """Dictionary text: the identifiers that the most texts have, frequent ones last, then ``PRIMER``.

    Counts every text of (doc_id, text); equally frequent identifiers go by name. An identifier needs
    ``LEAST_TEXTS`` texts, and those beyond ``DICTIONARY_BYTES`` are left out. A task passes its counts
    on whenever it holds ``HELD``, and the driver gets at most ``DICTIONARY_BYTES`` / 4 words. A table
    without such identifiers, an empty one included, gives ``PRIMER`` alone. With ``rows``, only a
    sample of at most that many rows, those with the least hashes, is counted.
    """
    texts = docs.where("text IS NOT NULL")
    if rows is not None:
        keyed = texts.selectExpr("text", "xxhash64(doc_id, text) AS key")
        least = keyed.select("key").orderBy("key").limit(rows + 1).agg(F.count("*"), F.max("key")).first()
        texts = keyed.where(F.col("key") < least[1]) if least[0] > rows else keyed

    def written(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(set(map(re.Match.group, IDENTIFIER.finditer(text.as_py()))))
                if len(seen) >= HELD:
                    yield written(seen)
                    seen = Counter()
        yield written(seen)

    found = (
        texts.select("text").mapInArrow(count, "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TEXTS)
        .orderBy(F.desc("n"), "word").limit(DICTIONARY_BYTES // 4)
        # one task merges the partitions' shares, so that the driver doesn't get each of them
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word")))).first()[0]
    )
    chosen, size = [], 0
    for word in found:
        size += len(word.word) + 1
        if size > DICTIONARY_BYTES:
            break
        chosen.append(word.word)
    return " ".join(reversed(chosen)) + PRIMER


def find_secrets(docs: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """Secrets in every whole text.

    Takes (doc_id, text). Returns one row per input row: counts per kind of pattern, n_novel,
    base_sha256 over the pattern spans, and all spans as ``kind:start:end`` in order. A NULL text
    counts as empty, which has no spans and the digest of the empty string. Repeated rows give
    repeated rows, an empty table gives none, and other columns are ignored. The time for a text is
    proportional to its length. The dictionary is trained on all rows when this is called, or on at
    most ``sample_rows``, if given; the scan itself has no shuffle.
    """
    primer = trained_primer(docs, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(primer)
        for batch in batches:
            rows = [scan_text(t.as_py(), novelty) for t in batch.column(1)]
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(run, SCHEMA)
