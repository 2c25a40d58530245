"""Line de-duplication with a log-template tree.

A line's place in the tree is its number of tokens, then its leading tokens, at fixed depth. Tokens
with digits are variable fields from the start. Below its leaf a line is generalised further: the
rest of its tokens is cut into bands, and leaving out one band gives a template that stands for
all lines that differ only there. Every template is one hash, so lines meet in a grouped minimum
instead of being compared with each other. A template that occurs in several documents recurs; the
document with the smallest id keeps its line, the others drop theirs.

Lines that are equal but for their variable fields have all templates and signatures in common.
They become one class first, so that everything below a leaf is done once for each class.

Changes scattered over several bands leave no template in common. Such lines meet by signatures: a
few tokens of the body at drawn places, the same places for all lines of a leaf. A line is compared,
token by token, with one line of the first document that has its signature, and goes when enough of
the body is equal. Only that line is compared, so the work doesn't grow with the signature's square.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tracewell.llm.common import materialise, unused

DEPTH = 3  # leading tokens that lead to a leaf
BANDS = 3
LEAST_TOKENS = 4  # shorter lines are matched as they stand, if at all
LEAST_BODY = 6  # tokens below the leaf for a band to be left out
LEAST_FIXED = 3  # tokens without digits; a line with fewer is only matched as it stands
FIELD = "<*>"
SIGNATURES = 8  # lines with 9 of 10 tokens equal share none with a probability of 3e-5, 8 of 10: 3e-3
DRAWN = 3  # places of the body in a signature
EQUAL = 2, 3  # least share of equal tokens in the body, as leaving out one band of three leaves
DIGIT = re.compile(r"\d")
LOWEST = -(1 << 63)
BELOW = [f"b{k}" for k in range(BANDS)]  # templates without one band
MET = [f"s{k}" for k in range(SIGNATURES)]
PLACE = "id long, row long, line int, whole long"


def fields(line: str) -> tuple[list[str], bool]:
    """A line's tokens with its variable fields, and whether it may be generalised."""
    tokens = line.split()
    if DIGIT.search(line):
        masked = [FIELD if DIGIT.search(t) else t for t in tokens]
        if len(tokens) - masked.count(FIELD) < LEAST_FIXED:
            return tokens, False
        tokens = masked
    return tokens, len(tokens) >= LEAST_TOKENS


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _draw(n: int) -> list[list[int]]:
    """The places of each signature in a body of ``n`` tokens."""
    draw = np.random.default_rng([20_240_611, n])
    return [sorted(draw.choice(n, DRAWN, replace=False).tolist()) for _ in range(SIGNATURES)]


def parse_line(line: str, places: dict[int, list[list[int]]], short: bool = False) -> tuple[list[int], list[int]]:
    """Hashes of a line's templates, and those by which it meets lines of its leaf to compare.

    The templates are the line itself with its variable fields, then the line without each band.
    A line of fewer than LEAST_TOKENS tokens has none, with ``short`` its exact one. ``places``
    remembers where signatures are drawn from, by the length of the body.
    """
    tokens, general = fields(line)
    if len(tokens) < LEAST_TOKENS:
        tokens = line.split()
        return [digest("\n".join(tokens))] if short and tokens else [], []
    if not general:
        return [digest("\n".join(tokens))], []
    # each token is hashed once; hashes of tuples of integers are the same in every process
    leaf = digest(f"{len(tokens)} {' '.join(tokens[:DEPTH])}")
    body = [xxhash.xxh64_intdigest(t) for t in tokens[DEPTH:]]
    n = len(body)
    if n < LEAST_BODY:
        return [hash((leaf, *body))], []
    cuts = [n * k // BANDS for k in range(BANDS + 1)]
    bands = [hash(tuple(body[a:b])) for a, b in zip(cuts, cuts[1:])]
    found = [hash((leaf, *bands))]
    found += [hash((leaf, k, *bands[:k], *bands[k + 1 :])) for k in range(BANDS)]
    at = places.get(n)
    if at is None:
        at = places[n] = _draw(n)
    return found, [hash((leaf, k, body[a], body[b], body[c])) for k, (a, b, c) in enumerate(at)]


def _parsed(short: bool):
    """A row for each line that has a template: where it is, its class, templates, signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[int, list[list[int]]] = {}
        none = [0] * (BANDS + SIGNATURES)
        for batch in batches:
            owner, number, hashes, bare = [], [], [], []
            for at, text in enumerate(batch.column(2)):
                for k, line in enumerate((text.as_py() or "").split("\n")):
                    found, near = parse_line(line, places, short)
                    if not found:
                        continue
                    owner.append(at)
                    number.append(k)
                    bare.append(not near)
                    hashes += found + near if near else found + none
            values = np.array(hashes, dtype=np.int64).reshape(len(owner), -1 if owner else 1 + len(none)).T
            owners, mask = pa.array(owner, pa.int32()), np.array(bare, dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(owners),
                    batch.column(1).take(owners),
                    pa.array(number, pa.int32()),
                    pa.array(values[0].copy()),
                    *[pa.array(v.copy(), mask=mask) for v in values[1:]],
                ],
                ["id", "row", "line", "whole", *BELOW, *MET],
            )

    return run


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes with a hash of every token in their bodies, in order, from the asked lines."""
    for batch in batches:
        found = []
        for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines = text.split("\n")
            for one in asked:
                body = fields(lines[one["line"]])[0][DEPTH:]
                found.append((one["whole"], [digest(t) for t in body]))
        columns = list(zip(*found)) or [()] * 2
        kinds = [pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["whole", "body"])


def _shared(classes: DataFrame, keys: list[str], name: str, label: str, *more: str) -> DataFrame:
    """Classes (whole, first, *more, name, met) by each of ``keys`` that classes of several documents share.

    ``met`` is the smallest id of a document that has the key.
    """
    flat = classes.where(F.col(keys[0]).isNotNull()).select(
        "whole", "first", *more, F.explode(F.array(*keys)).alias(name)
    )
    # a key whose classes all begin in one document tells no more than the classes do
    several = materialise(
        flat.groupBy(name).agg(F.min("first").alias("met"), F.max("first").alias("to"))
        .where("met < to").select(name, "met"),
        f"lines-{label}",
    )
    return flat.join(several, name)


def _near(rows: DataFrame, parsed: DataFrame, open_: DataFrame) -> DataFrame:
    """Classes (whole, met) of ``open_`` close to a line of the first document with their signature."""
    flat = materialise(_shared(open_, MET, "signature", "met", "undecided"), "lines-meeting")
    leaders = flat.where("first = met").groupBy("signature").agg(F.min("whole").alias("leader"))
    later = flat.where("first > met AND undecided").select("whole", "met", "signature")
    pairs = materialise(
        later.join(materialise(leaders, "lines-leaders"), "signature")
        .groupBy("whole", "leader").agg(F.min("met").alias("met")),
        "lines-pairs",
    )
    wanted = pairs.select("whole").union(pairs.select("leader")).distinct()
    # any line of a class will do
    asked = (
        parsed.select("id", "row", "line", "whole").join(wanted, "whole")
        .groupBy("whole").agg(F.min(F.struct("id", "row", "line")).alias("at"))
        .select("whole", "at.*").groupBy("id", "row")
        .agg(F.collect_list(F.struct("whole", "line")).alias("lines"))
    )
    bodies = materialise(
        rows.join(asked.hint("merge"), ["id", "row"])
        .select("text", "lines")
        .mapInArrow(_bodies, "whole long, body array<long>")
        .dropDuplicates(["whole"]),
        "lines-bodies",
    )
    theirs = bodies.select(F.col("whole").alias("leader"), F.col("body").alias("other"))
    equal = F.size(F.filter(F.zip_with("body", "other", lambda a, b: a == b), lambda x: x))
    close = EQUAL[1] * equal >= EQUAL[0] * F.size("body")
    return pairs.join(bodies, "whole").join(theirs, "leader").where(close).select("whole", "met")


def recurring_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """Lines to drop: (id, row, lines), one row per document that has any."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"),
        F.xxhash64("doc_id", "text").alias("row"),
        "text",
    )
    hashes = ", ".join(f"{c} long" for c in [*BELOW, *MET])
    parsed = materialise(rows.mapInArrow(_parsed(short), f"{PLACE}, {hashes}"), "lines-parsed")
    classes = materialise(
        parsed.groupBy("whole").agg(
            F.min("id").alias("first"), F.max("id").alias("last"),
            *[F.max(c).alias(c) for c in [*BELOW, *MET]],  # the same in all lines of a class
        ),
        "lines-classes",
    )
    banded = materialise(
        _shared(classes, BELOW, "band", "bands").where("met < first").groupBy("whole").agg(F.min("met").alias("met")),
        "lines-banded",
    )
    # a class that a band leads to an earlier document goes altogether and has nothing left to decide
    undecided = classes.select("whole", "first", *MET).join(
        banded.select("whole", F.lit(False).alias("undecided")), "whole", "left"
    ).withColumn("undecided", F.coalesce("undecided", F.lit(True)))
    found = banded.union(_near(rows, parsed, undecided)).groupBy("whole").agg(F.min("met").alias("met"))
    earliest = materialise(
        classes.select("whole", "first", "last").join(found, "whole", "left")
        .select("whole", F.least("met", "first").alias("first"), "last")
        .where("first < last").select("whole", "first"),
        "lines-earliest",
    )
    return (
        parsed.select("id", "row", "line", "whole").join(earliest, "whole").where("first < id")
        .groupBy("id", "row")
        .agg(F.collect_set("line").alias("lines"))  # no more than the document's lines
    )


def dedup_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """All columns of ``docs``, the text without recurring lines, and n_lines and n_dropped.

    Takes (doc_id, text). Lines end in a line feed. A line goes when one of its templates also
    occurs in a document with a smaller id, so each template is kept where it comes first, and
    lines that recur only inside one document stay. It also goes when the first document with one
    of its signatures has a smaller id and EQUAL of both bodies is the same; of several lines of that
    document the one with the smallest hash is compared. Lines of fewer than LEAST_TOKENS tokens stay,
    unless ``short``: then they are matched as they stand. Rows with the same id are one document; rows
    without an id are one, before all others. A NULL text stays NULL and has no lines; a text
    whose lines all go becomes empty, and its row stays. Columns named like the helpers are kept,
    except n_lines and n_dropped, which are replaced. No rows give no rows.
    """
    other = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    id_, row, dropped, lines = unused(docs, "id", "row", "dropped", "lines")
    drops = recurring_lines(docs, short).toDF(id_, row, dropped)
    # lines are a column of their own: an expression would be split again for each line looked up
    joined = docs.join(
        drops,
        (F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)) == F.col(id_))
        & (F.xxhash64("doc_id", "text") == F.col(row)),
        "left",
    ).withColumn(lines, F.split("text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(dropped))
    kept = F.array_join(F.transform(left, lambda k: F.get(F.col(lines), k)), "\n")
    text = F.when(F.col(dropped).isNull(), F.col("text")).otherwise(kept)
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in other],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.array_size(dropped), F.lit(0)).cast("long").alias("n_dropped"),
    )
