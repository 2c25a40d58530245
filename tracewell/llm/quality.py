"""Quality classifier with hierarchical empirical Bayes.

Two logistic models read a document's own text: one for low quality, one for toxic text. They are
fitted on a bounded sample of labelled rows. Every document's probabilities are then summed per
host and per path of a host, sites with few documents are shrunk toward their host, hosts toward
the global rate, with strengths estimated from how far the groups really differ. A document is
judged by its own evidence on top of its path's posterior rate, which leaves the document itself
out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm.common import materialise, unused

SAMPLE_ROWS = 4_000  # labelled rows that the models are fitted on, whatever the size of the corpus
WORDS_KEPT = 400
LEAST_DOCUMENTS = 4
BEGINNINGS = (5, 7)
REJECT_AT = 0.5
KINDS = ("low", "toxic")
WORD = re.compile(r"[^\W\d_]+")
SYMBOLS = "#$%&*|!<>{}[]\\^~@=+_"
STRENGTHS = (2.0, 10_000.0)


def words_of(text: str) -> set[str]:
    """Distinct words, and their beginnings, which families of inflected words share."""
    words = set(WORD.findall(text.lower()))
    return words.union(*[{w[:n] + "-" for w in words if len(w) >= n} for n in BEGINNINGS])


def style_of(text: str, words: int) -> list[float]:
    """Numbers about the look of a whole text."""
    n = max(1, len(text))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lower = text.lower()
    if len(lower) == len(text):
        folded = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        upper = float((points != folded).sum())
    else:
        upper = float(sum(c.isupper() for c in text))
    tokens = text.split()
    lines = text.split("\n")
    sentences = text.split(". ")
    symbols = [text.count(c) for c in SYMBOLS]
    return [
        np.log1p(n),
        upper / n,
        float(((points >= 48) & (points <= 57)).sum()) / n,
        sum(symbols) / n,
        min(1.0, 20.0 * sum(symbols) / n),
        text.count("|") / max(1, len(tokens)),
        text.count("!") / max(1, len(tokens)),
        words / max(1, len(tokens)),
        len(set(tokens)) / max(1, len(tokens)),
        n / max(1, len(tokens)) / 10.0,
        len(set(lines)) / len(lines),
        len(set(sentences)) / len(sentences),
        np.log1p(len(lines)),
    ]


@dataclass
class Model:
    """Weights of one label: intercept, style, words, and the rate in the sample."""

    mean: np.ndarray
    scale: np.ndarray
    bias: float
    style: np.ndarray
    words: dict[str, float]
    rate: float

    def evidence(self, style: np.ndarray, words: set[str]) -> float:
        """Log likelihood ratio of the label, from the text alone."""
        logit = self.bias + float(((style - self.mean) / self.scale) @ self.style)
        known = self.words
        logit += sum(known[w] for w in known.keys() & words)
        return logit - np.log(self.rate / (1 - self.rate))


def informative_words(sample: DataFrame, kind: str, keep: int = WORDS_KEPT) -> list[str]:
    """Words whose presence tells most about the label, by the z score of log odds."""
    n1, n = sample.agg(F.sum(kind), F.count("*")).first()
    a, b = F.col("a") + 0.5, F.col("b") - F.col("a") + 0.5
    not_a, not_b = F.lit(n1 + 1.0) - a, F.lit(n - n1 + 1.0) - b
    odds = F.log(a / not_a) - F.log(b / not_b)
    error = F.sqrt(1 / a + 1 / not_a + 1 / b + 1 / not_b)
    found = (
        sample.select(F.explode("words").alias("word"), F.col(kind).alias("y"))
        .groupBy("word")
        .agg(F.sum("y").alias("a"), F.count("*").alias("b"))
        .where(F.col("b") >= LEAST_DOCUMENTS)
        .orderBy(F.desc(F.round(F.abs(odds / error), 9)), "word")
        .limit(keep)
        .collect()
    )
    return [r.word for r in found]


def fit(styles: np.ndarray, word_sets: list[list[str]], chosen: list[str], y: np.ndarray, ridge: float = 2.0) -> Model:
    """Logistic regression by Newton steps with a ridge on everything but the intercept."""
    mean, scale = styles.mean(axis=0), styles.std(axis=0) + 1e-6
    place = {w: k for k, w in enumerate(chosen)}
    x = np.zeros((len(y), 1 + styles.shape[1] + len(chosen)))
    x[:, 0] = 1.0
    x[:, 1 : 1 + styles.shape[1]] = (styles - mean) / scale
    for row, words in enumerate(word_sets):
        for w in place.keys() & words:
            x[row, 1 + styles.shape[1] + place[w]] = 1.0
    weights = np.zeros(x.shape[1])
    rate = (y.sum() + 1.0) / (len(y) + 2.0)
    weights[0] = np.log(rate / (1 - rate))
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - p) - penalty * weights * (np.arange(len(weights)) > 0)
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        weights += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    k = 1 + styles.shape[1]
    return Model(mean, scale, float(weights[0]), weights[1:k], dict(zip(chosen, weights[k:])), rate)


def neutral() -> Model:
    """A model without evidence, for a label that is as good as never given."""
    width, rate = len(style_of("", 0)), 1e-6
    bias = float(np.log(rate / (1 - rate)))
    return Model(np.zeros(width), np.ones(width), bias, np.zeros(width), {}, rate)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents, chosen by a hash of their id: (doc_id, text, low, toxic).

    Of documents with the same id, the one with the least text is taken, so repeated ids don't
    make the sample larger.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg((F.min("quality") < 1).cast("int").alias("low"), (F.max("toxic") > 0).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    texts = docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text")
    return (
        texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        .groupBy("doc_id", "low", "toxic").agg(F.min("text").alias("text"))
        .select("doc_id", "text", "low", "toxic")
    )


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict[str, Model]:
    """One model per kind. A kind that the sample has no cases of, or only cases, says nothing."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sets = [words_of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([sorted(s) for s in sets], pa.list_(pa.string())),
                    pa.array([style_of(t, len(s)) for t, s in zip(texts, sets)], pa.list_(pa.float64())),
                    batch.column(2).cast(pa.int32()),
                    batch.column(3).cast(pa.int32()),
                ],
                ["doc_id", "words", "style", "low", "toxic"],
            )

    sample = materialise(
        labelled_sample(docs, labels, rows).mapInArrow(
            features, "doc_id long, words array<string>, style array<double>, low int, toxic int"
        ),
        "quality-sample",
    )
    models = {}
    for kind in KINDS:
        chosen = informative_words(sample, kind) if sample.agg(F.count_distinct(kind)).first()[0] > 1 else []
        if not chosen:
            models[kind] = neutral()
            continue
        told = F.array_intersect("words", F.lit(chosen)).alias("words")
        found = sample.select("doc_id", told, "style", F.col(kind).alias("y")).collect()
        found.sort(key=lambda r: (r.doc_id, r.words, r.style))
        y = np.array([float(r.y > 0) for r in found])
        models[kind] = fit(np.array([r.style for r in found]), [r.words for r in found], chosen, y)
    return models


def _strength(rate: Column, n: Column, mean: Column, groups: DataFrame) -> float:
    """Prior strength in documents: how little the groups' rates differ beyond chance."""
    row = groups.agg(
        F.sum(n).alias("n"),
        F.sum(n * (rate - mean) * (rate - mean)).alias("spread"),
        F.sum(mean * (1 - mean)).alias("chance"),
        F.sum(n * mean * (1 - mean)).alias("room"),
    ).first()
    if not row.n or not row.room:
        return STRENGTHS[1]
    between = (row.spread - row.chance) / row.room  # share of the variance that the groups explain
    return float(min(max(1 / between - 1, STRENGTHS[0]), STRENGTHS[1])) if between > 0 else STRENGTHS[1]


def site_rates(scores: DataFrame) -> DataFrame:
    """Posterior rates per (host, path), each level shrunk toward the one above.

    Rows are summed with map-side combining, so a host with a third of all documents is no more
    than one row of each task.
    """
    paths = materialise(
        scores.groupBy("host", "path").agg(
            F.count("*").alias("n"), *[F.sum(f"p_{k}").alias(f"s_{k}") for k in KINDS]
        ),
        "quality-paths",
    )
    hosts = paths.groupBy("host").agg(
        F.sum("n").alias("host_n"), *[F.sum(f"s_{k}").alias(f"host_s_{k}") for k in KINDS]
    )
    overall = paths.agg(F.sum("n"), *[F.sum(f"s_{k}") for k in KINDS]).first()
    n = overall[0] or 0
    for i, kind in enumerate(KINDS):
        rate = (overall[i + 1] + 0.5) / (n + 1) if n else 0.5
        own = F.col(f"host_s_{kind}") / F.col("host_n")
        k = _strength(own, F.col("host_n"), F.lit(rate), hosts)
        hosts = hosts.withColumn(
            f"host_{kind}", (F.lit(k * rate) + F.col(f"host_s_{kind}")) / (F.col("host_n") + k)
        )
    hosts = materialise(hosts.withColumnRenamed("host", "_host"), "quality-hosts")
    joined = materialise(
        paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host"), "quality-joined"
    )
    for kind in KINDS:
        own = F.col(f"s_{kind}") / F.col("n")
        k = _strength(own, F.col("n"), F.col(f"host_{kind}"), joined)
        joined = joined.withColumn(f"k_{kind}", F.lit(k))
    return materialise(
        joined.select(
            F.col("host").alias("_host"), F.col("path").alias("_path"), "n",
            *[c for kind in KINDS for c in (f"s_{kind}", f"k_{kind}", f"host_{kind}")],
        ),
        "quality-sites",
    )


def judge_documents(
    docs: DataFrame,
    labels: DataFrame,
    host: Column | None = None,
    path: Column | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Every document with its evidence, its site's rates, posterior probabilities and verdict.

    Takes documents (doc_id, text; source and lang unless ``host`` and ``path`` are given) and
    labels (doc_id, quality 0/1, toxic 0/1; several labels of one document count as its worst,
    labels with a NULL are left out; of repeated ids one document is fitted on). Without ``host``
    and ``path``, source stands for the host and lang for the path. Returns doc_id, host, path, p_low, p_toxic (from the text),
    site_low, site_toxic, posterior_low, posterior_toxic, keep. One row out per row in; a NULL or
    empty text is judged as an empty one; a NULL host or path is a group of its own. Without
    usable labels nothing is rejected. Other columns are ignored.
    """
    models = train(docs, labels, sample_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(3):
                text = text.as_py() or ""
                words = words_of(text)
                style = np.array(style_of(text, len(words)))
                found.append([models[k].evidence(style, words) for k in KINDS])
            evidence = np.array(found).reshape(-1, len(KINDS))
            prior = np.array([np.log(models[k].rate / (1 - models[k].rate)) for k in KINDS])
            p = 1 / (1 + np.exp(-np.clip(evidence + prior, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *map(pa.array, evidence.T.copy()), *map(pa.array, p.T.copy())],
                ["doc_id", "host", "path", "e_low", "e_toxic", "p_low", "p_toxic"],
            )

    scores = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.col("source") if host is None else host).cast("string").alias("host"),
            (F.col("lang") if path is None else path).cast("string").alias("path"),
            "text",
        ).mapInArrow(
            score,
            "doc_id long, host string, path string, e_low double, e_toxic double, p_low double, p_toxic double",
        ),
        "quality-scores",
    )
    result = scores.join(
        site_rates(scores),
        F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")),
    )
    for kind in KINDS:
        # the document's own probability is taken out of its path's sum
        others = (F.col(f"k_{kind}") * F.col(f"host_{kind}") + F.col(f"s_{kind}") - F.col(f"p_{kind}")) / (
            F.col(f"k_{kind}") + F.col("n") - 1
        )
        site = F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6))
        result = result.withColumn(f"site_{kind}", site).withColumn(
            f"posterior_{kind}",
            1 / (1 + F.exp(-(F.col(f"e_{kind}") + F.log(F.col(f"site_{kind}") / (1 - F.col(f"site_{kind}")))))),
        )
    bad = F.greatest(*[F.col(f"posterior_{k}") for k in KINDS]) >= REJECT_AT
    known = any(models[k].words for k in KINDS)
    return result.select(
        "doc_id", "host", "path", "p_low", "p_toxic", "site_low", "site_toxic",
        "posterior_low", "posterior_toxic", (~bad if known else F.lit(True)).alias("keep"),
    )


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps; rows without an id are judged by none and stay.

    Rows of one id stay or go together: they go when all of them are rejected.
    """
    verdict = judge_documents(docs, labels)
    (name,) = unused(docs, "gone")
    gone = (
        verdict.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(name))
        .agg(F.max("keep").alias("kept")).where("NOT kept").select(name)
    )
    gone = gone.hint("merge")  # grows with the corpus
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
