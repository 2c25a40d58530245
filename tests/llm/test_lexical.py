import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.llm.conftest import CLASHING, prose
from tests.oracle_check import compare, connect
from tracewell.llm import common, lexical as lx

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TEXTS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms_of(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, top=50):
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    n = sum(1 for _, c in counts if c)
    whole = sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    rows = []
    for item, wanted in asked.items():
        scores = []
        for doc, c in counts:
            m = 100 - 50 + (50 * c.total() * n) // whole if whole else 0
            w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in wanted if c[t]}
            score = sum(w[t] * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in w)
            if score > 0:
                scores.append((-score, doc is not None, doc))
        ranked = sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:top]
        rows += [(item, k + 1, doc, -s) for k, (s, _, doc) in enumerate(ranked)]
    return sorted(rows, key=str)


def cases():
    rng = random.Random(8)
    words = ["the", "of", "É", "x1", "rare", *(f"w{k}" for k in range(60))]
    odds = [60, 40, 20, 10, 1, *[3] * 60]
    docs = [(k, " ".join(rng.choices(words, odds, k=rng.randint(1, 90)))) for k in range(300)]
    docs += [(k, docs[5][1]) for k in range(400, 480)]  # equal scores over many documents
    docs += [(7, docs[7][1]), (None, docs[5][1]), (None, None), (600, ""), (601, " .,"), (602, "THE_of-É"), (603, prose(1, 20_000))]
    items = [(k, " ".join(rng.choices(words, k=n))) for k, n in enumerate([1, 2, 5, 12, 30, 200])]
    items += [(50, "the"), (51, "nowhere"), (52, None), (53, ""), (3, "rare of"), (None, "x1 x1 RARE"), (54, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("cells, block, portion, postings", [(1 << 25, 4096, 1 << 20, 1 << 21), (640, 20, 50, 300), (6400, 4096, 1 << 20, 40)])
def test_against_brute_force(spark, monkeypatch, cells, block, portion, postings):
    monkeypatch.setattr(lx, "CELLS", cells)
    monkeypatch.setattr(lx, "QUERY_TERMS", block)
    monkeypatch.setattr(lx, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(common, "PORTION", portion)
    docs, items = cases()
    extra = [F.lit(7).alias(c) for c in (*CLASHING, "score", "item_id", "terms")]
    table = spark.createDataFrame(docs, TEXTS).select("*", *extra).repartition(4)
    asked = spark.createDataFrame(items, ITEMS).select("*", F.lit(1).alias("doc_id"), F.lit(2).alias("rank"))
    got = lx.ranked_search(table, asked).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_the_walk_stops_early_and_only_when_nothing_better_is_left():
    rng = np.random.default_rng(3)
    n_docs, n_terms = 4000, 12
    dense = np.where(rng.random((n_terms, n_docs)) < 0.3, rng.integers(1, 1000, (n_terms, n_docs)) ** 3, 0)
    term, doc = np.nonzero(dense)
    shard = lx.Shard(list(range(n_docs)), n_terms, doc, term, dense[term, doc])
    query = np.array([0, 3, 7])
    want = dense[query].sum(axis=0)
    best = sorted(range(n_docs), key=lambda d: (-want[d], d))[:50]
    found, scored = shard.search(query, 50)
    assert found == [(d, want[d]) for d in best] and scored < 0.6 * (want > 0).sum()
    ties = lx.Shard(list(range(900, 0, -1)), 1, np.arange(900), np.zeros(900, int), np.full(900, 5))
    assert [900 - k for k, _ in ties.search(np.array([0]), 50)[0]] == list(range(1, 51))  # all tied: smallest ids


def test_nulls_ties_and_nothing(spark, trouble, nothing):
    rows = [tuple(r) for r in trouble.select("doc_id", "text").collect()]
    items = [(1, prose(3, 61)), (2, "Wort 漢字")]
    got = lx.ranked_search(trouble, spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, items)
    assert not lx.ranked_search(nothing, spark.createDataFrame(items, ITEMS)).count()
    assert not lx.ranked_search(trouble, spark.createDataFrame([], ITEMS)).count()


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    name = "op13_best_positions"
    assert compare(spark, connect(sf), name, entry.queries()[name], entry.oracle_sql()[name], sf) is None
