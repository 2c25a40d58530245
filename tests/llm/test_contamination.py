import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.llm.conftest import CLASHING, DOCUMENTS, prose
from tests.oracle_check import compare, connect
from tracewell.llm import common, contamination as cn

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    found = []
    patterns = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            patterns.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    lengths = {len(p) for p in patterns}
    for doc_id, text in docs:
        w = words_of(text)
        hit, ids = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in patterns:
                    hit.update(range(i, i + n))
                    ids |= patterns[tuple(w[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        found.append((doc_id, len(w), len(hit), len(ids), digest, bool(hit)))
    return sorted(found, key=str)


def cases():
    rng = random.Random(5)
    few = ["a", "b", "c", "É", "x1"]
    items = [(k, " ".join(rng.choices(few, k=n))) for k, n in enumerate([1, 2, 3, 7, 9, 10, 11, 12, 30, 60])]
    items += [(100, prose(100, 40)), (101, prose(101, 2500)), (101, "two words"), (7, "漢字 Ärger"), (None, "no id here"), (102, None), (103, " .,!"), (100, prose(100, 40))]
    docs = [(k, " ".join(rng.choices(few, k=n))) for k, n in enumerate([0, 1, 5, 9, 10, 11, 40, 400])]
    docs += [(50, prose(100, 40).upper()), (51, "x " + prose(101, 2500) + " y"), (52, prose(100, 40).replace(" ", "\x00-")), (53, "(漢字)Ärger; ärger"), (54, "two, words. TWO-WORDS no id here")]
    docs += [(55, prose(7, 30) + " " + " ".join(words_of(prose(101, 2500))[900:1100])), (None, None), (56, ""), (50, prose(100, 40).upper()), (57, prose(57, 20_000))]
    return docs, items


@pytest.mark.parametrize("portion, piece, block", [(1 << 20, 1024, 1 << 21), (64, 16, 1 << 21), (300, 40, 4000)])
def test_against_brute_force(spark, monkeypatch, portion, piece, block):
    monkeypatch.setattr(common, "PORTION", portion)
    monkeypatch.setattr(cn, "PIECE_WORDS", piece)
    monkeypatch.setattr(cn, "PATTERN_BYTES", block)
    docs, items = cases()
    extra = [F.lit(7).alias(c) for c in (*CLASHING, "spans", "items", "n_words", "item", "words")]
    table = spark.createDataFrame(docs, "doc_id long, text string").select("*", *extra).repartition(3)
    bench = spark.createDataFrame(items, ITEMS).select("*", *extra).repartition(2)
    got = sorted((tuple(r) for r in cn.contamination_report(table, bench).collect()), key=str)
    assert got == brute(docs, items)


def test_spans_are_merged_and_in_order(spark):
    docs = spark.createDataFrame([(1, "u a b c d u u d e u")], "doc_id long, text string")
    items = spark.createDataFrame([(4, "a b c"), (5, "c d"), (30, "d e"), (6, "c d e")], ITEMS)
    row = cn.find_contamination(docs, items, window=3).first()
    assert row.spans == [(1, 5), (7, 9)] and row.items == ["30", "4", "5"] and row.n_words == 10


def test_a_clean_text_is_mostly_skipped():
    words = [b"w%d" % k for k in range(10)]
    searcher = cn.Searcher(10, {tuple(words): 0})
    asked = []
    searcher.shift = type("", (dict,), {"get": lambda self, k, d: asked.append(k) or dict.get(self, k, d)})(searcher.shift)
    assert not list(searcher.occurrences([b"x"] * 9000, 0)) and len(asked) == 999


def test_nulls_ties_and_nothing(spark, trouble, nothing):
    none = spark.createDataFrame([], ITEMS)
    rows = cn.contamination_report(trouble, none).collect()
    assert len(rows) == trouble.count() and not any(r.contaminated or r.n_items for r in rows)
    items = spark.createDataFrame([(1, prose(3, 61)), (2, "Wort")], ITEMS)
    hit = sorted(r.doc_id for r in cn.contamination_report(trouble, items).collect() if r.contaminated)
    assert hit == [3, 24, 30, 31, 31, 31] and cn.contamination_report(nothing, items).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    name = "op11_contamination"
    assert compare(spark, connect(sf), name, entry.queries()[name], entry.oracle_sql()[name], sf) is None
