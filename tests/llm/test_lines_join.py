import math

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import prose, rows_of_trouble
from tracewell.llm import lines, queries, signature_tree as st
from tracewell.llm.common import components


def templates(line, short=False):
    return lines.parse_line(line, {}, short)[0]


def test_templates_generalise_fields_and_one_band():
    base = "user alice logged in from host seven at noon today again"
    other = "user alice logged out of host seven at noon today again"
    assert set(templates(base)) & set(templates(other))
    assert not set(templates(base)) & set(templates("user bob " + base[11:]))
    assert set(templates("request 17 took 250 ms for host a9")) & set(templates("request 4 took 9 ms for host b2"))
    assert not set(templates("1 2 3 4 5")) & set(templates("6 7 8 9 0"))
    assert templates("too short here") == []


def brute_lines(rows):
    first = {}
    order = lambda i: lines.LOWEST if i is None else i
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            for t in templates(line):
                first[t] = min(first.get(t, order(doc_id)), order(doc_id))
    out = []
    for doc_id, text, *_ in rows:
        if text is None:
            out.append((doc_id, None, 0, 0))
            continue
        all_ = text.split("\n")
        kept = [x for x in all_ if all(first[t] == order(doc_id) for t in templates(x))]
        out.append((doc_id, "\n".join(kept), len(all_), len(all_) - len(kept)))
    return Counter(out)


def test_lines_against_brute_force(spark, trouble, nothing):
    got = lines.dedup_lines(trouble)
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == brute_lines(rows_of_trouble())
    assert set(got.columns) == {*trouble.columns, "n_lines", "n_dropped"}
    assert lines.dedup_lines(nothing).count() == 0
    banner = "All rights reserved by the people of the valley"
    rows = [(k, f"{prose(100 + k, 30)}\n{banner} {1990 + k} indeed\nbye") for k in range(30)]
    kept = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in kept if banner in r.text] == [0]
    assert all(r.text.endswith("bye") for r in kept)


def sets_of(rows):
    found = {}
    for doc_id, text, *_ in rows:
        w = (text or "").encode().lower().split()
        found[doc_id] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    return found


def brute_components(sets):
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= 90 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def family(seed, words, members, edits):
    rng = np.random.default_rng(seed)
    base = prose(seed, words).replace("\n", " ").split()
    for _ in range(members):
        copy = list(base)
        for at in rng.integers(0, words, edits):
            copy[at] = f"w{rng.integers(10**6)}"
        yield " ".join(copy)


@pytest.mark.parametrize("block", [1024, 8])
def test_join_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(st, "BLOCK", block)
    texts = [t for s, e in ((1, 1), (2, 3), (3, 5), (4, 8)) for t in family(s, 600, 12, e)]
    texts += [prose(500 + k, 60) for k in range(40)] + texts[:5] + ["a b", "A B", "a", "", "x y z"]
    rows = [(k * 3, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = sets_of(rows)
    want = {i: (len(sets[i]), c) for i, c in brute_components(sets).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in st.jaccard_components(docs).collect()}
    assert got == want and len({c for _, c in got.values()}) < len(rows) - 20


def test_join_of_trouble(trouble, nothing):
    got = st.jaccard_components(trouble).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows_of_trouble())
    by = {r.doc_id: r for r in got}
    assert by[31].component_id == by[30].component_id == 3 or by[31].component_id == 30
    assert by[20].n_shingles == by[22].n_shingles == 0 and by[21].component_id == 21
    assert by[23].n_shingles == by[24].n_shingles == 1 and by[None].component_id is None
    assert st.jaccard_components(nothing).count() == 0
    kept = st.one_of_each(trouble)
    assert kept.columns == trouble.columns and kept.where("doc_id = 31").count() == 0


def test_traversal_bounds_never_lose_a_pair():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 400, 120).astype(np.uint64)) for _ in range(60)]
    sets += [np.unique(np.append(s[:-2], rng.integers(400, 500, 2).astype(np.uint64))) for s in sets[:20]]
    sets = [np.unique(st.mix(s)) for s in sets]
    found = st.links(sets, None, 90)
    up = list(range(len(sets)))
    for x, y in found:
        rx, ry = x, y
        while up[rx] != rx:
            rx = up[rx]
        while up[ry] != ry:
            ry = up[ry]
        up[max(rx, ry)] = min(rx, ry)
    want = brute_components({k: set(s.tolist()) for k, s in enumerate(sets)})
    for k in want:
        r = k
        while up[r] != r:
            r = up[r]
        assert r == want[k]


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(20, 60)] + [(1, k) for k in range(2, 15)] + [(100, 100), (9, 3)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {(k, 20) for k in range(20, 61)} | {(k, 1) for k in range(1, 15)}
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0
    assert math.isclose(st.PERCENT, 90)


def test_number_of_trees_follows_the_threshold():
    assert st.tree_count(90) == (12, 2) and st.tree_count(80) == (20, 2)
    for percent in (30, 50, 65, 80, 90, 99):
        trees, minima = st.tree_count(percent)
        assert (1 - (percent / 100) ** minima) ** trees <= st.MISS
        assert len(st.TreeNames(percent)(np.arange(9, dtype=np.uint64))) == trees


def test_pipeline_links_at_80_percent_of_five_words(spark):
    def shingles(text):
        w = text.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    base = [f"w{k}" for k in range(204)]
    near = [w if k not in (30, 80, 120, 160) else "new" for k, w in enumerate(base)]  # 20 of 200 shingles
    far = [w if k not in (20, 60, 100, 140, 180) else "new" for k, w in enumerate(base)]  # 25 of 200
    texts = [" ".join(x) for x in (base, near, far)]
    share = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert 0.8 <= share(texts[0], texts[1]) < 0.9 and share(texts[0], texts[2]) < 0.8 > share(texts[1], texts[2])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2]
    assert st.one_of_each(docs).count() == 3


def test_scattered_changes_of_a_line_are_matched(spark):
    base = [f"t{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}" for k in range(100)]
    change = lambda at: " ".join("new" if k in at else w for k, w in enumerate(base))
    few, many = {10, 50, 90}, set(range(4, 100, 2))
    assert not set(templates(change(()))) & set(templates(change(few)))
    rows = [(1, change(())), (2, change(few)), (3, change(range(5, 100, 7))), (4, change(many)), (5, change({0}))]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_dropped for r in got} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0}


def test_query_drops_recurring_short_lines(spark, tmp_path):
    script = "漢字だけの長い一行には空白がなく一つの語になる。" * 4
    rows = [(k, f"Menu\n\n{prose(900 + k, 20)}\nPage {k}\n{script}\nAll rights reserved.") for k in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id: r.text.split("\n") for r in queries.op2_lines(spark, str(tmp_path)).collect()}
    for line in ("Menu", script, "All rights reserved."):
        assert [k for k in sorted(kept) if line in kept[k]] == [0]
    assert all("" in lines_ and f"Page {k}" in lines_ for k, lines_ in kept.items())
