import os

from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.conftest import DOCUMENTS, prose
from tests.oracle_check import compare, connect
from tracewell.llm import vector_graph as vg
from tracewell.llm.common import materialise

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, space int, m int"


def cloud(seed, centres, copies, noise, dim=24):
    rng = np.random.default_rng(seed)
    for c in rng.normal(size=(centres, dim)):
        for _ in range(copies):
            yield (c + rng.normal(size=dim) * noise).astype(np.float32).tolist()


def brute(rows):
    usable = {
        i: np.array(v, dtype=np.float64)
        for i, (_, v, label, *_) in enumerate(rows)
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)
    }
    links, up = Counter(), {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in usable.items():
        for j, b in usable.items():
            if i < j and rows[i][2] == rows[j][2] and len(a) == len(b):
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                    links[rows[i][0]] += 1
                    links[rows[j][0]] += 1
                    x, y = root(rows[i][0]), root(rows[j][0])
                    up[max(x, y)] = min(x, y)
    return {r[0]: (links[r[0]], root(r[0])) for r in rows}


@pytest.mark.parametrize("cell", [1000, 60])
def test_vectors_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(vg, "CELL_ROWS", cell)
    monkeypatch.setattr(vg, "BLOCK_ROWS", 4 * cell)
    vectors = [*cloud(1, 30, 6, 0.05), *cloud(2, 1, 80, 0.02), *cloud(3, 60, 1, 0.0)]
    rows = [(k, v, k % 2) for k, v in enumerate(vectors)]
    rows += [(1000, vectors[0], 0), (1001, vectors[0], 0), (1002, [2 * x for x in vectors[0]], 0), (1003, vectors[0], None)]
    rows += [(1004, [0.0] * 24, 0), (1005, None, 0), (1006, [], 0), (1007, [None] + vectors[0][1:], 0)]
    rows += [(1008, [float("nan")] * 24, 0), (1009, [float("inf")] * 24, 0), (1010, vectors[0][:12], 0)]
    docs = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA).repartition(3)
    got = vg.near_duplicates(docs).collect()
    want = brute(rows)
    assert sum(r.n_links for r in got) >= 0.97 * sum(n for n, _ in want.values())
    assert all(r.n_links <= want[r.vec_id][0] for r in got) and len(got) == len(rows)
    assert sum(r.component_id == want[r.vec_id][1] for r in got) >= 0.98 * len(rows)
    assert all(r.kept == (r.component_id == r.vec_id) for r in got)


def planted(seed, pairs, singles, dim=24):
    """Isolated pairs just above the threshold among vectors that link with nothing."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(pairs):
        a, b = rng.normal(size=(2, dim))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        c = 0.981 + 0.018 * rng.random()
        b = c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)
        rows += [(2 * k, a.tolist(), 0), (2 * k + 1, b.tolist(), 0)]
    return rows + [(2 * pairs + k, rng.normal(size=dim).tolist(), 0) for k in range(singles)]


def test_sparse_planted_pairs(spark):
    rows = planted(5, 400, 4200)  # five cells
    docs = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA.replace("float", "double")).repartition(4)
    got = {r.vec_id: r for r in vg.near_duplicates(docs).collect()}
    want = {2 * k + j: 2 * k for k in range(400) for j in (0, 1)}
    found = sum(got[i].component_id == c and got[i].n_links == 1 for i, c in want.items())
    assert found >= 0.99 * len(want)
    assert all(r.n_links == 0 for i, r in got.items() if i not in want)
    assert got[0].audited_recall >= 0.99


def test_audit_has_evidence_or_says_nothing(spark):
    rows = [(k, v, 0, 1, 1) for k, v in enumerate(cloud(9, 40, 1, 0.0))]
    assert {r.audited_recall for r in vg.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == {None}
    # one large cluster is found, the isolated pairs are not: the average tells
    rows = [(k, v, 0, 1, 1) for k, v in enumerate([*cloud(2, 1, 20, 0.01), *cloud(4, 20, 2, 0.01)])]
    classes = vg._classes(spark.createDataFrame(rows, SCHEMA))
    linked = spark.createDataFrame([(k, 19) for k in range(20)], "rep long, links long")
    assert vg.audit(classes, linked, vg.THRESHOLD) == pytest.approx(1 / 3)


def test_low_recall_ends_in_an_exact_search(spark, monkeypatch):
    monkeypatch.setattr(vg, "CELL_ROWS", 60)
    monkeypatch.setattr(vg, "BLOCK_ROWS", 40)
    monkeypatch.setattr(vg, "ROUNDS", 1)
    told = []
    real = vg.audit
    monkeypatch.setattr(vg, "audit", lambda *a: 0.5 if not told.append(1) and len(told) == 1 else real(*a))
    rows = [*planted(6, 60, 200), *[(1000 + k, v, 0) for k, v in enumerate(cloud(7, 1, 50, 0.1))]]
    docs = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA.replace("float", "double"))
    got = vg.near_duplicates(docs).collect()
    assert len(told) == 2 and {(r.vec_id, r.n_links, r.component_id) for r in got} == {
        (i, *v) for i, v in brute(rows).items()
    }
    assert {r.audited_recall for r in got} == {1.0}


def test_vectors_without_ids_and_none_at_all(spark):
    rows = [(None, [1.0, 0.0], 1, 1, 1), (5, [1.0, 0.0], 1, 1, 1), (5, [1.0, 0.0], 1, 1, 1)]
    got = sorted(map(str, (tuple(r)[:4] for r in vg.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())))
    assert got == ["(5, 1, 5, True)", "(5, 1, 5, True)", "(None, 0, None, True)"]
    assert vg.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pruned_graph_finds_its_way(monkeypatch):
    x = vg.unit(list(cloud(4, 200, 2, 0.05, dim=32)))
    graph = vg.Graph(x).build()
    assert graph.filled.max() <= graph.room and graph.filled.min() >= 1
    lists = [row[:k] for row, k in zip(graph.adjacent, graph.filled)]
    found = vg.Graph.of_lists(x, lists, vg.BEAM)
    q, node = found.within(x, np.stack([np.full(len(x), found.medoid), np.arange(len(x))], axis=1), 0.98)
    true = np.argwhere((x @ x.T) >= 0.98)
    assert len(set(zip(q.tolist(), node.tolist())) & set(map(tuple, true.tolist()))) >= 0.97 * len(true)


def write_tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_stage_by_stage(spark, tmp_path):
    texts = [prose(k, 200) for k in range(40)]
    junk = [" ".join(f"{w}$$$" for w in prose(100 + k, 100).split()) for k in range(20)]
    rows = [(k, t, "en", f"s{k % 4}", len(t)) for k, t in enumerate(texts + junk)]
    rows += [(90, texts[0], "en", "s0", 1), (91, None, None, None, None), (92, "", "en", "s1", 0), (None, "no id here at all", "en", "s1", 2)]
    labels = [(k, int(k < 40), 0) for k in range(0, 60, 2)]
    folder = str(tmp_path / "sf")
    write_tables(spark, folder, rows, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    left = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, folder), "stage")
        left.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
    kept = {r.doc_id for r in left[0]}
    assert set(range(40)) <= kept and len(kept & set(range(40, 60))) <= 1 and None in kept
    assert next(r for r in left[1] if r.doc_id == 90).text == "" and len(left[1]) == len(left[0])
    assert all(r.exact for r in left[4]) and len(left[4]) == len(left[3])
    final = Counter(map(str, corpus_pipeline.run(spark, folder).collect()))
    assert final == Counter(map(str, left[4]))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")
def test_all_are_registered(spark):
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    tables = connect(SF_DIR)
    for name, sql in entry.oracle_sql().items():
        if name.startswith("op") or name == "pipeline":
            assert compare(spark, tables, name, names[name], sql, SF_DIR) is None
