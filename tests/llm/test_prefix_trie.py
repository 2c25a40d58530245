import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.llm.conftest import CLASHING
from tests.oracle_check import compare, connect
from tracewell.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows, opened):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, f"{len(text)}:{digest}", (role, text)))
    own = {c: [t[3] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in own.items()}
    if not opened:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - int(math.fmod(c, 100)), [])[: h[c]] + ts[h[c] :] for c, ts in own.items()}


def brute(rows, opened):
    paths = rebuilt(rows, opened)
    members = {}
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(conv)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    found = []
    for node, convs in members.items():
        below, todo = [], [node]
        while todo:
            below.append(todo.pop())
            todo += children.get(below[-1], [])
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(node))
        found.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, [])),
            sum(1 for x in below if x not in children),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(found, key=str)


def conversations(seed):
    rng = random.Random(seed)
    say = ["hi", "ho", "", "Äh 漢😀", "x" * 300]
    rows = []
    for conv in [*range(0, 30), *range(95, 108), *range(200, 206), 310, 311, -5, -105]:
        for turn in range(rng.choice([1, 2, 3, 4, 7, 8, 9, 16, 17, 23])):
            rows.append((conv, turn, rng.choice(["user", "bot"]) if turn > 3 else "user", rng.choice(say[: 1 + turn % 5])))
    rows += [(conv, turn, "user", "copy") for conv in range(1000, 1040) for turn in range(3)]  # one common conversation
    rows += [(400, k, "user", f"turn {k}") for k in range(500)]  # one long one
    rows += [(401, k, "user", f"turn {k}") for k in range(490)]
    rows += [(500, None, None, None), (500, None, "", ""), (500, 1, "user", None), (501, 1, "a", "b"), (501, 1, "a", "b"), (501, 1, "", "ab")]
    rows += [(502, 7, "user", "late"), (502, -3, "user", "early"), (None, 1, "user", "nobody's"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("opened", [True, False])
def test_against_brute_force(spark, opened):
    rows = conversations(3)
    extra = [F.lit(7).alias(c) for c in (*CLASHING, "pos", "block", "t1", "a", "b", "level", "depth", "h", "base")]
    table = spark.createDataFrame(rows, SCHEMA).select("*", *extra).repartition(3)
    got = (pt.opened_trie if opened else pt.prefix_trie)(table).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, opened)


def test_parts_and_packs_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(pt, "PACK", 4)
    rows = conversations(4)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:  # many parts, so that conversations and groups of copies lie in several
        spark.conf.set("spark.sql.shuffle.partitions", 13)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = pt.opened_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert sorted(map(tuple, got), key=str) == brute(rows, True)


def test_none_and_only_turnless_ones(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert not pt.opened_trie(none).count() and not pt.prefix_trie(none).count()
    bare = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(bare, 0, "user", "gone")]  # no opening to take, and its own turn is cut off
    empty = hashlib.sha256(str(bare).encode()).hexdigest()
    got = pt.opened_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(bare, 0, None, 1, 0, 1, 0, empty)]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    name = "op12_prefix_trie"
    assert compare(spark, connect(sf), name, entry.queries()[name], entry.oracle_sql()[name], sf) is None
