import random
import re
import zlib

from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import rows_of_trouble
from tracewell.llm import mixing, shards

DIMS = ["doc_id", "n_chars", "lang", "source"]


def bytes_of(text):
    return len((text or "").encode()) + 8


def test_shards_hold_every_row_once_with_gapless_slots(trouble):
    got = shards.kd_shards(trouble, DIMS, shards=5).collect()
    want = Counter((r[0], bytes_of(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows_of_trouble())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))


def test_shards_are_of_near_equal_bytes_even_when_all_rows_are_equal(spark):
    rows = [(1, "x" * 92, "en", "s", 92)] * 600 + [(k, "y" * (k % 50), "de", f"t{k % 4}", k % 50) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sizes = Counter()
    for r in shards.kd_shards(docs, DIMS, shards=7).collect():
        sizes[r.shard] += r["size"]
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 300


def test_shards_by_target_bytes_and_of_nothing(trouble, nothing):
    total = sum(bytes_of(r[1]) for r in rows_of_trouble())
    got = shards.kd_shards(trouble, DIMS, target_bytes=total // 2).select("shard").distinct().count()
    assert got in (2, 3)
    assert shards.kd_shards(nothing, DIMS, shards=4).count() == 0


def level_targets(sizes: dict, cap: float = 3.0) -> dict:
    """Shares by weight; what is above a cap is shared again, one round after the other."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, left = dict.fromkeys(order, 0.0), set(order), float(sum(sizes.values()))
    while left > 1e-9 and free:
        share = left / sum(weight[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += share * weight[s]
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                free.discard(s)
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix_meets_targets_and_agrees_with_itself(trouble):
    got = mixing.mix_sources(trouble).collect()
    sizes = Counter()
    for r in rows_of_trouble():
        sizes[r[3]] += words(r[1])
    want = level_targets(sizes)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], words(r[1])) for r in rows_of_trouble())
    taken, longest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r["size"])
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
    again = mixing.mix_sources(trouble.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mix_in_a_tree_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = [(k, "w " * (k % 17), "big" if k % 3 else f"s{k % 5}") for k in range(600)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(got) == 600 and all(abs(taken[s] - target[s]) <= 16 for s in target)


def test_exchange_keeps_expected_words():
    up, _ = mixing.exchange(0.3, 10, 0.8, 4, 0.0)
    for draw in (0.0, 0.999):
        p, q = mixing.exchange(0.3, 10, 0.8, 4, draw)
        assert p * 10 + q * 4 == pytest.approx(0.3 * 10 + 0.8 * 4)
        assert any(min(abs(x), abs(1 - x)) < 1e-9 for x in (p, q))
    assert up > 0.3


def test_mixed_documents_repeat_rows(trouble, nothing):
    copies = Counter()
    for r in mixing.mix_sources(trouble).collect():
        copies[r.doc_id, r["size"]] += r.copies
    got = mixing.mixed_documents(trouble)
    assert got.columns == trouble.columns
    assert Counter((r.doc_id, words(r.text)) for r in got.collect()) == +copies
    assert mixing.mix_sources(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_copies_stay_with_their_source(spark):
    """Rows of one id and size in two sources, without an id, and repeated more often than a bucket holds."""
    rows = [(k % 40, " ".join(f"{s}{k}w{j}" for j in range(3 + k % 7)), s) for k in range(400) for s in "ab"]
    rows += [(None, f"x y z {s}", s) for s in "abc" for _ in range(300)] + [(5, "one two", None)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, got = Counter(), Counter()
    for r in mixing.mix_sources(docs).collect():
        want[r.doc_id, r["size"], r.source] += r.copies
    delivered = mixing.mixed_documents(docs.repartition(3)).collect()
    for r in delivered:
        got[r.doc_id, words(r.text), r.source] += 1
    assert got == +want
    per_row = Counter((r.doc_id, r.text, r.source) for r in delivered)
    had = Counter(rows)
    assert all(n <= 3 * had[row] for row, n in per_row.items())


def test_a_long_open_document_is_made_up_for(spark, monkeypatch):
    rng = random.Random(2)
    sizes = [20_000] + [rng.randint(1, 900) for _ in range(49)]
    rows = [(k, "w " * n, f"s{s}") for s in range(6) for k, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = Counter(), {}
    for r in mixing.mix_sources(docs).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in target)


def test_a_row_repeated_very_often_is_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 8)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 32)
    docs = spark.createDataFrame([(1, "a b c", "s")] * 900 + [(2, "a b", "t")] * 100, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    assert len(got) == 1000 and all(abs(taken[r.source] - r.target) <= 3 for r in got)
