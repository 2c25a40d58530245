import math
import random
import time
import zlib

from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F
from tests.llm.conftest import prose, rows_of_trouble
from tracewell.llm import lattice, pieces, quality


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary()


def whole_viterbi(text: str, v: pieces.Vocabulary) -> list[int]:
    """All positions at once, without window or commits."""
    text = text.replace(pieces.MARK, pieces.LITERAL).replace(" ", pieces.MARK)
    place = {p: k for k, (p, s) in enumerate(zip(v.pieces, v.scores)) if s is not None}
    best, back = [0] + [None] * len(text), [None] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - v.longest), end):
            k = place.get(text[start:end])
            if k is not None and (best[end] is None or best[start] + v.scores[k] > best[end]):
                best[end], back[end] = best[start] + v.scores[k], (start, [k])
        if best[end] is None:
            spelled = v.spelled(text[end - 1])
            best[end], back[end] = best[end - 1] + v.byte_score * len(spelled), (end - 1, spelled)
    ids, at = [], len(text)
    while at:
        at, part = back[at]
        ids = part + ids
    return ids


TEXTS = ["", " ", "hello world", "  two  spaces ", "▁mark ▁▁ and é́😀漢字", prose(2, 80), "x" * 500, "thethethethe" * 30]


@pytest.mark.parametrize("text", TEXTS)
def test_streaming_equals_whole_search_and_decodes(vocabulary, text):
    want = whole_viterbi(text, vocabulary)
    assert pieces.Encoder(vocabulary).encode(text).tolist() == want
    assert pieces.Decoder(vocabulary).decode(np.array(want, dtype="<i4")) == text
    stream, ids = pieces.StreamingViterbi(vocabulary), []
    marked = text.replace(pieces.MARK, pieces.LITERAL).replace(" ", pieces.MARK)
    for at in range(0, len(marked), 7):
        ids += stream.feed(marked[at : at + 7])
    assert ids + stream.finish() == want


def test_stream_keeps_a_bounded_window(vocabulary):
    stream, most = pieces.StreamingViterbi(vocabulary), 0
    for _ in range(300):
        stream.feed("intheendofthestation")
        most = max(most, len(stream.best))
    assert most < 4 * (pieces.TRACE_EVERY + vocabulary.longest)


def test_encode_and_decode_documents(trouble, nothing):
    encoded = pieces.encode_documents(trouble)
    got = encoded.collect()
    assert all(r.exact for r in got)
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((r[0], len(r[1] or "")) for r in rows_of_trouble())
    assert all((r.ids is None) == (r.doc_id == 20) for r in got if r.doc_id is not None)
    back = pieces.decode_documents(encoded).collect()
    assert Counter(map(tuple, back)) == Counter((r[0], r[1]) for r in rows_of_trouble())
    assert pieces.encode_documents(nothing).count() == 0


def brute_base(rows):
    c, n = Counter(), 0
    for doc_id, text, *_ in rows:
        if zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2:
            tokens = [*(text or "").encode().lower().split(), None]
            c.update(tokens)
            n += len(tokens)
    out = []
    for doc_id, text, *_ in rows:
        tokens = [*(text or "").encode().lower().split(), None]
        base = sum(math.log10((c[t] + 1) / (n + len(c) + 1)) for t in tokens)
        out.append((str(doc_id), len(tokens), sum(c[t] > 0 for t in tokens), n, round(base, 6)))
    return Counter(out)


@pytest.mark.parametrize("frequent", [0, 20, 50_000])
def test_word_model_is_exact_whatever_the_route(trouble, frequent):
    got = lattice.score_documents(trouble, frequent=frequent).collect()
    mine = Counter((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert mine == brute_base(rows_of_trouble())


def test_lattice_of_nothing(nothing):
    assert lattice.score_documents(nothing).count() == 0


def test_lattice_sums_all_segmentations(vocabulary):
    model = lattice.PieceModel.of(vocabulary, np.zeros(len(vocabulary.pieces)), 3)

    def p_of(piece):
        level, p = model.tree, 0.0
        for char in piece:
            if char not in level:
                return 0.0
            level, p = level[char]
        return p

    def all_ways(text, at=0):
        if at == len(text):
            return 1.0
        spelled = math.prod(model.byte_p[b] for b in (" " if at == 0 else text[at]).encode())
        total = spelled * all_ways(text, at + 1)
        for end in range(at + 1, len(text) + 1):
            if p := p_of(text[at:end]):
                total += p * all_ways(text, end)
        return total

    for word in ("the", "station", "é漢x"):
        assert model.log10(word) == pytest.approx(math.log10(all_ways("▁" + word)))
    assert model.log10("station" * 400) == pytest.approx(400 * model.log10("station") , rel=0.3)
    assert math.isfinite(model.log10("漢" * 3000))


def labelled(spark):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for k in range(400):
        text = prose(7, 60 + k % 40)[k % 30 :]
        low, toxic = k % 5 == 0, k % 7 == 0
        if low:
            text = " ".join(f"{w}&&&" for w in text.split())
        if toxic:
            text += " vile" * 3 + " wretch"
        docs.append((k, text, "en", "good.org" if k % 3 else "junk.net", len(text)))
        if k % 2:
            labels.append((k, int(not low), int(toxic)))
    rng.shuffle(docs)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_on_rows_without_labels(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r.keep for r in quality.judge_documents(docs, labels).collect()}
    right = sum(got[k] == (k % 5 != 0 and k % 7 != 0) for k in got if not k % 2)
    assert right >= 0.95 * sum(1 for k in got if not k % 2)


def test_sparse_sites_shrink_toward_their_host(spark):
    rows = [("a", "x", 0.9, 0.1)] * 200 + [("a", "y", 0.1, 0.1)] + [("b", "x", 0.1, 0.1)] * 200 + [("c", None, 0.9, 0.1)]
    scores = spark.createDataFrame(rows, "host string, path string, p_low double, p_toxic double")
    got = {(r._host, r._path): r for r in quality.site_rates(scores).collect()}
    assert got["a", "x"].host_low > 0.8 > 0.2 > got["b", "x"].host_low
    assert 0.3 < got["c", None].host_low < 0.9
    assert len(got) == 4


def test_posteriors_against_plain_computation(spark):
    docs, labels = labelled(spark)
    site = docs.selectExpr(
        "doc_id", "text", "IF(doc_id % 9 = 0, NULL, CAST(doc_id % 4 AS string)) AS source", "IF(doc_id % 40 < 3, 'rare', CAST(doc_id % 2 AS string)) AS lang"
    )
    got = quality.judge_documents(site, labels).collect()
    models = quality.train(site, labels)
    for kind in quality.KINDS:
        p = {r.doc_id: r[f"p_{kind}"] for r in got}
        hosts, paths = {}, {}
        for r in got:
            hosts.setdefault(r.host, []).append(p[r.doc_id])
            paths.setdefault((r.host, r.path), []).append(p[r.doc_id])
        overall = (sum(p.values()) + 0.5) / (len(p) + 1)

        def strength(groups):
            """From (sum, n, mean) of each group: variance within over variance between, less chance."""
            n = sum(g[1] for g in groups)
            spread = sum(k * (s / k - m) ** 2 for s, k, m in groups)
            between = (spread - sum(m * (1 - m) for _, _, m in groups)) / sum(k * m * (1 - m) for _, k, m in groups)
            assert n == len(p)
            low, high = quality.STRENGTHS
            return min(max(1 / between - 1, low), high) if between > 0 else high

        k = strength([(sum(v), len(v), overall) for v in hosts.values()])
        rate = {h: (k * overall + sum(v)) / (k + len(v)) for h, v in hosts.items()}
        k = strength([(sum(v), len(v), rate[h]) for (h, _), v in paths.items()])
        base = math.log(models[kind].rate / (1 - models[kind].rate))
        for r in got:
            v = paths[r.host, r.path]
            own = min(max((k * rate[r.host] + sum(v) - p[r.doc_id]) / (k + len(v) - 1), 1e-6), 1 - 1e-6)
            odds = math.log(p[r.doc_id] / (1 - p[r.doc_id])) - base + math.log(own / (1 - own))
            assert r[f"site_{kind}"] == pytest.approx(own, rel=1e-6)
            assert r[f"posterior_{kind}"] == pytest.approx(1 / (1 + math.exp(-odds)), rel=1e-4, abs=1e-9)
    assert all(r.keep == (max(r.posterior_low, r.posterior_toxic) < quality.REJECT_AT) for r in got)


def test_repeated_labelled_ids_keep_the_sample_bounded(spark):
    docs, labels = labelled(spark)
    many = docs.union(docs).union(docs.withColumn("text", F.concat("text", F.lit(" more"))))
    sample = quality.labelled_sample(many, labels, 50).collect()
    assert len(sample) == len({r.doc_id for r in sample}) == 50
    alone = {r.doc_id: r.text for r in quality.labelled_sample(docs, labels, 50).collect()}
    assert alone == {r.doc_id: r.text for r in sample}


def test_hosts_and_paths_of_urls(spark):
    docs, labels = labelled(spark)
    pages = docs.withColumn("url", F.concat(F.lit("https://h"), F.expr("doc_id % 3"), F.lit(".example/p"), F.expr("doc_id % 2"), F.lit("/x")))
    got = quality.judge_documents(
        pages, labels, F.parse_url("url", F.lit("HOST")), F.regexp_extract(F.parse_url("url", F.lit("PATH")), "^/[^/]*", 0)
    )
    sites = {(r.host, r.path) for r in got.select("host", "path").distinct().collect()}
    assert sites == {(f"h{h}.example", f"/p{p}") for h in range(3) for p in range(2)}


def test_classifier_of_trouble(spark, trouble, nothing):
    labels = spark.createDataFrame([(0, 1, 0), (1, None, 0), (None, 0, 0), (2, 1, None)], "doc_id long, quality int, toxic int")
    got = quality.judge_documents(trouble, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows_of_trouble()) and all(r.keep for r in got)
    assert quality.kept_documents(trouble, labels).count() == len(rows_of_trouble())
    docs, real = labelled(spark)
    mixed = quality.judge_documents(docs.select("*", F.lit(1).alias("keep")), real.union(real)).count()
    assert mixed == 400
    assert quality.judge_documents(nothing, labels.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a    b", "if x:\n        return  y", " " * 40 + "z", "a \u2581  \u2581b", "end   "])
def test_runs_of_spaces_use_their_pieces(vocabulary, text):
    ids = pieces.Encoder(vocabulary).encode(text).tolist()
    assert ids == whole_viterbi(text, vocabulary)
    assert any(pieces.MARK in vocabulary.pieces[i][1:] for i in ids)
    assert pieces.Decoder(vocabulary).decode(np.array(ids, dtype="<i4")) == text


def strange(rng: random.Random) -> str:
    """URLs, base64, glued words, CJK, one word per line, repeated characters, of 1 to 5 000 code points."""
    glued = prose(rng.randrange(50), 30).replace(" ", "").replace("\n", "")
    kinds = [
        lambda: "https://" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789/-_.?=&%", k=rng.randint(1, 500))),
        lambda: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=rng.randint(1, 700))),
        lambda: (glued * 40)[: rng.randint(1, 900)],
        lambda: "".join(chr(rng.randint(0x4E00, 0x4E60)) for _ in range(rng.randint(1, 200))),
        lambda: prose(rng.randrange(50), 60).replace(" ", "\n"),
        lambda: rng.choice("xaé漢 =-▁") * rng.randint(1, 800),
        lambda: " ".join("".join(rng.choices("theinand  ", k=90)) for _ in range(4)),
    ]
    return "".join(rng.choice(kinds)() for _ in range(rng.choice([1, 1, 1, 2, 6])))[: rng.choice([70, 500, 5000])]


def test_strange_texts_in_any_portions(vocabulary, monkeypatch):
    rng = random.Random(11)
    encoder, decoder = pieces.Encoder(vocabulary), pieces.Decoder(vocabulary)
    for case in range(1500):
        text = strange(rng)
        monkeypatch.setattr(pieces, "PORTION", rng.choice([1, 5, 64, 65, 4096]))
        want = whole_viterbi(text, vocabulary)
        assert encoder.encode(text).tolist() == want, text
        assert decoder.decode(np.array(want, dtype="<i4")) == text
        if case % 5 == 0:
            stream, ids, at = pieces.StreamingViterbi(vocabulary), [], 0
            marked = text.replace(pieces.MARK, pieces.LITERAL).replace(" ", pieces.MARK)
            while at < len(marked):
                step = rng.randint(1, 200)
                ids += stream.feed(marked[at : at + step])
                at += step
            assert ids + stream.finish() == want, text


@pytest.mark.parametrize("unit", ["x", "https://a.b/c?d=1&", "dGhlIHF1aWNr+/", "漢字かな"])
def test_time_grows_with_the_text(vocabulary, unit):
    def seconds(n: int) -> float:
        text = (unit * (n // len(unit) + 1))[:n]
        began = time.process_time()
        encoded = pieces.Encoder(vocabulary).encode(text)
        took = time.process_time() - began
        assert pieces.Decoder(vocabulary).decode(encoded) == text
        return took

    short, long = seconds(100_000), seconds(800_000)
    assert long < 16 * max(short, 0.05)


def test_documents_without_spaces(spark, vocabulary):
    rng = random.Random(12)
    texts = [strange(rng) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in pieces.encode_documents(docs).collect()}
    assert all(got[k].exact and list(got[k].ids) == whole_viterbi(t, vocabulary) for k, t in enumerate(texts))
