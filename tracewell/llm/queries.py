"""Registered corpus queries: each operator on its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.common import table
from tracewell.llm.contamination import contamination_report
from tracewell.llm.lattice import score_documents
from tracewell.llm.lexical import ranked_search
from tracewell.llm.lines import dedup_lines
from tracewell.llm.mixing import mix_sources
from tracewell.llm.phrases import fingerprint_documents
from tracewell.llm.pieces import encode_documents
from tracewell.llm.prefix_trie import opened_trie
from tracewell.llm.quality import judge_documents
from tracewell.llm.secret_scan import find_secrets
from tracewell.llm.shards import kd_shards
from tracewell.llm.signature_tree import jaccard_components
from tracewell.llm.vector_graph import near_duplicates

Query = Callable[[SparkSession, str], DataFrame]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return kd_shards(docs, ["doc_id", "n_chars", "lang", "source"], shards=24)


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), short=True).select(
        "doc_id", "text", "n_lines", "n_dropped"
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op4_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


def op7_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def op11_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened_trie(table(spark, sf_dir, "conversations"))


def op13_best_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_sharding": op1_sharding,
    "op2_lines": op2_lines,
    "op3_secret_scan": op3_secret_scan,
    "op4_vector_graph": op4_vector_graph,
    "op5_fingerprints": op5_fingerprints,
    "op6_source_mix": op6_source_mix,
    "op7_signature_tree": op7_signature_tree,
    "op8_quality": op8_quality,
    "op9_lattice": op9_lattice,
    "op10_pieces": op10_pieces,
    "op11_contamination": op11_contamination,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_best_positions": op13_best_positions,
}
# Links by brute force, then the smallest id that links lead to.
_REACHED = """
reached AS (SELECT id, id AS other FROM nodes UNION
    SELECT r.id, l.b FROM reached r JOIN links l ON l.a = r.other),
named AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)"""

_TERMS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

CHECKS: dict[str, str] = {
    "op4_vector_graph": f"""WITH RECURSIVE
nodes AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT p.id AS a, q.id AS b FROM nodes p JOIN nodes q ON p.label = q.label
    AND p.id <> q.id AND len(p.v) = len(q.v) AND list_cosine_similarity(p.v, q.v) >= 0.98),
{_REACHED}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
    coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept,
    CASE WHEN EXISTS (SELECT 1 FROM links) THEN 1.0::DOUBLE END AS audited_recall
FROM embeddings LEFT JOIN named ON id = vec_id""",
    "op7_signature_tree": f"""WITH RECURSIVE
split AS (SELECT doc_id AS id, list_filter(string_split_regex(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
        lambda x: x <> '') AS w FROM documents),
nodes AS (SELECT id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1),
        lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM split),
words AS (SELECT id, len(s) AS n, unnest(s) AS x FROM nodes),
links AS (SELECT p.id AS a, q.id AS b FROM words p JOIN words q ON p.x = q.x AND p.id <> q.id
    AND 100 * p.n >= 90 * q.n AND 100 * q.n >= 90 * p.n
    GROUP BY p.id, q.id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
{_REACHED}
SELECT id AS doc_id, coalesce(len(s), 0) AS n_shingles, component_id FROM nodes JOIN named USING (id)""",
    "op11_contamination": f"""WITH
texts AS (SELECT doc_id, {_TERMS} AS w FROM documents),
item AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS s
    FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT k FROM windows),
runs AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
    FROM texts, lengths, unnest(range(1, len(w) - k + 2)) AS t(i)),
found AS (SELECT doc_id, i, k, item_id FROM runs JOIN windows USING (k, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(name, ',' ORDER BY name)) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    coalesce(items, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM texts LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    "op12_prefix_trie": """WITH
turns AS (SELECT conv_id, turn, length(coalesce(text, '')) AS chars, md5(length(coalesce(role, '')) || ':'
    || coalesce(role, '') || coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'t': t, 'chars': chars} ORDER BY turn NULLS FIRST, chars || ':' || t) AS path,
    list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
        lambda x: [unicode(x), 0, 0, 0, 0, 0, 0, 0]))), lambda c, x:
        xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384 ELSE 0 END)) AS crc
    FROM turns GROUP BY conv_id),
rebuilt AS (SELECT o.conv_id, list_concat(coalesce(list_slice(b.path, 1, xor(o.crc, 4294967295) % 6), []),
        list_slice(o.path, xor(o.crc, 4294967295) % 6 + 1, len(o.path))) AS path
    FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
nodes AS (SELECT d AS depth, list_slice(path, 1, d) AS pre, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
            FILTER (len(path) = d), '')) AS ends_sha256
    FROM rebuilt, unnest(range(len(path) + 1)) AS t(d) GROUP BY d, pre),
children AS (SELECT depth - 1 AS depth, list_slice(pre, 1, depth - 1) AS pre, count(*) AS n
    FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (depth, pre)),
above AS (SELECT up AS depth, list_slice(pre, 1, up) AS pre, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves,
        CAST(sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * pre[depth].chars END) AS BIGINT) AS saved_tokens
    FROM counted, unnest(range(depth + 1)) AS t(up) GROUP BY ALL)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens,
    c.ends_sha256
FROM counted c JOIN above USING (depth, pre)
LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.pre = list_slice(c.pre, 1, c.depth - 1)""",
    "op13_best_positions": f"""WITH
texts AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
total AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM texts WHERE len(w) > 0),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM texts)
    WHERE t IN (SELECT t FROM asked) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM tf, total GROUP BY t),
scored AS (SELECT item_id, doc_id, r, CAST(sum(w.w * ((1000000000 * tf) //
        (1000 * tf + 20 * (50 + (50 * len(texts.w) * n) // l)))) AS BIGINT) AS score
    FROM asked JOIN tf USING (t) JOIN w USING (t) JOIN texts USING (r), total
    GROUP BY item_id, doc_id, r),
ranked AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id
    ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""",
}
