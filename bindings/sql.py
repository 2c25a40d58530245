"""The registered queries as SQL, to check results on another engine.

``CHECKS`` has one statement per query name. The common table expressions mirror the frames of
``bindings.tables``; a statement gets those it mentions, directly or through another.
"""

from __future__ import annotations

import re

from bindings.tables import (
    ALIGNED,
    EVENT_SENSORS,
    EVENT_TYPES,
    MANY_SENSORS,
    TOOLS,
    WIDE_SENSORS,
)
from tracewell.operators.telemetry import EVENT_FIELDS

CTES = {
    "wide": """SELECT 'tool_' || (l_suppkey % 8) AS tool_id, l_shipdate AS ts,
        l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""",
    "long": """SELECT 'tool_' || (user_id % 8) AS tool_id, ts, event_type AS sensor, value
        FROM events""",
    "sparse": "SELECT tool_id, ts, "
    + ", ".join(f"CASE WHEN sensor = '{s}' THEN value END AS {s}" for s in EVENT_SENSORS)
    + " FROM long",
    "file_index": """SELECT file_id, tool_id, hour_bucket, min_ts, max_ts, row_count,
        row_count * 32 AS size_bytes,
        CASE WHEN row_count % 4 <> 0 THEN sha256(file_id || ':' || (row_count % 3)) END AS sha256,
        month(min_ts) = 1 AS pinned, month(min_ts) = 12 AS archived
        FROM (SELECT tool_id || '/' || strftime(ts, '%Y-%m') || '.parquet' AS file_id, tool_id,
              strftime(ts, '%Y-%m') AS hour_bucket, min(ts) AS min_ts, max(ts) AS max_ts,
              count(*) AS row_count FROM wide GROUP BY 1, 2, 3)""",
    "scanned_index": """SELECT tool_id || '/' || hour_bucket || '.parquet' AS file_id, tool_id,
        hour_bucket, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS row_count,
        count(*) * 128 AS size_bytes
        FROM (SELECT 'tool_' || (o_custkey % 8) AS tool_id, o_orderdate AS ts,
              strftime(o_orderdate, '%Y-%m') AS hour_bucket FROM orders) GROUP BY ALL""",
    "undated": """SELECT 'tool_' || (l_suppkey % 8) AS tool_id,
        CASE WHEN l_orderkey % 7 <> 0 THEN l_shipdate END AS ts,
        l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""",
    "manifest": """SELECT file_id, tool_id,
        CASE WHEN n % 4 = 1 THEN 'https://files/' || file_id ELSE '/v1/data/' || file_id END AS url,
        CASE WHEN n % 5 > 1 THEN sha256(file_id || ':' || (n % 3)) END AS sha256,
        CASE WHEN n % 7 = 0 THEN 0 ELSE n * 32 END AS size_bytes
        FROM (SELECT tool_id || '/' || month || '.parquet' AS file_id, tool_id, count(*) AS n
              FROM (SELECT 'tool_' || (o_custkey % 8) AS tool_id,
                    strftime(o_orderdate, '%Y-%m') AS month FROM orders) GROUP BY ALL)""",
    "downloads": """SELECT m.file_id, m.tool_id, m.url, m.sha256, m.size_bytes,
        CASE WHEN f.file_id IS NULL THEN 'absent'
             WHEN m.sha256 IS NOT NULL AND f.sha256 IS NULL THEN 'no_local_checksum'
             ELSE 'changed' END AS why
        FROM manifest m LEFT JOIN file_index f ON f.file_id = m.file_id
        WHERE f.file_id IS NULL OR (m.sha256 IS NOT NULL AND f.sha256 IS NULL)
           OR m.sha256 <> f.sha256""",
    "gone": "SELECT * FROM file_index WHERE file_id NOT IN (SELECT file_id FROM manifest)",
    "aged": """SELECT *, NOT pinned AND max_ts <= (SELECT max(max_ts) FROM file_index)
        - INTERVAL 1826 DAY AS old FROM file_index""",
    "room": """SELECT *, (sum(size_bytes) OVER (ORDER BY max_ts DESC, file_id ROWS UNBOUNDED PRECEDING)
        + (SELECT coalesce(sum(size_bytes), 0) FROM aged WHERE pinned))::BIGINT AS bytes_kept
        FROM aged WHERE NOT pinned AND NOT old""",
    "map_lines": """SELECT 'group_' || (l_orderkey % 3) AS prc_group_id,
        'tool_' || (l_suppkey % 8) AS tool_id, 'part_' || l_partkey AS canonical_name,
        CASE WHEN l_linenumber NOT IN (5, 6)
             THEN 'col_' || (l_orderkey % 97) || '_' || l_linenumber END AS raw_name,
        l_orderkey * 8 + l_linenumber AS ord FROM lineitem""",
    "mapping": """SELECT tool_id, canonical_name, arg_max(raw_name, ord) AS raw_name
        FROM map_lines WHERE raw_name IS NOT NULL GROUP BY ALL""",
    "tool_group": """SELECT tool_id, arg_min(prc_group_id, ord) AS prc_group_id
        FROM map_lines GROUP BY ALL""",
    "canonical": """SELECT 'group_' || (p_partkey % 2 * 2) AS prc_group_id,
        'part_' || p_partkey AS canonical_name, p_name AS description,
        CASE WHEN p_size % 3 = 1 THEN p_type END AS units,
        CASE WHEN p_size % 5 <> 0 THEN 'cat_' || p_size END AS category_id,
        p_partkey AS ord FROM part""",
    "category": """SELECT 'cat_' || p_size AS category_id,
        arg_max('Size ' || p_size || ' ' || p_brand, p_partkey) AS name,
        CASE WHEN p_size % 2 = 1 THEN arg_max(p_type, p_partkey) END AS parent_id
        FROM part WHERE p_size <= 40 GROUP BY p_size""",
    "cells": """SELECT prc_group_id, canonical_name, tool_id, raw_name
        FROM canonical JOIN tool_group USING (prc_group_id)
        LEFT JOIN mapping USING (tool_id, canonical_name)""",
    "raw_units": """SELECT DISTINCT 'tool_' || (l_suppkey % 8) AS tool_id,
        'col_' || (l_orderkey % 97) || '_' || l_linenumber AS raw_name,
        CASE WHEN l_linenumber <> 4 THEN 'u' || (l_orderkey % 97 % 3) END AS raw_unit
        FROM lineitem WHERE l_linenumber NOT IN (5, 6)""",
    "usual": """SELECT prc_group_id, canonical_name, raw_unit AS usual FROM (
        SELECT prc_group_id, canonical_name, raw_unit, row_number() OVER (
            PARTITION BY prc_group_id, canonical_name ORDER BY count(*) DESC, raw_unit) AS place
        FROM cells JOIN raw_units USING (tool_id, raw_name) WHERE raw_unit IS NOT NULL
        GROUP BY prc_group_id, canonical_name, raw_unit) WHERE place = 1""",
    "judged": """SELECT l.*, u.raw_unit, coalesce(c.units, usual) AS expected,
        CASE WHEN l.raw_name IS NULL THEN 'empty'
             WHEN count(l.raw_name) OVER (PARTITION BY prc_group_id, tool_id, l.raw_name) > 1 THEN 'duplicate'
             WHEN u.raw_unit <> coalesce(c.units, usual) THEN 'units_mismatch' ELSE 'ok' END AS state
        FROM cells l JOIN canonical c USING (prc_group_id, canonical_name)
        LEFT JOIN usual USING (prc_group_id, canonical_name)
        LEFT JOIN raw_units u USING (tool_id, raw_name)""",
    "labels": """SELECT c.prc_group_id, c.canonical_name AS sensor,
        c.canonical_name || CASE WHEN c.units IS NULL THEN '' ELSE ' (' || c.units || ')' END
            AS label,
        coalesce(g.name, c.category_id, 'Other') AS category,
        c.category_id IS NULL AS uncategorised, coalesce(c.units, '') AS units,
        coalesce(c.description, '') AS description
        FROM canonical c LEFT JOIN category g USING (category_id)""",
    "raw_catalog": """SELECT DISTINCT tool_id, sensor AS raw_name,
        CASE WHEN sensor LIKE '%i%' THEN 'count' END AS units FROM long""",
    "picker": """SELECT g.tool_id, 'canonical' AS kind, l.sensor, l.label, l.category,
        l.uncategorised, l.units, l.description
        FROM labels l JOIN tool_group g USING (prc_group_id)
        WHERE g.tool_id IN (SELECT tool_id FROM file_index WHERE NOT archived)
        UNION ALL
        SELECT tool_id, 'raw', raw_name,
        raw_name || CASE WHEN units IS NULL THEN '' ELSE ' (' || units || ')' END,
        'All sensors (raw)', FALSE, coalesce(units, ''), ''
        FROM raw_catalog
        WHERE tool_id IN (SELECT tool_id FROM file_index WHERE NOT archived)
          AND tool_id NOT IN (SELECT tool_id FROM tool_group
                              WHERE prc_group_id IN (SELECT prc_group_id FROM canonical))""",
    "selections": """SELECT o_orderkey AS selection_id,
        ['tool_' || (o_custkey % 8), 'tool_' || ((o_custkey + 3) % 9)] AS tools,
        CASE WHEN o_orderkey % 2 = 0 THEN ['l_quantity', 'l_tax'] ELSE ['l_discount'] END
            AS sensors_raw,
        ['part_' || o_custkey, 'part_' || (o_custkey + 1)] AS sensors_canonical,
        o_orderdate AS "start",
        o_orderdate + to_days((o_orderkey % 400)::INT) + INTERVAL 1 HOUR AS "end",
        CASE o_orderpriority WHEN '1-URGENT' THEN 'overview' WHEN '2-HIGH' THEN 'standard'
            WHEN '3-MEDIUM' THEN 'focus' ELSE lower(o_orderpriority) END AS mode,
        o_custkey AS set_id FROM orders""",
    "tool_ranges": """SELECT DISTINCT selection_id, unnest(tools) AS tool_id, "start", "end"
        FROM selections""",
    "wanted_tools": """SELECT selection_id, sensors_raw, sensors_canonical,
        unnest(tools) AS tool_id, unnest(range(len(tools))) AS tool_ord FROM selections""",
    "wanted": """SELECT selection_id, tool_id, tool_ord, unnest(sensors_raw) AS name,
        'raw' AS source, unnest(range(len(sensors_raw))) AS ord FROM wanted_tools
        UNION ALL
        SELECT selection_id, tool_id, tool_ord, unnest(sensors_canonical), 'canonical',
        unnest(range(len(sensors_canonical))) + len(sensors_raw) FROM wanted_tools""",
    "resolved": """SELECT w.*, CASE WHEN source = 'raw' THEN w.name ELSE m.raw_name END AS raw_name
        FROM wanted w LEFT JOIN mapping m ON w.source = 'canonical'
         AND m.tool_id = w.tool_id AND m.canonical_name = w.name""",
    "plan": """SELECT selection_id, tool_id, raw_name, min(tool_ord) AS tool_ord, min(ord) AS ord
        FROM resolved WHERE raw_name IS NOT NULL GROUP BY ALL""",
    "widths": """SELECT selection_id, mode, CASE
        WHEN us <= points * 1000000 THEN 1 WHEN us <= points * 10000000 THEN 10
        WHEN us <= points * 60000000 THEN 60 WHEN us <= points * 300000000 THEN 300
        WHEN us <= points * 3600000000 THEN 3600 ELSE 86400 END::BIGINT AS resolution_seconds,
        us // 1000000 AS range_seconds
        FROM (SELECT selection_id, mode, epoch_us("end") - epoch_us("start") AS us,
              (CASE mode WHEN 'overview' THEN 100 WHEN 'focus' THEN 5000 ELSE 2000 END)::BIGINT
                  AS points FROM selections)""",
    "overlap": """SELECT selection_id, tool_id, file_id, min_ts, max_ts
        FROM tool_ranges JOIN file_index USING (tool_id)
        WHERE NOT archived AND min_ts <= "end" AND max_ts >= "start" """,
    "daily": "SELECT tool_id, time_bucket(INTERVAL 1 DAY, ts) AS bucket, "
    + ", ".join(f"avg({s}) AS {s}_avg, min({s}) AS {s}_min, max({s}) AS {s}_max" for s in WIDE_SENSORS)
    + " FROM wide GROUP BY ALL",
    "series": " UNION ALL ".join(
        f"SELECT tool_id, '{s}' AS sensor, bucket, {s}_avg AS avg, {s}_min AS min, {s}_max AS max"
        " FROM daily"
        for s in WIDE_SENSORS
    ),
    "asked": """SELECT DISTINCT 'tool_' || (o_custkey % 9) AS tool_id,
        CASE WHEN o_custkey % 9 = 6 OR o_custkey % 9 = 5 AND o_orderkey % 10 = 0 THEN 'l_ghost'
             WHEN o_orderkey % 2 = 0 THEN 'l_quantity' ELSE 'l_tax' END AS raw_name FROM orders""",
    "known_asked": """SELECT *, raw_name <> 'l_ghost'
        AND tool_id IN (SELECT tool_id FROM wide) AS known FROM asked""",
    "outcome": """SELECT tool_id,
        CASE WHEN NOT has_files AND reason IS NOT NULL THEN 'unreadable'
             WHEN NOT has_files THEN 'empty'
             WHEN all_absent THEN 'missing_column' ELSE 'ok' END AS status,
        CASE WHEN NOT has_files THEN coalesce(reason, '')
             WHEN all_absent THEN absent ELSE coalesce(reason, absent, '') END AS message
        FROM (SELECT tool_id,
              'no column ''' || min(CASE WHEN NOT known THEN raw_name END)
                  || ''' in this tool''s files' AS absent,
              bool_and(NOT known) AS all_absent,
              bool_or(tool_id IN (SELECT tool_id FROM file_index)) AS has_files
              FROM known_asked GROUP BY tool_id)
        LEFT JOIN (SELECT 'tool_' || (s_nationkey % 11) AS tool_id,
                   min('bad file of ' || s_name) AS reason FROM supplier
                   WHERE s_nationkey % 11 IN (2, 8, 9) GROUP BY 1) USING (tool_id)""",
    "silences": """SELECT tool_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (
        PARTITION BY tool_id ORDER BY ts) AS us FROM long""",
    "numbered": """SELECT *, sum(CASE WHEN us IS NULL OR us > 7200000000 THEN 1 ELSE 0 END) OVER (
        PARTITION BY tool_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS run_no
        FROM silences""",
    "run_list": """SELECT tool_id, run_no, min(ts) AS run_start, max(ts) AS run_end,
        count(*) AS "rows", (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS duration_s,
        max(CASE WHEN us > 7200000000 THEN us END) / 1000000 AS gap_before_s
        FROM numbered GROUP BY tool_id, run_no""",
    "kinds": """SELECT *, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events""",
    "app": """SELECT event_id AS id, user_id AS client, event_type, ts AS created_at,
        max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id
            ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_exit
        FROM events""",
    "saved": """SELECT c_custkey AS set_id, c_name AS name,
        ['tool_' || (c_nationkey % 8), 'tool_' || (c_nationkey % 5)] AS tools,
        ['part_' || c_custkey] AS sensors_canonical,
        CASE WHEN c_custkey % 4 = 0 THEN []::VARCHAR[] ELSE ['l_tax', 'l_discount'] END
            AS sensors_raw FROM customer""",
    "signals": """SELECT DISTINCT tool_id, sensor FROM (
        SELECT 'tool_' || (user_id % 8) AS tool_id, k % 7 AS channel,
        arg_max(event_type, event_id) AS sensor FROM kinds WHERE k % 13 <> 0 GROUP BY 1, 2)
        WHERE channel IN (0, 2, 4, 6, 8)""",
}


def _statement(body: str) -> str:
    """Prefix the expressions the statement needs, in their listed order."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name, definition in CTES.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                pending.append(definition)
    if not needed:
        return body
    parts = ",\n".join(f"{name} AS ({CTES[name]})" for name in CTES if name in needed)
    return f"WITH {parts}\n{body}"


def _long_buckets(width: str, where: str = "", source: str = "long") -> str:
    return f"""SELECT tool_id, sensor, time_bucket(INTERVAL '{width}', ts) AS bucket,
        round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, count(value) AS n
        FROM {source} {where} GROUP BY ALL"""


def _wide_buckets(sensors: list[str], width: str, source: str) -> str:
    cells = ", ".join(
        f"round(avg({s}), 6) AS {s}_avg, min({s}) AS {s}_min, max({s}) AS {s}_max" for s in sensors
    )
    return f"""SELECT tool_id, time_bucket(INTERVAL '{width}', ts) AS bucket, {cells}
        FROM {source} GROUP BY ALL"""


def _iso(ts: str) -> str:
    return f"""CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S')
        ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00'"""


def _aligned() -> str:
    cells = [
        (f"round(max(CASE WHEN tool_id = '{tool}' THEN {c} END), 7)" if c.endswith("_avg")
         else f"max(CASE WHEN tool_id = '{tool}' THEN {c} END)") + f' AS "{tool}.{c}"'
        for tool, columns in ALIGNED.items()
        for c in columns
    ]
    listed = ", ".join(f"'{tool}'" for tool in ALIGNED)
    return f"SELECT bucket AS ts, {', '.join(cells)} FROM daily WHERE tool_id IN ({listed}) GROUP BY bucket"


def _chart_lines() -> str:
    cells = " || ',' || ".join(
        f"coalesce(max(CASE WHEN tool_id = '{tool}' THEN {c} END)::VARCHAR, '')"
        for tool, columns in list(ALIGNED.items())[:2]
        for c in columns[:3]
        if not c.endswith("_avg")
    )
    return f"""SELECT {_iso("bucket")} || ',' || {cells} AS line, 0::BIGINT AS out_of_order
        FROM daily WHERE tool_id IN ('tool_0', 'tool_1') GROUP BY bucket"""


def _many() -> str:
    cells = ", ".join(
        f"round(avg(l_quantity * {i} - 25), 6) AS s{i}_avg, min(l_quantity * {i} - 25) AS s{i}_min,"
        f" max(l_quantity * {i} - 25) AS s{i}_max"
        for i in range(MANY_SENSORS)
    )
    return f"SELECT tool_id, time_bucket(INTERVAL 70 DAY, ts) AS bucket, {cells} FROM wide GROUP BY ALL"


def _own_sensors(sensor: str) -> str:
    """Tools that ask for a sensor in the lists of two each."""
    at = WIDE_SENSORS.index(sensor)
    return ", ".join(f"'{tool}'" for i, tool in enumerate(TOOLS) if at in (i % 3, i % 3 + 1))


EVENT_CELLS = {
    "tool_count": "k::VARCHAR",
    "sensor_count": "user_id::VARCHAR",
    "range_seconds": "'-'",
    "resolution_seconds": "k || '.5'",
    "latency_ms": "event_id::VARCHAR",
    "error_type": "'E' || (k % 5)",
    "partial_results": "(k % 2 = 0)::VARCHAR",
    "file_id": "'f' || k",
    "resuming": "(k % 3 = 0)::VARCHAR",
    "existing_bytes": "(k * 10)::VARCHAR",
    "partial_bytes": "(k * 7)::VARCHAR",
    "bytes_written": "(k * 100)::VARCHAR",
    "cache_hit": "(k % 2 = 1)::VARCHAR",
    "app_version": "'1.' || k",
    "platform": "'p' || (k % 3)",
    "platform_release": "'r1'",
    "python_version": "'3.' || (k % 4)",
    "seconds_since_last_exit": "k || '.25'",
    "traceback": "'line ' || k",
    "thread": "'main'",
}


def _all_event_types() -> str:
    return " UNION ALL ".join(
        f"SELECT '{kind}' AS type, ts AS created_at, "
        + " || '|' || ".join(EVENT_CELLS[field] for field in EVENT_FIELDS[kind])
        + f" AS fields FROM kinds WHERE event_id % 9 = {i}"
        for i, kind in enumerate(EVENT_TYPES)
    )


FULL_RANGE = "WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'"
PAGE_ORDER = "tool_id, l_quantity, l_extendedprice, l_discount, l_tax"
INDEX_COLUMNS = "tool_id hour_bucket min_ts max_ts row_count size_bytes".split()
UNINDEXED = (
    "benchmark conversations customer documents embeddings labels nation pages part region supplier"
).split()

_BODIES = {
    "downsample_second": _long_buckets("1 second"),
    "downsample_hour": _long_buckets("1 hour"),
    "downsample_day": _wide_buckets(WIDE_SENSORS, "1 day", "wide"),
    "downsample_auto_overview": _long_buckets("1 day", FULL_RANGE),
    "downsample_auto_standard": _long_buckets("1 hour", FULL_RANGE),
    "downsample_auto_focus": _long_buckets("1 hour", FULL_RANGE),
    "downsample_full_extent": """SELECT tool_id, sensor, width,
        time_bucket(to_seconds(width), ts) AS bucket, round(avg(value), 6) AS avg,
        min(value) AS min, max(value) AS max, count(value) AS n
        FROM long JOIN (SELECT tool_id, greatest(1, round_even(
            (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 / 2000, 0))::BIGINT AS width
            FROM long GROUP BY tool_id) USING (tool_id) GROUP BY ALL""",
    "downsample_zoom": _long_buckets(
        "259 seconds", "WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-16'"
    ),
    "downsample_wide": _wide_buckets(EVENT_SENSORS, "1 hour", "sparse"),
    "downsample_canonical": _long_buckets("1 hour", "JOIN signals USING (tool_id, sensor)"),
    "downsample_wanted": "SELECT tool_id, sensor, bucket, round(avg, 6) AS avg, min, max FROM series WHERE "
    + " OR ".join(f"(sensor = '{s}' AND tool_id IN ({_own_sensors(s)}))" for s in WIDE_SENSORS),
    "downsample_plan_wide": """SELECT tool_id, sensor, bucket, round(avg, 6) AS avg, min, max
        FROM series JOIN (SELECT DISTINCT tool_id, raw_name AS sensor FROM plan) USING (tool_id, sensor)""",
    "downsample_wide_groups": _many(),
    "downsample_index_extent": """SELECT tool_id, sensor, width,
        time_bucket(to_seconds(width), ts) AS bucket, round(avg(value), 6) AS avg,
        min(value) AS min, max(value) AS max, count(value) AS n
        FROM (SELECT tool_id, ts, 'l_quantity' AS sensor, l_quantity AS value FROM wide
              UNION ALL SELECT tool_id, ts, 'l_tax', l_tax FROM wide)
        JOIN (SELECT tool_id, greatest(1, round_even(
            (epoch_us(max(max_ts)) - epoch_us(min(min_ts))) / 1000000 / 500, 0))::BIGINT AS width
            FROM file_index WHERE NOT archived GROUP BY tool_id) USING (tool_id) GROUP BY ALL""",
    "downsample_from_files": """SELECT tool_id, time_bucket(INTERVAL '1 day', ts) AS bucket,
        round(avg(l_quantity), 6) AS l_quantity_avg, min(l_quantity) AS l_quantity_min,
        max(l_quantity) AS l_quantity_max, round(avg(value), 6) AS value_avg,
        min(value) AS value_min, max(value) AS value_max
        FROM (SELECT 'lineitem' AS tool_id, l_shipdate AS ts, l_quantity, NULL::DOUBLE AS value
              FROM lineitem UNION ALL SELECT 'events', ts, NULL, value FROM events) GROUP BY ALL""",
    "tool_outcome_at_read": """SELECT tool_id,
        CASE WHEN tool_id = 'tool_2' THEN 'unreadable' ELSE 'ok' END AS status,
        CASE WHEN tool_id <> 'tool_2' THEN count(*) END AS buckets,
        CASE WHEN tool_id <> 'tool_2' THEN sum(n)::BIGINT END AS "rows",
        CASE WHEN tool_id <> 'tool_2' THEN round(sum(l_tax_avg), 5) END AS tax_means,
        CASE WHEN tool_id <> 'tool_2' THEN max(l_quantity_max) END AS most
        FROM daily JOIN (SELECT tool_id, ts AS bucket, count(*) AS n FROM wide GROUP BY ALL)
        USING (tool_id, bucket) GROUP BY tool_id""",
    "index_incremental": """SELECT tool_id, count(*) AS files, sum(n)::BIGINT AS "rows",
        min(earliest) AS earliest, max(latest) AS latest FROM (
        SELECT tool_id, count(*) AS n, min(ts) AS earliest, max(ts) AS latest FROM wide GROUP BY 1
        UNION ALL
        SELECT 'tool_' || (o_custkey % 9), count(*), min(o_orderdate), max(o_orderdate)
        FROM orders GROUP BY 1) GROUP BY tool_id""",
    "selected_readings": """SELECT selection_id, tool_id, sensor, count(*) AS "rows",
        min(ts) AS first_ts, max(value) AS top FROM long JOIN (
        SELECT n_nationkey AS selection_id, 'tool_' || (n_nationkey % 9) AS tool_id,
        TIMESTAMP '2024-01-01' + to_days(n_nationkey::INT) + to_hours(n_nationkey::INT) AS "start",
        TIMESTAMP '2024-01-01' + to_days((n_nationkey * 2 - n_nationkey % 5)::INT) + to_hours(3)
            AS "end" FROM nation) USING (tool_id)
        WHERE ts >= "start" AND ts < "end" GROUP BY ALL""",
    "hour_changes": """WITH old AS (SELECT 'tool_' || (l_suppkey % 8) AS tool_id, l_shipdate AS period,
        list_sort(list(concat_ws('|', l_quantity, l_extendedprice, l_discount, l_tax))) AS r
        FROM lineitem GROUP BY 1, 2),
        new AS (SELECT 'tool_' || (l_suppkey % 8) AS tool_id, l_shipdate AS period,
        list_sort(list(concat_ws('|', l_quantity, l_extendedprice, l_discount,
            CASE WHEN l_orderkey % 100 = 0 THEN l_tax + 1 ELSE l_tax END))) AS r
        FROM lineitem WHERE l_linenumber < 7 GROUP BY 1, 2)
        SELECT tool_id, period, CASE WHEN old.r IS NULL THEN 'new' WHEN new.r IS NULL THEN 'missing'
            WHEN old.r = new.r THEN 'same' ELSE 'changed' END AS state
        FROM old FULL JOIN new USING (tool_id, period)""",
    "late_arrivals": """WITH e AS (SELECT DISTINCT 'tool_' || (user_id % 8) AS tool_id, ts, event_type,
            value, event_id % 10 = 0 AS after FROM events),
        first AS (SELECT tool_id, max(ts) AS newest FROM e WHERE NOT after GROUP BY 1),
        placed AS (SELECT e.*, after AND coalesce(date_trunc('day', ts)
            < date_trunc('day', newest - INTERVAL 36 HOUR), FALSE) AS is_late
            FROM e LEFT JOIN first USING (tool_id))
        SELECT tool_id, count(*) FILTER (NOT is_late) AS "rows", max(ts) FILTER (NOT is_late) AS newest,
        CASE WHEN count(*) FILTER (is_late) > 0 THEN count(*) FILTER (is_late) END AS late,
        date_trunc('day', max(ts) - INTERVAL 36 HOUR)::TIMESTAMP AS sealed_before
        FROM placed GROUP BY tool_id""",
    "retention_plan": """SELECT file_id, tool_id, size_bytes, pinned, CASE WHEN bytes_kept
            > (SELECT sum(size_bytes) * 2 // 5 FROM file_index) THEN 'size' END AS "drop", bytes_kept FROM room
        UNION ALL
        SELECT file_id, tool_id, size_bytes, pinned, CASE WHEN old THEN 'age' END, NULL
        FROM aged WHERE pinned OR old""",
    "telemetry_archive": """SELECT CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'archive' ELSE 'live' END
        AS place, ts::DATE AS day, count(*) AS events FROM events GROUP BY ALL""",
    "overlay_groups": """SELECT CASE grouping(tool_id, sensor) WHEN 0 THEN 'both' WHEN 1 THEN 'tool'
            ELSE 'sensor' END AS group_by, tool_id, sensor, count(*) AS series,
        sum(points)::BIGINT AS points, min(low) AS min_value, round(sum(total) / sum(points), 6) AS mean_value,
        max(high) AS max_value, round(max(size) / min(size), 6) AS scale_ratio,
        grouping(tool_id, sensor) = 1 AND max(size) / min(size) > 100 AS scales_differ
        FROM (SELECT tool_id, sensor, count(*) AS points, min(min) AS low, max(max) AS high, sum(avg) AS total,
              nullif(greatest(abs(min(min)), abs(max(max))), 0) AS size
              FROM series WHERE isfinite(avg) GROUP BY ALL)
        GROUP BY GROUPING SETS ((tool_id, sensor), (tool_id), (sensor))""",
    "mapping_indicators": "SELECT prc_group_id, canonical_name, tool_id, raw_name, raw_unit, expected, state FROM judged",
    "canonical_indicators": """SELECT prc_group_id, canonical_name, count(tool_id) AS tools,
        count(*) FILTER (state = 'empty') AS empty, count(*) FILTER (state = 'duplicate') AS duplicate,
        count(*) FILTER (state = 'units_mismatch') AS units_mismatch, count(*) FILTER (state = 'ok') AS ok,
        count(raw_name) = 0 AS unmapped, any_value(c.description) IS NULL AS no_description
        FROM canonical c LEFT JOIN judged USING (prc_group_id, canonical_name) GROUP BY ALL""",
    "chart_csv_lines": _chart_lines(),
    "table_csv_lines": f"""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS lines,
        min(line) AS first_line, max(line) AS last_line, sum(length(line))::BIGINT AS chars,
        0::BIGINT AS out_of_order FROM (SELECT ts, {_iso("ts")} || ',' || tool_id || ','
        || l_quantity || ',' || l_tax AS line FROM wide) GROUP BY 1""",
    "partitioned_order": """SELECT tool_id, day(ts)::BIGINT AS day, count(*) AS "rows", 0::BIGINT AS out_of_order
        FROM long GROUP BY 1, 2""",
    "resolution_choice": "SELECT selection_id, mode, resolution_seconds FROM widths",
    "resolve_plan": "SELECT * FROM plan",
    "missing_mapping_warnings": """SELECT selection_id, tool_id, name AS canonical_name,
        tool_id || ': no mapping for ''' || name || '''; chart will show no data.' AS warning
        FROM resolved WHERE raw_name IS NULL""",
    "displayed_column_sets": """SELECT selection_id,
        array_to_string(list_sort(list_distinct(list(raw_name))), ',') AS columns
        FROM plan GROUP BY selection_id""",
    "query_run_metrics": """SELECT s.selection_id, len(s.tools) AS tool_count,
        count(DISTINCT p.raw_name) AS sensor_count, w.range_seconds, w.resolution_seconds
        FROM selections s JOIN widths w USING (selection_id) LEFT JOIN plan p USING (selection_id)
        GROUP BY ALL""",
    "series_cap": """SELECT selection_id, tool_id, raw_name, "position" FROM (
        SELECT *, row_number() OVER (PARTITION BY selection_id ORDER BY tool_ord, ord, raw_name)
            AS "position" FROM plan) JOIN selections USING (selection_id)
        WHERE mode = 'overview' OR "position" <= CASE mode WHEN 'focus' THEN 4 ELSE 50 END""",
    "tool_outcome": "SELECT * FROM outcome",
    "raw_count": """SELECT tool_id, count(*) AS "rows" FROM wide
        WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '2001-01-01' GROUP BY tool_id""",
    "raw_rows_padded": "SELECT tool_id, ts, NULL::DOUBLE AS a_ghost, "
    + ", ".join(f"CASE WHEN tool_id IN ({_own_sensors(s)}) THEN {s} END AS {s}" for s in WIDE_SENSORS)
    + " FROM wide",
    "raw_union_padded": "SELECT * FROM wide UNION ALL BY NAME SELECT * FROM sparse",
    "raw_page_asc": f"SELECT * FROM wide ORDER BY ts, {PAGE_ORDER} LIMIT 250 OFFSET 500",
    "raw_page_desc": f"SELECT * FROM wide ORDER BY ts DESC, {PAGE_ORDER} LIMIT 250 OFFSET 500",
    "raw_page_deep": f"""SELECT * FROM undated ORDER BY ts NULLS FIRST, {PAGE_ORDER}
        LIMIT 250 OFFSET (SELECT count(*) * 3 // 4 FROM lineitem)""",
    "raw_page_undated": f"""SELECT * FROM undated ORDER BY ts DESC NULLS LAST, {PAGE_ORDER}
        LIMIT 250 OFFSET (SELECT count(ts) - 100 FROM undated)""",
    "raw_page_keyset": f"""SELECT * FROM wide WHERE ts > TIMESTAMP '1999-06-15'
        OR (ts = TIMESTAMP '1999-06-15' AND tool_id > 'tool_3')
        ORDER BY ts, {PAGE_ORDER} LIMIT 250""",
    "focus_stats": """SELECT tool_id, sensor, min(min) AS min_value, round(avg(avg), 6) AS mean_value,
        max(max) AS max_value FROM series WHERE isfinite(avg) GROUP BY ALL""",
    "sparkline_summary": """SELECT tool_id, sensor, round(latest, 6) AS latest,
        round(low - pad, 6) AS y_min, round(high + pad, 6) AS y_max, x_start, x_end
        FROM (SELECT *, CASE WHEN abs(low - high) <= greatest(abs(low), abs(high)) * 1e-9
              THEN greatest(abs(low), 1) * 0.05 ELSE 0 END AS pad
              FROM (SELECT tool_id, sensor, arg_max(avg, bucket) AS latest, min(avg) AS low,
                    max(avg) AS high, min(bucket) AS x_start, max(bucket) AS x_end
                    FROM series GROUP BY ALL))""",
    "series_status": """SELECT a.tool_id, a.raw_name,
        CASE WHEN p.points > 0 THEN 'data'
             WHEN o.status IN ('unreadable', 'missing_column') OR NOT a.known THEN 'error'
             ELSE 'no_data' END AS status,
        coalesce(p.points, 0) AS points
        FROM known_asked a LEFT JOIN outcome o USING (tool_id)
        LEFT JOIN (SELECT tool_id, sensor AS raw_name, count(*) AS points FROM series
                   WHERE isfinite(avg) GROUP BY ALL) p USING (tool_id, raw_name)""",
    "aligned_wide": _aligned(),
    "csv_text_rows": f"""SELECT event_id::VARCHAR AS event_id, {_iso("ts")} AS ts,
        {_iso("date_trunc('second', ts)")} AS whole_ts, value::VARCHAR AS value,
        (value * 1e14)::DOUBLE::VARCHAR AS large, (value / 1e6)::DOUBLE::VARCHAR AS small,
        (-value / 3)::DOUBLE::VARCHAR AS thirds,
        CASE WHEN value > 50 THEN value::VARCHAR ELSE '' END AS gaps FROM events""",
    "run_detection": """SELECT tool_id, run_no, run_start, run_end, "rows",
        round(duration_s, 6) AS duration_s, round(gap_before_s, 6) AS gap_before_s,
        CASE WHEN gap_before_s IS NULL THEN 'first'
             WHEN gap_before_s BETWEEN 15 AND 30 THEN 'wafer'
             WHEN gap_before_s BETWEEN 300 AND 2700 THEN 'lot'
             WHEN gap_before_s BETWEEN 14400 AND 43200 THEN 'maintenance'
             ELSE 'other' END AS gap_class FROM run_list""",
    "utilisation": """SELECT r.tool_id, g.prc_group_id, r.runs, r."rows",
        coalesce(f.files, 0) AS files, coalesce(f.bytes, 0) AS bytes,
        round(r."rows" / (720 * 3600 * 0.01)::DOUBLE * 100, 6) AS utilisation_pct
        FROM (SELECT tool_id, count(*) AS runs, sum("rows")::BIGINT AS "rows"
              FROM run_list GROUP BY ALL) r
        LEFT JOIN (SELECT tool_id, count(*) AS files, sum(size_bytes)::BIGINT AS bytes
                   FROM file_index GROUP BY ALL) f USING (tool_id)
        LEFT JOIN tool_group g USING (tool_id)""",
    "file_index_scan": " UNION ALL ".join(
        f"""SELECT '{name}.parquet' AS file_id, '{name}' AS tool_id, NULL::VARCHAR AS hour_bucket,
        min({ts}) AS min_ts, max({ts}) AS max_ts, count(*) AS row_count, '{ts}' AS time_column
        FROM {name}"""
        for name, ts in (("events", "ts"), ("lineitem", "l_shipdate"), ("orders", "o_orderdate"))
    ),
    "quarantine": "SELECT name || '.parquet' AS file_id, name AS tool_id,"
    " 'no time column ts or l_shipdate or o_orderdate' AS reason FROM (VALUES "
    + ", ".join(f"('{name}')" for name in UNINDEXED)
    + ") v(name)",
    "schema_catalog": """SELECT DISTINCT table_name AS tool_id, column_name AS raw_name,
        NULL::VARCHAR AS units, data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') AS "numeric",
        (ordinal_position - 1)::BIGINT AS "position" FROM information_schema.columns
        WHERE table_name IN ('events', 'lineitem', 'orders')
          AND column_name NOT IN ('ts', 'l_shipdate', 'o_orderdate')""",
    "file_overlap": "SELECT * FROM overlap",
    "coverage_warnings": f"""SELECT r.selection_id, r.tool_id, earliest, latest,
        coalesce(files, 0) AS files,
        CASE WHEN earliest IS NULL
             THEN 'No local data for ' || r.tool_id || ' in the requested range.'
             ELSE concat_ws('|',
               CASE WHEN earliest > r."start" THEN r.tool_id
                 || ': range starts before local data (earliest ' || {_iso("earliest")} || ').' END,
               CASE WHEN latest < r."end" THEN r.tool_id
                 || ': range ends after local data (latest ' || {_iso("latest")} || ').' END)
        END AS warnings
        FROM tool_ranges r LEFT JOIN (
          SELECT selection_id, tool_id, min(min_ts) AS earliest, max(max_ts) AS latest,
          count(*) AS files FROM overlap GROUP BY ALL) o USING (selection_id, tool_id)""",
    "tool_extents": """SELECT tool_id, count(*) AS files, min(min_ts) AS earliest,
        max(max_ts) AS latest FROM file_index WHERE NOT archived GROUP BY tool_id""",
    "global_extent": "SELECT min(min_ts) AS earliest, max(max_ts) AS latest FROM file_index",
    "active_tools": "SELECT DISTINCT tool_id FROM file_index WHERE NOT archived",
    "archived_files": "SELECT * FROM file_index WHERE archived",
    "library_size": "SELECT coalesce(sum(size_bytes), 0)::BIGINT AS total_bytes FROM file_index",
    "index_upsert": "SELECT coalesce(n.file_id, o.file_id) AS file_id, "
    + ", ".join(
        f"CASE WHEN n.file_id IS NULL THEN o.{c} ELSE n.{c} END AS {c}" for c in INDEX_COLUMNS
    )
    + """, CASE WHEN n.file_id IS NULL OR (o.size_bytes = n.size_bytes AND o.min_ts = n.min_ts
             AND o.max_ts = n.max_ts) THEN o.sha256 END AS sha256,
        coalesce(o.pinned, FALSE) AS pinned, coalesce(o.archived, FALSE) AS archived
        FROM file_index o FULL JOIN scanned_index n ON n.file_id = o.file_id""",
    "index_rescan": "SELECT n.file_id, "
    + ", ".join(f"n.{c}" for c in INDEX_COLUMNS)
    + """, CASE WHEN o.size_bytes = n.size_bytes AND o.min_ts = n.min_ts
             AND o.max_ts = n.max_ts THEN o.sha256 END AS sha256,
        coalesce(o.pinned, FALSE) AS pinned, coalesce(o.archived, FALSE) AS archived
        FROM scanned_index n LEFT JOIN file_index o ON n.file_id = o.file_id""",
    "index_vanished": """SELECT * FROM file_index
        WHERE file_id NOT IN (SELECT file_id FROM scanned_index)""",
    "manifest_parse": "SELECT * FROM manifest",
    "manifest_diff": "SELECT * FROM downloads",
    "manifest_archived": """SELECT * EXCLUDE (archived),
        archived OR file_id NOT IN (SELECT file_id FROM manifest) AS archived FROM file_index""",
    "manifest_tool_bytes": """SELECT tool_id, count(*) AS files, sum(size_bytes)::BIGINT AS bytes
        FROM downloads GROUP BY tool_id""",
    "update_summary": """SELECT (SELECT count(*) FROM downloads) AS to_download,
        (SELECT count(*) FROM gone) AS archived_locally""",
    "checksum_audit": """SELECT m.file_id, m.tool_id, m.sha256, f.sha256 AS actual_sha256,
        CASE WHEN f.sha256 IS NULL THEN 'missing' WHEN m.sha256 IS NULL THEN 'unchecked'
             WHEN m.sha256 = f.sha256 THEN 'ok' ELSE 'mismatch' END AS status
        FROM (SELECT 'page_' || (page_id + CASE WHEN page_id % 7 = 3 THEN page_id % 5 * 1000000 ELSE 0 END)
                  AS file_id, 'tool_' || (page_id % 8) AS tool_id,
              CASE page_id % 3 WHEN 0 THEN sha256(html) WHEN 1 THEN sha256(url) END AS sha256 FROM pages) m
        LEFT JOIN (SELECT 'page_' || page_id AS file_id, sha256(html) AS sha256 FROM pages) f USING (file_id)""",
    "mapping_parse": "SELECT * FROM map_lines WHERE raw_name IS NOT NULL",
    "mapping_latest": "SELECT * FROM mapping",
    "tool_process_group": "SELECT * FROM tool_group",
    "process_groups": "SELECT DISTINCT prc_group_id FROM tool_group",
    "canonical_parse": "SELECT * FROM canonical",
    "category_parse": "SELECT * FROM category",
    "sensor_parse": """SELECT 'tool_' || s_suppkey AS tool_id, 'acct' AS raw_name,
        CASE WHEN s_nationkey % 2 = 1 THEN 'n' || s_nationkey END AS units FROM supplier
        UNION ALL SELECT 'tool_' || s_suppkey, 'key', NULL FROM supplier WHERE s_suppkey % 3 <> 0""",
    "mapping_cells": "SELECT * FROM cells",
    "mapping_matrix": "SELECT canonical_name, "
    + ", ".join(
        f"coalesce(max(CASE WHEN tool_id = '{tool}' THEN raw_name END), '—') AS {tool}"
        for tool in TOOLS
    )
    + " FROM canonical LEFT JOIN mapping USING (canonical_name) GROUP BY canonical_name",
    "mapping_lines": """SELECT prc_group_id, canonical_name,
        string_agg(tool_id || ' → ' || coalesce(raw_name, '(no mapping)'), chr(10)
                   ORDER BY tool_id) AS lines FROM cells GROUP BY ALL""",
    "catalog_labels": "SELECT * FROM labels",
    "catalog_fallback": "SELECT * FROM picker",
    "sensor_search": """SELECT tool_id, sensor,
        tool_id || '  /  ' || category || '  /  ' || label AS breadcrumb FROM picker
        WHERE contains(lower(label), 'ring') OR contains(lower(tool_id), 'ring')
           OR contains(lower(sensor), 'ring') OR contains(lower(units), 'ring')
           OR contains(lower(description), 'ring')""",
    "sensor_search_count": """SELECT count(*) AS hits FROM picker
        WHERE contains(lower(label), 'ring') OR contains(lower(tool_id), 'ring')
           OR contains(lower(sensor), 'ring') OR contains(lower(units), 'ring')
           OR contains(lower(description), 'ring')""",
    "catalog_ordered": """SELECT tool_id, category, sensor, row_number() OVER (
        PARTITION BY tool_id ORDER BY uncategorised, category, sensor) AS place FROM picker""",
    "index_ordered": """SELECT tool_id, file_id, row_number() OVER (
        PARTITION BY tool_id ORDER BY min_ts, file_id) AS place FROM file_index WHERE NOT archived""",
    "hours_with_data": """SELECT tool_id, date_trunc('hour', ts) AS hour, count(*) AS "rows"
        FROM long GROUP BY ALL""",
    "selection_counts": """SELECT p.tool_id, count(c.sensor) AS selected, count(*) AS total
        FROM picker p LEFT JOIN (SELECT DISTINCT 'tool_' || (l_suppkey % 8) AS tool_id,
            'canonical' AS kind, 'part_' || l_partkey AS sensor
            FROM lineitem) c
          ON c.tool_id = p.tool_id AND c.kind = p.kind AND c.sensor = p.sensor
        GROUP BY ROLLUP (p.tool_id)""",
    "telemetry_parse": """SELECT ts AS created_at, k::BIGINT AS tool_count,
        user_id AS sensor_count, NULL::BIGINT AS range_seconds, value AS resolution_seconds,
        7::BIGINT AS latency_ms FROM kinds WHERE event_type = 'view' """,
    "telemetry_all_types": _all_event_types(),
    "telemetry_counts": """SELECT CASE event_type WHEN 'view' THEN 'query_run'
        WHEN 'click' THEN 'download_completed' WHEN 'purchase' THEN 'update_check'
        WHEN 'error' THEN 'app_exit' ELSE 'app_start' END AS type,
        CAST(ts AS DATE) AS day, count(*) AS events FROM events GROUP BY ALL""",
    "seconds_since_exit": """SELECT id, client, created_at,
        (us // 1000 + CASE WHEN us % 1000 > 500 OR (us % 1000 = 500 AND us // 1000 % 2 = 1)
                           THEN 1 ELSE 0 END) / 1000 AS seconds_since_last_exit
        FROM (SELECT *, epoch_us(created_at) - epoch_us(last_exit) AS us FROM app)
        WHERE event_type = 'signup' """,
    "saved_set_parse": """SELECT set_id, name, array_to_string(tools, ',') AS tools,
        array_to_string(sensors_canonical, ',') AS sensors_canonical,
        array_to_string(sensors_raw, ',') AS sensors_raw FROM saved""",
    "saved_set_roundtrip": """SELECT set_id, name, array_to_string(tools, ',') AS tools,
        array_to_string(sensors_canonical, ',') AS sensors_canonical,
        array_to_string(sensors_raw, ',') AS sensors_raw FROM saved""",
    "saved_set_pairs": """SELECT set_id, tool_id, kind, unnest(sensors) AS sensor FROM (
        SELECT set_id, unnest(tools) AS tool_id, 'canonical' AS kind, sensors_canonical AS sensors
        FROM saved UNION ALL
        SELECT set_id, unnest(tools), 'raw', sensors_raw FROM saved)""",
    "saved_set_union": "SELECT c.selection_id, "
    + ", ".join(
        f"array_to_string(list_sort(list_distinct(list_concat(c.{p}, s.{p}))), ',') AS {p}"
        for p in ("tools", "sensors_canonical", "sensors_raw")
    )
    + " FROM selections c JOIN saved s USING (set_id)",
    "saved_set_replace": """SELECT c.selection_id, array_to_string(s.tools, ',') AS tools,
        array_to_string(s.sensors_canonical, ',') AS sensors_canonical,
        array_to_string(s.sensors_raw, ',') AS sensors_raw
        FROM selections c JOIN saved s USING (set_id)""",
    "partitioned_roundtrip": """SELECT tool_id, month(ts) AS month, day(ts) AS day, sensor,
        count(*) AS "rows", min(ts) AS first_ts, max(value) AS top FROM long GROUP BY ALL""",
}

CHECKS = {name: _statement(body) for name, body in _BODIES.items()}
