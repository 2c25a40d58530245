"""Sensor-shaped inputs derived by Spark from the test tables.

Every frame here has a common table expression of the same name in ``bindings.sql``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

WIDE_SENSORS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EVENT_SENSORS = ["click", "error", "purchase", "signup", "view"]
TOOLS = [f"tool_{i}" for i in range(8)]
MANY_SENSORS = 130
# Each tool's own columns of the aligned table; tool_7 has failed and is left out.
ALIGNED = {
    tool: [f"{s}_{k}" for s in WIDE_SENSORS[i % 3 : i % 3 + 2] for k in ("avg", "min", "max")]
    for i, tool in enumerate(TOOLS[:7])
}
EVENTS_START, EVENTS_END = datetime(2024, 1, 1), datetime(2024, 1, 31)
ZOOM_START, ZOOM_END = datetime(2024, 1, 10), datetime(2024, 1, 16)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as readings: one row per sample, four sensors."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr("concat('tool_', l_suppkey % 8)").alias("tool_id"),
        F.col("l_shipdate").alias("ts"),
        *WIDE_SENSORS,
    )


def second_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines again, without the last lines of long orders and with some other taxes."""
    return table(spark, sf_dir, "lineitem").where("l_linenumber < 7").select(
        F.expr("concat('tool_', l_suppkey % 8)").alias("tool_id"),
        F.col("l_shipdate").alias("ts"),
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        F.expr("if(l_orderkey % 100 = 0, l_tax + 1, l_tax)").alias("l_tax"),
    )


def undated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, the time of every seventh order line lost."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.expr("concat('tool_', l_suppkey % 8)").alias("tool_id"),
        F.expr("if(l_orderkey % 7 = 0, NULL, l_shipdate)").alias("ts"),
        *WIDE_SENSORS,
    )


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings: one sensor value per row."""
    return table(spark, sf_dir, "events").select(
        F.expr("concat('tool_', user_id % 8)").alias("tool_id"),
        "ts",
        F.col("event_type").alias("sensor"),
        "value",
    )


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one column per sensor, all but one of them NULL."""
    return long(spark, sf_dir).select(
        "tool_id",
        "ts",
        *[F.when(F.col("sensor") == s, F.col("value")).alias(s) for s in EVENT_SENSORS],
    )


def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One indexed file per tool and month of the order lines."""
    return _monthly(
        table(spark, sf_dir, "lineitem").select(
            F.expr("concat('tool_', l_suppkey % 8)").alias("tool_id"),
            F.col("l_shipdate").alias("ts"),
        )
    ).select(
        "*",
        F.expr("row_count * 32").alias("size_bytes"),
        F.expr(
            "if(row_count % 4 = 0, null, sha2(concat(file_id, ':', row_count % 3), 256))"
        ).alias("sha256"),
        F.expr("month(min_ts) = 1").alias("pinned"),
        F.expr("month(min_ts) = 12").alias("archived"),
    )


def scanned_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later scan, of the orders: other rows in most files, some months gone, no checksums."""
    return _monthly(
        table(spark, sf_dir, "orders").select(
            F.expr("concat('tool_', o_custkey % 8)").alias("tool_id"),
            F.col("o_orderdate").alias("ts"),
        )
    ).select(
        "*",
        F.expr("row_count * 128").alias("size_bytes"),
        F.lit(None).cast("string").alias("sha256"),
    )


def _monthly(rows: DataFrame) -> DataFrame:
    keyed = rows.select("tool_id", "ts", F.expr("date_format(ts, 'yyyy-MM')").alias("month"))
    return (
        keyed.groupBy("tool_id", "month")
        .agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count("*").alias("row_count"))
        .select(
            F.concat("tool_id", F.lit("/"), "month", F.lit(".parquet")).alias("file_id"),
            "tool_id",
            F.col("month").alias("hour_bucket"),
            "min_ts",
            "max_ts",
            "row_count",
        )
    )


def manifest_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest document per tool and month of the orders, with flawed entries mixed in."""
    files = (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.expr("concat('tool_', o_custkey % 8)").alias("tool_id"),
            F.expr("date_format(o_orderdate, 'yyyy-MM')").alias("month"),
        )
        .agg(F.count("*").alias("n"))
        .withColumn("file_id", F.concat("tool_id", F.lit("/"), "month", F.lit(".parquet")))
    )
    entry = """concat(
        if(n % 2 = 0, concat('{"path":"', file_id, '"'),
           concat('{"file_id":"', file_id, '","path":"ignored"')),
        ',"tool_id":"', tool_id, '"',
        if(n % 4 = 1, concat(',"url":"https://files/', file_id, '"'), ',"url":""'),
        case when n % 5 = 0 then ',"sha256":""'
             when n % 5 = 1 then ',"sha256":17'
             else concat(',"sha256":"', sha2(concat(file_id, ':', n % 3), 256), '"') end,
        case when n % 7 = 0 then concat(',"size_bytes":"', n, '"}')
             when n % 7 = 1 then concat(',"size_bytes":', n * 32, '.75}')
             else concat(',"size_bytes":', n * 32, '}') end)"""
    return files.select(
        F.expr(
            "concat('{\"version\":1,\"files\":[', "
            + entry
            + ", ',{\"file_id\":5,\"path\":\"x\",\"tool_id\":\"t\"},"
            "{\"file_id\":\"y\"},7,null]}')"
        ).alias("payload"),
        F.lit(0).alias("ord"),
    )


def mapping_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mapping document per order line: a usable or empty or mistyped entry, then junk."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr(
            """concat('{"prc_group_id":"group_', l_orderkey % 3, '","mappings":[{"tool_id":"tool_',
            l_suppkey % 8, '","canonical_name":"part_', l_partkey, '","raw_name":',
            case when l_linenumber = 6 then '6'
                 when l_linenumber = 5 then '""'
                 else concat('"col_', l_orderkey % 97, '_', l_linenumber, '"') end,
            '},{"tool_id":4,"canonical_name":"part_0","raw_name":"x"},7,null]}')"""
        ).alias("payload"),
        F.expr("l_orderkey * 8 + l_linenumber").alias("ord"),
    )


def canonical_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One canonical catalog document per part."""
    return table(spark, sf_dir, "part").select(
        F.expr(
            """concat('{"prc_group_id":"group_', p_partkey % 2 * 2, '","sensors":[{"name":"part_',
            p_partkey, '","description":"', p_name, '"',
            case when p_size % 3 = 0 then ',"units":""'
                 when p_size % 3 = 1 then concat(',"units":"', p_type, '"')
                 else ',"units":5' end,
            if(p_size % 5 = 0, '', concat(',"category_id":"cat_', p_size, '"')),
            '},{"name":7},null]}')"""
        ).alias("payload"),
        F.col("p_partkey").alias("ord"),
    )


def category_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One category document per part; sizes above 40 never get a usable name."""
    return table(spark, sf_dir, "part").select(
        F.expr(
            """concat('{"categories":[{"id":"cat_', p_size, '","name":',
            if(p_size > 40, '40', concat('"Size ', p_size, ' ', p_brand, '"')),
            ',"parent_id":', if(p_size % 2 = 0, 'null', concat('"', p_type, '"')), '}]}')"""
        ).alias("payload"),
        F.col("p_partkey").alias("ord"),
    )


def sensor_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw sensor document per supplier."""
    return table(spark, sf_dir, "supplier").select(
        F.expr("concat('tool_', s_suppkey)").alias("tool_id"),
        F.expr(
            """concat('[{"name":"acct","units":"',
            if(s_nationkey % 2 = 0, '', concat('n', s_nationkey)), '"},
            {"name":', if(s_suppkey % 3 = 0, '3', '"key"'), ',"units":null},"junk"]')"""
        ).alias("payload"),
        F.col("s_suppkey").alias("ord"),
    )


def raw_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors each tool has events of."""
    return (
        long(spark, sf_dir)
        .select("tool_id", F.col("sensor").alias("raw_name"))
        .distinct()
        .withColumn("units", F.expr("if(raw_name like '%i%', 'count', null)"))
    )


def raw_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of the raw columns that the mapping documents name."""
    return table(spark, sf_dir, "lineitem").where("l_linenumber NOT IN (5, 6)").select(
        F.expr("concat('tool_', l_suppkey % 8)").alias("tool_id"),
        F.expr("concat('col_', l_orderkey % 97, '_', l_linenumber)").alias("raw_name"),
        F.expr("if(l_linenumber = 4, NULL, concat('u', l_orderkey % 97 % 3))").alias("units"),
    ).distinct()


CHOICE_PARTS = (
    "array(concat('tool_', o_custkey % 8), concat('tool_', (o_custkey + 3) % 9)) AS tools",
    "if(o_orderkey % 2 = 0, array('l_quantity', 'l_tax'), array('l_discount')) AS sensors_raw",
    "array(concat('part_', o_custkey), concat('part_', o_custkey + 1)) AS sensors_canonical",
)


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One selection per order: two tools (tool_8 has no data), raw and canonical sensors."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS selection_id",
        *CHOICE_PARTS,
        "o_orderdate AS start",
        "o_orderdate + make_dt_interval(cast(o_orderkey % 400 AS int), 1) AS end",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'overview' WHEN '2-HIGH' THEN 'standard'"
        " WHEN '3-MEDIUM' THEN 'focus' ELSE lower(o_orderpriority) END AS mode",
    )


def tool_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections with one row per tool."""
    return selections(spark, sf_dir).select(
        "selection_id", F.explode(F.array_distinct("tools")).alias("tool_id"), "start", "end"
    )


def day_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One selection per nation of some days of one tool's events; tool_8 has none."""
    return table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS selection_id",
        "concat('tool_', n_nationkey % 9) AS tool_id",
        "timestamp_ntz'2024-01-01' + make_dt_interval(n_nationkey, n_nationkey) AS start",
        "timestamp_ntz'2024-01-01' + make_dt_interval(n_nationkey * 2 - n_nationkey % 5, 3) AS end",
    )


def saved_set_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One saved set per customer; some payloads lack a part."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS set_id",
        "c_name AS name",
        """concat('{"tools":["tool_', c_nationkey % 8, '","tool_', c_nationkey % 5, '"]',
        ',"sensors_canonical":["part_', c_custkey, '"]',
        if(c_custkey % 4 = 0, '', ',"sensors_raw":["l_tax","l_discount"]'), '}') AS payload""",
    )


def current_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's selection together with the number of its customer's saved set."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS selection_id", "o_custkey AS set_id", *CHOICE_PARTS
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage-event JSON lines, every event type filled from the event's number k."""
    k = "get_json_object(props, '$.k')"
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.expr(
            f"""concat('{{"type":"', CASE event_type WHEN 'view' THEN 'query_run'
            WHEN 'click' THEN 'download_completed' WHEN 'purchase' THEN 'update_check'
            WHEN 'error' THEN 'app_exit' ELSE 'app_start' END,
            '","created_at":"', replace(cast(ts AS string), ' ', 'T'), '+00:00","data":{{',
            CASE event_type
              WHEN 'view' THEN concat('"tool_count":', {k}, ',"sensor_count":', user_id,
                   ',"range_seconds":"n/a","resolution_seconds":', value, ',"latency_ms":7')
              WHEN 'click' THEN concat('"file_id":"f', {k}, '","bytes_written":', {k} * 100)
              WHEN 'purchase' THEN concat('"cache_hit":', if({k} % 2 = 0, 'true', 'false'))
              ELSE concat('"app_version":"1.', {k}, '"') END, '}}}}')"""
        ).alias("value"),
    )


# Every event type, in the order in which event numbers go round them.
EVENT_TYPES = (
    "query_run query_failed download_started download_failed download_completed update_check"
    " app_start app_exit error"
).split()


def all_event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage-event JSON lines of every type in turn, each with every field there is."""
    kinds = ", ".join(f"'{kind}'" for kind in EVENT_TYPES)
    data = """concat('"tool_count":', k, ',"sensor_count":', user_id, ',"range_seconds":"n/a"',
        ',"resolution_seconds":', k, '.5,"latency_ms":', event_id, ',"error_type":"E', k % 5,
        '","partial_results":', k % 2 = 0, ',"file_id":"f', k, '","resuming":', k % 3 = 0,
        ',"existing_bytes":', k * 10, ',"partial_bytes":', k * 7, ',"bytes_written":', k * 100,
        ',"cache_hit":', k % 2 = 1, ',"app_version":"1.', k, '","platform":"p', k % 3,
        '","platform_release":"r1","python_version":"3.', k % 4, '","seconds_since_last_exit":', k,
        '.25,"traceback":"line ', k, '","thread":"main"')"""
    numbered = table(spark, sf_dir, "events").withColumn(
        "k", F.expr("cast(get_json_object(props, '$.k') AS int)")
    )
    return numbered.select(
        F.expr(
            f"""concat('{{"type":"', element_at(array({kinds}), int(event_id % 9) + 1),
            '","created_at":"', replace(cast(ts AS string), ' ', 'T'), '+00:00","data":{{', {data},
            '}}}}')"""
        ).alias("value")
    )


def app_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as application starts and errors as exits, per user."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        "user_id AS client",
        "CASE event_type WHEN 'signup' THEN 'app_start' WHEN 'error' THEN 'app_exit'"
        " ELSE event_type END AS type",
        "ts AS created_at",
    )


def signal_mapping_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mapping document per event: channel signal_0 to signal_6 to the event's sensor."""
    k = "cast(get_json_object(props, '$.k') AS int)"
    return table(spark, sf_dir, "events").select(
        F.expr(
            f"""concat('{{"prc_group_id":"g","mappings":[{{"tool_id":"tool_', user_id % 8,
            '","canonical_name":"signal_', {k} % 7, '","raw_name":',
            if({k} % 13 = 0, '13', concat('"', event_type, '"')), '}}]}}')"""
        ).alias("payload"),
        F.col("event_id").alias("ord"),
    )


def status_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Tools, plan, catalog, files and quarantine for the per-tool status."""
    plan = table(spark, sf_dir, "orders").selectExpr(
        "concat('tool_', o_custkey % 9) AS tool_id",
        "CASE WHEN o_custkey % 9 = 6 OR o_custkey % 9 = 5 AND o_orderkey % 10 = 0 THEN 'l_ghost'"
        " WHEN o_orderkey % 2 = 0 THEN 'l_quantity' ELSE 'l_tax' END AS raw_name",
    ).distinct()
    catalog = (
        wide(spark, sf_dir)
        .select("tool_id")
        .distinct()
        .select("tool_id", F.explode(F.array(*map(F.lit, WIDE_SENSORS))).alias("raw_name"))
    )
    files = file_index(spark, sf_dir)
    bad = table(spark, sf_dir, "supplier").selectExpr(
        "concat('tool_', s_nationkey % 11) AS tool_id",
        "if(s_nationkey % 11 IN (2, 8, 9), concat('bad file of ', s_name), NULL) AS reason",
    )
    return plan.select("tool_id").distinct(), plan, catalog, files, bad
