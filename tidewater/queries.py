"""Registered queries with their SQL oracles: relational core, windows, the thirty aggregates, requests, tiles and sources.

E = events. Values are taken in whole hundredths (``v``) so that sums are exact
on both sides; the order among equal times is event_id.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.registry import BASES
from .operators import relational
from .operators.request import request_features
from .operators.tiling import tiled_features
from .operators.window import Feature, window_features
from .plans.linear import Chain
from .plans.pipeline import compile_query
from .plans.spec import PipelineSpec, SourceSpec
from .plans.sqlrewrite import rewrite
from .sources import datagen, files

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
HOUR, DAY = 3600 * 10**6, 86_400 * 10**6
V = "CAST(round(value * 100) AS BIGINT)"
EVENTS = f"SELECT event_id, user_id, ts, event_type, {V} AS v FROM events"
COND = "v > 5000"


def _views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def statement(sql: str) -> Query:
    """A query written in SQL, custom aggregates included."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _views(spark, sf_dir, sql)
        return spark.sql(rewrite(sql))

    return run


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "user_id", "ts", "event_type", f"{V} AS v")


#: name: (SQL for both, or SQL for Spark and for DuckDB)
PLAIN: dict[str, str | tuple[str, str]] = {
    "select_all": "SELECT * FROM events",
    "select_columns": "SELECT event_id, event_type FROM events",
    "select_computed": f"SELECT event_id, {V} * 2 AS doubled FROM events",
    "select_case_when": "SELECT event_id, CASE WHEN value > 50 THEN 'high' WHEN value > 20 THEN 'middle' ELSE 'low' END AS level FROM events",
    "aliases": "SELECT e.event_id AS id, e.event_type AS kind FROM events AS e",
    "where_string": "SELECT event_id, value FROM events WHERE event_type = 'purchase'",
    "where_numeric": "SELECT event_id, value FROM events WHERE value > 20.0",
    "where_and": "SELECT event_id, value FROM events WHERE value > 20 AND event_type != 'view'",
    "where_or": "SELECT event_id, value FROM events WHERE value < 5 OR event_type = 'signup'",
    "where_in": "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')",
    "where_between": "SELECT event_id, value FROM events WHERE value BETWEEN 10 AND 30",
    "where_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%'",
    "where_complex": "SELECT event_id, event_type, value FROM events WHERE (event_type = 'click' OR event_type = 'view') AND (value < 10 OR value >= 40) AND user_id != 3",
    "group_by_count": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "group_by_sum": (f"SELECT event_type, sum({V}) AS total FROM events GROUP BY event_type", f"SELECT event_type, CAST(sum({V}) AS BIGINT) AS total FROM events GROUP BY event_type"),
    "group_by_avg": f"SELECT event_type, avg({V}) AS mean FROM events GROUP BY event_type",
    "group_by_min_max": "SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type",
    "group_by_having": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 60",
    "group_by_multi_column": "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS lo FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_by_multi_level_cte": "WITH per_user AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) SELECT event_type, max(n) AS most, count(*) AS users FROM per_user GROUP BY event_type",
    "group_by_global": f"SELECT count(*) AS n, CAST(sum({V}) AS BIGINT) AS total, avg({V}) AS mean FROM events",
    "group_by_distinct": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "derived_table": "SELECT t.user_id, t.n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) t WHERE t.n > 50",
    "subquery_in": "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "subquery_exists": "SELECT count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "subquery_scalar": "SELECT event_id FROM events WHERE value > (SELECT avg(value) + 20 FROM events)",
    "join_inner": "SELECT c.c_custkey, count(*) AS n FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey",
    "join_left": "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey",
    "join_full": "SELECT n.n_nationkey, s.s_suppkey FROM nation n FULL OUTER JOIN supplier s ON n.n_nationkey = s.s_nationkey",
    "join_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "join_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey"),
    "union_all": "SELECT user_id FROM events WHERE event_type = 'click' UNION ALL SELECT user_id FROM events WHERE event_type = 'view'",
    "union_distinct": "SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'view'",
    "intersect_except": "(SELECT user_id FROM events WHERE value > 90 INTERSECT SELECT user_id FROM events WHERE value < 10) EXCEPT SELECT user_id FROM events WHERE event_type = 'signup' AND value > 80",
    "distinct": "SELECT DISTINCT user_id, event_type FROM events",
    "order_limit": "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25 OFFSET 5",
    "rollup": "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id)",
    "cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())",
    "ranking": "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS rn, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS previous FROM events",
    "top_k_per_group": "SELECT event_type, event_id, rn FROM (SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS BIGINT) AS rn FROM events) t WHERE rn <= 3",
    "rows_frame": (f"SELECT event_id, sum({V}) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s FROM events", f"SELECT event_id, CAST(sum({V}) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM events"),
    "scalar_text": "SELECT event_id, upper(event_type) AS u, CAST(length(event_type) AS BIGINT) AS n, substring(event_type, 1, 3) AS s, concat(event_type, '-', CAST(user_id AS STRING)) AS k, replace(event_type, 'e', '') AS r, lpad(event_type, 10, '*') AS p FROM events",
    "scalar_number": ("SELECT event_id, abs(value - 50) AS a, CAST(floor(value) AS BIGINT) AS f, CAST(ceil(value) AS BIGINT) AS c, user_id % 7 AS m, user_id div 7 AS d, greatest(value, 50) AS g, coalesce(nullif(user_id, 3), -1) AS z FROM events", "SELECT event_id, abs(value - 50) AS a, CAST(floor(value) AS BIGINT) AS f, CAST(ceil(value) AS BIGINT) AS c, user_id % 7 AS m, user_id // 7 AS d, greatest(value, 50) AS g, coalesce(nullif(user_id, 3), -1) AS z FROM events"),
    "scalar_time": ("SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS h, CAST(extract(day FROM ts) AS BIGINT) AS d, ts + INTERVAL '1' HOUR AS later FROM events", "SELECT event_id, date_trunc('hour', ts) AS h, CAST(extract(day FROM ts) AS BIGINT) AS d, ts + INTERVAL 1 HOUR AS later FROM events"),
    "scalar_case": "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS c, nullif(event_type, 'view') AS n, coalesce(nullif(event_type, 'view'), 'none') AS d, least(user_id, 10) AS l, CASE WHEN nullif(user_id, 3) > 5 AND value > 50 THEN 'a' WHEN nullif(user_id, 3) IS NULL THEN 'b' ELSE 'c' END AS t FROM events",
    "scalar_logic": "SELECT event_id, NOT (value > 50) AS a, nullif(user_id, 3) > 5 OR value > 90 AS b, nullif(user_id, 3) IS DISTINCT FROM 4 AS c, event_type LIKE 'c%k' AS d, event_type ILIKE 'VIEW' AS e, event_type NOT IN ('click', 'view') AS f, value NOT BETWEEN 10 AND 90 AS g FROM events",
    "scalar_math": ("SELECT event_id, round(sqrt(value), 6) AS r, round(power(value, 2), 4) AS p, round(exp(value / 100), 6) AS e, round(ln(value + 1), 6) AS l, round(log10(value + 1), 6) AS g, round(sin(value), 6) AS s, round(cos(value), 6) AS c, round(atan2(value, 2), 6) AS a, sign(value - 50) AS h, pmod(user_id - 70, 7) AS m FROM events", "SELECT event_id, round(sqrt(value), 6) AS r, round(power(value, 2), 4) AS p, round(exp(value / 100), 6) AS e, round(ln(value + 1), 6) AS l, round(log10(value + 1), 6) AS g, round(sin(value), 6) AS s, round(cos(value), 6) AS c, round(atan2(value, 2), 6) AS a, CAST(sign(value - 50) AS DOUBLE) AS h, ((user_id - 70) % 7 + 7) % 7 AS m FROM events"),
    "scalar_regex": ("SELECT p_partkey, regexp_replace(p_name, '[aeiou]+', '_') AS r, regexp_extract(p_brand, '([0-9]+)', 1) AS x, p_type RLIKE '^[A-M]' AS m, split_part(p_type, ' ', 1) AS s, trim(concat('  ', p_name, ' ')) AS t, reverse(p_brand) AS v, CAST(instr(p_name, 'e') AS BIGINT) AS i, concat_ws('/', p_brand, p_type) AS c, lower(p_name) AS l FROM part", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]+', '_', 'g') AS r, regexp_extract(p_brand, '([0-9]+)', 1) AS x, regexp_matches(p_type, '^[A-M]') AS m, split_part(p_type, ' ', 1) AS s, trim(concat('  ', p_name, ' ')) AS t, reverse(p_brand) AS v, CAST(instr(p_name, 'e') AS BIGINT) AS i, concat_ws('/', p_brand, p_type) AS c, lower(p_name) AS l FROM part"),
    "scalar_time_parts": ("SELECT event_id, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS m, CAST(date_part('hour', ts) AS BIGINT) AS h, CAST(datediff(CAST(ts AS DATE), DATE'2024-01-01') AS BIGINT) AS d, date_add(CAST(ts AS DATE), 7) AS w, ts - INTERVAL '90' MINUTE AS e, CAST(extract(MINUTE FROM ts) AS BIGINT) AS u FROM events", "SELECT event_id, year(ts) AS y, month(ts) AS m, date_part('hour', ts) AS h, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d, CAST(CAST(ts AS DATE) + INTERVAL 7 DAY AS DATE) AS w, ts - INTERVAL 90 MINUTE AS e, CAST(extract(minute FROM ts) AS BIGINT) AS u FROM events"),
    "scalar_array": ("SELECT user_id, CAST(size(a) AS BIGINT) AS n, element_at(a, 1) AS f, array_join(slice(a, 1, 2), ',') AS s, CAST(size(filter(a, x -> x LIKE '%i%')) AS BIGINT) AS i, array_join(transform(a, x -> upper(x)), ',') AS u, array_contains(a, 'click') AS c FROM (SELECT user_id, array_sort(collect_set(event_type)) AS a FROM events GROUP BY user_id)", "SELECT user_id, len(a) AS n, a[1] AS f, array_to_string(a[1:2], ',') AS s, len(list_filter(a, lambda x: x LIKE '%i%')) AS i, array_to_string(list_transform(a, lambda x: upper(x)), ',') AS u, list_contains(a, 'click') AS c FROM (SELECT user_id, list_sort(list(DISTINCT event_type)) AS a FROM events GROUP BY user_id)"),
    "scalar_cast": ("SELECT event_id, CAST(user_id AS STRING) AS s, CAST(floor(value) AS INT) AS i, try_cast(concat(event_type, '1') AS INT) AS n, CAST(CAST(user_id AS STRING) AS DOUBLE) AS d, CAST(value > 50 AS INT) AS b, CAST(ts AS DATE) AS t FROM events", "SELECT event_id, CAST(user_id AS VARCHAR) AS s, CAST(floor(value) AS INT) AS i, try_cast(concat(event_type, '1') AS INT) AS n, CAST(CAST(user_id AS VARCHAR) AS DOUBLE) AS d, CAST(value > 50 AS INT) AS b, CAST(ts AS DATE) AS t FROM events"),
    "agg_if_and_moments": (f"SELECT event_type, count_if(value > 50) AS n, round(stddev_samp({V}), 4) AS s, round(var_pop({V}) / 1000000, 4) AS v, count(DISTINCT user_id) AS u, bool_or(value > 99) AS b FROM events GROUP BY event_type", f"SELECT event_type, CAST(count_if(value > 50) AS BIGINT) AS n, round(stddev_samp({V}), 4) AS s, round(var_pop({V}) / 1000000, 4) AS v, count(DISTINCT user_id) AS u, bool_or(value > 99) AS b FROM events GROUP BY event_type"),
    "recursive_cte": "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT r.n, count(e.event_id) AS events FROM r LEFT JOIN events e ON e.user_id = r.n GROUP BY r.n",
    "scalar_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
}

PLAIN |= {
    "join_right": "SELECT s.s_suppkey, n.n_name FROM nation n RIGHT JOIN supplier s ON n.n_nationkey = s.s_nationkey AND n.n_nationkey < 10",
    "join_theta": "SELECT n.n_nationkey AS nation, r.r_regionkey AS region FROM nation n JOIN region r ON n.n_regionkey < r.r_regionkey",
    "join_cross": "SELECT a.r_regionkey AS a, b.r_regionkey AS b FROM region a CROSS JOIN region b",
    "values_rows": "SELECT t.k, t.v, count(e.event_id) AS n FROM (VALUES (1, 'one'), (2, 'two'), (-1, 'none')) AS t(k, v) LEFT JOIN events e ON e.user_id = t.k GROUP BY t.k, t.v",
    "unnest_rows": ("SELECT p_partkey, explode(split(p_type, ' ')) AS word FROM part", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part"),
    "scalar_map_struct": ("SELECT event_id, element_at(map('a', user_id, 'b', user_id + 1), 'b') AS m, CAST(size(map_keys(map('a', 1, event_type, 2))) AS BIGINT) AS k, named_struct('x', user_id, 'y', event_type).y AS s FROM events", "SELECT event_id, user_id + 1 AS m, CAST(2 AS BIGINT) AS k, struct_pack(x := user_id, y := event_type).y AS s FROM events"),
    "window_tumbling": ("SELECT user_id, CAST(window(ts, '1 day').start AS TIMESTAMP_NTZ) AS started, count(*) AS n FROM events GROUP BY user_id, window(ts, '1 day')", "SELECT user_id, date_trunc('day', ts) AS started, count(*) AS n FROM events GROUP BY user_id, date_trunc('day', ts)"),
    "window_sliding": ("SELECT event_type, CAST(window(ts, '2 days', '1 day').start AS TIMESTAMP_NTZ) AS started, count(*) AS n FROM events GROUP BY event_type, window(ts, '2 days', '1 day')", "SELECT event_type, date_trunc('day', ts) - d * INTERVAL 1 DAY AS started, count(*) AS n FROM events CROSS JOIN (VALUES (0), (1)) AS t(d) GROUP BY ALL"),
}

SINCE = "PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '{}' PRECEDING AND CURRENT ROW"
LAST_1H, LAST_1D, LAST_7D = (f"({SINCE.format(x)})" for x in ("1' HOUR", "1' DAY", "7' DAY"))


def _frames(sql: str) -> str:
    return sql.replace("HOUR' PRECEDING", "HOUR PRECEDING").replace("DAY' PRECEDING", "DAY PRECEDING")


def _windowed(columns: str, where: str = "") -> str:
    return _frames(f"SELECT event_id, {columns} FROM ({EVENTS}) e{where}")


PLAIN |= {
    "win_sum_1h": _windowed(f"CAST(sum(v) OVER {LAST_1H} AS BIGINT) AS s"),
    "win_count_1h": _windowed(f"count(*) OVER {LAST_1H} AS n"),
    "win_avg_1h": _windowed(f"avg(v) OVER {LAST_1H} AS m"),
    "win_min_max_1d": _windowed(f"min(v) OVER {LAST_1D} AS lo, max(v) OVER {LAST_1D} AS hi"),
    "win_stddev_7d": _windowed(f"round(stddev_samp(v) OVER {LAST_7D}, 4) AS s, round(stddev_pop(v) OVER {LAST_7D}, 4) AS p"),
    "win_var_7d": _windowed(f"round(var_samp(v) OVER {LAST_7D} / 1000000, 3) AS s, round(var_pop(v) OVER {LAST_7D} / 1000000, 3) AS p"),
    "win_stddev_variance_1d": _windowed(f"round(stddev(v) OVER {LAST_1D}, 4) AS s, round(variance(v) OVER {LAST_1D} / 1000000, 3) AS x"),
    "win_multi_frame": _windowed(f"count(*) OVER {LAST_1H} AS n_1h, CAST(sum(v) OVER {LAST_7D} AS BIGINT) AS s_7d, avg(v) OVER {LAST_1D} AS m_1d"),
    "win_expr_args": _windowed(f"CAST(sum(v * 10 + 1) OVER {LAST_1D} AS BIGINT) AS s"),
    "win_filter_before": _windowed(f"CAST(sum(v) OVER {LAST_7D} AS BIGINT) AS s", " WHERE event_type = 'purchase'"),
    "win_named": _frames(f"SELECT event_id, count(*) OVER w1 AS n, max(v) OVER w2 AS hi FROM ({EVENTS}) e WINDOW w1 AS {LAST_1H}, w2 AS {LAST_7D}"),
}

#: Customers joined to their orders, then windows over order dates; equal dates are one frame on both sides.
README_JOIN = _frames(
    """SELECT o.o_orderkey, c.c_mktsegment, count(*) OVER w AS orders_90d, max(o.o_totalprice) OVER w AS dearest_90d
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
WINDOW w AS (PARTITION BY o.o_custkey ORDER BY o.o_orderdate RANGE BETWEEN INTERVAL '90' DAY PRECEDING AND CURRENT ROW)"""
)
PLAIN["readme_features_join"] = README_JOIN


# --- the thirty aggregates over seven days, ties by event_id

PAIRS = f"""WITH e AS ({EVENTS}),
p AS (SELECT r.event_id AS rid, x.v AS v, x.event_type AS k, (x.v > 5000) AS c FROM e r JOIN e x
      ON x.user_id = r.user_id AND x.ts >= r.ts - INTERVAL 7 DAY AND (x.ts < r.ts OR (x.ts = r.ts AND x.event_id <= r.event_id)))"""
#: DuckDB text of a metric by base.
_DUCK = {"sum": "CAST(CAST(sum(v) AS BIGINT) AS VARCHAR)", "count": "CAST(count(v) AS VARCHAR)", "min": "CAST(min(v) AS VARCHAR)", "max": "CAST(max(v) AS VARCHAR)", "avg": r"regexp_replace(printf('%.6f', avg(v)), '\.?0+$', '')"}
_RAW = {b: f"{b}(v)" for b in BASES}
_RATIO = "avg(CASE WHEN c THEN 1.0 ELSE 0.0 END)"


def _feature(name: str, *args: str) -> Query:
    return lambda spark, sf_dir: window_features(events(spark, sf_dir), ["user_id"], "ts", [Feature("f", name, args, 7 * DAY)], "event_id").select("event_id", "f")


def _joined(rows: str, missing: str = "''") -> str:
    return f"{PAIRS}, q AS ({rows}) SELECT e.event_id, coalesce(q.f, {missing}) AS f FROM e LEFT JOIN q ON q.rid = e.event_id"


def _listed(metric: str, where: str, order: str, limit: int | None = None) -> str:
    """rid and the joined "key:metric" list of DuckDB."""
    inner = f"SELECT rid, k, {metric} AS m, {order.split('|')[0]} AS o FROM p WHERE {where} GROUP BY rid, k"
    if limit is None:
        return f"SELECT rid, string_agg(k || ':' || m, ',' ORDER BY k || ':' || m) AS f FROM ({inner}) GROUP BY rid"
    by = "k DESC" if order.endswith("|k") else "o DESC, k DESC"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY rid ORDER BY {by}) AS rn FROM ({inner})"
    return f"SELECT rid, string_agg(k || ':' || m, ',' ORDER BY rn) AS f FROM ({ranked}) WHERE rn <= {limit} GROUP BY rid"


def _aggregates() -> tuple[dict[str, Query], dict[str, str]]:
    queries, oracle = {}, {}
    for b in BASES:
        cast = f"CAST({b}(CASE WHEN c THEN v END) AS BIGINT)" if b in ("sum", "count") else f"{b}(CASE WHEN c THEN v END)"
        queries[f"{b}_where"] = _feature(f"{b}_where", "v", COND)
        oracle[f"{b}_where"] = f"{PAIRS} SELECT rid AS event_id, {cast} AS f FROM p GROUP BY rid"
        queries[f"{b}_cate"] = _feature(f"{b}_cate", "v", "event_type")
        oracle[f"{b}_cate"] = _joined(_listed(_DUCK[b], "true", "1|k"))
        queries[f"{b}_cate_where"] = _feature(f"{b}_cate_where", "v", COND, "event_type")
        oracle[f"{b}_cate_where"] = _joined(_listed(_DUCK[b], "c", "1|k"))
        for by, order in (("key", "1|k"), ("value", f"{_RAW[b]}|o")):
            name = f"top_n_{by}_{b}_cate_where"
            queries[name] = _feature(name, "v", COND, "event_type", "2")
            oracle[name] = _joined(_listed(_DUCK[b], "c", order, 2))
    for by, order in (("key", "1|k"), ("value", f"{_RATIO}|o")):
        name = f"top_n_{by}_ratio_cate"
        queries[name] = _feature(name, "v", COND, "event_type", "2")
        oracle[name] = _joined(_listed(rf"regexp_replace(printf('%.6f', {_RATIO}), '\.?0+$', '')", "true", order, 2))
    queries["top_value"] = _feature("top", "v", "3")
    oracle["top_value"] = _joined("SELECT rid, string_agg(CAST(v AS VARCHAR), ',' ORDER BY rn) AS f FROM (SELECT rid, v, row_number() OVER (PARTITION BY rid ORDER BY v DESC) AS rn FROM p) WHERE rn <= 3 GROUP BY rid")
    queries["topn_frequency"] = _feature("topn_frequency", "event_type", "2")
    oracle["topn_frequency"] = _joined("SELECT rid, string_agg(k, ',' ORDER BY rn) AS f FROM (SELECT rid, k, row_number() OVER (PARTITION BY rid ORDER BY count(*) DESC, k DESC) AS rn FROM p GROUP BY rid, k) WHERE rn <= 2 GROUP BY rid")
    queries["top1_ratio"] = _feature("top1_ratio", "event_type")
    oracle["top1_ratio"] = _joined("SELECT rid, CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS f FROM (SELECT rid, k, count(*) AS n FROM p GROUP BY rid, k) GROUP BY rid", "0.0")
    return queries, oracle


# --- operators with a DataFrame form


def win_ties_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = events(spark, sf_dir).withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return window_features(rounded, ["user_id"], "ts", [Feature("s", "sum", ("v",), 2 * DAY), Feature("n", "count", (), 2 * DAY)], "event_id").select("event_id", "s", "n")


WIN_TIES = f"""WITH e AS (SELECT event_id, user_id, date_trunc('day', ts) AS ts, v FROM ({EVENTS}))
SELECT r.event_id, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS n FROM e r JOIN e x
ON x.user_id = r.user_id AND x.ts >= r.ts - INTERVAL 2 DAY AND (x.ts < r.ts OR (x.ts = r.ts AND x.event_id <= r.event_id)) GROUP BY r.event_id"""


def _requests(spark: SparkSession, sf_dir: str, exclude: bool) -> DataFrame:
    every = events(spark, sf_dir)
    asked = every.withColumn("ts", F.expr("ts + INTERVAL '90' MINUTE"))
    made = [Feature("s", "sum", ("v",), DAY), Feature("n", "count", (), 7 * DAY), Feature("k", "sum_cate", ("v", "event_type"), 7 * DAY)]
    return request_features(every, asked, ["user_id"], "ts", made, exclude).select("event_id", "s", "n", "k")


def _requests_sql(exclude: bool) -> str:
    own = "" if exclude else " UNION ALL SELECT event_id, ts, ts, v, event_type FROM r"
    return f"""WITH e AS ({EVENTS}), r AS (SELECT event_id, user_id, ts + INTERVAL 90 MINUTE AS ts, event_type, v FROM e),
p AS (SELECT r.event_id AS rid, r.ts AS asked, e.ts AS ts, e.v AS v, e.event_type AS k FROM r JOIN e ON e.user_id = r.user_id AND e.ts <= r.ts AND e.ts >= r.ts - INTERVAL 7 DAY{own}),
a AS (SELECT rid, CAST(sum(CASE WHEN ts >= asked - INTERVAL 1 DAY THEN v END) AS BIGINT) AS s, count(*) AS n FROM p GROUP BY rid),
c AS (SELECT rid, string_agg(k || ':' || m, ',' ORDER BY k || ':' || m) AS k FROM (SELECT rid, k, CAST(CAST(sum(v) AS BIGINT) AS VARCHAR) AS m FROM p GROUP BY rid, k) GROUP BY rid)
SELECT r.event_id, a.s, coalesce(a.n, 0) AS n, coalesce(c.k, '') AS k FROM r LEFT JOIN a ON a.rid = r.event_id LEFT JOIN c ON c.rid = r.event_id"""


def tiled_sum_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiled_features(events(spark, sf_dir), ["user_id"], "ts", "v", 7 * DAY, "event_id").select("event_id", "w_sum", "w_count")


def tiled_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three keys only, whose windows hold thousands of rows."""
    dense = events(spark, sf_dir).withColumn("k", F.col("user_id") % 3)
    return tiled_features(dense, ["k"], "ts", "v", 7 * DAY, "event_id").select("event_id", "w_sum", "w_count", "w_max")


TILED_DENSE = f"""WITH e AS (SELECT *, user_id % 3 AS g FROM ({EVENTS}))
SELECT r.event_id, CAST(sum(x.v) AS BIGINT) AS w_sum, count(*) AS w_count, max(x.v) AS w_max FROM e r JOIN e x
ON x.g = r.g AND x.ts >= r.ts - INTERVAL 7 DAY AND (x.ts < r.ts OR (x.ts = r.ts AND x.event_id <= r.event_id)) GROUP BY r.event_id"""


def _specified(spark: SparkSession, sf_dir: str, sql: str, **more) -> DataFrame:
    rounded = events(spark, sf_dir).withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    spec = PipelineSpec(sql, (SourceSpec("e", "vector", options={"data": rounded}),), sequence="event_id", **more)
    return compile_query(spark, spec.validate())


TIES_SPEC = "SELECT event_id, sum(v) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '2 days' PRECEDING AND CURRENT ROW) AS s, count(*) OVER(PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 WEEK PRECEDING AND CURRENT ROW) AS n FROM e"
TIES_SPEC_DUCK = f"""WITH e AS (SELECT event_id, user_id, event_type, date_trunc('day', ts) AS ts, v FROM ({EVENTS}))
SELECT r.event_id, CAST(sum(CASE WHEN x.ts >= r.ts - INTERVAL 2 DAY THEN x.v END) AS BIGINT) AS s, count(CASE WHEN x.event_type = r.event_type THEN 1 END) AS n FROM e r JOIN e x
ON x.user_id = r.user_id AND x.ts >= r.ts - INTERVAL 7 DAY AND (x.ts < r.ts OR (x.ts = r.ts AND x.event_id <= r.event_id)) GROUP BY r.event_id"""
TILED_SPEC = "SELECT event_id, sum(v) OVER w AS w_sum, count(*) OVER w AS w_count FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '7' DAY PRECEDING AND CURRENT ROW)"
TILED_SPEC_DUCK = TIES_SPEC_DUCK.replace("CAST(sum(CASE WHEN x.ts >= r.ts - INTERVAL 2 DAY THEN x.v END) AS BIGINT) AS s, count(CASE WHEN x.event_type = r.event_type THEN 1 END) AS n", "CAST(sum(x.v) AS BIGINT) AS w_sum, count(*) AS w_count")


def request_keys_and_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = events(spark, sf_dir)
    made = [Feature("s", "sum", ("v",), DAY), Feature("n", "count", (), 7 * DAY)]
    return request_features(every, every.select("user_id", "ts").distinct(), ["user_id"], "ts", made, True).select("user_id", "ts", "s", "n")


REQUEST_KEYS = f"""WITH e AS ({EVENTS}), r AS (SELECT DISTINCT user_id, ts FROM e)
SELECT r.user_id, r.ts, CAST(sum(CASE WHEN e.ts >= r.ts - INTERVAL 1 DAY THEN e.v END) AS BIGINT) AS s, count(*) AS n
FROM r JOIN e ON e.user_id = r.user_id AND e.ts <= r.ts AND e.ts >= r.ts - INTERVAL 7 DAY GROUP BY r.user_id, r.ts"""


def chain_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Chain(events(spark, sf_dir)).filter("v > 1000").project("user_id", "v * 2 AS w").key_by(bucket="user_id % 8").reduce("w", ("max", "count")).run(spark)


def json_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through JSON arrays, one a key, and back."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "v")
    return files.from_json_array(files.to_json_array(rows, "user_id").select("value"), rows.schema)


def group_by_custom_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.aggregate(events(spark, sf_dir), ["user_id"], best=("top_n_value_sum_cate_where", "v", COND, "event_type", "2"), share=("top1_ratio", "event_type"), means=("avg_cate", "v", "event_type"))


GROUPED_ALL = f"""WITH e AS (SELECT user_id AS rid, event_type AS k, v, (v > 5000) AS c FROM ({EVENTS})),
b AS (SELECT rid, string_agg(k || ':' || CAST(m AS VARCHAR), ',' ORDER BY rn) AS f FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY m DESC, k DESC) AS rn FROM (SELECT rid, k, CAST(sum(v) AS BIGINT) AS m FROM e WHERE c GROUP BY rid, k)) WHERE rn <= 2 GROUP BY rid),
s AS (SELECT rid, CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS f FROM (SELECT rid, k, count(*) AS n FROM e GROUP BY rid, k) GROUP BY rid),
a AS (SELECT rid, string_agg(k || ':' || m, ',' ORDER BY k || ':' || m) AS f FROM (SELECT rid, k, {_DUCK["avg"]} AS m FROM e GROUP BY rid, k) GROUP BY rid)
SELECT s.rid AS user_id, coalesce(b.f, '') AS best, s.f AS share, a.f AS means FROM s JOIN a USING (rid) LEFT JOIN b USING (rid)"""


def tiled_min_max_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = (3600 * 10**6, 6 * 3600 * 10**6)
    return tiled_features(events(spark, sf_dir), ["user_id"], "ts", "v", 7 * DAY, "event_id", tiles).select("event_id", "w_min", "w_max", "w_avg")


def reduce_all_aggregations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.reduce_by(events(spark, sf_dir), ["user_id"], "v")


def reduce_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.reduce_by(events(spark, sf_dir), ["event_type"], "v", ("average",))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.upsert_latest(events(spark, sf_dir), ["user_id", "event_type"], "event_id")


def watermark_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrived = events(spark, sf_dir).withColumn("arrival", F.expr("(event_id * 7919 % 1000) div 10 + event_id div 1000 * 100"))
    return relational.late_split(arrived, "arrival", "ts", 10 * DAY).select("event_id", "accepted")


LATE = f"""WITH e AS (SELECT event_id, ts, (event_id * 7919 % 1000) // 10 + event_id // 1000 * 100 AS arrival FROM events),
b AS (SELECT arrival, max(ts) AS m FROM e GROUP BY arrival),
w AS (SELECT arrival, max(m) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 DAY AS wm FROM b)
SELECT e.event_id, coalesce(e.ts > w.wm, true) AS accepted FROM e JOIN w USING (arrival)"""


def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = events(spark, sf_dir)
    return relational.as_of_join(every.where("event_type = 'purchase'"), every.where("event_type = 'view'"), ["user_id"], "ts", ["v"]).select("event_id", "asof_v")


AS_OF = f"""WITH e AS ({EVENTS}) SELECT l.event_id, r.v AS asof_v FROM (SELECT * FROM e WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts >= r.ts"""


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = events(spark, sf_dir)
    joined = relational.interval_join(every.where("event_type = 'purchase'"), every.where("event_type = 'click'"), ["user_id"], "ts", "ts", 86_400)
    return joined.select("event_id", "r_event_id")


INTERVAL = f"WITH e AS ({EVENTS}) SELECT l.event_id, r.event_id AS r_event_id FROM e l JOIN e r ON l.user_id = r.user_id AND l.event_type = 'purchase' AND r.event_type = 'click' AND l.ts >= r.ts AND l.ts <= r.ts + INTERVAL 1 DAY"


def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


SESSIONS = """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM m)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, g"""


def datagen_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = datagen.Datagen(
        {"event_time": datagen.Generator("IncrementalTimestamp", 1_000_000, 100), "key": datagen.Generator("Key", num_unique=6), "id": datagen.Generator("Increment", 1, 1, type="long"), "category": datagen.Generator("Values", values=("A", "B", "C"))},
        limit=121,
        parallelism=2,
        replayable=True,
    )
    return datagen.batch(spark, spec).select(F.unix_millis("event_time").alias("ms"), "key", "id", "category")


DATAGEN = """WITH r AS (SELECT range AS n, least(range // 60, 1) AS t FROM range(121)), l AS (SELECT t, n - t * 60 AS j FROM r)
SELECT 1000000 + (j // 3) * 100 AS ms, 'key-' || t || '-' || (j % 3) AS key, j // 3 + 1 AS id, ['A', 'B', 'C'][CAST((j // 3) % 3 + 1 AS INTEGER)] AS category FROM l"""


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = datagen.words(spark, [f"word{n}" for n in range(10)], 1000)
    return made.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def grouped_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.aggregate(events(spark, sf_dir), ["user_id"], spent=("sum_cate_where", "v", COND, "event_type"), frequent=("topn_frequency", "event_type", "1"))


GROUPED = f"""WITH e AS (SELECT user_id AS rid, event_type AS k, v, (v > 5000) AS c FROM ({EVENTS})),
s AS (SELECT rid, string_agg(k || ':' || m, ',' ORDER BY k || ':' || m) AS f FROM (SELECT rid, k, CAST(CAST(sum(v) AS BIGINT) AS VARCHAR) AS m FROM e WHERE c GROUP BY rid, k) GROUP BY rid),
t AS (SELECT rid, k FROM (SELECT rid, k, row_number() OVER (PARTITION BY rid ORDER BY count(*) DESC, k DESC) AS rn FROM e GROUP BY rid, k) WHERE rn = 1)
SELECT t.rid AS user_id, coalesce(s.f, '') AS spent, t.k AS frequent FROM t LEFT JOIN s USING (rid)"""

SQL_CUSTOM = _frames(f"SELECT event_id, sum_cate_where(v, v > 5000, event_type) OVER w AS f, top(v, 2) OVER w AS t FROM ({EVENTS}) e WINDOW w AS {LAST_7D}")
SQL_CUSTOM_DUCK = (
    PAIRS
    + f""", s AS ({_listed(_DUCK['sum'], 'c', '1|k')}), t AS (SELECT rid, string_agg(CAST(v AS VARCHAR), ',' ORDER BY rn) AS f FROM (SELECT rid, v, row_number() OVER (PARTITION BY rid ORDER BY v DESC) AS rn FROM p) WHERE rn <= 2 GROUP BY rid)
SELECT e.event_id, coalesce(s.f, '') AS f, t.f AS t FROM e LEFT JOIN s ON s.rid = e.event_id LEFT JOIN t ON t.rid = e.event_id"""
)

FLAGSHIP = _frames(f"SELECT event_id, user_id, ts, count(*) OVER w1h AS events_1h, CAST(sum(v) OVER w7d AS BIGINT) AS spent_7d FROM ({EVENTS}) e WINDOW w1h AS {LAST_1H}, w7d AS {LAST_7D}")
PLAIN["flagship"] = FLAGSHIP

_FUNCTIONS: dict[str, tuple[Query, str]] = {
    "win_ties_running": (win_ties_running, WIN_TIES),
    "request_include_current": (lambda s, d: _requests(s, d, False), _requests_sql(False)),
    "request_exclude_current": (lambda s, d: _requests(s, d, True), _requests_sql(True)),
    "tiled_sum_7d": (tiled_sum_7d, f"{PAIRS} SELECT rid AS event_id, CAST(sum(v) AS BIGINT) AS w_sum, count(*) AS w_count FROM p GROUP BY rid"),
    "tiled_min_max_7d": (tiled_min_max_7d, f"{PAIRS} SELECT rid AS event_id, min(v) AS w_min, max(v) AS w_max, avg(v) AS w_avg FROM p GROUP BY rid"),
    "tiled_dense": (tiled_dense, TILED_DENSE),
    "spec_exact_ties": (lambda s, d: _specified(s, d, TIES_SPEC), TIES_SPEC_DUCK),
    "spec_tiles": (lambda s, d: _specified(s, d, TILED_SPEC, tiles_ms=(3_600_000, 86_400_000)), TILED_SPEC_DUCK),
    "request_keys_and_time": (request_keys_and_time, REQUEST_KEYS),
    "chain_reduce": (chain_reduce, f'SELECT user_id % 8 AS bucket, CAST(max(v * 2) AS DOUBLE) AS "max", count(*) AS "count" FROM ({EVENTS}) WHERE v > 1000 GROUP BY user_id % 8'),
    "json_codec": (json_codec, f"SELECT event_id, user_id, event_type, v FROM ({EVENTS})"),
    "group_by_custom_all": (group_by_custom_all, GROUPED_ALL),
    "reduce_all_aggregations": (reduce_all_aggregations, f'SELECT user_id, CAST(min(v) AS DOUBLE) AS "min", CAST(max(v) AS DOUBLE) AS "max", CAST(sum(v) AS DOUBLE) AS "sum", count(*) AS "count", avg(v) AS average FROM ({EVENTS}) GROUP BY user_id'),
    "reduce_single": (reduce_single, f"SELECT event_type, avg(v) AS average FROM ({EVENTS}) GROUP BY event_type"),
    "upsert_latest": (upsert_latest, f"WITH e AS ({EVENTS}) SELECT event_id, user_id, ts, event_type, v FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM e) WHERE rn = 1"),
    "watermark_late_drop": (watermark_late_drop, LATE),
    "as_of_join": (as_of_join, AS_OF),
    "interval_join": (interval_join, INTERVAL),
    "session_window": (session_window, SESSIONS),
    "datagen_keys": (datagen_keys, DATAGEN),
    "word_count": (word_count, "SELECT 'word' || range AS word, CAST(1000 AS BIGINT) AS n FROM range(10)"),
    "group_by_custom": (grouped_custom, GROUPED),
    "sql_custom_aggregates": (statement(SQL_CUSTOM), SQL_CUSTOM_DUCK),
}


def queries() -> dict[str, Query]:
    found = {name: statement(sql if isinstance(sql, str) else sql[0]) for name, sql in PLAIN.items()}
    return found | _aggregates()[0] | {name: q for name, (q, _) in _FUNCTIONS.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: sql if isinstance(sql, str) else sql[1] for name, sql in PLAIN.items()}
    return found | _aggregates()[1] | {name: sql for name, (_, sql) in _FUNCTIONS.items()}
