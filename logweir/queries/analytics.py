"""Queries of charts, joins, sets, stored SQL, rates, routing and key-value tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import charts as c
from ..operators import filters as f
from ..operators import keyvalues as k
from ..operators import rates as n
from ..operators import routing as r
from ..operators import rule_index
from ..plans import stored as z
from ..rules import ChartRule, RoutingRule
from ..rules import FilterRule as R
from ..rules import SelectRule as S
from ..sources.events import logs_view
from .common import FLAT, LOGS, NOW, Query, flat, naive, on_logs, table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def chart(name: str, sql_value: str, agg: str, path: str = "metadata.value", period: str = "hour", where: str = "TRUE", rules=(), round_to: int | None = 6) -> None:
    def query(df: DataFrame) -> DataFrame:
        out = c.chart(f.filter_events(df, rules), agg, path, period)
        return out.withColumn("value", F.round("value", round_to)) if round_to is not None else out

    value = f"round({sql_value}, {round_to})" if round_to is not None else sql_value
    register(name, on_logs(query), f"SELECT date_trunc('{period}', \"timestamp\") AS \"timestamp\", {value} AS value FROM {LOGS} WHERE {where} GROUP BY 1")


chart("a01_count", "count(*)", "count", "timestamp", "minute", round_to=None)
chart("a02_countd", "count(DISTINCT user_id)", "countd", "metadata.user_id", "day", round_to=None)
chart("a03_avg", "avg(value)", "avg")
chart("a04_sum", "sum(value)", "sum", period="day")
chart("a05_max", "max(value)", "max", where="level = 'error'", rules=[R("m.level", "=", "error")])
chart("a06_p50", "quantile_cont(value, 0.5)", "p50")
chart("a06_p95", "quantile_cont(value, 0.95)", "p95", period="day")
chart("a06_p99", "quantile_cont(value, 0.99)", "p99", period="day")
chart("a07_second", "count(*)", "count", "timestamp", "second", round_to=None)


def volume(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = c.chart(li, "sum", "l_quantity", "day", time="l_shipdate")
    return naive(out.withColumn("value", F.round("value", 2)))


register("a07_day_volume", volume, "SELECT date_trunc('day', l_shipdate) AS \"timestamp\", round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1")
register("a08_zone", on_logs(lambda df: c.chart(df, "count", "timestamp", "day", zone="Etc/GMT+5")), f"SELECT date_trunc('day', \"timestamp\" - INTERVAL 5 HOUR) + INTERVAL 5 HOUR AS \"timestamp\", count(*) AS value FROM {LOGS} GROUP BY 1")


def nested(spark, sf_dir):
    df = logs_view(spark, sf_dir).withColumn("words", F.split("event_message", " "))
    return naive(c.chart_nested(df, "countd", "words", "day", lambda x: F.rlike(x, F.lit(r"^\d+$"))))


register("a09_nested", nested, f"SELECT date_trunc('day', t) AS \"timestamp\", count(DISTINCT w) AS value FROM (SELECT \"timestamp\" AS t, unnest(string_split(event_message, ' ')) AS w FROM {LOGS}) WHERE regexp_matches(w, '^\\d+$') GROUP BY 1")
_levels = ", ".join(f"count(*) FILTER (level IN ({', '.join(repr(x) for x in texts)})) AS {name}" for name, texts in c.LEVEL_TEXTS.items())
_known = ", ".join(repr(x) for texts in c.LEVEL_TEXTS.values() for x in texts)
register("a10_levels", on_logs(lambda df: c.level_chart(df, "metadata.level", "hour")), f"SELECT date_trunc('hour', \"timestamp\") AS \"timestamp\", count(*) FILTER (level IS NULL OR level NOT IN ({_known})) AS other, {_levels}, count(*) AS total FROM {LOGS} GROUP BY 1")
_statuses = ", ".join(f"count(*) FILTER (status_code BETWEEN {100 * i} AND {100 * i + 99}) AS status_{i}xx" for i in range(1, 6))
_status_sql = f"SELECT date_trunc('hour', \"timestamp\") AS \"timestamp\", count(*) FILTER (status_code IS NULL OR status_code BETWEEN 0 AND 99 OR status_code >= 601) AS other, {_statuses}, count(*) AS total FROM {LOGS} GROUP BY 1"
register("a11_statuses", on_logs(lambda df: c.status_chart(df, "metadata.status_code", "hour")), _status_sql)
register("a12_auto", on_logs(lambda df: c.auto_chart(df, "hour")), _status_sql)

_low, _high = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12)


def filled(spark, sf_dir):
    """The flagship: a filtered hourly chart with its gaps filled."""
    df = f.where_time(f.filter_events(logs_view(spark, sf_dir), [R("m.level", "=", "error")]), _low, _high)
    out = naive(c.chart(df, "avg", "metadata.value", "hour"))
    return naive(c.fill_missing(out.withColumn("value", F.round("value", 6)), _low, _high, "hour"))


register("a13_filled", filled, f"""WITH b AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-12', INTERVAL 1 HOUR)) AS "timestamp"),
v AS (SELECT date_trunc('hour', "timestamp") AS "timestamp", round(avg(value), 6) AS value FROM {LOGS} WHERE level = 'error' AND "timestamp" BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' GROUP BY 1)
SELECT b."timestamp", COALESCE(v.value, 0) AS value FROM b LEFT JOIN v USING ("timestamp")""")
register("a14_default_window", on_logs(lambda df: c.latest_buckets(c.chart(c.default_window(df, "hour", NOW), "count", "timestamp", "hour"), "hour")), f"SELECT date_trunc('hour', \"timestamp\") AS \"timestamp\", count(*) AS value FROM {LOGS} WHERE \"timestamp\" >= TIMESTAMP '2024-01-31' - INTERVAL 168 HOUR GROUP BY 1 ORDER BY 1 DESC LIMIT 168")
register("a15_auto_period", on_logs(lambda df: c.chart(df, "count", "timestamp", "auto", max_ticks=1000)), f"SELECT date_trunc('hour', \"timestamp\") AS \"timestamp\", count(*) AS value FROM {LOGS} GROUP BY 1")
register("a16_total", on_logs(c.count_total), f"SELECT count(*) AS total FROM {LOGS}")
register("a17_distinct", on_logs(lambda df: df.select("metadata.level", "metadata.user_id").distinct()), f"SELECT DISTINCT level, user_id FROM {LOGS}")
register("a18_having", on_logs(lambda df: df.groupBy("metadata.user_id").agg(F.count("*").alias("n")).filter("n > 15")), f"SELECT user_id, count(*) AS n FROM {LOGS} GROUP BY 1 HAVING count(*) > 15")
register("a19_filtered", on_logs(lambda df: df.groupBy("source").agg(F.count_if(F.col("metadata.value") > 50).alias("high"), F.round(F.sum(F.when(F.col("metadata.status_code") >= 500, F.col("metadata.value"))), 4).alias("bad"))), f"SELECT source, count(*) FILTER (value > 50) AS high, round(sum(value) FILTER (status_code >= 500), 4) AS bad FROM {LOGS} GROUP BY 1")
register("a20_counts", on_logs(lambda df: df.groupBy("source").agg(F.count("*").alias("n"), F.count("metadata.value").alias("values"), F.count_distinct("metadata.user_id").alias("users"))), f"SELECT source, count(*) AS n, count(value) AS \"values\", count(DISTINCT user_id) AS users FROM {LOGS} GROUP BY 1")


def usage(spark, sf_dir) -> DataFrame:
    """Orders as billing rows."""
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 50).alias("user_id"), F.lit(1).cast("long").alias("count"), F.col("o_orderdate").alias("inserted_at"))


_from, _to = dt.date(1996, 1, 1), dt.date(1996, 1, 31)
_usage = "(SELECT o_custkey % 50 AS user_id, CAST(1 AS BIGINT) AS count, o_orderdate AS inserted_at FROM orders)"
register("a21_daily_usage", lambda s, d: c.daily_usage(usage(s, d), _from, _to), f"""WITH u AS (SELECT DISTINCT user_id FROM {_usage}), days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-01-31', INTERVAL 1 DAY)) AS DATE) AS date),
v AS (SELECT user_id, CAST(inserted_at AS DATE) AS date, CAST(sum(count) AS BIGINT) AS count FROM {_usage} GROUP BY 1, 2)
SELECT days.date, u.user_id, COALESCE(v.count, 0) AS count FROM u CROSS JOIN days LEFT JOIN v ON v.user_id = u.user_id AND v.date = days.date""")
register("a22_cumulative_usage", lambda s, d: c.cumulative_usage(usage(s, d), _from, _to), f"SELECT COALESCE(CAST(sum(count) AS BIGINT), 0) AS count FROM {_usage} WHERE CAST(inserted_at AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-01-31'")
_classes = {"english": "/en/", "german": "/de/", "french": "/fr/"}


def requests(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("url", (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(mins=F.col("page_id").cast("int"))).alias("timestamp"))
    return naive(c.request_counts(pages, "url", "hour", classes=_classes))


register("a23_requests", requests, "SELECT date_trunc('hour', TIMESTAMP '2024-01-01' + to_minutes(page_id)) AS \"timestamp\", " + ", ".join(f"count(*) FILTER (regexp_matches(url, '{p}')) AS total_{x}_requests" for x, p in _classes.items()) + " FROM pages GROUP BY 1")
register("a24_ingest", on_logs(lambda df: c.ingest_metrics(df, ["source"])), f"SELECT source, CAST(sum(strlen(event_message)) AS BIGINT) AS bytes, count(*) AS events FROM {LOGS} GROUP BY 1")


# joins


def joined(how: str):
    def query(spark, sf_dir):
        cu = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select("c_custkey", "c_name")
        o = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select("o_orderkey", "o_custkey")
        return cu.join(o, cu.c_custkey == o.o_custkey, how)

    return query


_c = "(SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000)"
_o = "(SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000)"
for _how in ("inner", "left", "right", "full"):
    register(f"j01_{_how}", joined(_how), f"SELECT c_custkey, c_name, o_orderkey, o_custkey FROM {_c} {_how} JOIN {_o} ON c_custkey = o_custkey")
register("j02_cross", lambda s, d: table(s, d, "nation").select("n_name").crossJoin(table(s, d, "region").select("r_name")), "SELECT n_name, r_name FROM nation CROSS JOIN region")
register("j03_array_join", lambda s, d: table(s, d, "documents").select("doc_id", F.explode_outer(F.filter(F.split("text", " "), lambda x: F.startswith(x, F.lit("thre")))).alias("word")), "SELECT doc_id, w AS word FROM documents LEFT JOIN LATERAL (SELECT unnest(list_filter(string_split(text, ' '), lambda x: starts_with(x, 'thre'))) AS w) ON TRUE")
register("j04_lateral", lambda s, d: table(s, d, "documents").alias("t").lateralJoin(s.tvf.explode(F.split(F.col("t.text").outer(), "\n"))).select("doc_id", F.col("col").alias("line")), "SELECT doc_id, line FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line)")


def looked_up(spark, sf_dir):
    from ..operators.prepare import enrich_from_key_values

    kv = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.to_json(F.struct("n_name", "n_regionkey")).alias("value"))
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return enrich_from_key_values(cu, kv, [("c_nationkey", "nation", "n_name")])


register("j05_lookup", looked_up, "SELECT c_custkey, c_nationkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
register("j06_semi", joined("left_semi"), f"SELECT * FROM {_c} WHERE EXISTS (SELECT 1 FROM {_o} WHERE o_custkey = c_custkey)")
register("j07_anti", joined("left_anti"), f"SELECT * FROM {_c} WHERE NOT EXISTS (SELECT 1 FROM {_o} WHERE o_custkey = c_custkey)")


def theta(spark, sf_dir):
    a, b = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey"), table(spark, sf_dir, "nation")
    return a.join(b, (a.s_nationkey == b.n_nationkey) & (a.s_acctbal > b.n_regionkey * 1000)).select("s_suppkey", "n_name")


register("j08_theta", theta, "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > n_regionkey * 1000")


def on_series(spark, sf_dir):
    days = c.series(table(spark, sf_dir, "orders"), dt.datetime(1996, 1, 1), dt.datetime(1996, 3, 1), "day", "day")
    o = table(spark, sf_dir, "orders").filter("o_orderdate < timestamp_ntz'1996-04-01' and o_orderdate >= timestamp_ntz'1996-02-01'").groupBy(F.date_trunc("day", "o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return naive(days.join(o, "day", "full").select("day", F.coalesce("n", F.lit(0)).alias("n")))


register("j09_series", on_series, "SELECT COALESCE(s.day, v.day) AS day, COALESCE(n, 0) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-03-01', INTERVAL 1 DAY)) AS day) s FULL JOIN (SELECT date_trunc('day', o_orderdate) AS day, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1996-04-01' GROUP BY 1) v ON s.day = v.day")


def correlated(spark, sf_dir):
    from ..operators.correlate import correlate_traces

    logs = logs_view(spark, sf_dir).select("id", F.col("metadata.user_id").cast("string").alias("trace_id"))
    spans = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("trace_id"), F.col("c_name").alias("span_id"), F.col("c_mktsegment").alias("span_name"))
    return correlate_traces(spans, logs).select("id", "trace_id", "span_id", "span_name")


register("j10_traces", correlated, f"SELECT id, CAST(user_id AS VARCHAR) AS trace_id, c_name AS span_id, c_mktsegment AS span_name FROM {LOGS} JOIN customer ON user_id = c_custkey")


# sets and stored SQL


def users(df: DataFrame, level: str) -> DataFrame:
    return df.filter(F.col("metadata.level") == level).select("metadata.user_id")


def _users(level: str) -> str:
    return f"SELECT user_id FROM {LOGS} WHERE level = '{level}'"


register("z01_union_all", on_logs(lambda df: users(df, "error").unionByName(users(df, "notice"))), f"{_users('error')} UNION ALL {_users('notice')}")
register("z01_union", on_logs(lambda df: users(df, "error").unionByName(users(df, "notice")).distinct()), f"{_users('error')} UNION {_users('notice')}")
register("z02_except", on_logs(lambda df: users(df, "notice").subtract(users(df, "error"))), f"{_users('notice')} EXCEPT {_users('error')}")
register("z03_intersect", on_logs(lambda df: users(df, "error").intersect(users(df, "notice"))), f"{_users('error')} INTERSECT {_users('notice')}")


def sql(text: str, params: dict | None = None) -> Query:
    """A stored query over views of the tables; the same text is the oracle's, with values for parameters."""
    def query(spark, sf_dir):
        for name in ("orders", "customer", "nation", "lineitem"):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
        return z.run_stored(spark, text, params, max_rows=None)

    return query


_cte = "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey), named AS (SELECT c_name, n FROM customer JOIN big ON c_custkey = o_custkey) SELECT c_name, n FROM named WHERE n > 3"
register("z04_cte", sql(_cte), _cte)
_sub = "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey IN (SELECT r FROM (VALUES (1), (2)) AS v(r)))"
register("z05_subqueries", sql(_sub), _sub)


def nesting(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    z.stored_query(spark, "dear_orders", "SELECT * FROM orders WHERE o_totalprice > @least", {"least": 250000})
    z.stored_query(spark, "dear_by_customer", "SELECT o_custkey, count(*) AS n FROM dear_orders GROUP BY o_custkey")
    return z.run_stored(spark, "SELECT * FROM dear_by_customer WHERE n >= @n", {"n": 2}, max_rows=None)


register("z06_nested_views", nesting, "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 250000 GROUP BY 1 HAVING count(*) >= 2")
register("z07_parameters", sql("SELECT o_orderkey FROM orders WHERE o_orderstatus = @status AND (@priority IS NULL OR o_orderpriority = @priority) AND '@status' <> 'x'", {"status": "F"}), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")


def isolated(spark, sf_dir):
    views = {"logs": logs_view(spark, sf_dir), "errors": logs_view(spark, sf_dir).filter("metadata.level = 'error'")}
    return z.run_over_views(spark, views, "SELECT count(*) AS n, count(DISTINCT metadata.user_id) AS users FROM errors WHERE id IN (SELECT id FROM logs WHERE metadata.value > @v)", {"v": 10})


register("z08_views_only", isolated, f"SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM {LOGS} WHERE level = 'error' AND value > 10")
register("z09_search_view", on_logs(lambda df: z.search_view(df, [R("m.level", "=", "error")], [S("id"), S("metadata.user_id")])), f"SELECT id, user_id AS metadata_user_id FROM {LOGS} WHERE level = 'error'")
register("z09_chart_view", on_logs(lambda df: z.search_view(df, [R("m.level", "=", "error")], charts=ChartRule("count", "timestamp", "day"))), f"SELECT date_trunc('day', \"timestamp\") AS \"timestamp\", count(*) AS value FROM {LOGS} WHERE level = 'error' GROUP BY 1")


def sources(spark, sf_dir):
    df = logs_view(spark, sf_dir)
    return naive(z.union_sources({x: df.filter(F.col("source") == x).drop("source") for x in ("click", "error")}, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 8)))


register("z10_union_sources", sources, f"SELECT id, \"timestamp\", event_message, source FROM {LOGS} WHERE source IN ('click', 'error') AND \"timestamp\" > TIMESTAMP '2024-01-05' AND \"timestamp\" <= TIMESTAMP '2024-01-08'")


# routing

RULES = (
    RoutingRule(1, (R("metadata.level", "=", "error"),), "errors"),
    RoutingRule(2, (R("metadata.value", ">", 50), R("metadata.event_type", "=", "purchase")), "dear"),
    RoutingRule(3, (R("event_message", "~", "user 1[0-9]$"),), "few"),
    RoutingRule(4, (R("metadata.level", "=", "debug", negate=True), R("metadata.status_code", "range", values=(500, 599))), "broken"),
    RoutingRule(5, (R("metadata.missing", "=", "x", negate=True),), "never"),
)
_rules = {1: "level = 'error'", 2: "value > 50 AND event_type = 'purchase'", 3: "regexp_matches(event_message, 'user 1[0-9]$')", 4: "level <> 'debug' AND status_code BETWEEN 500 AND 599"}
_hits = " UNION ALL ".join(f"SELECT id, CAST({i} AS BIGINT) AS via_rule_id FROM {LOGS} WHERE {w}" for i, w in _rules.items())
_names = " ".join(f"WHEN {x.rule_id} THEN '{x.target}'" for x in RULES)
register("r01_match", on_logs(lambda df: r.match_rules(df, RULES).select("id", F.array_join(F.transform("rule_ids", lambda x: x.cast("string")), ",").alias("rules"))), f"SELECT id, COALESCE(rules, '') AS rules FROM {LOGS} LEFT JOIN (SELECT id, string_agg(CAST(via_rule_id AS VARCHAR), ',' ORDER BY via_rule_id) AS rules FROM ({_hits}) GROUP BY 1) USING (id)")
EQUAL = tuple(RoutingRule(100 + i, (R("metadata.user_id", "=", i), R("metadata.level", "=", level)), "x") for i in range(200) for level in ("error", "info"))


def by_join(spark, sf_dir):
    rows = r.match_rules_join(logs_view(spark, sf_dir), r.conditions(spark, EQUAL))
    return rows.select("id", F.explode("rule_ids").alias("rule_id"))


register("r02_match_join", by_join, f"SELECT id, user_id + 100 AS rule_id FROM {LOGS} WHERE level IN ('error', 'info') AND user_id < 200")


def mixed_rule(i: int) -> RoutingRule:
    """One of ten kinds of rules, of one to three conditions of all operators."""
    user, value, status, message, level = "metadata.user_id", "metadata.value", "metadata.status_code", "event_message", "metadata.level"
    return RoutingRule(i, {
        0: (R(user, "=", i), R(value, ">", i % 90)),
        1: (R(message, "contains", f"user {i}"), R(level, "=", "info", negate=True)),
        2: (R(value, "range", values=(i % 97, i % 97 + 0.5)), R(user, "<", 300)),
        3: (R(status, ">=", 100 + i % 500), R(status, "<", 103 + i % 500), R(message, "contains", str(i % 10), negate=True)),
        4: (R(message, "~", f"^[a-m].* {i % 300}$"), R(value, "<=", 50.0)),
        5: (R(user, "in", values=(i, i + 1, i + 2)), R(status, ">", 300, negate=True)),
        6: (R(level, "=", "error"), R(value, ">=", 99 - i % 3 + i / 10_000)),
        7: (R("metadata.none", "=", "x"),),
        8: (R(user, "range", values=(i % 900, i % 900 + 2), negate=True), R(user, "range", values=(i % 900 - 1, i % 900 + 3)), R(message, "contains", "e")),
        9: (R(message, "contains", f"click user {i % 700}"), R(value, "=", None, negate=True), R(user, "<=", 40)),
    }[i % 10])


_MIXED = """CASE i % 10 WHEN 0 THEN user_id = i AND value > i % 90 WHEN 1 THEN contains(event_message, 'user ' || i) AND level <> 'info' WHEN 2 THEN value BETWEEN i % 97 AND i % 97 + 0.5 AND user_id < 300
WHEN 3 THEN status_code >= 100 + i % 500 AND status_code < 103 + i % 500 AND NOT contains(event_message, CAST(i % 10 AS VARCHAR)) WHEN 4 THEN event_message < 'n' AND ends_with(event_message, ' ' || i % 300) AND value <= 50
WHEN 5 THEN user_id BETWEEN i AND i + 2 AND NOT status_code > 300 WHEN 6 THEN level = 'error' AND value >= 99 - i % 3 + CAST(i AS DOUBLE) / 10000 WHEN 8 THEN user_id IN (i % 900 - 1, i % 900 + 3) AND contains(event_message, 'e')
WHEN 9 THEN contains(event_message, 'click user ' || i % 700) AND value IS NOT NULL AND user_id <= 40 ELSE FALSE END"""


def by_index(df: DataFrame) -> DataFrame:
    df = df.repartition(df.sparkSession.sparkContext.defaultParallelism)  # one small file, much work a row
    rows = rule_index.match_rules_index(df, [mixed_rule(i) for i in range(5000)])
    return rows.select("id", F.size("rule_ids").cast("long").alias("n"), F.array_join("rule_ids", ",").alias("rule_ids"))


register("r06_rule_index", on_logs(by_index), f"SELECT id, count(*) AS n, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS rule_ids FROM {LOGS} JOIN (SELECT unnest(range(5000)) AS i) AS r ON {_MIXED} GROUP BY 1")
register("r03_route", on_logs(lambda df: r.route(df.withColumn("via_rule_id", F.lit(None).cast("long")), RULES).select("id", "via_rule_id", "target")), f"SELECT id, via_rule_id, CASE via_rule_id {_names} END AS target FROM ({_hits})")
register("r05_hits", on_logs(lambda df: r.rule_hits(df, RULES)), f"SELECT via_rule_id AS rule_id, count(*) AS hits FROM ({_hits}) GROUP BY 1")


# rates, quotas, alerts

register("n01_rate", on_logs(n.rate_per_second), f"SELECT source, date_trunc('second', \"timestamp\") AS \"timestamp\", count(*) AS rate FROM {LOGS} GROUP BY 1, 2")


#: A row for every second of a month and source: too many for an oracle; tests hold it against a plain version.
_SECONDS = f"""WITH r AS (SELECT source, CAST(floor(epoch("timestamp")) AS BIGINT) AS s, count(*) AS rate FROM {LOGS} GROUP BY 1, 2),
e AS (SELECT source, unnest(range(min(s), max(s) + 1)) AS s FROM r GROUP BY 1),
g AS (SELECT e.source, e.s, COALESCE(rate, 0) AS rate FROM e LEFT JOIN r ON r.source = e.source AND r.s = e.s),
w AS (SELECT source, s, rate, sum(rate) OVER (PARTITION BY source ORDER BY s ROWS 59 PRECEDING) AS total, max(rate) OVER (PARTITION BY source ORDER BY s) AS top FROM g),
c AS (SELECT *, CASE WHEN rate IS DISTINCT FROM lag(rate) OVER o OR total IS DISTINCT FROM lag(total) OVER o THEN 1 ELSE 0 END AS new FROM w WINDOW o AS (PARTITION BY source ORDER BY s)),
i AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY s) AS n FROM c)"""
register("n02_rolling", on_logs(n.rolling_intervals), f"""{_SECONDS} SELECT source, min(s) AS start, max(s) + 1 AS "end", max(rate) AS rate, CAST(max(total) AS BIGINT) AS sum, CAST(ceil(max(total) / 60) AS BIGINT) AS average, max(top) AS max FROM i GROUP BY source, n""")


def quota(spark, sf_dir):
    df = logs_view(spark, sf_dir).select((F.col("metadata.user_id") % 7).alias("user"), "source").groupBy("user", "source").agg(F.count("*").alias("count"))
    per_source = spark.createDataFrame([("click", 5), ("error", 1), ("view", 4), ("signup", 2), ("purchase", 2)], "source string, limit long")
    per_user = df.select("user").distinct().withColumn("limit", F.col("user") * 5)
    return n.quota_status(df, per_source, per_user)


register("n03_quota", quota, f"""WITH s AS (SELECT user_id % 7 AS "user", source, count(*) AS n FROM {LOGS} GROUP BY 1, 2), u AS (SELECT "user", CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1),
l AS (SELECT * FROM (VALUES ('click', 5), ('error', 1), ('view', 4), ('signup', 2), ('purchase', 2)) AS v(source, lim)),
x AS (SELECT s."user", s.source, CAST(60 * lim - s.n AS BIGINT) AS source_remaining, CAST(60 * s."user" * 5 - u.n AS BIGINT) AS user_remaining FROM s JOIN u USING ("user") LEFT JOIN l USING (source))
SELECT *, CASE WHEN user_remaining < 0 THEN 'user' WHEN source_remaining < 0 THEN 'source' ELSE 'none' END AS exceeded FROM x""")


def alert(spark, sf_dir):
    logs_view(spark, sf_dir).createOrReplaceTempView("alert_logs")
    return n.run_alert(spark, "SELECT metadata.user_id, count(*) AS n FROM alert_logs WHERE metadata.level = :level GROUP BY 1 HAVING count(*) >= 3 ORDER BY user_id", {"level": "error"})[1]


register("n04_alert", alert, f"SELECT user_id, count(*) AS n FROM {LOGS} WHERE level = 'error' GROUP BY 1 HAVING count(*) >= 3 ORDER BY user_id LIMIT 1000")
register("n05_digest", on_logs(lambda df: n.new_event_digest(df, "1 day", 1).select("source", "interval", "count", F.get("newest", F.lit(0)).alias("newest"))), f"SELECT source, date_trunc('day', \"timestamp\") AS \"interval\", count(*) AS count, arg_max(event_message, (\"timestamp\", id)) AS newest FROM {LOGS} GROUP BY 1, 2")
register("n06_stats", on_logs(n.source_stats), f'SELECT source, count(*) AS inserts, max("timestamp") AS last_event, CAST(10 AS BIGINT) AS fields FROM {LOGS} GROUP BY 1')
register("n07_usage", on_logs(lambda df: n.usage_counts(df, "1 hour")), f"SELECT source, date_trunc('hour', \"timestamp\") AS inserted_at, count(*) AS count FROM {LOGS} GROUP BY 1, 2")


# key-value tables


def kv(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.concat(F.lit('{"segment":"'), "c_mktsegment", F.lit('","nation":'), F.col("c_nationkey").cast("string"), F.lit("}")).alias("value"))


_kv = """(SELECT CAST(c_custkey AS VARCHAR) AS key, '{"segment":"' || c_mktsegment || '","nation":' || c_nationkey || '}' AS value FROM customer)"""
register("k01_upsert", lambda s, d: k.upsert(kv(s, d), table(s, d, "supplier").select((F.col("s_suppkey") * 20).cast("string").alias("key"), F.lit("1").alias("value"))), f"WITH n AS (SELECT DISTINCT CAST(s_suppkey * 20 AS VARCHAR) AS key, '1' AS value FROM supplier) SELECT * FROM n UNION ALL SELECT * FROM {_kv} WHERE key NOT IN (SELECT key FROM n)")
register("k02_delete_keys", lambda s, d: k.delete_keys(kv(s, d), table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("key"))), f"SELECT * FROM {_kv} WHERE key NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)")
register("k03_delete_values", lambda s, d: k.delete_values(kv(s, d), "segment", ["BUILDING", "MACHINERY"]), f"SELECT * FROM {_kv} WHERE json_extract_string(value, '$.segment') NOT IN ('BUILDING', 'MACHINERY')")
register("k04_lookup", lambda s, d: k.lookup(kv(s, d), table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("key")), "nation"), f"SELECT key, json_extract_string(value, '$.nation') AS value FROM {_kv} WHERE key IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders)")
register("f_flat_scan", on_logs(flat), f"SELECT {FLAT} FROM {LOGS}")
