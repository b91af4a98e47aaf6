"""Queries of filters, projections, paging and scalar functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..functions.redact import redact_ip
from ..operators import filters as f
from ..operators import paging as p
from ..operators import projection as pr
from ..rules import FilterRule as R
from ..rules import SelectRule as S
from ..sources.events import logs_view
from .common import FLAT, LOGS, NOW, Query, flat, naive, on_logs, table

DAY = dt.datetime(2024, 1, 10)
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def rules(name: str, where: str, *of: R) -> None:
    """A filter query: the events that the rules hold for."""
    register(name, on_logs(lambda df: flat(f.filter_events(df, of))), f"SELECT {FLAT} FROM {LOGS} WHERE {where}")


rules("f01_equal", "level = 'error'", R("metadata.level", "=", "error"))
rules("f02_not_null", "value IS NOT NULL AND level = 'error'", R("metadata.value", "=", None, negate=True), R("m.level", "=", "error"))
rules("f03_compare", "value > 50 AND status_code <= 300 AND value < 90.5 AND status_code >= 120", R("m.value", ">", 50), R("m.status_code", "<=", "300"), R("m.value", "<", 90.5), R("m.status_code", ">=", 120))
rules("f04_range", "status_code BETWEEN 200 AND 299", R("m.status_code", "range", values=(200, 299)))
rules("f05_regex", "regexp_matches(event_message, '^(click|view) user \\d*7$')", R("event_message", "~", r"^(click|view) user \d*7$"))
rules("f06_contains", "contains(event_message, 'user 12')", R("event_message", "contains", "user 12"))
rules("f09_negate", "value IS NULL OR NOT (value > 20)", R("m.value", ">", 20, negate=True))
rules("f09_negate_range", "status_code IS NULL OR NOT (status_code BETWEEN 200 AND 599)", R("m.status_code", "range", values=(200, 599), negate=True))
rules("f10_nested", "event_type = 'signup' AND user_id < 100", R("metadata.event_type", "=", "signup"), R("metadata.user_id", "<", 100))
rules("f12_levels", "level IN ('warning', 'error', 'critical')", f.level_range("metadata.level", "warning", "critical"))
rules("f13_typed", "status_code = 404", R("m.status_code", "=", "404"))
rules("x07_in", "level IN ('debug', 'error')", R("m.level", "in", values=("debug", "error")))
rules("x07_empty_in", "FALSE", R("m.level", "in", values=()))


def tagged(df: DataFrame) -> DataFrame:
    """Documents with the words of their text, and with a map of their fields."""
    return df.select("doc_id", F.split("text", " ").alias("words"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("size"), F.col("n_chars").cast("string")).alias("labels"))


register("f07_list_includes", lambda s, d: f.filter_events(tagged(table(s, d, "documents")), [R("words", "list_includes", "the")]).select("doc_id"), "SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'the')")
register("f08_list_regexp", lambda s, d: f.filter_events(tagged(table(s, d, "documents")), [R("words", "list_includes_regexp", "^th[ae]")]).select("doc_id"), "SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '^th[ae]'))) > 0")
register("f02_null", lambda s, d: f.filter_events(tagged(table(s, d, "documents")), [R("labels.lang", "=", None)]).select("doc_id"), "SELECT doc_id FROM documents WHERE lang IS NULL")
register("f11_map_number", lambda s, d: f.filter_events(tagged(table(s, d, "documents")), [R("labels.size", ">", 3000), R("labels.lang", "=", "en")]).select("doc_id"), "SELECT doc_id FROM documents WHERE n_chars > 3000 AND lang = 'en'")

_low, _high = f.brace_range("2024-01-{05..07}")
register("f14_time", on_logs(lambda df: flat(f.filter_events(df, [R("timestamp", ">=", "1704844800"), R("timestamp", "<", "2024-01-10T06:00:00+00:00")]))), f"SELECT {FLAT} FROM {LOGS} WHERE \"timestamp\" >= TIMESTAMP '2024-01-10' AND \"timestamp\" < TIMESTAMP '2024-01-10 06:00:00'")
register("f15_braces", on_logs(lambda df: flat(f.where_time(df, _low, _high))), f"SELECT {FLAT} FROM {LOGS} WHERE \"timestamp\" BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07'")
register("f16_relative", on_logs(lambda df: flat(f.where_time(df, *f.relative_range("last@2d", NOW)))), f"SELECT {FLAT} FROM {LOGS} WHERE \"timestamp\" >= TIMESTAMP '2024-01-29'")
register("f16_yesterday", on_logs(lambda df: flat(f.where_time(df, *f.relative_range("yesterday", NOW)))), f"SELECT {FLAT} FROM {LOGS} WHERE \"timestamp\" >= TIMESTAMP '2024-01-30' AND \"timestamp\" < TIMESTAMP '2024-01-31'")
register("f17_zone", on_logs(lambda df: flat(f.where_time(df, f.in_utc(DAY, "America/New_York"), f.in_utc(DAY + dt.timedelta(hours=6), "America/New_York")))), f"SELECT {FLAT} FROM {LOGS} WHERE \"timestamp\" BETWEEN TIMESTAMP '2024-01-10 05:00:00' AND TIMESTAMP '2024-01-10 11:00:00'")
register("f18_ago", on_logs(lambda df: flat(f.where_timestamp_ago(df, 36, "hour", NOW))), f"SELECT {FLAT} FROM {LOGS} WHERE \"timestamp\" >= TIMESTAMP '2024-01-31' - INTERVAL 36 HOUR")
register("f19_open_range", on_logs(lambda df: flat(f.where_time(df, *f.chart_range(None, DAY, "minute", NOW)))), f"SELECT {FLAT} FROM {LOGS} WHERE \"timestamp\" BETWEEN TIMESTAMP '2024-01-10' - INTERVAL 1000 MINUTE AND TIMESTAMP '2024-01-10'")
register("f20_effective", on_logs(lambda df: flat(f.where_time(df, *f.effective_range([(DAY, None), (DAY - dt.timedelta(days=3), DAY + dt.timedelta(days=2)), (None, DAY + dt.timedelta(days=1))])))), f"SELECT {FLAT} FROM {LOGS} WHERE \"timestamp\" BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-11'")

register("p01_select", on_logs(lambda df: pr.select_fields(df, [S("id"), S("metadata.level"), S("m.value", "v"), S("id")])), f"SELECT id, level AS metadata_level, value AS v FROM {LOGS}")
register("p02_wildcard", on_logs(lambda df: pr.select_fields(df, [S("id"), S("*")]).select("id", "event_message", "source", "body")), f"SELECT id, event_message, source, body FROM {LOGS}")
register("p03_defaults", on_logs(lambda df: pr.select_search_defaults(df, ["metadata.user_id", "missing"])), f'SELECT "timestamp", id, event_message, level AS metadata_level, user_id AS metadata_user_id FROM {LOGS}')
register("p04_unnest", lambda s, d: pr.unnest(tagged(table(s, d, "documents")), "words", alias="word").select("doc_id", "word"), "SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents")
register("p05_inferred", on_logs(lambda df: pr.select_inferred(df, [R("metadata.level", "=", "x"), R("id", "=", "1")])), f"SELECT level AS metadata_level, id FROM {LOGS}")

_desc = 'ORDER BY "timestamp" DESC, id DESC'
_cursor = (dt.datetime(2024, 1, 20), "5000")
register("l01_latest", on_logs(lambda df: flat(p.latest(df, 100))), f"SELECT {FLAT} FROM {LOGS} {_desc} LIMIT 100")
register("l02_page_older", on_logs(lambda df: flat(p.page(df, _cursor, "older", 50))), f"SELECT {FLAT} FROM {LOGS} WHERE (\"timestamp\", id) <= (TIMESTAMP '2024-01-20', '5000') {_desc} LIMIT 51")
register("l02_page_newer", on_logs(lambda df: flat(p.page(df, _cursor, "newer", 50))), f"SELECT {FLAT} FROM {LOGS} WHERE (\"timestamp\", id) > (TIMESTAMP '2024-01-20', '5000') ORDER BY \"timestamp\", id LIMIT 51")
register("l03_search", on_logs(lambda df: p.search(df, [R("m.level", "=", "error")], NOW)), f"SELECT \"timestamp\", id, event_message, level AS metadata_level FROM {LOGS} WHERE \"timestamp\" >= TIMESTAMP '2024-01-29' AND level = 'error' {_desc} LIMIT 101")
register("l04_by_id", on_logs(lambda df: flat(p.event_by_id(df, "7700", now=NOW, days=7))), f"SELECT {FLAT} FROM {LOGS} WHERE id = '7700' AND \"timestamp\" >= TIMESTAMP '2024-01-24'")
register("l05_by_path", on_logs(lambda df: flat(p.event_by_path(df, "metadata.user_id", 42))), f"SELECT {FLAT} FROM {LOGS} WHERE user_id = 42")


def context(spark, sf_dir):
    df = logs_view(spark, sf_dir)
    return naive(p.event_context(df, "0", dt.datetime(2024, 1, 10), 20, hours=48).select("id", "timestamp", F.col("rank").cast("long").alias("rank")))


register("l06_context", context, f"""WITH near AS (SELECT id, "timestamp" FROM {LOGS} WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-12'),
b AS (SELECT id, "timestamp", 1 - row_number() OVER (ORDER BY "timestamp" DESC, id DESC) AS rank FROM near WHERE ("timestamp", id) <= (TIMESTAMP '2024-01-10', '0')),
a AS (SELECT id, "timestamp", row_number() OVER (ORDER BY "timestamp", id) AS rank FROM near WHERE ("timestamp", id) > (TIMESTAMP '2024-01-10', '0'))
SELECT * FROM b WHERE rank >= -20 UNION ALL SELECT * FROM a WHERE rank <= 20""")
register("l07_recent", on_logs(lambda df: p.recent(df, "source", 20).select("source", "id", "timestamp")), f'SELECT source, id, "timestamp" FROM {LOGS} QUALIFY row_number() OVER (PARTITION BY source ORDER BY "timestamp" DESC, id DESC) <= 20')
register("l08_nulls_last", on_logs(lambda df: flat(p.ordered(df, ("metadata.value", "desc", "last"), ("id", "asc", "first")).limit(50))), f"SELECT {FLAT} FROM {LOGS} ORDER BY value DESC NULLS LAST, id ASC NULLS FIRST LIMIT 50")
register("l09_offset", on_logs(lambda df: flat(df.orderBy("timestamp", "id").offset(30).limit(20))), f'SELECT {FLAT} FROM {LOGS} ORDER BY "timestamp", id LIMIT 20 OFFSET 30')
register("l10_cap", on_logs(lambda df: flat(p.cap_rows(df.orderBy("id"), 1000))), f"SELECT {FLAT} FROM {LOGS} ORDER BY id LIMIT 1000")
register("l11_window", on_logs(lambda df: df.select("id", p.framed(F.max("metadata.status_code"), ("source",), ("timestamp", "id"), 4).alias("highest"), p.framed(F.count("*"), ("source",), ("timestamp", "id"), 4).alias("n"))), f'SELECT id, max(status_code) OVER w AS highest, count(*) OVER w AS n FROM {LOGS} WINDOW w AS (PARTITION BY source ORDER BY "timestamp", id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)')
register("l12_rank", on_logs(lambda df: p.ranked(df, ("metadata.user_id",)).select("id", F.col("rank").cast("long").alias("rank"))), f'SELECT id, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp", id) AS rank FROM {LOGS}')


def column(name: str, value, sql: str, more: str = "") -> None:
    """A query of a scalar function over all events."""
    register(name, on_logs(lambda df: df.select("id", value(df).alias("x"))), f"SELECT id, {sql} AS x FROM {LOGS} {more}")


column("x01_regexp_contains", lambda df: X.regexp_contains(F.col("event_message"), "user 1[0-9]$"), "regexp_matches(event_message, 'user 1[0-9]$')")
column("x02_timestamp_trunc", lambda df: X.timestamp_trunc(F.col("timestamp"), "hour"), "date_trunc('hour', \"timestamp\")")
column("x03_timestamp_sub", lambda df: X.timestamp_sub(F.col("timestamp"), 90, "minute"), '"timestamp" - INTERVAL 90 MINUTE')
column("x04_safe_cast", lambda df: X.safe_cast(F.regexp_extract("event_message", r"user (\d)", 1), "INT64"), "TRY_CAST(regexp_extract(event_message, 'user (\\d)', 1) AS BIGINT)")
column("x05_strpos", lambda df: X.strpos(F.col("event_message"), "user").cast("long"), "CAST(strpos(event_message, 'user') AS BIGINT)")
column("x06_like", lambda df: X.matches_like(F.col("event_message"), "%USER 1_", True) & X.matches_like(F.col("event_message"), "click%", negate=True), "event_message ILIKE '%USER 1_' AND event_message NOT LIKE 'click%'")
column("x08_extract_date", lambda df: X.extract_date(F.col("timestamp")), 'CAST("timestamp" AS DATE)')
column("x09_timestamp_micros", lambda df: X.timestamp_micros(F.col("id").cast("long") * 1_000_003), "make_timestamp(CAST(id AS BIGINT) * 1000003)")
column("x10_date_add", lambda df: X.timestamp_add(F.col("timestamp"), 3, "day"), '"timestamp" + INTERVAL 3 DAY')
column("x11_json", lambda df: X.json_value(F.col("body"), "k").cast("long"), "CAST(json_extract_string(body, '$.k') AS BIGINT)")
column("x12_has", lambda df: X.has(F.split("event_message", " "), "view") | X.array_exists(F.split("event_message", " "), "^1.$"), "list_contains(string_split(event_message, ' '), 'view') OR len(list_filter(string_split(event_message, ' '), lambda v: regexp_matches(v, '^1.$'))) > 0")
column("x13_interval", lambda df: X.start_of_interval(F.col("timestamp"), 15, "minute"), "time_bucket(INTERVAL 15 MINUTE, \"timestamp\", TIMESTAMP '1970-01-01')")
column("x14_case", lambda df: F.coalesce(F.when(F.lower("metadata.level") == "error", "bad").when(F.col("metadata.value") > 50, "high"), F.lit("fine")), "COALESCE(CASE WHEN lower(level) = 'error' THEN 'bad' WHEN value > 50 THEN 'high' END, 'fine')")
column("x16_map", lambda df: X.map_value(F.create_map(F.lit("a"), F.col("metadata.status_code").cast("string")), "a", "int"), "status_code")


def redacted(spark, sf_dir):
    more = F.concat("text", F.lit(" at fe80::1%eth0 or 2001:db8::7"))
    return redact_ip(table(spark, sf_dir, "documents").select("doc_id", more.alias("text")))


_NUMBER = "len(x) BETWEEN 1 AND 3 AND COALESCE(TRY_CAST(x AS INTEGER) BETWEEN 0 AND 255, FALSE)"
register("x15_redact_ip", redacted, f"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_.]+|[^A-Za-z0-9_.]+'), lambda p:
CASE WHEN len(list_filter(string_split(trim(p, '.'), '.'), lambda x: {_NUMBER})) = 4 AND len(string_split(trim(p, '.'), '.')) = 4 THEN replace(p, trim(p, '.'), 'REDACTED') ELSE p END), '') || ' at REDACTED or REDACTED' AS text FROM documents""")
