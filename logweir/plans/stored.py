"""Stored SQL: named queries that nest, take parameters, and can be shown as the only views of a session."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.redact import redact_ip
from ..operators.charts import chart
from ..operators.filters import filter_events
from ..operators.paging import MAX_ROWS, cap_rows
from ..operators.projection import select_fields, select_inferred
from ..rules import ChartRule, FilterRule, SelectRule


def stored_query(spark: SparkSession, name: str, sql: str, args: dict | None = None) -> DataFrame:
    """Makes a query a view under its name; others can then use the name as a table."""
    df = spark.sql(named(sql), args=args or {})
    df.createOrReplaceTempView(name)
    return df


def named(sql: str) -> str:
    """@name parameters in the form that Spark takes; those in quotes are left alone."""
    return re.sub(r"('(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`)|@(\w+)", lambda m: m[1] or f":{m[2]}", sql)


def parameters(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<![\w:]):([A-Za-z_]\w*)", re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`", "", named(sql)))))


def run_stored(spark: SparkSession, sql: str, params: dict | None = None, max_rows: int | None = MAX_ROWS, redact: bool = False) -> DataFrame:
    """A query's rows, capped unless max_rows is None; parameters that are not given are null."""
    given = params or {}
    out = cap_rows(spark.sql(named(sql), args={p: given.get(p) for p in parameters(sql)}), max_rows)
    return redact_ip(out) if redact else out


def run_over_views(spark: SparkSession, views: dict[str, DataFrame], consumer: str, params: dict | None = None, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """A query that sees these views and none of the session's others."""
    own = spark.newSession()
    for name, df in views.items():
        # the same plan, in a session that has no other view
        in_session(own, df).createOrReplaceTempView(name)
    given = params or {}
    return cap_rows(own.sql(named(consumer), args={p: given.get(p) for p in parameters(consumer)}), max_rows)


def in_session(session: SparkSession, df: DataFrame) -> DataFrame:
    return DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.queryExecution().analyzed()), session)


def search_view(df: DataFrame, filters: Iterable[FilterRule] = (), selects: Iterable[SelectRule] = (), charts: ChartRule | None = None) -> DataFrame:
    """Filter, select and chart rules on one view."""
    filters, selects = list(filters), list(selects)
    found = filter_events(df, filters)
    if charts:
        return chart(found, charts.aggregate, charts.path, charts.period)
    return select_fields(found, selects) if selects else select_inferred(found, filters)


def union_sources(sources: dict[str, DataFrame], low=None, high=None, project: str | None = None, columns: tuple[str, ...] = ("id", "timestamp", "event_message"), limit: int | None = None) -> DataFrame:
    """Events of several tables within time bounds and of one project, newest first, with their source."""
    out = None
    for name, df in sources.items():
        part = df
        if low is not None:
            part = part.filter(F.col("timestamp") > F.lit(low))
        if high is not None:
            part = part.filter(F.col("timestamp") <= F.lit(high))
        if project is not None and "project" in part.columns:
            part = part.filter(F.col("project") == project)
        part = part.select(*columns, F.lit(name).alias("source"))
        out = part if out is None else out.unionByName(part)
    out = out.orderBy(F.desc("timestamp"), "id")
    return out.limit(limit) if limit else out
