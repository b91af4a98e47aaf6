"""Aggregates over time buckets: charts, gap filling, level and status shapes, usage.

Every aggregate is one groupBy with partial sums before its shuffle. A chart's series of buckets is
made from its own bounds and is as long as the chart.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..paths import col_at, has_path
from .filters import shifted
from .projection import unnest

PERIODS = ("second", "minute", "hour", "day")
AGGREGATES = ("count", "countd", "avg", "sum", "max", "p50", "p95", "p99")
#: Buckets of each period that a chart without a time filter looks back.
DEFAULT_TICKS = {"day": 31, "hour": 168, "minute": 120, "second": 180}
#: The levels of a level chart, and the texts that count as each.
LEVEL_TEXTS = {"debug": ("debug",), "info": ("info",), "notice": ("notice",), "warn": ("warn", "warning"), "error": ("error",), "critical": ("critical",), "alert": ("alert",), "emergency": ("emergency",)}
#: The request classes of the request report, by URL path.
REQUEST_CLASSES = {"auth": "^/auth", "realtime": "^/realtime", "rest": "^/rest", "storage": "^/storage"}
STATUS_PATHS = ("metadata.response.status_code", "metadata.status_code", "metadata.proxy.statusCode")


def bucket(column: Column, period: str, zone: str | None = None) -> Column:
    """The start of a time's bucket; with a zone, of the bucket in that zone's time, as UTC."""
    if period not in PERIODS:
        raise ValueError(f"unknown period: {period}")
    if zone is None:
        return F.date_trunc(period, column)
    return F.to_utc_timestamp(F.date_trunc(period, F.from_utc_timestamp(column.cast("timestamp"), zone)), zone)


def aggregate(name: str, column: Column, approx: bool = False) -> Column:
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {name}")
    if name == "count":
        return F.count("*")
    if name == "countd":
        return F.approx_count_distinct(column) if approx else F.count_distinct(column)
    if name[0] == "p":
        share = int(name[1:]) / 100
        return F.percentile_approx(column, share) if approx else F.percentile(column, share)
    return {"avg": F.avg, "sum": F.sum, "max": F.max}[name](column)


def auto_period(df: DataFrame, column: str = "timestamp", max_ticks: int = 250) -> str:
    """The smallest period that cuts the data's time range into fewer than max_ticks buckets."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    seconds = (high - low).total_seconds() if low is not None else 0
    return next((p for p, s in zip(PERIODS, (1, 60, 3600, 86400), strict=True) if seconds / s < max_ticks), "day")


def chart(df: DataFrame, agg: str = "count", path: str = "timestamp", period: str = "minute", time: str = "timestamp", zone: str | None = None, approx: bool = False, max_ticks: int = 250, by: tuple[str, ...] = ()) -> DataFrame:
    """(timestamp, value) of an aggregate in each bucket, also by further columns. period "auto" asks the data."""
    if period == "auto":
        period = auto_period(df, time, max_ticks)
    at = bucket(F.col(time), period, zone).alias("timestamp")
    return df.groupBy(*by, at).agg(aggregate(agg, col_at(df, path), approx).alias("value"))


def chart_nested(df: DataFrame, agg: str, path: str, period: str, where=None, time: str = "timestamp") -> DataFrame:
    """A chart over the elements of arrays; `where` tests each element (a Column), after the unnesting."""
    flat = unnest(df, path, alias="element_")
    flat = flat.filter(where(F.col("element_"))) if where else flat
    return flat.groupBy(bucket(F.col(time), period).alias("timestamp")).agg(aggregate(agg, F.col("element_")).alias("value"))


def level_chart(df: DataFrame, path: str = "metadata.level", period: str = "minute", time: str = "timestamp") -> DataFrame:
    """Events of each level in each bucket."""
    level = col_at(df, path)
    known = [x for texts in LEVEL_TEXTS.values() for x in texts]
    counts = [F.count_if(level.isin(*texts)).alias(name) for name, texts in LEVEL_TEXTS.items()]
    other = F.count_if(level.isNull() | ~level.isin(*known)).alias("other")
    return df.groupBy(bucket(F.col(time), period).alias("timestamp")).agg(other, *counts, F.count("*").alias("total"))


def status_chart(df: DataFrame, path: str, period: str = "minute", time: str = "timestamp") -> DataFrame:
    """Events of each class of HTTP status in each bucket. Status 600 is in none, as other starts beyond it."""
    status = col_at(df, path).cast("int")
    counts = [F.count_if(status.between(100 * n, 100 * n + 99)).alias(f"status_{n}xx") for n in range(1, 6)]
    other = F.count_if(status.isNull() | status.between(0, 99) | (status >= 601)).alias("other")
    return df.groupBy(bucket(F.col(time), period).alias("timestamp")).agg(other, *counts, F.count("*").alias("total"))


def auto_chart(df: DataFrame, period: str = "minute", time: str = "timestamp") -> DataFrame:
    """The status shape, the level shape or a count, by what the schema has."""
    for path in STATUS_PATHS:
        if has_path(df, path):
            return status_chart(df, path, period, time)
    if has_path(df, "metadata.level"):
        return level_chart(df, "metadata.level", period, time)
    return chart(df, "count", time, period, time)


def series(df: DataFrame, low: Column | dt.datetime, high: Column | dt.datetime, period: str, column: str = "timestamp") -> DataFrame:
    """A row for each bucket between two times, both included."""
    a, b = (F.date_trunc(period, x if isinstance(x, Column) else F.lit(x)) for x in (low, high))
    return df.sparkSession.range(1).select(F.explode(F.sequence(a, b, F.expr(f"interval 1 {period}"))).alias(column))


def fill_missing(df: DataFrame, low: dt.datetime, high: dt.datetime, period: str, column: str = "timestamp") -> DataFrame:
    """A chart with zero rows for the buckets that it lacks between two times, newest first."""
    buckets = series(df, low, high, period, column)
    filled = buckets.join(df, column, "left")
    return filled.select(column, *(F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c) for c, t in df.dtypes if c != column)).orderBy(F.desc(column))


def fill_missing_by(df: DataFrame, by: str, period: str, column: str = "timestamp") -> DataFrame:
    """The same for each value of a column, between that value's own first and last bucket."""
    spans = df.groupBy(by).agg(F.min(column).alias("low"), F.max(column).alias("high"))
    buckets = spans.select(by, F.explode(F.sequence("low", "high", F.expr(f"interval 1 {period}"))).alias(column))
    filled = buckets.join(df, [by, column], "left")
    return filled.select(by, column, *(F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c) for c, t in df.dtypes if c not in (by, column)))


def default_window(df: DataFrame, period: str, now: dt.datetime, time: str = "timestamp") -> DataFrame:
    """Without a time filter: the events that a chart of the period looks back on."""
    return df.filter(F.col(time) >= F.lit(shifted(now, -DEFAULT_TICKS[period], period)))


def latest_buckets(chart_df: DataFrame, period: str, column: str = "timestamp") -> DataFrame:
    """The newest buckets, as many as the period's limit."""
    return chart_df.orderBy(F.desc(column)).limit(DEFAULT_TICKS[period])


def count_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def daily_usage(df: DataFrame, low: dt.date, high: dt.date, user: str = "user_id", count: str = "count", at: str = "inserted_at") -> DataFrame:
    """(date, user, count): each user's sum of each day between two days, 0 without any."""
    sums = df.filter(F.to_date(at).between(F.lit(low), F.lit(high))).groupBy(user, F.to_date(at).alias("date")).agg(F.sum(count).alias("count"))
    days = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("date"))
    users = df.select(user).distinct().select(user, F.explode(F.sequence(F.lit(low), F.lit(high))).alias("date"))
    grid = users.unionByName(days.join(users.select("date").distinct(), "date", "left_anti").select(F.lit(None).cast(dict(df.dtypes)[user]).alias(user), "date"))
    return sums.join(grid, [user, "date"], "full").select("date", user, F.coalesce("count", F.lit(0)).alias("count"))


def cumulative_usage(df: DataFrame, low: dt.date, high: dt.date, count: str = "count", at: str = "inserted_at") -> DataFrame:
    return df.filter(F.to_date(at).between(F.lit(low), F.lit(high))).agg(F.coalesce(F.sum(count), F.lit(0)).alias("count"))


def request_counts(df: DataFrame, path: str, period: str, time: str = "timestamp", classes: dict[str, str] = REQUEST_CLASSES) -> DataFrame:
    """Requests of each class of URL path in each bucket, newest first."""
    url = col_at(df, path)
    counts = [F.count_if(F.rlike(url, F.lit(p))).alias(f"total_{n}_requests") for n, p in classes.items()]
    return df.groupBy(bucket(F.col(time), period).alias("timestamp")).agg(*counts).orderBy(F.desc("timestamp"))


def ingest_metrics(df: DataFrame, labels: list[str], body: str = "event_message") -> DataFrame:
    """Events and bytes for each combination of labels."""
    return df.groupBy(*labels).agg(F.coalesce(F.sum(F.octet_length(body)), F.lit(0)).alias("bytes"), F.count("*").alias("events"))
