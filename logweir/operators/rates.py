"""Rates, quotas, alerts and usage over events, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..paths import col_at
from .schema import flat_types

ALERT_ROWS = 1000


def rate_per_second(df: DataFrame, source: str = "source", time: str = "timestamp") -> DataFrame:
    """(source, timestamp, rate) of the seconds that have events."""
    return df.groupBy(source, F.date_trunc("second", time).alias("timestamp")).agg(F.count("*").alias("rate"))


#: Seconds of a source that one task rolls over, at least.
BLOCK_SECONDS = 86_400


def rolling_intervals(df: DataFrame, seconds: int = 60, source: str = "source", time: str = "timestamp") -> DataFrame:
    """The rolling rate of each source as intervals of seconds, `start` to `end` (excluded), in which nothing
    changes, from its first second to its last: rate, sum and average (rounded up) of the last seconds, and
    the highest rate so far.

    A sweep over changes: a second with events raises the rate and the sum, the next one lowers the rate, and
    the one `seconds` later the sum. So the work follows the events, however far apart they lie. A source is
    cut into blocks of a day, which take over the sums and the highest rate from those before (a row for each
    day with a change), so that no source is one task."""
    span = max(BLOCK_SECONDS, seconds)
    rates = rate_per_second(df, source, time).filter("timestamp is not null").select(F.col(source).alias("source"), F.unix_seconds("timestamp").alias("second"), "rate")
    none, rate = F.lit(0).cast("long"), F.col("rate")
    change = lambda after, now, total, top: F.struct((F.col("second") + after).alias("second"), now.alias("now"), total.alias("total"), top.alias("top"))
    changes = rates.select("source", F.explode(F.array(change(0, rate, rate, rate), change(1, -rate, none, none), change(seconds, none, -rate, none))).alias("x")).select("source", "x.*")
    changes = changes.groupBy("source", "second").agg(*(F.sum(x).alias(x) for x in ("now", "total")), F.max("top").alias("top"), F.max(F.col("top") > 0).alias("own"))
    changes = changes.withColumn("block", F.floor(F.col("second") / span)).withColumn("new", F.expr("now != 0 or total != 0"))
    blocks = changes.groupBy("source", "block").agg(*(F.sum(x).alias(x) for x in ("now", "total")), F.max("top").alias("top"), F.min(F.when(F.col("new"), F.col("second"))).alias("first"), F.max(F.when(F.col("own"), F.col("second"))).alias("last"))
    by_block = Window.partitionBy("source").orderBy("block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(how(x).over(earlier), none).alias(f"{x}_before") for x, how in (("now", F.sum), ("total", F.sum), ("top", F.max))]
    blocks = blocks.select(F.col("source").alias("of"), F.col("block").alias("day"), *before, F.first("first", True).over(by_block.rowsBetween(1, Window.unboundedFollowing)).alias("next"), (F.max("last").over(Window.partitionBy("source")) + 1).alias("stop"))
    within = Window.partitionBy("source", "block").orderBy("second")
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    rolled = changes.filter("new").join(blocks, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("day"))).select(
        "source", F.col("second").alias("start"), F.least(F.coalesce(F.lead("second").over(within), "next", "stop"), "stop").alias("end"),
        (F.sum("now").over(so_far) + F.col("now_before")).alias("rate"), (F.sum("total").over(so_far) + F.col("total_before")).alias("sum"), F.greatest(F.max("top").over(so_far), "top_before").alias("max"),
    )
    kept = rolled.filter(F.col("start") < F.col("end"))
    return kept.select(F.col("source").alias(source), "start", "end", "rate", "sum", F.ceil(F.col("sum") / F.lit(seconds)).alias("average"), "max")


def rolling_rate(df: DataFrame, seconds: int = 60, source: str = "source", time: str = "timestamp", low: str | None = None, high: str | None = None) -> DataFrame:
    """Each second of the rolling intervals, quiet ones included; those from `low` to `high` if times are given."""
    found = rolling_intervals(df, seconds, source, time)
    first = F.greatest("start", F.unix_seconds(F.lit(low).cast("timestamp"))) if low else F.col("start")
    last = F.least(F.col("end") - 1, F.unix_seconds(F.lit(high).cast("timestamp"))) if high else F.col("end") - 1
    each = found.withColumn("first_", first).withColumn("last_", last).filter("first_ <= last_").withColumn("second_", F.explode(F.sequence("first_", "last_")))
    return each.select(source, F.timestamp_seconds("second_").alias("timestamp"), "rate", "sum", "average", "max")


def quota_status(counts: DataFrame, source_limits: DataFrame, user_limits: DataFrame, window: int = 60) -> DataFrame:
    """What is left of each source's and its user's quota over a window of seconds.

    counts: (user, source, count) within the window; limits are events a second: (source, limit), (user, limit).
    """
    by_source = counts.groupBy("user", "source").agg(F.sum("count").alias("source_sum"))
    by_user = by_source.groupBy("user").agg(F.sum("source_sum").alias("user_sum"))
    joined = by_source.join(by_user, "user").join(source_limits.select("source", F.col("limit").alias("source_limit")), "source", "left").join(user_limits.select("user", F.col("limit").alias("user_limit")), "user", "left")
    source_left, user_left = window * F.col("source_limit") - F.col("source_sum"), window * F.col("user_limit") - F.col("user_sum")
    exceeded = F.when(user_left < 0, "user").when(source_left < 0, "source").otherwise("none")
    return joined.select("user", "source", source_left.alias("source_remaining"), user_left.alias("user_remaining"), exceeded.alias("exceeded"))


def run_alert(spark: SparkSession, query: str | DataFrame, args: dict | None = None) -> tuple[bool, DataFrame]:
    """Whether a stored query has rows, and the first of them (ALERT_ROWS at most)."""
    rows = (query if isinstance(query, DataFrame) else spark.sql(query, args=args or {})).limit(ALERT_ROWS)
    return bool(rows.take(1)), rows


def new_event_digest(df: DataFrame, every: str = "5 minutes", samples: int = 5, source: str = "source", time: str = "timestamp") -> DataFrame:
    """For each source and interval with events: how many, and the newest of them."""
    at = F.window(F.col(time).cast("timestamp"), every).getField("start").cast("timestamp_ntz")
    keyed = df.withColumn("interval", at)
    rank = F.row_number().over(Window.partitionBy(source, "interval").orderBy(F.desc(time), F.desc("id")))
    newest = keyed.withColumn("rank_", rank).filter(F.col("rank_") <= samples)
    shown = newest.groupBy(source, "interval").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank_", "event_message"))), lambda x: x["event_message"]).alias("newest"))
    return keyed.groupBy(source, "interval").agg(F.count("*").alias("count")).join(shown, [source, "interval"])


def source_stats(df: DataFrame, source: str = "source", time: str = "timestamp") -> DataFrame:
    """Events, last event time and number of fields of each source: of the nodes of its table's schema that
    have a value in some event, parents of such among them."""
    nodes = [p for p, _ in flat_types(df.drop(source).schema)]
    held = [F.max(col_at(df, p).isNotNull().cast("int")) for p in nodes]
    fields = sum((F.coalesce(x, F.lit(0)) for x in held), F.lit(0)).cast("long")
    return df.groupBy(source).agg(F.count("*").alias("inserts"), F.max(time).alias("last_event"), fields.alias("fields"))


def usage_counts(df: DataFrame, every: str = "1 hour", source: str = "source", time: str = "timestamp") -> DataFrame:
    """(source, inserted_at, count): a billing row for each write interval."""
    at = F.window(F.col(time).cast("timestamp"), every).getField("start").cast("timestamp_ntz").alias("inserted_at")
    return df.groupBy(source, at).agg(F.count("*").alias("count"))
