"""The operators on streams. Stateless ones are the batch functions themselves; windowed ones carry a
watermark, so that their state stays bounded."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..operators import prepare
from ..operators.charts import aggregate
from ..operators.filters import filter_events
from ..operators.keyvalues import accessor_value
from ..operators.rates import run_alert
from ..operators.routing import route, write_routed
from ..operators.schema import schema_updates
from ..paths import col_at, set_at
from ..rules import FilterRule, PrepareConfig, RoutingRule
from ..sinks.tables import write_events

TAIL, LATE = "10 minutes", "1 hour"


def timed(stream: DataFrame, delay: str, time: str = "timestamp") -> DataFrame:
    """A watermark needs a time with a zone: NTZ times count as UTC in a UTC session."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def tail(stream: DataFrame, rules: Iterable[FilterRule], now: Callable[[], dt.datetime] | None = None) -> DataFrame:
    """Live search: events that the rules hold for, of the last ten minutes. Time rules are refused."""
    rules = list(rules)
    if any(r.path == "timestamp" for r in rules):
        raise ValueError("a live search takes no time filter")
    moment = F.lit(now()) if now else F.current_timestamp()
    return filter_events(stream, rules).filter(F.col("timestamp").cast("timestamp") >= moment - F.expr(f"interval {TAIL}"))


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def stream_prepare(stream: DataFrame, config: PrepareConfig, good: str, rejected: str, checkpoint: str, now: Callable[[], dt.datetime] = utc_now, kv: DataFrame | None = None) -> DataStreamWriter:
    """Prepared events to one folder, rejected ones with their error to another; each batch asks the clock
    anew. A batch that is tried again overwrites its own part."""
    def write(batch: DataFrame, number: int) -> None:
        marked = prepare.prepare_events(batch, config, now(), kv).withColumn("batch", F.lit(number)).persist()
        for rows, path in ((marked.filter("error is null").drop("error"), good), (marked.filter("error is not null"), rejected)):
            rows.drop("batch").write.mode("overwrite").parquet(f"{path}/batch={number}")
        marked.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_route(stream: DataFrame, rules: Iterable[RoutingRule], path: str, checkpoint: str) -> DataStreamWriter:
    """Events to their targets' folders; what came by a rule is not routed again."""
    rules = list(rules)

    def write(batch: DataFrame, number: int) -> None:
        write_routed(route(batch, rules), f"{path}/batch={number}", "overwrite")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_chart(stream: DataFrame, agg: str = "count", path: str = "timestamp", period: str = "minute", delay: str = TAIL) -> DataFrame:
    """(timestamp, value) of each bucket, as charts give them; distinct counts and percentiles are approximate."""
    own = timed(stream, delay)
    value = aggregate(agg, col_at(own, path), approx=True).alias("value")
    return own.groupBy(F.window("timestamp", f"1 {period}").alias("w")).agg(value).select(F.col("w.start").alias("timestamp"), "value")


def stream_rates(stream: DataFrame, source: str = "source", delay: str = TAIL) -> DataFrame:
    """Events of each source in each second."""
    return timed(stream, delay).groupBy(source, F.window("timestamp", "1 second").alias("w")).agg(F.count("*").alias("rate")).select(source, F.col("w.start").alias("timestamp"), "rate")


def stream_averages(stream: DataFrame, source: str = "source", seconds: int = 60, delay: str = TAIL) -> DataFrame:
    """Sum and average (rounded up) of the last seconds, at each second with events near it."""
    w = F.window("timestamp", f"{seconds} seconds", "1 second").alias("w")
    return timed(stream, delay).groupBy(source, w).agg(F.count("*").alias("sum")).select(source, (F.col("w.end") - F.expr("interval 1 second")).alias("timestamp"), "sum", F.ceil(F.col("sum") / seconds).alias("average"))


def stream_quota(stream: DataFrame, limits: DataFrame, source: str = "source", seconds: int = 60, delay: str = TAIL) -> DataFrame:
    """What is left of each source's quota (limits: source, limit a second) in each window."""
    w = F.window("timestamp", f"{seconds} seconds").alias("w")
    sums = timed(stream, delay).groupBy(source, w).agg(F.count("*").alias("sum"))
    left = F.col("limit") * seconds - F.col("sum")
    return sums.join(limits, source).select(source, F.col("w.start").alias("timestamp"), left.alias("remaining"), (left < 0).alias("exceeded"))


def stream_digest(stream: DataFrame, every: str = "5 minutes", source: str = "source", delay: str = TAIL) -> DataFrame:
    """For each source and interval with events: how many, and the newest one's message."""
    w = F.window("timestamp", every).alias("w")
    newest = F.max(F.struct("timestamp", "id", "event_message"))["event_message"]
    return timed(stream, delay).groupBy(source, w).agg(F.count("*").alias("count"), newest.alias("newest")).select(source, F.col("w.start").alias("interval"), "count", "newest")


def stream_alert(stream: DataFrame, query: Callable[[DataFrame], DataFrame], notify: Callable[[int, DataFrame], None], checkpoint: str) -> DataStreamWriter:
    """Runs a query over each batch and notifies of its rows when there are any."""
    def check(batch: DataFrame, number: int) -> None:
        fired, rows = run_alert(batch.sparkSession, query(batch))
        if fired:
            notify(number, rows)

    return stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)


def stream_dedup(stream: DataFrame, delay: str = TAIL) -> DataFrame:
    """Each event once; repeats within the delay are dropped."""
    return timed(stream, delay).dropDuplicatesWithinWatermark(["id"])


def stream_schema(stream: DataFrame, column: str, start: StructType, save: Callable[[StructType], None], checkpoint: str, events_per_second: float = 1.0, locked: bool = False) -> DataStreamWriter:
    """Tracks the schema of JSON events over batches; save() gets every one that differs from the last. The
    schema after each batch is kept beside the checkpoint, so that a restarted stream goes on from it."""
    spark, kept = stream.sparkSession, f"{checkpoint.rstrip('/')}-schemas"

    def held(below: int) -> StructType:
        """The schema after the last batch before this one: a batch that is tried again starts from the same."""
        try:
            rows = spark.read.schema("schema string, batch long").parquet(kept).filter(F.col("batch") < below)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return start
        newest = rows.agg(F.max_by("schema", "batch")).first()[0]
        return StructType.fromJson(json.loads(newest)) if newest else start

    def look(batch: DataFrame, number: int) -> None:
        old = held(number)
        new = schema_updates(batch, old, column, events_per_second, locked)
        if new != old:
            spark.createDataFrame([(new.json(),)], "schema string").write.mode("overwrite").parquet(f"{kept}/batch={number}")
            save(new)

    return stream.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint)


def stream_late(stream: DataFrame, max_hours: int = 72, time: str = "timestamp", now: dt.datetime | None = None) -> DataFrame:
    """df with `arrival`: late, future or on_time, against the clock of each batch, or a given moment."""
    now, at = F.lit(now).cast("timestamp") if now else F.current_timestamp(), F.col(time).cast("timestamp")
    return stream.withColumn("arrival", F.when(at < now - F.expr(f"interval {max_hours} hours"), "late").when(at > now + F.expr(f"interval {LATE}"), "future").otherwise("on_time"))


def stream_enrich(stream: DataFrame, kv: DataFrame, key: str, out: str = "enriched", accessor: str | None = None) -> DataFrame:
    """A join with a static table, which a file source reads anew in each batch: its value, or a part of it
    (see accessor_value), at the path `out`."""
    value = F.col("kv_value_") if accessor is None else accessor_value(F.col("kv_value_"), accessor)
    met = stream.join(kv.select(F.col("key").alias("kv_key_"), F.col("value").alias("kv_value_")), col_at(stream, key).cast("string") == F.col("kv_key_"), "left")
    return set_at(met, out, value).drop("kv_key_", "kv_value_")


def stream_write(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> DataStreamWriter:
    """Events to a table by day. Batches are bounded by the source's files or rows a trigger."""
    def write(batch: DataFrame, number: int) -> None:
        write_events(batch, f"{path}/batch={number}", "overwrite")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every) if every else writer


def drained(writer: DataStreamWriter) -> None:
    """Runs a stream over all there is, then stops."""
    writer.trigger(availableNow=True).start().awaitTermination()
