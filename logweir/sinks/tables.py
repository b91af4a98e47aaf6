"""Writing events to tables and files."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..paths import flat_map

ARCHIVE_ENVELOPE = ("id", "event_message", "timestamp")
TELEMETRY_ORDER = ("project", "source_name", "second", "timestamp")
#: Days that telemetry tables keep.
TELEMETRY_DAYS = 90


def dated(df: DataFrame, time: str = "timestamp") -> DataFrame:
    return df.withColumn("date", F.to_date(time))


def write_events(df: DataFrame, path: str, mode: str = "append", time: str = "timestamp", files_per_day: int | None = None) -> None:
    """A table partitioned by day, sorted by time within files. Rows are dealt by ranges of date and time, so
    that a busy day is several tasks' (of sampled, equal sizes) and a quiet one's files are few; with
    files_per_day, a day's rows are dealt to so many tasks by the minute's hash."""
    salt = F.pmod(F.xxhash64(F.date_trunc("minute", time)), F.lit(files_per_day or 1))
    own = dated(df, time)
    dealt = own.repartition("date", salt) if files_per_day else own.repartitionByRange("date", time)
    dealt.sortWithinPartitions("date", time).write.mode(mode).partitionBy("date").parquet(path)


def write_telemetry(df: DataFrame, path: str, mode: str = "append", time: str = "timestamp") -> None:
    """The mapped tables: by day, sorted by project, source, second and time, with a bloom filter on ids.
    Rows are dealt by ranges of that order, so that a hot source of a day is several tasks'."""
    out = df.withColumn("date", F.to_date(time)).withColumn("second", F.date_trunc("second", time))
    order = [c for c in TELEMETRY_ORDER if c in out.columns]
    writer = out.repartitionByRange("date", *order).sortWithinPartitions("date", *order).drop("second").write.mode(mode).partitionBy("date")
    if "trace_id" in df.columns:
        writer = writer.option("parquet.bloom.filter.enabled#trace_id", "true")
    writer.parquet(path)


def archive_rows(df: DataFrame, source: str | None = None) -> DataFrame:
    """id, event_message, body (the other fields as flat JSON) and timestamp, after the source's column."""
    first = [source] if source else []
    rest = [c for c in df.columns if c not in (*ARCHIVE_ENVELOPE, *first)]
    return df.select(*first, "id", "event_message", F.to_json(flat_map(df, rest)).alias("body"), "timestamp")


def write_parquet_archive(df: DataFrame, path: str, source: str | None = None, mode: str = "append") -> None:
    """The archive's rows; with a source column, in a folder for each source."""
    if source is None:
        archive_rows(df).write.mode(mode).parquet(path)
    else:
        archive_rows(df, source).write.mode(mode).partitionBy(source).parquet(path)


def to_json_body_table(df: DataFrame) -> DataFrame:
    """Rows for a row store: id, body (nested JSON), event_message, timestamp."""
    return df.select("id", F.to_json(F.struct(*df.columns)).alias("body"), "event_message", "timestamp")


def retention_days(source_days: int | None, default_days: int, plan_days: int) -> int:
    return source_days if source_days is not None else min(default_days, plan_days)


def apply_retention(df: DataFrame, days: int, today: dt.date, date_column: str = "date") -> DataFrame:
    """What stays of a table: days before the limit go. On a table partitioned by the column no other
    partition is read."""
    return df.filter(F.col(date_column) > F.lit(today - dt.timedelta(days=days)))


#: The list of days that are given up, beside a table's partitions, and seconds until their folders go.
EXPIRED, GRACE_SECONDS = "_expired.json", 3600


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and a maker of its paths."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def expired_days(spark: SparkSession, path: str) -> dict[str, float]:
    """The days that a table has given up, with the time of it (unix seconds)."""
    fs, hadoop = _files(spark, path)
    name = hadoop(f"{path}/{EXPIRED}")
    if not fs.exists(name):
        return {}
    stream = fs.open(name)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def remove_expired(spark: SparkSession, path: str, days: int, today: dt.date, now: float, grace: float = GRACE_SECONDS) -> tuple[list[str], list[str]]:
    """Removes the days before the limit from a table partitioned by `date`; returns the days given up now and
    those whose folders are gone now.

    In two steps, so that a reader that has listed files is not broken: first a day is put on the list
    beside the partitions (replaced by one rename), and readers by read_live() leave it out; a call after the grace
    period deletes its folder. Folders are listed and deleted, no row is read. A call that is cut short is
    made good by the next one."""
    fs, hadoop = _files(spark, path)
    listed, limit = expired_days(spark, path), str(today - dt.timedelta(days=days))
    held = sorted(x.getPath().getName().removeprefix("date=") for x in fs.listStatus(hadoop(path)) if x.getPath().getName().startswith("date="))
    given_up = [d for d in held if d <= limit and d != "__HIVE_DEFAULT_PARTITION__" and d not in listed]
    gone = [d for d, since in listed.items() if now - since >= grace]
    for day in gone:
        fs.delete(hadoop(f"{path}/date={day}"), True)
    kept = {d: since for d, since in listed.items() if d not in gone} | dict.fromkeys(given_up, now)
    if kept != listed:
        out = fs.create(hadoop(f"{path}/{EXPIRED}.new"), True)
        out.write(bytearray(json.dumps(kept).encode()))
        out.close()
        fs.delete(hadoop(f"{path}/{EXPIRED}"), False)
        fs.rename(hadoop(f"{path}/{EXPIRED}.new"), hadoop(f"{path}/{EXPIRED}"))
    return given_up, gone


def read_live(spark: SparkSession, path: str) -> DataFrame:
    """A table partitioned by date without the days that it has given up; their partitions are not read."""
    listed = [F.lit(dt.date.fromisoformat(d)) for d in expired_days(spark, path)]
    table = spark.read.parquet(path)
    return table.filter(F.col("date").isNull() | ~F.col("date").isin(*listed)) if listed else table


def batch_by_size(df: DataFrame, by: str, max_rows: int, max_bytes: int, body: str = "event_message", order: tuple[str, ...] = ("timestamp", "id"), stretch: str = "hour") -> DataFrame:
    """df with `batch`, a number for each stretch of time of a source: no batch has more rows than max_rows, nor
    more bytes than max_bytes beyond its largest event. Batches are cut at multiples of the running
    count and sum (not anew after each cut), within a source's hour, so that no task sorts a whole source."""
    within = Window.partitionBy(by, F.date_trunc(stretch, "timestamp")).orderBy(*order)
    rows = F.row_number().over(within) - 1
    size = F.coalesce(F.octet_length(body), F.lit(0)).cast("long")
    before = F.coalesce(F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = df.withColumn("rows_", F.floor(rows / max_rows)).withColumn("bytes_", F.floor(before / max_bytes))
    change = F.coalesce((F.lag("rows_").over(within) != F.col("rows_")) | (F.lag("bytes_").over(within) != F.col("bytes_")), F.lit(False))
    return cut.withColumn("change_", change.cast("int")).withColumn("batch", F.sum("change_").over(within.rowsBetween(Window.unboundedPreceding, 0))).drop("rows_", "bytes_", "change_")


def batch_key(df: DataFrame, time_us: Column) -> DataFrame:
    """df with event_type's day_bucket, dealt by ranges of the two and the time, so that a batch hits one partition
    of a table and a busy day of a type is several tasks'."""
    keyed = df.withColumn("day_bucket", F.call_function("div", time_us, F.lit(86_400_000_000))).withColumn("time_", time_us)
    return keyed.repartitionByRange("event_type", "day_bucket", "time_").drop("time_")


def retry_failed(df: DataFrame, max_retries: int) -> tuple[DataFrame, DataFrame]:
    """Failed events that are to be tried again, with a retry more, and those that are given up."""
    tried = F.coalesce("retries", F.lit(0))
    return df.filter(tried < max_retries).withColumn("retries", tried + 1), df.filter(tried >= max_retries)
