"""What the registered queries share: tables, the log view in SQL, and times without a zone."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.events import EVENT_LEVELS, logs_view

Query = Callable[[SparkSession, str], DataFrame]

#: The moment that relative times count from: queries give the same rows on any day.
NOW = dt.datetime(2024, 1, 31)

_LEVELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_LEVELS.items())
#: logs_view() for the oracle; metadata's fields are columns of their own.
LOGS = f"""(SELECT CAST(event_id AS VARCHAR) AS id, ts AS "timestamp", event_type || ' user ' || user_id AS event_message,
  CASE event_type {_LEVELS} END AS level, user_id, event_type, value, CAST(100 + event_id % 510 AS INTEGER) AS status_code,
  event_type AS source, props AS body FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def naive(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the tables have them."""
    return df.select(*(F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f"`{f.name}`") for f in df.schema))


def on_logs(change: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: naive(change(logs_view(spark, sf_dir)))


def flat(df: DataFrame) -> DataFrame:
    """id and the fields that the oracle's log view has."""
    return df.select("id", "timestamp", "event_message", "metadata.level", "metadata.value", "metadata.status_code")


FLAT = 'id, "timestamp", event_message, level, value, status_code'
