"""Reading events, and the log view of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The level of each type of event in the log view.
EVENT_LEVELS = {"click": "debug", "view": "info", "signup": "notice", "purchase": "warning", "error": "error"}


#: JSON times with all their digits.
NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def write_plain(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Events as files that read_events reads."""
    df.write.format(fmt).option("timestampNTZFormat", NTZ_FORMAT).save(path)


def read_events(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None) -> DataFrame:
    """Stored events: parquet, ORC or JSON lines. JSON without a schema is read twice, to infer it."""
    reader = spark.read.format(fmt).option("timestampNTZFormat", NTZ_FORMAT)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_event_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_trigger: int | None = None, names: str | None = None) -> DataFrame:
    """Batches of events as they arrive in a folder, of files with names of a pattern if one is given."""
    reader = spark.readStream.format(fmt).schema(schema)
    reader = reader.option("pathGlobFilter", names) if names else reader
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def logs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as log events: id, timestamp, event_message, metadata, source and body."""
    return as_logs(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_logs(e: DataFrame) -> DataFrame:
    level = F.try_element_at(F.create_map(*(F.lit(x) for kv in EVENT_LEVELS.items() for x in kv)), F.col("event_type"))
    metadata = F.struct(level.alias("level"), "user_id", "event_type", "value", (F.lit(100) + F.col("event_id") % 510).cast("int").alias("status_code"))
    return e.select(F.col("event_id").cast("string").alias("id"), F.col("ts").alias("timestamp"), F.concat_ws(" ", "event_type", F.lit("user"), F.col("user_id").cast("string")).alias("event_message"), metadata.alias("metadata"), F.col("event_type").alias("source"), F.col("props").alias("body"))
