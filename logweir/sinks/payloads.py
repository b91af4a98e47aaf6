"""Events in the shapes that other services take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegralType, MapType, NumericType, StructType

from ..operators.presets import severity
from ..paths import flat_map, value_or_null

#: syslog's severities by level, the default one, and its facility (16) times 8.
SYSLOG_LEVELS = {"emergency": 0, "alert": 1, "critical": 2, "error": 3, "warning": 4, "warn": 4, "notice": 5, "info": 6, "debug": 7}
SYSLOG_DEFAULT, SYSLOG_FACILITY = 5, 128
#: The error tracker's level for each level text.
TRACKER_LEVELS = {"debug": "debug", "info": "info", "notice": "info", "warning": "warn", "warn": "warn", "error": "error", "fatal": "fatal", "critical": "fatal", "alert": "fatal", "emergency": "fatal"}
TRACKER_DROPPED = ("timestamp", "event_message", "level", "trace_id")
#: Fields of a log record that have places of their own.
RECORD_FIELDS = ("timestamp", "event_message", "attributes", "trace_id", "span_id", "severity_number", "severity_text")


def iso_time(column: str = "timestamp") -> Column:
    return F.concat(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def _message(df: DataFrame) -> Column:
    return F.coalesce(value_or_null(df, "message", "string"), value_or_null(df, "event_message", "string"), F.lit(""))


def _of(column: Column, known: dict, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), F.lower(column)), F.lit(default))


def to_metrics_service_payload(df: DataFrame, service: str, source_name: str = "logs") -> DataFrame:
    """message (ISO time and text), source, service and the event as data."""
    return df.select(F.concat_ws(" ", iso_time(), _message(df)).alias("message"), F.lit(source_name).alias("ddsource"), F.col(service).alias("service"), F.to_json(F.struct(*df.columns)).alias("data"))


def to_label_streams(df: DataFrame, source: str, service: str, batch: str | None = None) -> DataFrame:
    """Streams by source and service: values are (nanoseconds, text, flat metadata) in time order.

    One stream's events meet in one row, as the service wants them; give `batch` (see batch_by_size) so
    that a row has one batch of a stream.
    """
    flat = flat_map(df, [c for c in df.columns if c not in ("timestamp", "event_message", batch)], "_")
    nanos = (F.unix_micros(F.col("timestamp").cast("timestamp")) * 1000).cast("string")
    value = F.struct(nanos.alias("ns"), F.coalesce("event_message", F.lit("")).alias("text"), flat.alias("metadata"))
    keys = [source, service, *([batch] if batch else [])]
    ordered = F.struct(F.col("timestamp").alias("t"), F.col("id").alias("i"), value["ns"].alias("ns"), value["text"].alias("text"), F.to_json(value["metadata"]).alias("metadata"))
    rows = df.select(*(F.col(k) for k in keys), ordered.alias("v"))
    shown = F.transform(F.array_sort(F.collect_list("v")), lambda x: F.struct(x["ns"].alias("ns"), x["text"].alias("text"), x["metadata"].alias("metadata")))
    return rows.groupBy(*keys).agg(shown.alias("values"))


def _typed(column: Column, kind) -> Column:
    """A value and its type's name, both as text."""
    if isinstance(kind, BooleanType):
        name, text = "boolean", column.cast("string")
    elif isinstance(kind, IntegralType):
        name, text = "integer", column.cast("string")
    elif isinstance(kind, NumericType):
        name, text = "double", column.cast("string")
    elif isinstance(kind, StructType | MapType | ArrayType):
        name, text = "string", F.to_json(column)
    else:
        name, text = "string", column.cast("string")
    return F.struct(text.alias("value"), F.lit(name).alias("type"))


def to_error_tracker_items(df: DataFrame, base: dict[str, str] | None = None) -> DataFrame:
    """Seconds, level, body, trace id (made of the event's id where there is none) and typed attributes;
    metadata's fields become metadata.<field>."""
    entries = [F.struct(F.lit(k).alias("key"), F.struct(F.lit(v).alias("value"), F.lit("string").alias("type")).alias("value")) for k, v in (base or {}).items()]
    for f in df.schema:
        if f.name in TRACKER_DROPPED:
            continue
        if f.name == "metadata" and isinstance(f.dataType, StructType):
            entries += [F.struct(F.lit(f"metadata.{g.name}").alias("key"), _typed(F.col("metadata").getField(g.name), g.dataType).alias("value")) for g in f.dataType]
        else:
            entries.append(F.struct(F.lit(f.name).alias("key"), _typed(F.col(f"`{f.name}`"), f.dataType).alias("value")))
    attributes = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"]["value"].isNotNull()))
    level = F.coalesce(value_or_null(df, "level", "string"), value_or_null(df, "metadata.level", "string"), F.lit("info"))
    trace = F.coalesce(value_or_null(df, "trace_id", "string"), F.md5(F.col("id").cast("string")))
    seconds = F.unix_micros(F.col("timestamp").cast("timestamp")) / 1_000_000
    return df.select("id", seconds.alias("timestamp"), _of(level, TRACKER_LEVELS, "info").alias("level"), F.coalesce("event_message", F.lit("")).alias("body"), trace.alias("trace_id"), attributes.alias("attributes"))


def to_otlp_records(df: DataFrame, flatten: bool = False) -> DataFrame:
    """Log records: times in nanoseconds, severity, ids, body and attributes. Flat: the message is the
    body and all other fields are attributes; else they are the body, as JSON, and the message is the
    event's name."""
    extra = [c for c in df.columns if c not in RECORD_FIELDS]
    number = F.coalesce(value_or_null(df, "severity_number", "int"), severity(value_or_null(df, "metadata.parsed.error_severity", "string"), value_or_null(df, "metadata.level", "string"), value_or_null(df, "metadata.response.status_code", "int")), F.lit(0))
    message = F.coalesce(value_or_null(df, "event_message", "string"), F.lit(""))
    own = flat_map(df, ["attributes"]) if "attributes" in df.columns else F.create_map().cast("map<string,string>")
    own = F.transform_keys(own, lambda k, _: F.regexp_replace(k, r"^attributes\.", ""))
    return df.select(
        "id", (F.unix_micros(F.col("timestamp").cast("timestamp")) * 1000).alias("time_unix_nano"), number.alias("severity_number"), value_or_null(df, "severity_text", "string").alias("severity_text"),
        value_or_null(df, "trace_id", "string").alias("trace_id"), value_or_null(df, "span_id", "string").alias("span_id"), (F.lit(None).cast("string") if flatten else message).alias("event_name"),
        (message if flatten else F.to_json(F.struct(*extra))).alias("body"), (F.map_concat(own, F.map_filter(flat_map(df, extra), lambda k, _: ~F.map_contains_key(own, k))) if flatten else own).alias("attributes"),
    )


def _header(column: Column, most: int) -> Column:
    """A header field: visible ASCII, cut; a dash for nothing."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(column, r"[^\x21-\x7E]", "_"), 1, most), F.lit("")), F.lit("-"))


def to_syslog_lines(df: DataFrame, max_bytes: int | None = None, structured_data: str = "-", default_app: str = "logs") -> DataFrame:
    """id and line: RFC 5424 frames with their length before them; a message that makes a frame longer
    than max_bytes is cut."""
    def first(*paths: str) -> Column:
        return F.coalesce(*(value_or_null(df, p, "string") for p in paths))

    level = first("metadata.level", "level")
    code = F.when(F.rlike(level, F.lit("^[0-7]$")), level.try_cast("int")).otherwise(_of(level, SYSLOG_LEVELS, SYSLOG_DEFAULT))
    time = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    head = F.concat(
        F.lit("<"), (SYSLOG_FACILITY + code).cast("string"), F.lit(">1 "), time, F.lit(" "), _header(first("metadata.host", "resource.node", "host"), 255), F.lit(" "),
        _header(F.coalesce(first("metadata.app_name", "resource.name", "app_name"), F.lit(default_app)), 48), F.lit(" "), _header(first("metadata.procid", "procid"), 128), F.lit(" "),
        _header(F.regexp_replace(F.col("id"), "-", ""), 32), F.lit(f" {structured_data} "),
    )
    rows = df.select("id", head.alias("head"), F.to_json(F.struct(*df.columns)).alias("body"))
    body = F.col("body").cast("binary")
    if max_bytes is not None:
        body = F.substring(body, F.lit(1), F.greatest(F.lit(max_bytes) - F.octet_length("head"), F.lit(0)))
    size = F.octet_length("head") + F.octet_length(body)
    return rows.select("id", F.concat(size.cast("string"), F.lit(" "), F.col("head"), F.make_valid_utf8(body.cast("string"))).alias("line"))


def to_iso_time_rows(df: DataFrame) -> DataFrame:
    """Events with their time as ISO text."""
    return df.withColumn("timestamp", iso_time())
