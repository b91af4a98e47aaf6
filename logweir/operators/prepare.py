"""Preparing events: type, time, message, clean values and names, copies, look-ups, drops, checks."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegralType, MapType, NumericType, StringType, StructType

from ..paths import col_at, drop_at, has_path, rebuilt, set_at, split_path, value_or_null
from ..rules import FilterRule, PrepareConfig
from .keyvalues import accessor_value
from .routing import matches

MAX_FUTURE_US = 3_600_000_000
MAX_NAME_BYTES = 128
MAX_BROADCAST_KEYS = 200_000
#: Column names that the warehouse reserves begin so.
RESERVED_PREFIXES = ("_TABLE_", "_FILE_", "_PARTITION", "_ROW_TIMESTAMP", "__ROOT__", "_COLIDENTIFIER", "_CHANGE_SEQUENCE_NUMBER", "_CHANGE_TYPE", "_CHANGE_TIMESTAMP")
#: Fields whose heads cannot be dropped.
KEPT_FIELDS = ("id", "timestamp", "event_message")
#: The fields that tell a trace and a metric.
TRACE_IDS, SPAN_IDS = ("trace_id", "traceId", "otel_trace_id"), ("span_id", "spanId", "otel_span_id")
SPAN_FIELDS = ("parent_span_id", "parentSpanId", "start_time", "end_time", "duration", "duration_ms", "duration_ns")
METRIC_NAMES, METRIC_VALUES = ("metric_type", "metric"), ("value", "gauge", "count", "sum")
START_TIMES = ("start_time", "startTime", "start_time_unix_nano", "startTimeUnixNano")


def _any_text(df: DataFrame, paths: Iterable[str]) -> Column:
    """Whether one of the fields is a text that is not empty."""
    out = F.lit(False)
    for p in paths:
        if has_path(df, p) and isinstance(df.schema[p].dataType, StringType):
            out = out | F.coalesce(F.col(p) != "", F.lit(False))
    return out


def detect_event_type(df: DataFrame, out: str = "event_type") -> DataFrame:
    """log, metric or trace: as metadata.type says, else by the fields that are there."""
    said = value_or_null(df, "metadata.type", "string")
    values = [F.col(p) for p in METRIC_VALUES if p in df.columns]
    has_value = F.coalesce(*(v.isNotNull() for v in values)) if len(values) == 1 else F.lit(False)
    if len(values) > 1:
        has_value = F.greatest(*(v.isNotNull() for v in values))
    kind = (
        F.when(said == "span", "trace").when(said == "metric", "metric").when(said.isin("event", "otel_log"), "log")
        .when(_any_text(df, TRACE_IDS) & _any_text(df, SPAN_IDS) & _any_text(df, SPAN_FIELDS), "trace")
        .when(_any_text(df, METRIC_NAMES) & has_value, "metric").otherwise("log")
    )
    return df.withColumn(out, kind)


def to_micros(number: Column) -> Column:
    """Unix time of 19, 16, 13, 10 or 7 digits in microseconds; others are taken as they are."""
    digits = F.length(number.cast("string"))
    return F.when(digits == 19, F.call_function("div", number, F.lit(1000))).when(digits == 13, number * 1000).when(digits == 10, number * 1_000_000).when(digits == 7, number * 1_000_000_000).otherwise(number).cast("long")


def resolve_timestamp(df: DataFrame, now: dt.datetime, column: str = "timestamp") -> DataFrame:
    """timestamp in microseconds and timestamp_inferred. Text must be ISO 8601 with an offset; without a
    usable time it is now, for traces their start."""
    instant = F.lit(int(now.replace(tzinfo=now.tzinfo or dt.timezone.utc).timestamp() * 1_000_000)).cast("long")
    kind = df.schema[column].dataType if column in df.columns else None
    own = F.lit(None).cast("long")
    if isinstance(kind, StringType):
        offset = F.rlike(column, F.lit(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d([.,]\d+)?(Z|z|[+-]\d\d:?\d\d)$"))
        own = F.when(offset, F.unix_micros(F.try_to_timestamp(F.upper(column))))
    elif isinstance(kind, NumericType):
        whole = F.col(column) if isinstance(kind, IntegralType) else F.round(F.col(column))
        own = F.when(F.col(column) >= 0, to_micros(whole.cast("long")))
    elif kind is not None:
        own = F.unix_micros(F.col(column).cast("timestamp"))
    start = F.lit(None).cast("long")
    for p in reversed(START_TIMES):
        if p in df.columns and isinstance(df.schema[p].dataType, IntegralType):
            start = F.coalesce(F.when(F.col(p) > 0, to_micros(F.col(p))), start)
    if "event_type" in df.columns:
        start = F.when(F.col("event_type") == "trace", start)
    else:
        start = F.lit(None).cast("long")
    return df.withColumn("timestamp_inferred", own.isNull()).withColumn(column, F.coalesce(own, start, instant))


def resolve_message_and_id(df: DataFrame) -> DataFrame:
    """event_message from message or event_message, without a message of its own; an id for those without."""
    texts = [F.col(c).cast("string") for c in ("message", "event_message") if c in df.columns]
    out = df.withColumn("event_message", F.coalesce(*texts) if texts else F.lit(None).cast("string")).drop("message")
    return out.withColumn("id", F.coalesce(F.col("id").cast("string"), F.uuid()) if "id" in df.columns else F.uuid())


def _emptied(column: Column, kind: DataType) -> Column:
    """Empty values as null, from the innermost outwards."""
    if isinstance(kind, StructType):
        parts = {f.name: _emptied(column.getField(f.name), f.dataType) for f in kind}
        full = F.lit(False)
        for p in parts.values():
            full = full | p.isNotNull()
        return F.when(full, F.struct(*(p.alias(n) for n, p in parts.items())))
    if isinstance(kind, ArrayType):
        kept = F.array_compact(F.transform(column, lambda x: _emptied(x, kind.elementType)))
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, MapType):
        kept = F.map_filter(F.transform_values(column, lambda _, v: _emptied(v, kind.valueType)), lambda _, v: v.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    return F.nullif(column, F.lit("")) if isinstance(kind, StringType) else column


def drop_empty_values(df: DataFrame) -> DataFrame:
    """Nulls, empty texts, lists and maps removed at every depth, with what becomes empty by that."""
    return df.select(*(_emptied(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def safe_name(name: str) -> str:
    """A name that the warehouse takes: other characters as underscores, one underscore before it for each
    of reserved prefix, dash, leading digit (unless one of these), other character; cut to the limit."""
    body = re.sub("[^A-Za-z0-9_]", "_", name)
    reserved, dash = name.startswith(RESERVED_PREFIXES), "-" in name
    digit = not reserved and not dash and name[:1].isdigit() and name[:1].isascii()
    body = "_" * (reserved + dash + digit + bool(re.search("[^A-Za-z0-9_-]", name))) + body
    return "_" + body[:MAX_NAME_BYTES] if len(body) > MAX_NAME_BYTES else body


def renamed(df: DataFrame, name) -> DataFrame:
    """Every key at every depth by a function of its name. The later of two columns of one name stays."""
    columns = {name(f.name): rebuilt(F.col(f"`{f.name}`"), f.dataType, lambda c, _: c, name).alias(name(f.name)) for f in df.schema}
    return df.select(*columns.values())


def normalize_column_names(df: DataFrame) -> DataFrame:
    return renamed(df, safe_name)


#: The single renaming rules.
RENAMES = {
    "alphanumeric_only": lambda n: "_" + re.sub(r"\W", "_", n, flags=re.A) if re.search(r"\W", n, re.A) else n,
    "strip_prefixes": lambda n: "_" + n if n.startswith(("_TABLE_", "_FILE_", "_PARTITION_")) else n,
    "dashes_to_underscores": lambda n: "_" + n.replace("-", "_") if "-" in n else n,
    "alter_leading_numbers": lambda n: "_" + n if n[:1].isascii() and n[:1].isdigit() else n,
}


def rename_rules(df: DataFrame, rules: Iterable[str | tuple[str, int]]) -> DataFrame:
    """Renaming rules in order; ("field_length", n) cuts longer names."""
    for rule in rules:
        if isinstance(rule, tuple):
            most = rule[1]
            df = renamed(df, lambda n, most=most: "_" + n[:most] if len(n.encode()) > most else n)
        else:
            df = renamed(df, RENAMES[rule])
    return df


def cast_fields(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Values at paths as another type; what can't be is null."""
    for path, kind in casts.items():
        if has_path(df, path):
            df = set_at(df, path, col_at(df, path).try_cast({"float": "double"}.get(kind, kind)))
    return df


def numbers_to_floats(df: DataFrame, column: str = "metadata") -> DataFrame:
    """All whole numbers below a column as doubles."""
    if column not in df.columns:
        return df
    return df.withColumn(column, rebuilt(F.col(column), df.schema[column].dataType, lambda c, k: c.cast("double") if isinstance(k, IntegralType) else c))


def parse_spec(text: str) -> list[tuple[str, ...]]:
    """`from:to`, `from:to:accessor` or `path` lines as tuples."""
    return [tuple(part.strip() for part in line.split(":", 2)) for line in text.splitlines() if line.strip()]


def copy_fields(df: DataFrame, spec: Iterable[tuple[str, str]]) -> DataFrame:
    """Values copied from path to path, in order; a missing source is left alone."""
    for source, to in spec:
        if has_path(df, source):
            df = set_at(df, to, col_at(df, source))
    return df


def drop_fields(df: DataFrame, paths: Iterable[str]) -> DataFrame:
    for path in paths:
        if split_path(path)[0] not in KEPT_FIELDS:
            df = drop_at(df, path)
    return df


def enrich_from_key_values(df: DataFrame, kv: DataFrame, spec: Iterable[tuple[str, str, str | None]]) -> DataFrame:
    """(from, to, accessor): the value that the table has for the key at `from`, or a part of it, at `to`.
    A key that is not in the table changes nothing. Keys must be distinct. The table is broadcast while
    it has MAX_BROADCAST_KEYS at the most; a larger one is joined by a shuffle."""
    small = kv.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS
    for source, to, accessor in spec:
        if not has_path(df, source):
            continue
        table = kv.select(F.col("key").alias("key_"), accessor_value(F.col("value"), accessor).alias("found_"))
        joined = df.join(F.broadcast(table) if small else table, col_at(df, source).cast("string") == F.col("key_"), "left")
        before = value_or_null(df, to, "string")
        df = set_at(joined, to, F.coalesce("found_", before)).drop("key_", "found_")
    return df


def custom_message(df: DataFrame, keys: Iterable[str], separator: str = " | ") -> DataFrame:
    """event_message of the chosen fields' values: texts as they are, others as JSON, missing as null."""
    parts = []
    for key in keys:
        path = {"message": "event_message"}.get(key, key.removeprefix("$."))
        if not has_path(df, path):
            parts.append(F.lit("null"))
            continue
        column, kind = col_at(df, path), df.select(col_at(df, path).alias("x")).schema["x"].dataType
        text = F.to_json(column) if isinstance(kind, StructType | ArrayType | MapType) else column.cast("string")
        parts.append(F.coalesce(text, F.lit("null")))
    return df.withColumn("event_message", F.concat_ws(separator, *parts)) if parts else df


def drop_by_filters(df: DataFrame, rules: Iterable[FilterRule]) -> DataFrame:
    """Without the events that all rules match, as in routing."""
    rules = list(rules)
    return df.filter(~matches(df, rules)) if rules else df


def is_future(now: dt.datetime, time: Column, most_us: int = MAX_FUTURE_US) -> Column:
    return time > F.lit(now + dt.timedelta(microseconds=most_us))


def drop_future(df: DataFrame, now: dt.datetime, most_us: int = MAX_FUTURE_US, time: str = "timestamp", observation=None) -> DataFrame:
    """Without events further ahead than allowed; an Observation counts them as `future`."""
    late = F.coalesce(is_future(now, F.col(time), most_us), F.lit(False))
    if observation is not None:
        df = df.observe(observation, F.count_if(late).alias("future"))
    return df.filter(~late)


def drop_stale(df: DataFrame, now: dt.datetime, max_hours: int, time: str = "timestamp") -> DataFrame:
    """Without events older than so many hours; 0 keeps all."""
    return df.filter(F.col(time) >= F.lit(now - dt.timedelta(hours=max_hours))) if max_hours else df


def day_bucket(micros: Column) -> Column:
    """Days since 1970, truncated towards zero."""
    return F.call_function("div", micros, F.lit(86_400_000_000))


def extract_labels(df: DataFrame, mapping: dict[str, str], out: str = "labels") -> DataFrame:
    """A map from label to the value at its path, without those that are missing."""
    pairs = [F.struct(F.lit(k).alias("key"), col_at(df, p).cast("string").alias("value")) for k, p in mapping.items() if has_path(df, p)]
    none = F.array().cast("array<struct<key:string,value:string>>")
    return df.withColumn(out, F.map_from_entries(F.filter(F.array(*pairs) if pairs else none, lambda e: e["value"].isNotNull())))


def with_error(df: DataFrame, now: dt.datetime, drop_filters: Iterable[FilterRule] = (), time: str = "timestamp") -> DataFrame:
    """df with `error`: why an event is not taken (stage, type, message), or null."""
    def problem(stage: str, kind: str, message: str) -> Column:
        return F.struct(F.lit(stage).alias("stage"), F.lit(kind).alias("type"), F.lit(message).alias("message"))

    empty = F.coalesce(F.col("event_message") == "", F.lit(True)) if "event_message" in df.columns else F.lit(True)
    rules = list(drop_filters)
    error = F.when(F.col(time).isNull(), problem("validate", "no_timestamp", "the event has no timestamp"))
    error = error.when(empty, problem("validate", "no_message", "the event has no message"))
    error = error.when(F.coalesce(is_future(now, F.col(time)), F.lit(False)), problem("time", "future", "the event is more than an hour ahead"))
    if rules:
        error = error.when(matches(df, rules), problem("filter", "dropped", "a drop filter matches"))
    return df.withColumn("error", error)


def split_rejected(df: DataFrame, now: dt.datetime, drop_filters: Iterable[FilterRule] = ()) -> tuple[DataFrame, DataFrame]:
    """Events that are taken, and the others with their `error`."""
    marked = with_error(df, now, drop_filters)
    return marked.filter("error is null").drop("error"), marked.filter("error is not null")


def dedup_events(df: DataFrame) -> DataFrame:
    """One row for each event (time and id)."""
    return df.dropDuplicates(["timestamp", "id"])


def prepare_events(df: DataFrame, config: PrepareConfig, now: dt.datetime, kv: DataFrame | None = None) -> DataFrame:
    """The steps in their order, with `error` at the end; timestamp becomes a timestamp_ntz."""
    out = detect_event_type(df)
    out = resolve_message_and_id(resolve_timestamp(out, now))
    out = normalize_column_names(drop_empty_values(out))
    out = copy_fields(cast_fields(out, config.casts), config.copy)
    out = numbers_to_floats(out) if config.floats else out
    if config.enrich and kv is not None:
        out = enrich_from_key_values(out, kv, config.enrich)
    out = drop_fields(out, config.drop)
    out = custom_message(out, config.message_keys)
    out = out.withColumn("timestamp", F.timestamp_micros("timestamp").cast("timestamp_ntz"))
    return with_error(out, now, config.drop_filters)


def conform_columns(dfs: Iterable[DataFrame]) -> DataFrame:
    """All rows with all columns; missing ones are null."""
    first, *rest = dfs
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first

