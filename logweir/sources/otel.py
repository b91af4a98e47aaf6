"""Nested telemetry payloads as rows: logs, spans with their events, and metric data points.

The tables hold decoded payloads: resource and scope with `attributes` as lists of (key, value), ids as
binary. An attribute's value is a struct with a field for each kind, of which one is set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

#: Names of span kinds and temporalities by number.
SPAN_KINDS = ("Unspecified", "Internal", "Server", "Client", "Producer", "Consumer")
TEMPORALITIES = ("unspecified", "delta", "cumulative")


def _value_text(value: Column, kind: DataType) -> Column:
    """An attribute's value as text: lists as JSON of their plain values, null stays null."""
    if not isinstance(kind, StructType):
        return value.cast("string")
    texts = []
    for f in kind:
        own = value.getField(f.name)
        if isinstance(f.dataType, StructType) and "values" in f.dataType.names:
            texts.append(F.to_json(F.transform(own.getField("values"), _reader(f.dataType["values"].dataType.elementType))))
        elif isinstance(f.dataType, ArrayType | StructType):
            texts.append(F.to_json(own))
        else:
            texts.append(own.cast("string"))
    return F.coalesce(*texts)


def _reader(kind: DataType):
    return lambda x: _value_text(x, kind)


def otel_attributes_to_map(column: Column, kind: ArrayType) -> Column:
    """A list of (key, value) as a map of texts; of equal keys the last stays, nulls stay."""
    value_kind = kind.elementType["value"].dataType
    entries = F.transform(column, lambda x: F.struct(x["key"].alias("key"), _value_text(x["value"], value_kind).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def _attributes(df: DataFrame, path: str) -> Column:
    return otel_attributes_to_map(F.col(path), df.select(F.col(path).alias("x")).schema["x"].dataType)


def _scoped(df: DataFrame, scopes: str, items: str) -> DataFrame:
    """A row for each item: resource (map), scope (struct), project and item."""
    resource = df.select(_attributes(df, "resource.attributes").alias("resource"), F.explode(scopes).alias("s"))
    scope = F.struct(F.col("s.scope.name").alias("name"), F.col("s.scope.version").alias("version"), _attributes(resource, "s.scope.attributes").alias("attributes"))
    return resource.select("resource", scope.alias("scope"), F.try_element_at("resource", F.lit("service.name")).alias("project"), F.explode(f"s.{items}").alias("item"))


def _hex(path: str) -> Column:
    return F.lower(F.hex(path))


def explode_otel_logs(df: DataFrame) -> DataFrame:
    """A row for each log record; the message is a text body, else the event's name."""
    rows = _scoped(df, "scope_logs", "log_records")
    return rows.select(
        F.coalesce("item.body.string_value", "item.event_name").alias("event_message"), F.struct(F.lit("otel_log").alias("type")).alias("metadata"), "scope", "resource",
        F.to_json("item.body").alias("body"), _attributes(rows, "item.attributes").alias("attributes"), F.col("item.severity_number").alias("severity_number"),
        F.col("item.severity_text").alias("severity_text"), _hex("item.trace_id").alias("trace_id"), _hex("item.span_id").alias("span_id"), F.col("item.time_unix_nano").alias("timestamp"),
    )


def explode_otel_traces(df: DataFrame) -> DataFrame:
    """A row for each span, and one for each of its events, whose parent is the span."""
    rows = _scoped(df, "scope_spans", "spans")
    kind = F.get(F.array(*map(F.lit, SPAN_KINDS)), F.coalesce("item.kind", F.lit(0)))
    spans = rows.select(
        F.col("item.name").alias("event_message"), F.struct(F.lit("span").alias("type")).alias("metadata"), "resource", "scope", _hex("item.span_id").alias("span_id"),
        _hex("item.parent_span_id").alias("parent_span_id"), _hex("item.trace_id").alias("trace_id"), F.coalesce(kind, F.lit(SPAN_KINDS[0])).alias("kind"),
        F.col("item.start_time_unix_nano").alias("start_time"), F.col("item.end_time_unix_nano").alias("end_time"), _attributes(rows, "item.attributes").alias("attributes"),
        F.col("item.start_time_unix_nano").alias("timestamp"), "project",
    )
    inner = rows.select("resource", "scope", "project", "item.span_id", "item.trace_id", F.explode("item.events").alias("e"))
    events = inner.select(
        F.col("e.name").alias("event_message"), F.struct(F.lit("event").alias("type")).alias("metadata"), "resource", "scope", _hex("span_id").alias("parent_span_id"),
        _hex("trace_id").alias("trace_id"), _attributes(inner, "e.attributes").alias("attributes"), F.col("e.time_unix_nano").alias("timestamp"), "project",
    )
    return spans.unionByName(events, allowMissingColumns=True)


#: For each kind of metric the columns that its data points fill, from the points' fields.
POINT_FIELDS = {
    "gauge": {},
    "sum": {},
    "histogram": {"count": "count", "sum": "sum", "min": "min", "max": "max", "bucket_counts": "bucket_counts", "explicit_bounds": "explicit_bounds"},
    "exponential_histogram": {"count": "count", "sum": "sum", "min": "min", "max": "max", "scale": "scale", "zero_count": "zero_count", "positive": "positive", "negative": "negative"},
}


def explode_otel_metrics(df: DataFrame) -> DataFrame:
    """A row for each data point of gauges, sums and histograms; summaries are left out."""
    rows = _scoped(df, "scope_metrics", "metrics")
    have = rows.schema["item"].dataType
    parts = []
    for kind, fields in POINT_FIELDS.items():
        if kind not in have.names:
            continue
        points = rows.select("resource", "scope", "project", "item", F.explode(f"item.{kind}.data_points").alias("p"))
        names = points.schema["p"].dataType.names
        whole = have[kind].dataType.names
        value = F.coalesce(*(F.col(f"p.{n}").cast("double") for n in ("as_double", "as_int") if n in names)) if {"as_double", "as_int"} & set(names) else F.lit(None).cast("double")
        columns = [F.col("item.name").alias("event_message"), F.col("item.unit").alias("unit"), F.struct(F.lit("metric").alias("type")).alias("metadata"), "scope", "resource", "project", F.lit(kind).alias("metric_type"), value.alias("value")]
        if "aggregation_temporality" in whole:
            columns.append(F.get(F.array(*map(F.lit, TEMPORALITIES)), F.col(f"item.{kind}.aggregation_temporality")).alias("aggregation_temporality"))
        if "is_monotonic" in whole:
            columns.append(F.col(f"item.{kind}.is_monotonic").alias("is_monotonic"))
        columns += [F.col(f"p.{source}").alias(name) for name, source in fields.items() if source in names]
        columns += [F.col("p.start_time_unix_nano").alias("start_time"), _attributes(points, "p.attributes").alias("attributes"), F.col("p.time_unix_nano").alias("timestamp")]
        parts.append(points.select(*columns))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
