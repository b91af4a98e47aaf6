"""The mappings of logs, metrics and traces to their tables, and severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..paths import value_or_null
from .mapping import Condition, Field, Infer, map_events

# The tables' columns and the paths that fill them, in order of preference.

PROJECT = ("$.project", "$.project_ref", "$.project_id", "$.metadata.project", "$.metadata.tenant", "$.metadata.tenantId")
MESSAGE = ("$.event_message", "$.message", "$.body", "$.msg")
SERVICE = ("$.resource.service.name", "$.service_name", "$.resource.name", "$.metadata.context.application")
SCOPE = ("$.scope.name", "$.metadata.context.module", "$.metadata.context.application", "$.instrumentation_library.name", "$.metadata.namespace")
SCOPE_VERSION = ("$.scope.version", "$.instrumentation_library.version")
ENVELOPE = ("id", "event_message", "timestamp")
CLUSTER = ("$.metadata.cluster", "$.cluster", "$.resource.cluster")
NODE = ("$.metadata.context.vm.node", "$.resource.node")
REGION = ("$.metadata.region", "$.region")
RESOURCE_SERVICE = ("$.resource.service.name", "$.service_name")
RESOURCE = (("application", ("$.metadata.context.application",)), ("cluster", CLUSTER), ("node", NODE), ("project", PROJECT[:5]), ("region", REGION), ("service_name", RESOURCE_SERVICE))
SEVERITIES = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "NOTICE": 11, "WARN": 13, "WARNING": 13, "ERROR": 17, "LOG": 9, "FATAL": 21, "CRITICAL": 21, "EMERGENCY": 21, "ALERT": 21, "PANIC": 21}
SPAN_KINDS = ("Unspecified", "Internal", "Server", "Client", "Producer", "Consumer")
METRIC_TYPES = {"gauge": 1, "sum": 2, "histogram": 3, "exponential_histogram": 4, "summary": 5}

LOGS = (
    Field("project", "string", PROJECT),
    Field("trace_id", "string", ("$.trace_id", "$.traceId", "$.otel_trace_id", "$.metadata.otel_trace_id")),
    Field("span_id", "string", ("$.span_id", "$.spanId", "$.otel_span_id", "$.metadata.otel_span_id")),
    Field("trace_flags", "uint8", ("$.trace_flags", "$.traceFlags", "$.flags", "$.metadata.otel_trace_flags"), default=0),
    Field("severity_text", "string", ("$.severity_text", "$.severityText", "$.metadata.level", "$.level", "$.metadata.parsed.error_severity"), default="INFO", transform="upcase", allowed=tuple(SEVERITIES)),
    Field("severity_number_alt", "uint8", ("$.severity_number", "$.severityNumber"), default=0),
    Field("severity_number", "uint8", from_output="severity_text", value_map=SEVERITIES, default=0),
    Field("service_name", "string", (*SERVICE, "$.metadata.context.service", "$.SYSLOG_IDENTIFIER", "$._SYSTEMD_UNIT")),
    Field("event_message", "string", MESSAGE),
    Field("scope_name", "string", (*SCOPE, "$.metadata.module_path")),
    Field("scope_version", "string", SCOPE_VERSION),
    Field("scope_schema_url", "string", ("$.scope.schema_url",)),
    Field("resource_schema_url", "string", ("$.resource.schema_url",)),
    Field("resource_attributes", "flat_map", ("$.resource",), pick=(
        ("application_id", ("$.app_id", "$.application_id", "$.metadata.app_id")),
        ("application_name", ("$.metadata.context.application", "$.app_name", "$.application_name", "$.metadata.app_name", "$.metadata.parsed.application_name")),
        ("cluster", CLUSTER), ("host", ("$.metadata.host", "$.metadata.context.host", "$.host")), ("instance_id", ("$.metadata.instance_id",)),
        ("machine_id", ("$.machine_id",)), ("node", NODE), ("organization_id", ("$.organization_id", "$.org_id")), ("organization_slug", ("$.organization_slug",)),
        ("project", PROJECT), ("region", REGION), ("service_name", RESOURCE_SERVICE), ("vector_file", ("$.metadata.vector_file",)), ("vector_host", ("$.metadata.vector_host",)),
    )),
    Field("scope_attributes", "flat_map", ("$.scope.attributes", "$.scope")),
    Field("log_attributes", "flat_map", ("$",), exclude=ENVELOPE, elevate=("metadata",)),
    Field("timestamp", "datetime64", ("$.timestamp",)),
)

METRICS = (
    Field("project", "string", PROJECT),
    Field("metric_name", "string", ("$.metric_name", "$.name", "$.event_message")),
    Field("metric_description", "string", ("$.metric_description", "$.description", "$.event_message")),
    Field("metric_unit", "string", ("$.metric_unit", "$.unit")),
    Field("metric_type", "enum8", ("$.metric_type",), labels=METRIC_TYPES, infer=tuple(Infer(k, any=(Condition(f"$.{k}", "exists"),)) for k in METRIC_TYPES), default=1),
    Field("service_name", "string", SERVICE),
    Field("event_message", "string", MESSAGE),
    Field("scope_name", "string", SCOPE),
    Field("scope_version", "string", SCOPE_VERSION),
    Field("scope_schema_url", "string", ("$.scope.schema_url",)),
    Field("resource_schema_url", "string", ("$.resource.schema_url",)),
    Field("resource_attributes", "flat_map", ("$.resource",), pick=RESOURCE),
    Field("scope_attributes", "flat_map", ("$.scope.attributes", "$.scope")),
    Field("attributes", "flat_map", ("$",), exclude=ENVELOPE, elevate=("metadata",)),
    Field("aggregation_temporality", "string", ("$.aggregation_temporality", "$.aggregationTemporality")),
    Field("is_monotonic", "bool", ("$.is_monotonic", "$.isMonotonic"), default=False),
    Field("flags", "uint32", ("$.flags",), default=0),
    Field("value", "float64", ("$.value", "$.gauge.value", "$.sum.value", "$.as_double", "$.as_int"), default=0),
    Field("count", "uint64", ("$.count", "$.histogram.count", "$.summary.count", "$.exponential_histogram.count"), default=0),
    Field("sum", "float64", ("$.sum", "$.sum.value", "$.histogram.sum", "$.exponential_histogram.sum"), default=0),
    Field("min", "float64", ("$.min", "$.histogram.min", "$.exponential_histogram.min"), default=0),
    Field("max", "float64", ("$.max", "$.histogram.max", "$.exponential_histogram.max"), default=0),
    Field("scale", "int32", ("$.scale", "$.exponential_histogram.scale"), default=0),
    Field("zero_count", "uint64", ("$.zero_count", "$.exponential_histogram.zero_count"), default=0),
    Field("positive_offset", "int32", ("$.positive_offset", "$.positive.offset", "$.exponential_histogram.positive.offset"), default=0),
    Field("negative_offset", "int32", ("$.negative_offset", "$.negative.offset", "$.exponential_histogram.negative.offset"), default=0),
    Field("bucket_counts", "array_uint64", ("$.bucket_counts",)),
    Field("explicit_bounds", "array_float64", ("$.explicit_bounds",)),
    Field("positive_bucket_counts", "array_uint64", ("$.positive_bucket_counts", "$.positive.bucket_counts", "$.exponential_histogram.positive.bucket_counts")),
    Field("negative_bucket_counts", "array_uint64", ("$.negative_bucket_counts", "$.negative.bucket_counts", "$.exponential_histogram.negative.bucket_counts")),
    Field("quantile_values", "array_float64", ("$.quantile_values", "$.summary.quantile_values")),
    Field("quantiles", "array_float64", ("$.quantiles", "$.summary.quantiles")),
    Field("exemplars.filtered_attributes", "array_flat_map", ("$.exemplars[*].filtered_attributes",)),
    Field("exemplars.time_unix", "array_datetime64", ("$.exemplars[*].time_unix_nano",)),
    Field("exemplars.value", "array_float64", ("$.exemplars[*].value", "$.exemplars[*].as_double")),
    Field("exemplars.span_id", "array_string", ("$.exemplars[*].span_id",)),
    Field("exemplars.trace_id", "array_string", ("$.exemplars[*].trace_id",)),
    Field("time_unix", "datetime64", ("$.time_unix_nano", "$.timeUnixNano", "$.time_unix", "$.timestamp")),
    Field("start_time_unix", "datetime64", ("$.start_time_unix_nano", "$.startTimeUnixNano", "$.start_time_unix", "$.start_time", "$.startTime")),
    Field("timestamp", "datetime64", ("$.timestamp",)),
)

TRACES = (
    Field("project", "string", PROJECT),
    Field("trace_id", "string", ("$.trace_id", "$.traceId", "$.otel_trace_id")),
    Field("span_id", "string", ("$.span_id", "$.spanId", "$.otel_span_id")),
    Field("parent_span_id", "string", ("$.parent_span_id", "$.parentSpanId")),
    Field("trace_state", "string", ("$.trace_state", "$.traceState")),
    Field("span_name", "string", ("$.span_name", "$.name", "$.operationName", "$.event_message")),
    Field("span_kind", "string", ("$.span_kind", "$.kind", "$.spanKind"), default="Unspecified", value_map={k: k for k in SPAN_KINDS} | {f"SPAN_KIND_{k.upper()}": k for k in SPAN_KINDS}),
    Field("service_name", "string", SERVICE),
    Field("event_message", "string", MESSAGE),
    Field("start_time", "datetime64", ("$.start_time", "$.startTime", "$.start_time_unix_nano", "$.startTimeUnixNano")),
    Field("end_time", "datetime64", ("$.end_time", "$.endTime", "$.end_time_unix_nano", "$.endTimeUnixNano")),
    Field("duration", "uint64", ("$.duration", "$.duration_ns", "$.duration_ms", "$.duration_us"), default=0),
    Field("status_code", "string", ("$.status.code", "$.status_code", "$.statusCode")),
    Field("status_message", "string", ("$.status.message", "$.status_message", "$.statusMessage")),
    Field("scope_name", "string", SCOPE),
    Field("scope_version", "string", SCOPE_VERSION),
    Field("resource_attributes", "flat_map", ("$.resource",), pick=RESOURCE),
    Field("span_attributes", "flat_map", ("$",), exclude=ENVELOPE, elevate=("metadata",)),
    Field("events.timestamp", "array_datetime64", ("$.events[*].time_unix_nano",)),
    Field("events.name", "array_string", ("$.events[*].name",)),
    Field("events.attributes", "array_flat_map", ("$.events[*].attributes",)),
    Field("links.trace_id", "array_string", ("$.links[*].trace_id",)),
    Field("links.span_id", "array_string", ("$.links[*].span_id",)),
    Field("links.trace_state", "array_string", ("$.links[*].trace_state",)),
    Field("links.attributes", "array_flat_map", ("$.links[*].attributes",)),
    Field("timestamp", "datetime64", ("$.timestamp",)),
)

#: Severities of a database's levels and of level texts, as severity numbers.
DATABASE_LEVELS = {"PANIC": 21, "FATAL": 21, "ERROR": 17, "WARNING": 13, "NOTICE": 9, "LOG": 9, "INFO": 9, "DEBUG1": 5, "DEBUG2": 5, "DEBUG3": 5, "DEBUG4": 5, "DEBUG5": 5}
LEVELS = {"trace": 1, "debug": 5, "info": 9, "notice": 9, "warn": 13, "warning": 13, "error": 17, "critical": 21, "fatal": 21, "panic": 21}


def map_logs(df: DataFrame, event: str = "event", keep: tuple[str, ...] = ()) -> DataFrame:
    return map_events(df, LOGS, event, keep)


def map_metrics(df: DataFrame, event: str = "event", keep: tuple[str, ...] = ()) -> DataFrame:
    return map_events(df, METRICS, event, keep)


def map_traces(df: DataFrame, event: str = "event", keep: tuple[str, ...] = ()) -> DataFrame:
    return map_events(df, TRACES, event, keep)


def severity(database_level: Column, level: Column, status: Column) -> Column:
    """The severity number of the first of the three that is there; null if it is not known."""
    def number(column: Column, known: dict[str, int]) -> Column:
        return F.try_element_at(F.create_map(*(x for k, v in known.items() for x in (F.lit(k), F.lit(v)))), column)

    return (
        F.when(database_level.isNotNull(), number(F.upper(database_level), DATABASE_LEVELS)).when(level.isNotNull(), number(F.lower(level), LEVELS))
        .when(status >= 500, 17).when(status >= 400, 13).when(status.isNotNull(), 9)
    )


def derive_severity(df: DataFrame, out: str = "severity_number") -> DataFrame:
    """severity_number from metadata, unless the event has one."""
    found = severity(value_or_null(df, "metadata.parsed.error_severity", "string"), value_or_null(df, "metadata.level", "string"), value_or_null(df, "metadata.response.status_code", "int"))
    return df.withColumn(out, F.coalesce(value_or_null(df, out, "int"), found))
