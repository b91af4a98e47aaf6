"""Queries of sources, preparation, schemas, mapping, sinks and streams."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from ..operators import mapping as m
from ..operators import prepare as e
from ..operators import presets
from ..operators import schema as h
from ..paths import flat_map
from ..rules import FilterRule as R
from ..rules import PrepareConfig, RoutingRule
from ..sinks import payloads as w
from ..sinks import tables as t
from ..sources import events as s
from ..sources import otel, vendors
from ..streaming import streams as st
from .common import FLAT, LOGS, NOW, Query, flat, naive, on_logs, table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# sources


def stored(fmt: str) -> Query:
    def query(spark, sf_dir):
        path, df = scratch(spark, "events"), flat(s.logs_view(spark, sf_dir))
        s.write_plain(df, path, fmt)
        return naive(s.read_events(spark, path, fmt, df.schema))

    return query


register("s01_parquet", stored("parquet"), f"SELECT {FLAT} FROM {LOGS}")
register("s01_json", stored("json"), f"SELECT {FLAT} FROM {LOGS}")


def raw(spark, sf_dir) -> DataFrame:
    """Events as their senders give them: nested columns, unclean names and values."""
    return s.logs_view(spark, sf_dir).select("id", "timestamp", F.col("event_message").alias("message"), F.col("metadata.level").alias("level"), F.struct(F.col("metadata.user_id").alias("user-id"), F.struct(F.col("metadata.value").alias("2nd"), F.nullif(F.col("source"), F.lit("view")).alias("kind")).alias("inner")).alias("metadata"))


register("s03_generic", lambda p, d: vendors.normalize_generic(table(p, d, "nation")).select("message", F.col("metadata.n_name").alias("name")), """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS message, n_name AS name FROM nation""")
register("s04_vector", lambda p, d: naive(vendors.normalize_vector(raw(p, d).select("timestamp", "message", "level", F.lit("p1").alias("project"))).select("timestamp", "message", "project", F.col("metadata.level").alias("level"))), f"SELECT \"timestamp\", event_message AS message, 'p1' AS project, level FROM {LOGS}")


def edge(spark, sf_dir):
    df = s.logs_view(spark, sf_dir)
    proxy = F.struct(F.col("metadata.status_code").alias("statusCode"), F.lit("a.example").alias("host"), F.concat(F.lit("/"), "source").alias("path"), F.lit("::1").alias("clientIp"), F.array(F.lit("x"), F.col("metadata.level")).alias("userAgent"))
    return naive(vendors.normalize_vercel(df.select(F.when(F.col("source") == "error", "build").otherwise("edge").alias("source"), F.col("event_message").alias("message"), proxy.alias("proxy"), "timestamp", "id")).select(F.col("metadata.id").alias("id"), "message"))


register("s05_edge", edge, f"SELECT id, CASE WHEN source = 'error' THEN 'build | ' ELSE 'edge | ' || status_code || ' | a.example | /' || source || ' | ::1 | x,' || level END AS message FROM {LOGS}")


def reports(spark, sf_dir):
    df = s.logs_view(spark, sf_dir)
    text = F.format_string("START RequestId: 4d0ff57e-4022-4bfd-8689-%012d Version: 1\nhello %s\nEND RequestId: x\nREPORT RequestId: 4d0ff57e-4022-4bfd-8689-%012d\tDuration: %.2f ms\tBilled Duration: 200 ms\tMemory Size: 1024 MB\tMax Memory Used: %d MB\tInit Duration: 1.50 ms", F.col("id").cast("long"), "source", F.col("id").cast("long"), "metadata.value", "metadata.status_code")
    r = vendors.parse_lambda_report(df.withColumn("text", text), "text")
    return r.select("id", "report.request_id", F.round("report.duration_ms", 2).alias("duration_ms"), "report.billed_duration_ms", "report.max_memory_used_mb", "report.init_duration_ms", "report.message_truncated", F.get("report.lines", F.lit(0)).alias("line"))


register("s06_reports", reports, f"SELECT id, '4d0ff57e-4022-4bfd-8689-' || lpad(id, 12, '0') AS request_id, CAST(printf('%.2f', value) AS DOUBLE) AS duration_ms, CAST(200 AS BIGINT) AS billed_duration_ms, CAST(status_code AS BIGINT) AS max_memory_used_mb, CAST(1.5 AS DOUBLE) AS init_duration_ms, FALSE AS message_truncated, 'hello ' || source AS line FROM {LOGS}")


def deploys(spark, sf_dir):
    df = s.logs_view(spark, sf_dir)
    return vendors.normalize_netlify(df.select("timestamp", F.when(F.col("source") != "view", "functions").alias("log_type"), F.lit("GET").alias("method"), F.col("metadata.status_code").alias("status_code"), F.col("id").alias("request_id"), F.concat(F.lit("/"), "source").alias("path"), F.col("event_message").alias("message"))).select("message", "metadata.log_type", F.col("metadata.request_id").alias("id"))


register("s07_deploys", deploys, f"SELECT CASE WHEN source = 'view' THEN event_message ELSE 'functions | GET | ' || status_code || ' | ' || id || ' | /' || source END AS message, CASE WHEN source = 'view' THEN 'validate' ELSE 'functions' END AS log_type, id FROM {LOGS}")


def hooks(spark, sf_dir):
    df = s.logs_view(spark, sf_dir)
    out = vendors.normalize_github(df.select(F.struct(F.concat(F.lit("o/"), "source").alias("full_name"), F.lit("u").alias("html_url")).alias("repository"), F.struct(F.col("id").alias("login"), F.array(F.struct(F.lit(1).alias("n"), F.lit("x").alias("a_url"))).alias("list")).alias("sender"), F.lit("push").alias("action"), F.lit("y").alias("hook_url")))
    return out.select("message", F.to_json("metadata").alias("metadata"))


register("s08_hooks", hooks, f"""SELECT 'o/' || source || ' | ' || id || ' | push' AS message, '{{"repository":{{"full_name":"o/' || source || '"}},"sender":{{"login":"' || id || '","list":[{{"n":1}}]}},"action":"push"}}' AS metadata FROM {LOGS}""")


def cloud(spark, sf_dir):
    df = s.logs_view(spark, sf_dir).select("id", F.create_map(F.lit("ce-time"), F.date_format("timestamp", "yyyy-MM-dd"), F.lit("Ce-Event-Type"), F.col("source"), F.lit("host"), F.lit("x")).alias("headers"))
    return vendors.normalize_cloud_event(df).select("id", "timestamp", F.col("cloud_event.event_type").alias("event_type"), F.size("cloud_event").alias("n"))


register("s09_cloud_events", cloud, f"SELECT id, strftime(\"timestamp\", '%Y-%m-%d') AS \"timestamp\", source AS event_type, 2 AS n FROM {LOGS}")


def syslog(spark, sf_dir):
    df = s.logs_view(spark, sf_dir)
    line = F.concat(F.lit("<"), (F.col("metadata.status_code") % 190).cast("string"), F.lit(">1 2024-01-01T00:00:00Z host app router msg [ex@1 a=\"1\" b=\"x y\"] method=GET path=/"), F.col("source"), F.lit(" user="), F.col("id"))
    r = vendors.parse_syslog(df.withColumn("line", line), "line")
    return naive(r.select("id", "syslog.priority", "syslog.facility", "syslog.severity", "syslog.hostname", "syslog.timestamp", F.col("syslog.logfmt.user").alias("user"), F.col("syslog.logfmt.path").alias("path"), "syslog.sd_id", F.filter("syslog.sd", lambda x: x["key"] == "b")[0]["value"].alias("b")))


_sev = ", ".join(f"'{x}'" for x in vendors.SEVERITIES)
_fac = ", ".join(f"'{x}'" for x in vendors.FACILITIES)
register("s10_syslog", syslog, f"SELECT id, status_code % 190 AS priority, [{_fac}][(status_code % 190) // 8 + 1] AS facility, [{_sev}][status_code % 190 % 8 + 1] AS severity, 'host' AS hostname, TIMESTAMP '2024-01-01' AS \"timestamp\", id AS \"user\", '/' || source AS path, 'ex@1' AS sd_id, 'x y' AS b FROM {LOGS}")

_VALUE = "struct<string_value:string,int_value:bigint,array_value:struct<values:array<struct<string_value:string,int_value:bigint>>>>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"


def _attributes(*pairs: tuple[str, object]):
    return F.array(*(F.struct(F.lit(k).alias("key"), F.struct(F.lit(None).cast("string").alias("string_value") if not isinstance(v, str) else F.col(v).cast("string").alias("string_value"), F.lit(None if isinstance(v, str) else v).cast("long").alias("int_value"), F.lit(None).cast("struct<values:array<struct<string_value:string,int_value:bigint>>>").alias("array_value")).alias("value")) for k, v in pairs)).cast(_ATTRIBUTES)


def _enveloped(df: DataFrame, scopes: str, items: str, item) -> DataFrame:
    """Events of one second and source as one payload."""
    grouped = df.groupBy("source", F.date_trunc("minute", "timestamp").alias("minute")).agg(F.collect_list(item).alias("items"))
    scope = F.struct(F.struct(F.lit("lib").alias("name"), F.lit("1").alias("version"), F.array().cast(_ATTRIBUTES).alias("attributes")).alias("scope"), F.col("items").alias(items))
    return grouped.select(F.struct(_attributes(("service.name", "source"), ("n", 3)).alias("attributes")).alias("resource"), F.array(scope).alias(scopes))


def _logs(spark, sf_dir) -> DataFrame:
    return s.logs_view(spark, sf_dir).withColumn("level", F.col("metadata.level")).withColumn("user", F.col("metadata.user_id"))


def otel_logs(spark, sf_dir):
    body = F.struct(F.when(F.col("source") != "view", F.col("event_message")).alias("string_value"))
    item = F.struct(body.alias("body"), F.col("source").alias("event_name"), _attributes(("user", "user")).alias("attributes"), F.lit(9).alias("severity_number"), F.upper("level").alias("severity_text"), F.lpad("id", 32, "0").cast("binary").alias("trace_id"), F.unhex(F.lit("AB01")).alias("span_id"), F.unix_micros(F.col("timestamp").cast("timestamp")).alias("time_unix_nano"))
    out = otel.explode_otel_logs(_enveloped(_logs(spark, sf_dir), "scope_logs", "log_records", item))
    return out.select("event_message", "metadata.type", F.col("attributes.user").alias("user"), "severity_text", "span_id", F.col("resource.n").alias("n"), F.col("scope.name").alias("scope"), "timestamp", F.unhex("trace_id").cast("string").alias("id"))


register("s11_otel_logs", otel_logs, f"SELECT CASE WHEN source <> 'view' THEN event_message ELSE source END AS event_message, 'otel_log' AS type, CAST(user_id AS VARCHAR) AS \"user\", upper(level) AS severity_text, 'ab01' AS span_id, '3' AS n, 'lib' AS scope, epoch_us(\"timestamp\") AS \"timestamp\", lpad(id, 32, '0') AS id FROM {LOGS}")


def otel_traces(spark, sf_dir):
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    event = F.struct(F.concat(F.lit("e"), "id").alias("name"), micros.alias("time_unix_nano"), F.array().cast(_ATTRIBUTES).alias("attributes"))
    item = F.struct(F.col("source").alias("name"), F.lpad("id", 8, "0").cast("binary").alias("span_id"), F.unhex(F.lit("")).alias("parent_span_id"), F.unhex(F.lit("0AFF")).alias("trace_id"), (F.col("user") % 7).cast("int").alias("kind"), micros.alias("start_time_unix_nano"), (micros + 5).alias("end_time_unix_nano"), F.array().cast(_ATTRIBUTES).alias("attributes"), F.when(F.col("source") == "error", F.array(event)).otherwise(F.array().cast("array<struct<name:string,time_unix_nano:bigint,attributes:" + _ATTRIBUTES + ">>")).alias("events"))
    out = otel.explode_otel_traces(_enveloped(_logs(spark, sf_dir), "scope_spans", "spans", item))
    return out.select("event_message", "metadata.type", "span_id", "parent_span_id", "trace_id", "kind", "start_time", "end_time", "timestamp", "project")


_hex8 = "lower(hex(lpad(id, 8, '0')))"
_kind = "CASE user_id % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(otel.SPAN_KINDS)) + " ELSE 'Unspecified' END"
register("s12_otel_traces", otel_traces, f"SELECT source AS event_message, 'span' AS type, {_hex8} AS span_id, '' AS parent_span_id, '0aff' AS trace_id, {_kind} AS kind, epoch_us(\"timestamp\") AS start_time, epoch_us(\"timestamp\") + 5 AS end_time, epoch_us(\"timestamp\") AS \"timestamp\", source AS project FROM {LOGS} UNION ALL SELECT 'e' || id, 'event', NULL, {_hex8}, '0aff', NULL, NULL, NULL, epoch_us(\"timestamp\"), source FROM {LOGS} WHERE source = 'error'")


def otel_metrics(spark, sf_dir):
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    point = F.struct(F.col("metadata.value").alias("as_double"), F.lit(0).cast("long").alias("start_time_unix_nano"), micros.alias("time_unix_nano"), F.array().cast(_ATTRIBUTES).alias("attributes"))
    bars = F.struct(F.col("user").alias("count"), F.col("metadata.value").alias("sum"), F.array(F.lit(1), F.lit(2)).cast("array<bigint>").alias("bucket_counts"), F.lit(0).cast("long").alias("start_time_unix_nano"), micros.alias("time_unix_nano"), F.array().cast(_ATTRIBUTES).alias("attributes"))
    item = F.struct(F.col("source").alias("name"), F.lit("ms").alias("unit"), F.when(F.col("source") != "error", F.struct(F.array(point).alias("data_points"), F.lit(2).alias("aggregation_temporality"), F.lit(True).alias("is_monotonic"))).alias("sum"), F.when(F.col("source") == "error", F.struct(F.array(bars).alias("data_points"), F.lit(1).alias("aggregation_temporality"))).alias("histogram"))
    out = otel.explode_otel_metrics(_enveloped(_logs(spark, sf_dir), "scope_metrics", "metrics", item))
    return out.select("event_message", "unit", "metric_type", "value", "aggregation_temporality", "is_monotonic", "count", "sum", F.size("bucket_counts").alias("bars"), "timestamp")


register("s13_otel_metrics", otel_metrics, f"SELECT source AS event_message, 'ms' AS unit, 'sum' AS metric_type, value, 'cumulative' AS aggregation_temporality, TRUE AS is_monotonic, CAST(NULL AS BIGINT) AS count, CAST(NULL AS DOUBLE) AS sum, CAST(NULL AS INTEGER) AS bars, epoch_us(\"timestamp\") AS \"timestamp\" FROM {LOGS} WHERE source <> 'error' UNION ALL SELECT source, 'ms', 'histogram', NULL, 'delta', NULL, user_id, value, 2, epoch_us(\"timestamp\") FROM {LOGS} WHERE source = 'error'")


# preparation


register("e01_event_type", on_logs(lambda df: e.detect_event_type(df.select("id", F.struct(F.when(F.col("source") == "click", "span").alias("type")).alias("metadata"), F.when(F.col("source") == "view", "t").alias("trace_id"), F.lit("s").alias("span_id"), F.lit("5").alias("duration"), F.when(F.col("source") == "error", "gauge").alias("metric_type"), F.lit(1).alias("value"))).select("id", "event_type")), f"SELECT id, CASE WHEN source IN ('click', 'view') THEN 'trace' WHEN source = 'error' THEN 'metric' ELSE 'log' END AS event_type FROM {LOGS}")


def times(spark, sf_dir):
    df = s.logs_view(spark, sf_dir)
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    digits = F.col("metadata.user_id") % 4
    number = F.when(digits == 0, micros).when(digits == 1, F.floor(micros / 1000)).when(digits == 2, F.floor(micros / 1_000_000)).otherwise(micros * 1000)
    return e.resolve_timestamp(df.select("id", number.alias("timestamp")), NOW)


register("e02_numbers", times, f"SELECT id, CASE user_id % 4 WHEN 1 THEN epoch_us(\"timestamp\") // 1000 * 1000 WHEN 2 THEN epoch_us(\"timestamp\") // 1000000 * 1000000 ELSE epoch_us(\"timestamp\") END AS \"timestamp\", FALSE AS timestamp_inferred FROM {LOGS}")
register("e02_texts", on_logs(lambda df: e.resolve_timestamp(df.select("id", F.when(F.col("source") != "view", F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise("soon").alias("timestamp")), NOW)), f"SELECT id, CASE WHEN source <> 'view' THEN epoch_us(date_trunc('second', \"timestamp\")) - 7200000000 ELSE epoch_us(TIMESTAMP '2024-01-31') END AS \"timestamp\", source = 'view' AS timestamp_inferred FROM {LOGS}")
register("e03_message_id", on_logs(lambda df: e.resolve_message_and_id(df.select("id", F.nullif("source", F.lit("view")).alias("message"), "event_message"))), f"SELECT id, COALESCE(NULLIF(source, 'view'), event_message) AS event_message FROM {LOGS}")


def emptied(spark, sf_dir):
    df = s.logs_view(spark, sf_dir)
    nested = F.struct(F.when(F.col("source") == "view", "").otherwise(F.col("source")).alias("a"), F.array(F.lit(""), F.when(F.col("metadata.user_id") % 2 == 0, "x")).alias("b"), F.struct(F.lit("").alias("d")).alias("c"))
    return e.drop_empty_values(df.select("id", nested.alias("n"))).select("id", F.to_json("n").alias("n"))


register("e04_empty", emptied, f"""SELECT id, CASE WHEN source = 'view' AND user_id % 2 <> 0 THEN NULL WHEN source = 'view' THEN '{{"b":["x"]}}' WHEN user_id % 2 = 0 THEN '{{"a":"' || source || '","b":["x"]}}' ELSE '{{"a":"' || source || '"}}' END AS n FROM {LOGS}""")
register("e05_names", lambda p, d: e.normalize_column_names(raw(p, d)).select("id", F.to_json(F.col("metadata").dropFields("inner")).alias("m"), F.col("metadata.inner._2nd").alias("v")), f"""SELECT id, '{{"_user_id":' || user_id || '}}' AS m, value AS v FROM {LOGS}""")
register("e06_rules", lambda p, d: e.rename_rules(raw(p, d).select("id", F.col("metadata.user-id").alias("user-id"), F.col("level").alias("1st.level")), ["dashes_to_underscores", "alter_leading_numbers", "alphanumeric_only", ("field_length", 6)]), f'SELECT id, user_id AS "__user_", level AS "___1st_" FROM {LOGS}')
register("e07_casts", on_logs(lambda df: e.cast_fields(df.select("id", F.struct(F.when(F.col("source") == "view", "n/a").otherwise(F.col("metadata.value").cast("string")).alias("v"), F.lit(1).alias("k")).alias("metadata")), {"metadata.v": "float"}).select("id", "metadata.v")), f"SELECT id, CASE WHEN source <> 'view' THEN value END AS v FROM {LOGS}")
register("e08_floats", on_logs(lambda df: e.numbers_to_floats(df).select("id", "metadata.status_code", "metadata.level")), f"SELECT id, CAST(status_code AS DOUBLE) AS status_code, level FROM {LOGS}")
register("e09_copy", on_logs(lambda df: e.copy_fields(df, [("m.level", "level"), ("metadata.user_id", "a.b.c"), ("missing", "x")]).select("id", "level", "a.b.c")), f"SELECT id, level, user_id AS c FROM {LOGS}")
register("e10_drop", on_logs(lambda df: e.drop_fields(df, ["metadata.level", "m.value", "id", "body"]).select("*", F.to_json("metadata").alias("m")).drop("metadata")), f"""SELECT id, "timestamp", event_message, source, '{{"user_id":' || user_id || ',"event_type":"' || event_type || '","status_code":' || status_code || '}}' AS m FROM {LOGS}""")


def enriched(spark, sf_dir):
    kv = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.to_json(F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("s")).alias("seg"))).alias("value"))
    return e.enrich_from_key_values(s.logs_view(spark, sf_dir), kv, [("metadata.user_id", "metadata.segment", "seg.s")]).select("id", "metadata.segment", "metadata.level")


register("e11_enrich", enriched, f"SELECT id, c_mktsegment AS segment, level FROM {LOGS} LEFT JOIN customer ON user_id = c_custkey")
register("e12_message", on_logs(lambda df: e.custom_message(df, ["id", "message", "m.status_code", "$.metadata.level", "nothing"]).select("id", "event_message")), f"SELECT id, id || ' | ' || event_message || ' | ' || status_code || ' | ' || level || ' | null' AS event_message FROM {LOGS}")
register("e13_drop_filter", on_logs(lambda df: flat(e.drop_by_filters(df, [R("m.level", "=", "debug"), R("m.value", ">", 20)]))), f"SELECT {FLAT} FROM {LOGS} WHERE NOT (level = 'debug' AND value > 20)")
register("e14_future", on_logs(lambda df: flat(e.drop_future(df, dt.datetime(2024, 1, 20)))), f"SELECT {FLAT} FROM {LOGS} WHERE \"timestamp\" <= TIMESTAMP '2024-01-20 01:00:00'")
register("e15_stale", on_logs(lambda df: flat(e.drop_stale(df, NOW, 72))), f"SELECT {FLAT} FROM {LOGS} WHERE \"timestamp\" >= TIMESTAMP '2024-01-28'")
register("e16_day_bucket", on_logs(lambda df: df.select("id", e.day_bucket(F.unix_micros(F.col("timestamp").cast("timestamp"))).alias("day"), e.day_bucket(-F.col("id").cast("long") * 40_000_000_000).alias("before"))), f"SELECT id, epoch_us(\"timestamp\") // 86400000000 AS day, -((CAST(id AS BIGINT) * 40000000000) // 86400000000) AS before FROM {LOGS}")
register("e17_labels", on_logs(lambda df: e.extract_labels(df, {"lvl": "m.level", "status": "metadata.status_code", "none": "m.none"}).select("id", F.col("labels.lvl").alias("lvl"), F.col("labels.status").alias("status"), F.size("labels").alias("n"))), f"SELECT id, level AS lvl, CAST(status_code AS VARCHAR) AS status, 2 AS n FROM {LOGS}")


def rejected(spark, sf_dir):
    df = s.logs_view(spark, sf_dir).withColumn("event_message", F.nullif("event_message", F.lit("view user 7")))
    good, bad = e.split_rejected(df, dt.datetime(2024, 1, 25), [R("m.level", "=", "notice")])
    return good.select("id", F.lit("").alias("why")).unionByName(bad.select("id", F.col("error.type").alias("why")))


register("e18_rejected", rejected, f"SELECT id, CASE WHEN event_message = 'view user 7' THEN 'no_message' WHEN \"timestamp\" > TIMESTAMP '2024-01-25 01:00:00' THEN 'future' WHEN level = 'notice' THEN 'dropped' ELSE '' END AS why FROM {LOGS}")
register("e19_dedup", on_logs(lambda df: flat(e.dedup_events(df.unionByName(df.filter("metadata.level = 'error'"))))), f"SELECT {FLAT} FROM {LOGS}")
CONFIG = PrepareConfig(copy=(("metadata.inner.kind", "kind"),), drop=("metadata.inner.kind",), drop_filters=(R("level", "=", "notice"),), message_keys=("id", "message"))


def prepared(spark, sf_dir):
    return naive(e.prepare_events(raw(spark, sf_dir), CONFIG, NOW).select("id", "timestamp", "event_message", "event_type", "timestamp_inferred", "kind", F.col("metadata._user_id").alias("user_id"), F.col("error.type").alias("why")))


register("e20_prepare", prepared, f"SELECT id, \"timestamp\", id || ' | ' || event_message AS event_message, 'log' AS event_type, FALSE AS timestamp_inferred, NULLIF(source, 'view') AS kind, user_id, CASE WHEN level = 'notice' THEN 'dropped' END AS why FROM {LOGS}")
register("e21_conform", lambda p, d: e.conform_columns([table(p, d, "nation"), table(p, d, "region")]), "SELECT n_nationkey, n_name, n_regionkey, NULL AS r_regionkey, NULL AS r_name FROM nation UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name FROM region")


# schemas


def inferred(spark, sf_dir):
    return h.flatten_schema(spark, h.infer_schema(table(spark, sf_dir, "events"), "props"))


register("h01_infer", inferred, "SELECT 'k' AS path, 'integer' AS type")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the cores, for work that is long for each row. It is done at any number of partitions: a
    file of one row group is cut into many, and all but one of them are empty."""
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def spread_logs(spark, sf_dir) -> DataFrame:
    """The log events, dealt while the rows are still small."""
    return s.as_logs(spread(table(spark, sf_dir, "events")))


def bodies(spark, sf_dir) -> DataFrame:
    """Events as JSON of differing shapes."""
    df = spread_logs(spark, sf_dir)
    return df.select("id", "source", F.to_json(F.struct(F.struct(F.col("metadata.level").alias("level"), F.when(F.col("source") == "error", F.col("metadata.status_code")).alias("code")).alias("metadata"), F.when(F.col("source") == "click", F.array("metadata.value")).alias("list"), F.when(F.col("source") == "view", F.lit("5")).alias("num"))).alias("body"))


HELD = StructType([StructField("num", LongType()), StructField("list", ArrayType(LongType())), StructField("metadata", StructType([StructField("level", StringType())])), StructField("x", DoubleType())])


def merged(spark, sf_dir):
    return h.flatten_schema(spark, h.merge_schema(HELD, bodies(spark, sf_dir), "body"))


register("h02_merge", merged, "SELECT * FROM (VALUES ('event_message', 'string'), ('id', 'string'), ('timestamp', 'datetime'), ('num', 'string'), ('list', 'list<float>'), ('metadata', 'map'), ('metadata.level', 'string'), ('metadata.code', 'integer'), ('x', 'float')) AS v(path, type)")
register("h03_flatten", lambda p, d: h.variant_paths(bodies(p, d), "id", "body").select("path", "type").distinct(), "SELECT * FROM (VALUES ('metadata', 'map'), ('metadata.level', 'string'), ('metadata.code', 'integer'), ('list', 'list<float>'), ('num', 'string')) AS v(path, type)")
register("h04_conflicts", lambda p, d: h.schema_conflicts(bodies(p, d), HELD, "id", "body"), f"SELECT id, 'num' AS path, 'string' AS type, 'integer' AS expected FROM {LOGS} WHERE source = 'view' UNION ALL SELECT id, 'list', 'list<float>', 'list<integer>' FROM {LOGS} WHERE source = 'click'")
register("h05_updates", lambda p, d: h.flatten_schema(p, h.schema_updates(bodies(p, d), HELD, "body", limit=20)), ORACLE["h02_merge"])
register("h06_counts", lambda p, d: h.field_counts(h.variant_paths(bodies(p, d), "source", "body").withColumnRenamed("key", "source"), limit=3), f"SELECT source, CAST(2 + (source IN ('error', 'click', 'view'))::INT AS BIGINT) AS fields, source IN ('error', 'click', 'view') AS at_limit FROM {LOGS} GROUP BY 1")


# mapping


def variants(spark, sf_dir) -> DataFrame:
    df = spread_logs(spark, sf_dir)
    nested = F.to_json(F.struct("id", (F.unix_micros(F.col("timestamp").cast("timestamp"))).alias("timestamp"), "event_message", F.struct(F.upper("metadata.level").alias("level"), F.col("metadata.status_code").alias("code"), F.col("metadata.value").alias("value"), F.lit("p").alias("project")).alias("metadata"), F.struct(F.struct(F.col("source").alias("name")).alias("service")).alias("resource"), F.when(F.col("source") == "error", F.struct(F.col("metadata.value").alias("value"))).alias("gauge"), F.array(F.struct(F.col("id").alias("name"), F.lit(None).alias("x")), F.struct(F.lit("b").alias("name"), F.lit(None).alias("x"))).alias("events"), F.lit("SPAN_KIND_SERVER").alias("kind"), F.col("metadata.user_id").alias("duration")))
    return m.as_variant(df.select("id", nested.alias("json")), "json")


_p = m.Field
OPTIONS = (
    _p("m01_first", "string", ("$.none", "$.metadata.level")), _p("m02_wild", "array_string", ("$.events[*].name",)), _p("m02_index", "string", ("$.events[1].name",)),
    _p("m03_default", "string", ("$.none",), default="d"), _p("m04_output", "string", from_output="m01_first", transform="downcase"), _p("m06_allowed", "string", ("$.metadata.level",), default="other", allowed=("DEBUG", "ERROR")),
    _p("m07_map", "uint8", ("$.metadata.level",), value_map={"debug": 5, "error": 17}, default=1), _p("m08_chars", "string", ("$.event_message", "$.metadata.level"), chars="alpha", bytes=("lte", 6)),
    _p("m09_uint8", "uint8", ("$.metadata.code",)), _p("m09_int", "int32", ("$.metadata.value",)), _p("m09_float", "float64", ("$.metadata.code",)), _p("m09_bad", "uint64", ("$.event_message",)), _p("m09_bool", "bool", ("$.metadata.code",)),
    _p("m10_time", "datetime64", ("$.timestamp",), precision=3), _p("m11_enum", "enum8", ("$.metadata.level",), labels={"debug": 1, "bad": 2, "fine": 3}, infer=(m.Infer("bad", all=(m.Condition("$.gauge", "exists"), m.Condition("$.metadata.code", "greater_than", 300))), m.Infer("fine", any=(m.Condition("$.metadata.code", "less_than", 300), m.Condition("$.metadata.level", "in", ("INFO",))))), default=0),
    _p("m12_text", "enum8", (), labels={"t": 1}, infer=(m.Infer("t", all=(m.Condition("$.metadata.level", "is_string"), m.Condition("$.metadata", "is_map"), m.Condition("$.events", "is_list"), m.Condition("$.duration", "is_number"), m.Condition("$.none", "not_exists"), m.Condition("$.duration", "not_zero"), m.Condition("$.metadata.level", "not_equals", "INFO"))),), default=0),
    _p("m13_pick", "json", pick=(("a", ("$.metadata.project",)), ("b", ("$.none",)))), _p("m14_flat", "flat_map", ("$",), exclude=("id", "timestamp", "event_message", "events", "resource", "gauge"), elevate=("metadata",)),
)


def mapped(spark, sf_dir):
    out = m.map_events(variants(spark, sf_dir), OPTIONS, keep=("id",))
    return out.select("id", *(F.col(f.name).cast("string").alias(f.name) if f.kind in ("uint64",) else F.to_json(f.name).alias(f.name) if f.kind.startswith("array") else F.array_join(F.array_sort(F.transform(F.map_entries(f.name), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ",").alias(f.name) if f.kind == "flat_map" else F.col(f.name).cast("int").alias(f.name) if f.kind in ("uint8", "enum8") else F.col(f.name) for f in OPTIONS))


register("m01_m16_options", mapped, f"""SELECT id, upper(level) AS m01_first, '["' || id || '","b"]' AS m02_wild, 'b' AS m02_index, 'd' AS m03_default, level AS m04_output, CASE WHEN level IN ('debug', 'error') THEN upper(level) ELSE 'other' END AS m06_allowed,
CASE level WHEN 'debug' THEN 5 WHEN 'error' THEN 17 ELSE 1 END AS m07_map, CASE WHEN length(level) <= 6 THEN upper(level) ELSE '' END AS m08_chars, least(status_code, 255) AS m09_uint8, CAST(trunc(value) AS INTEGER) AS m09_int, CAST(status_code AS DOUBLE) AS m09_float,
'0' AS m09_bad, TRUE AS m09_bool, epoch_us("timestamp") // 1000 AS m10_time, CASE WHEN level = 'debug' THEN 1 WHEN level = 'error' AND status_code > 300 THEN 2 WHEN status_code < 300 OR level = 'info' THEN 3 ELSE 0 END AS m11_enum, CASE WHEN level <> 'info' AND user_id <> 0 THEN 1 ELSE 0 END AS m12_text,
'{{"a":"p"}}' AS m13_pick, 'code=' || status_code || ',duration=' || user_id || ',kind=SPAN_KIND_SERVER,level=' || upper(level) || ',project=p,value=' || CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS m14_flat FROM {LOGS}""")


def telemetry(spark, sf_dir) -> DataFrame:
    """Events with something for most fields of the telemetry tables."""
    df, col = spread_logs(spark, sf_dir), F.col
    at = F.unix_micros(col("timestamp").cast("timestamp"))
    user, level = col("metadata.user_id"), col("metadata.level")
    parts = {
        "id": col("id"), "timestamp": at, "event_message": col("event_message"), "resource": F.struct(F.struct(col("source").alias("name")).alias("service")), "kind": F.lit("SPAN_KIND_SERVER"), "duration": user,
        "metadata": F.struct(F.upper(level).alias("level"), col("metadata.status_code").alias("code"), col("metadata.value").alias("value"), F.lit("p").alias("project")),
        "scope": F.struct(F.lit("lib").alias("name"), F.lit("1.2").alias("version"), F.struct(col("source").alias("k")).alias("attributes")), "trace_id": F.concat(F.lit("t"), "id"), "span_id": F.concat(F.lit("s"), "id"),
        "gauge": F.when(col("source") == "error", F.struct(col("metadata.value").alias("value"))), "bucket_counts": F.array(F.lit(1).cast("long"), user), "explicit_bounds": F.array(F.lit(0.5), F.lit(2.5)),
        "events": F.array(F.struct(col("id").alias("name"), at.alias("time_unix_nano"), F.struct(level.alias("a")).alias("attributes")), F.struct(F.lit("b").alias("name"), at.alias("time_unix_nano"), F.lit(None).cast("struct<a:string>").alias("attributes"))),
        "exemplars": F.array(F.struct(user.alias("value"), col("id").alias("span_id"), at.alias("time_unix_nano"), F.struct(F.struct(user.alias("er")).alias("deep")).alias("filtered_attributes"))),
        "links": F.array(F.struct(F.concat(F.lit("l"), "id").alias("trace_id"))), "status": F.struct(F.lit("OK").alias("code"), level.alias("message")), "is_monotonic": col("metadata.value") > 50, "flags": col("metadata.status_code"), "count": user, "min": F.lit(1.5),
    }
    return m.as_variant(df.select("id", F.to_json(F.struct(*(v.alias(k) for k, v in parts.items()))).alias("json")), "json")


def comparable(df: DataFrame) -> DataFrame:
    """Maps as sorted key=value texts, arrays as JSON, small and very large numbers as int and text."""
    def one(f):
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind == "map":
            return F.array_join(F.sort_array(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), "|")
        return F.to_json(c) if kind == "array" else c.cast("int") if kind in ("byte", "short") else c.cast("string") if kind == "decimal" else c

    return df.select(*(one(f).alias(f.name.replace(".", "_")) for f in df.schema))


_TIME = 'epoch_us("timestamp")'
_NUM = "CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END"
_ALL = f"""'bucket_counts=[1,' || user_id || ']|code=' || status_code || '|count=' || user_id || '|duration=' || user_id || '|events=[{{"attributes":{{"a":"' || level || '"}},"name":"' || id || '","time_unix_nano":' || {_TIME} || '}},{{"name":"b","time_unix_nano":' || {_TIME} || '}}]|exemplars=[{{"filtered_attributes":{{"deep":{{"er":' || user_id || '}}}},"span_id":"' || id || '","time_unix_nano":' || {_TIME} || ',"value":' || user_id || '}}]|explicit_bounds=[0.5,2.5]|flags=' || status_code
|| CASE WHEN source = 'error' THEN '|gauge.value=' || {_NUM} ELSE '' END || '|is_monotonic=' || (value > 50) || '|kind=SPAN_KIND_SERVER|level=' || upper(level) || '|links=[{{"trace_id":"l' || id || '"}}]|min=1.5|project=p|resource.service.name=' || source || '|scope.attributes.k=' || source || '|scope.name=lib|scope.version=1.2|span_id=s' || id || '|status.code=OK|status.message=' || level || '|trace_id=t' || id || '|value=' || {_NUM}"""
_SHARED = f"""id, 'p' AS project, source AS service_name, event_message, 'lib' AS scope_name, '1.2' AS scope_version, 'project=p|service_name=' || source AS resource_attributes, {_TIME} * 1000 AS "timestamp\""""
_SCOPES = "'' AS scope_schema_url, '' AS resource_schema_url, 'k=' || source AS scope_attributes"
_LOG = f"{_SHARED}, {_SCOPES}, 't' || id AS trace_id, 's' || id AS span_id, least(status_code, 255) AS trace_flags, upper(level) AS severity_text, 0 AS severity_number_alt, CASE level WHEN 'debug' THEN 5 WHEN 'info' THEN 9 WHEN 'notice' THEN 11 WHEN 'warning' THEN 13 ELSE 17 END AS severity_number, {_ALL} AS log_attributes"
_ZERO = ", ".join(f"0 AS {x}" for x in ("scale", "positive_offset", "negative_offset", "start_time_unix"))
_NONE = ", ".join(f"'[]' AS {x}" for x in ("positive_bucket_counts", "negative_bucket_counts", "quantile_values", "quantiles"))
_METRIC = f"""{_SHARED}, {_SCOPES}, event_message AS metric_name, event_message AS metric_description, '' AS metric_unit, 1 AS metric_type, {_ALL} AS attributes, '' AS aggregation_temporality, value > 50 AS is_monotonic, CAST(status_code AS BIGINT) AS flags, CASE WHEN source = 'error' THEN value ELSE 0 END AS value, CAST(user_id AS VARCHAR) AS count, CAST(0 AS DOUBLE) AS sum, 1.5 AS min, CAST(0 AS DOUBLE) AS max, '0' AS zero_count, {_ZERO}, {_NONE},
'[1,' || user_id || ']' AS bucket_counts, '[0.5,2.5]' AS explicit_bounds, '[{{"deep.er":"' || user_id || '"}}]' AS exemplars_filtered_attributes, '[' || {_TIME} * 1000 || ']' AS exemplars_time_unix, '[' || user_id || '.0]' AS exemplars_value, '["' || id || '"]' AS exemplars_span_id, '[""]' AS exemplars_trace_id, {_TIME} * 1000 AS time_unix"""
_TRACE = f"""{_SHARED}, 't' || id AS trace_id, 's' || id AS span_id, '' AS parent_span_id, '' AS trace_state, event_message AS span_name, 'Server' AS span_kind, 0 AS start_time, 0 AS end_time, CAST(user_id AS VARCHAR) AS duration, 'OK' AS status_code, level AS status_message, {_ALL} AS span_attributes, '[' || {_TIME} * 1000 || ',' || {_TIME} * 1000 || ']' AS events_timestamp, '["' || id || '","b"]' AS events_name,
'[{{"a":"' || level || '"}}]' AS events_attributes, '["l' || id || '"]' AS links_trace_id, '[""]' AS links_span_id, '[""]' AS links_trace_state, '[]' AS links_attributes"""
register("m17_logs", lambda p, d: comparable(presets.map_logs(telemetry(p, d), keep=("id",))), f"SELECT {_LOG} FROM {LOGS}")
register("m18_metrics", lambda p, d: comparable(presets.map_metrics(telemetry(p, d), keep=("id",))), f"SELECT {_METRIC} FROM {LOGS}")
register("m19_traces", lambda p, d: comparable(presets.map_traces(telemetry(p, d), keep=("id",))), f"SELECT {_TRACE} FROM {LOGS}")
KINDS = (
    _p("a_string", "array_string", ("$.list",)), _p("a_uint64", "array_uint64", ("$.list",)), _p("a_float64", "array_float64", ("$.list",)), _p("a_time", "array_datetime64", ("$.times",), precision=6), _p("a_json", "array_json", ("$.items",)),
    _p("a_map", "array_map", ("$.items",)), _p("a_flat", "array_flat_map", ("$.items[*].in",)), _p("a_dense", "array_string", ("$.list",), filter_nil=True), _p("a_nested", "array_json", ("$.items[*].more[*].n",)), _p("a_none", "array_uint64", ("$.none",)), _p("deep", "flat_map", ("$.deep",)),
    _p("scalar", "string", ("$.items[*].k", "$.list[0]")), _p("place", "uint64", ("$.items[1].more[0].n",)),
    *(_p(f"is_{i}", "enum8", (), labels={"y": 1}, infer=(m.Infer("y", any=(c,)),), default=0) for i, c in enumerate((m.Condition("$.zero", "is_zero"), m.Condition("$.blank", "is_empty"), m.Condition("$.list", "not_empty"), m.Condition("$.u", "equals", 7), m.Condition("$.none", "is_empty"), m.Condition("$.u", "not_zero")))),
)


def kinds(spark, sf_dir):
    df, user = spread_logs(spark, sf_dir), F.col("metadata.user_id").cast("string")
    text = F.concat(F.lit('{"u":'), user, F.lit(',"zero":0,"blank":"","list":["a",'), user, F.lit(',null,-1,true],"times":["2024-01-02T03:04:05Z",'), user, F.lit('],"items":[{"k":"x","in":{"a":{"b":['), user, F.lit(']}},"more":[{"n":1},{"n":'), user, F.lit('}]},{"k":null,"more":[{"n":'), user, F.lit('}]},5],"deep":{"1":{"2":{"3":{"4":{"5":{"6":{"7":{"8":"'), F.col("id"), F.lit('"}}}}}}}}}'))
    return comparable(m.map_events(m.as_variant(df.select("id", text.alias("json")), "json"), KINDS, keep=("id",)))


register("m16_arrays", kinds, f"""SELECT id, '["a","' || user_id || '","","-1","true"]' AS a_string, '[0,' || user_id || ',0,0,1]' AS a_uint64, '[0.0,' || user_id || '.0,0.0,-1.0,1.0]' AS a_float64, '[1704164645000000,' || user_id * 1000000 || ']' AS a_time,
'["{{\\"in\\":{{\\"a\\":{{\\"b\\":[' || user_id || ']}}}},\\"k\\":\\"x\\",\\"more\\":[{{\\"n\\":1}},{{\\"n\\":' || user_id || '}}]}}","{{\\"k\\":null,\\"more\\":[{{\\"n\\":' || user_id || '}}]}}","5"]' AS a_json,
'[{{"k":"x","more":"[{{\\"n\\":1}},{{\\"n\\":' || user_id || '}}]","in.a.b":"[' || user_id || ']"}},{{"more":"[{{\\"n\\":' || user_id || '}}]"}}]' AS a_map, '[{{"a.b":"[' || user_id || ']"}}]' AS a_flat, '["a","' || user_id || '","-1","true"]' AS a_dense, '["[1,' || user_id || ']","[' || user_id || ']",null]' AS a_nested, '[]' AS a_none, '1.2.3.4.5.6.7.8=' || id AS deep,
'' AS scalar, CAST(user_id AS VARCHAR) AS place, 1 AS is_0, 1 AS is_1, 1 AS is_2, CAST(user_id = 7 AS INTEGER) AS is_3, 1 AS is_4, CAST(user_id <> 0 AS INTEGER) AS is_5 FROM {LOGS}""")
register("m15_flat_map", on_logs(lambda df: df.select("id", F.explode(flat_map(df, ["metadata"])).alias("key", "value"))), f"SELECT id, unnest(['metadata.level', 'metadata.user_id', 'metadata.event_type', 'metadata.status_code', 'metadata.value']) AS key, unnest([level, CAST(user_id AS VARCHAR), event_type, CAST(status_code AS VARCHAR), CAST(value AS VARCHAR)]) AS value FROM {LOGS}")
register("m20_severity", on_logs(lambda df: presets.derive_severity(df.withColumn("metadata", F.struct(F.struct(F.when(F.col("source") == "view", "log").alias("error_severity")).alias("parsed"), F.when(F.col("source") == "click", F.col("metadata.level")).alias("level"), F.struct(F.col("metadata.status_code")).alias("response")))).select("id", "severity_number")), f"SELECT id, CASE WHEN source = 'view' THEN 9 WHEN source = 'click' THEN 5 WHEN status_code >= 500 THEN 17 WHEN status_code >= 400 THEN 13 ELSE 9 END AS severity_number FROM {LOGS}")


# sinks


def back(write, columns=None) -> Query:
    """Writes events and reads them back."""
    def query(spark, sf_dir):
        path = scratch(spark, "sink")
        write(s.logs_view(spark, sf_dir), path)
        out = spark.read.parquet(path)
        return naive(columns(out) if columns else out)

    return query


register("w01_events", back(t.write_events, lambda df: df.select("id", "event_message", "timestamp", F.col("date").cast("string").alias("date"))), f"SELECT id, event_message, \"timestamp\", strftime(\"timestamp\", '%Y-%m-%d') AS date FROM {LOGS}")
register("w02_telemetry", back(lambda df, path: t.write_telemetry(df.select("id", F.col("source").alias("source_name"), F.lit("p").alias("project"), F.lit("t").alias("trace_id"), "timestamp"), path), lambda df: df.select("id", "source_name", "timestamp")), f'SELECT id, source AS source_name, "timestamp" FROM {LOGS}')
register("w03_archive", back(lambda df, path: t.write_parquet_archive(df.drop("body").withColumn("metadata", F.col("metadata").dropFields("value")), path, "source"), lambda df: df.select("id", "event_message", "body", "timestamp", "source")), f"""SELECT id, event_message, '{{"metadata.level":"' || level || '","metadata.user_id":"' || user_id || '","metadata.event_type":"' || event_type || '","metadata.status_code":"' || status_code || '"}}' AS body, "timestamp", source FROM {LOGS}""")
register("w04_body", on_logs(lambda df: t.to_json_body_table(df).select("id", "event_message", "timestamp", F.get_json_object("body", "$.metadata.level").alias("level"))), f'SELECT id, event_message, "timestamp", level FROM {LOGS}')
register("w05_retention", on_logs(lambda df: flat(t.apply_retention(t.dated(df), 7, dt.date(2024, 1, 31)))), f"SELECT {FLAT} FROM {LOGS} WHERE CAST(\"timestamp\" AS DATE) > DATE '2024-01-24'")
register("w06_metrics_service", on_logs(lambda df: w.to_metrics_service_payload(df, "source").select(F.get_json_object("data", "$.id").alias("id"), "message", "service")), f"SELECT id, strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%S.%f') || 'Z ' || event_message AS message, source AS service FROM {LOGS}")


def label_streams(spark, sf_dir):
    df = t.batch_by_size(s.logs_view(spark, sf_dir).drop("body"), "source", 500, 100_000)
    rows = w.to_label_streams(df.withColumn("day", F.to_date("timestamp").cast("string")), "source", "day", "batch")
    return rows.select("source", F.explode("values").alias("v")).select("source", "v.ns", "v.text", F.get_json_object("v.metadata", "$.metadata_level").alias("level"))


register("w07_streams", label_streams, f"SELECT source, CAST(epoch_us(\"timestamp\") * 1000 AS VARCHAR) AS ns, event_message AS text, level FROM {LOGS}")
register("w08_tracker", on_logs(lambda df: w.to_error_tracker_items(df, {"sdk": "x"}).select("id", "level", "body", F.col("attributes")["metadata.user_id"]["value"].alias("user"), F.col("attributes")["metadata.user_id"]["type"].alias("type"), F.round("timestamp", 3).alias("timestamp"), F.col("trace_id"))), f"SELECT id, CASE level WHEN 'notice' THEN 'info' WHEN 'warning' THEN 'warn' ELSE level END AS level, event_message AS body, CAST(user_id AS VARCHAR) AS \"user\", 'integer' AS type, round(epoch_us(\"timestamp\") / 1000000, 3) AS \"timestamp\", md5(id) AS trace_id FROM {LOGS}")
register("w09_records", on_logs(lambda df: w.to_otlp_records(df, True).select("id", "time_unix_nano", "severity_number", "body", F.col("attributes")["metadata.level"].alias("level"), "event_name")), f"SELECT id, epoch_us(\"timestamp\") * 1000 AS time_unix_nano, CASE level WHEN 'debug' THEN 5 WHEN 'warning' THEN 13 WHEN 'error' THEN 17 ELSE 9 END AS severity_number, event_message AS body, level, CAST(NULL AS VARCHAR) AS event_name FROM {LOGS}")


def syslog_lines(spark, sf_dir):
    df = s.logs_view(spark, sf_dir).select("id", "timestamp", F.struct("metadata.level", F.lit("a host").alias("host")).alias("metadata"))
    return w.to_syslog_lines(df, 120)


_SYSLOG = f"""WITH l AS (SELECT id, '<' || (128 + CASE level WHEN 'debug' THEN 7 WHEN 'info' THEN 6 WHEN 'notice' THEN 5 WHEN 'warning' THEN 4 ELSE 3 END) || '>1 ' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%g') || 'Z a_host logs - ' || id || ' - ' AS head,
'{{"id":"' || id || '","timestamp":"' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%g') || '","metadata":{{"level":"' || level || '","host":"a host"}}}}' AS body FROM {LOGS})
SELECT id, (length(head) + length(body[1:120 - length(head)])) || ' ' || head || body[1:120 - length(head)] AS line FROM l"""


register("w10_syslog", syslog_lines, _SYSLOG)
register("w11_iso", on_logs(lambda df: w.to_iso_time_rows(df.select("id", "timestamp"))), f"SELECT id, strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS \"timestamp\" FROM {LOGS}")
register("w12_batches", on_logs(lambda df: t.batch_by_size(df, "source", 3, 60).groupBy("source", F.date_trunc("hour", "timestamp").alias("hour"), "batch").agg(F.count("*").alias("n"), F.sum(F.octet_length("event_message")).alias("bytes"))), f"""WITH r AS (SELECT source, date_trunc('hour', "timestamp") AS hour, "timestamp" AS t, id, strlen(event_message) AS size, row_number() OVER w - 1 AS r, COALESCE(sum(strlen(event_message)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {LOGS} WINDOW w AS (PARTITION BY source, date_trunc('hour', "timestamp") ORDER BY "timestamp", id)),
c AS (SELECT *, CASE WHEN lag(r // 3) OVER w <> r // 3 OR lag(CAST(b AS BIGINT) // 60) OVER w <> CAST(b AS BIGINT) // 60 THEN 1 ELSE 0 END AS change FROM r WINDOW w AS (PARTITION BY source, hour ORDER BY t, id)),
d AS (SELECT *, CAST(sum(change) OVER (PARTITION BY source, hour ORDER BY t, id) AS BIGINT) AS batch FROM c) SELECT source, hour, batch, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM d GROUP BY 1, 2, 3""")


def expired(spark, sf_dir):
    """A table whose old days are given up by one call and deleted by the next."""
    path = scratch(spark, "events")
    t.write_events(s.logs_view(spark, sf_dir), path)
    today = dt.date(2024, 1, 31)
    t.remove_expired(spark, path, 7, today, now=0)
    t.remove_expired(spark, path, 7, today, now=t.GRACE_SECONDS)
    return naive(flat(t.read_live(spark, path)))


register("w15_expired", expired, f"SELECT {FLAT} FROM {LOGS} WHERE CAST(\"timestamp\" AS DATE) > DATE '2024-01-24'")
register("w13_batch_key", on_logs(lambda df: t.batch_key(df.select("id", F.col("source").alias("event_type"), "timestamp"), F.unix_micros(F.col("timestamp").cast("timestamp"))).select("id", "event_type", "day_bucket")), f"SELECT id, source AS event_type, epoch_us(\"timestamp\") // 86400000000 AS day_bucket FROM {LOGS}")


def retried(spark, sf_dir):
    again, given_up = t.retry_failed(s.logs_view(spark, sf_dir).select("id", (F.col("metadata.user_id") % 5).alias("retries")), 3)
    return again.withColumn("state", F.lit("retry")).unionByName(given_up.withColumn("state", F.lit("exhausted")))


register("w14_retry", retried, f"SELECT id, CASE WHEN user_id % 5 < 3 THEN user_id % 5 + 1 ELSE user_id % 5 END AS retries, CASE WHEN user_id % 5 < 3 THEN 'retry' ELSE 'exhausted' END AS state FROM {LOGS}")


# streams: each runs over the whole table as it is, then stops


def stream_of(spark, sf_dir) -> DataFrame:
    return s.as_logs(s.read_event_stream(spark, sf_dir, spark.read.parquet(f"{sf_dir}/events.parquet").schema, names="events.parquet"))


def streamed(change, windows: bool = False) -> Query:
    """The rows of a stream over all there is. Windows are given as they are in the end, those that the
    watermark would keep open too."""
    def query(spark, sf_dir):
        out = change(stream_of(spark, sf_dir))
        path, point = scratch(spark, "stream"), scratch(spark, "point")

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/part={'all' if windows else number}")

        out.writeStream.outputMode("complete" if windows else "append").foreachBatch(keep).option("checkpointLocation", point).trigger(availableNow=True).start().awaitTermination()
        return naive(spark.read.schema(out.schema).parquet(f"{path}/*"))

    return query


def through(start) -> Query:
    """What a stream has written to a folder."""
    def query(spark, sf_dir):
        path, point = scratch(spark, "stream"), scratch(spark, "point")
        return naive(start(spark, stream_of(spark, sf_dir), path, point))

    return query


register("t01_tail", streamed(lambda df: flat(st.tail(df, [R("m.level", "=", "error")], lambda: dt.datetime(2024, 1, 20)))), f"SELECT {FLAT} FROM {LOGS} WHERE level = 'error' AND \"timestamp\" >= TIMESTAMP '2024-01-19 23:50:00'")


def _prepared(spark, df, path, point):
    st.drained(st.stream_prepare(df.drop("body"), PrepareConfig(drop_filters=(R("m.level", "=", "notice"),)), f"{path}/good", f"{path}/bad", point, lambda: NOW))
    good, bad = spark.read.parquet(f"{path}/good"), spark.read.parquet(f"{path}/bad")
    return good.select("id", F.lit("good").alias("state")).unionByName(bad.select("id", F.col("error.type").alias("state")))


register("t02_prepare", through(_prepared), f"SELECT id, CASE WHEN level = 'notice' THEN 'dropped' ELSE 'good' END AS state FROM {LOGS}")
_ROUTES = (RoutingRule(1, (R("metadata.level", "=", "error"),), "errors"), RoutingRule(2, (R("metadata.value", ">", 50),), "high"))


def _routed(spark, df, path, point):
    st.drained(st.stream_route(df, _ROUTES, path, point))
    return spark.read.parquet(path).select("id", "target")


register("t03_route", through(_routed), f"SELECT id, 'errors' AS target FROM {LOGS} WHERE level = 'error' UNION ALL SELECT id, 'high' FROM {LOGS} WHERE value > 50")
register("t04_chart", streamed(lambda df: st.stream_chart(df, "max", "metadata.value", "hour"), True), f"SELECT date_trunc('hour', \"timestamp\") AS \"timestamp\", max(value) AS value FROM {LOGS} GROUP BY 1")
register("t05_rates", streamed(st.stream_rates, True), f"SELECT source, date_trunc('second', \"timestamp\") AS \"timestamp\", count(*) AS rate FROM {LOGS} GROUP BY 1, 2")
register("t05_averages", streamed(st.stream_averages, True), f"""SELECT source, t AS "timestamp", count(*) AS sum, CAST(ceil(count(*) / 60.0) AS BIGINT) AS average FROM (SELECT source, unnest(generate_series(date_trunc('second', "timestamp"), date_trunc('second', "timestamp") + INTERVAL 59 SECOND, INTERVAL 1 SECOND)) AS t FROM {LOGS}) GROUP BY 1, 2""")


def _quota(df):
    limits = df.sparkSession.createDataFrame([(x, i % 2) for i, x in enumerate(s.EVENT_LEVELS)], "source string, limit long")
    return st.stream_quota(df, limits, seconds=3600)


_limits = ", ".join(f"('{x}', {i % 2})" for i, x in enumerate(s.EVENT_LEVELS))
register("t06_quota", streamed(_quota, True), f"SELECT source, date_trunc('hour', \"timestamp\") AS \"timestamp\", 3600 * any_value(lim) - count(*) AS remaining, 3600 * any_value(lim) - count(*) < 0 AS exceeded FROM {LOGS} JOIN (VALUES {_limits}) AS l(source, lim) USING (source) GROUP BY 1, 2")
register("t07_digest", streamed(lambda df: st.stream_digest(df, "1 day"), True), f"SELECT source, date_trunc('day', \"timestamp\") AS \"interval\", count(*) AS count, arg_max(event_message, (\"timestamp\", id)) AS newest FROM {LOGS} GROUP BY 1, 2")


def _alerted(spark, df, path, point):
    st.drained(st.stream_alert(df, lambda rows: rows.filter("metadata.level = 'error'").groupBy("source").count(), lambda n, rows: rows.write.mode("overwrite").parquet(f"{path}/{n}"), point))
    return spark.read.parquet(f"{path}/*")


register("t08_alert", through(_alerted), f"SELECT source, count(*) AS count FROM {LOGS} WHERE level = 'error' GROUP BY 1")
register("t09_dedup", streamed(lambda df: st.stream_dedup(df.select("id", "timestamp", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))).select("id", "timestamp")), f'SELECT id, "timestamp" FROM {LOGS}')


def _tracked(spark, df, path, point):
    found: list[StructType] = []
    st.drained(st.stream_schema(df, "body", h.BASE_SCHEMA, found.append, point))
    return h.flatten_schema(spark, found[-1])


register("t10_schema", through(_tracked), "SELECT * FROM (VALUES ('event_message', 'string'), ('id', 'string'), ('k', 'integer'), ('timestamp', 'datetime')) AS v(path, type)")
register("t11_late", streamed(lambda df: st.stream_late(df, now=dt.datetime(2024, 1, 20)).select("id", "arrival")), f"SELECT id, CASE WHEN \"timestamp\" < TIMESTAMP '2024-01-17' THEN 'late' WHEN \"timestamp\" > TIMESTAMP '2024-01-20 01:00:00' THEN 'future' ELSE 'on_time' END AS arrival FROM {LOGS}")


def _enriched(spark, sf_dir):
    kv = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.to_json(F.struct(F.struct(F.col("c_name").alias("name")).alias("is"))).alias("value"))
    return streamed(lambda df: st.stream_enrich(df.select("id", "metadata"), kv, "metadata.user_id", "metadata.customer.name", "is.name").select("id", F.col("metadata.user_id").cast("string").alias("user"), F.col("metadata.customer.name").alias("name")))(spark, sf_dir)


register("t12_enrich", _enriched, f"SELECT CAST(user_id AS VARCHAR) AS \"user\", id, c_name AS name FROM {LOGS} LEFT JOIN customer ON user_id = c_custkey")


def _written(spark, df, path, point):
    st.drained(st.stream_write(df, path, point))
    return flat(spark.read.parquet(path))


register("t13_write", through(_written), f"SELECT {FLAT} FROM {LOGS}")
register("s02_stream", streamed(flat), f"SELECT {FLAT} FROM {LOGS}")
