"""Payloads of senders as events: message, metadata, timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..paths import col_at, has_path, rebuilt, set_at, value_or_null


def _rest(df: DataFrame, *without: str) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in without))


def normalize_generic(df: DataFrame) -> DataFrame:
    """Any JSON payload: itself as metadata, its JSON as the message."""
    return df.select(F.to_json(_rest(df)).alias("message"), _rest(df).alias("metadata"))


def normalize_vector(df: DataFrame) -> DataFrame:
    """An agent's payload: message, timestamp and project are lifted, the rest is metadata; without a
    message it is the JSON of the rest."""
    rest = _rest(df, "message", "timestamp")
    message = F.coalesce(F.col("message"), F.to_json(rest)) if "message" in df.columns else F.to_json(rest)
    lifted = [F.col(c) for c in ("timestamp", "project") if c in df.columns]
    return df.select(message.alias("message"), rest.alias("metadata"), *lifted)


def _text(df: DataFrame, path: str) -> Column:
    return F.coalesce(value_or_null(df, path, "string"), F.lit(""))


def normalize_vercel(df: DataFrame) -> DataFrame:
    """Edge and function logs: source | status | host | path | client | agent; of build logs the source
    alone. A list of agents becomes a text."""
    if has_path(df, "proxy.userAgent") and isinstance(df.select(col_at(df, "proxy.userAgent").alias("x")).schema["x"].dataType, ArrayType):
        df = set_at(df, "proxy.userAgent", F.array_join(col_at(df, "proxy.userAgent"), ","))
    parts = [_text(df, p) for p in ("proxy.statusCode", "proxy.host", "proxy.path", "proxy.clientIp", "proxy.userAgent")]
    build = F.when(value_or_null(df, "message", "string").isNotNull(), F.concat(F.col("source"), F.lit(" | "))).otherwise(F.col("source"))
    message = F.when(F.col("source") == "build", build).otherwise(F.concat_ws(" | ", F.coalesce("source", F.lit("")), *parts))
    return df.select(message.alias("message"), _rest(df).alias("metadata"), "timestamp")


def normalize_netlify(df: DataFrame) -> DataFrame:
    """Traffic and function logs as one message; anything without a log type is a validation ping."""
    def joined(*paths: str) -> Column:
        values = [value_or_null(df, p, "string") for p in paths]
        whole = F.lit(True)
        for v in values:
            whole = whole & v.isNotNull()
        return F.when(whole, F.concat_ws(" | ", *values))

    function = joined("log_type", "method", "status_code", "request_id", "path")
    traffic = joined("log_type", "method", "status_code", "client_ip", "request_id", "url", "user_agent")
    rest = _rest(df, "timestamp")
    message = F.when(value_or_null(df, "log_type").isNull(), value_or_null(df, "message", "string")).otherwise(F.coalesce(function, traffic, F.to_json(rest)))
    kind = F.coalesce(value_or_null(df, "log_type", "string"), F.lit("validate"))
    metadata = F.struct(kind.alias("log_type"), *(F.col(f"`{c}`") for c in df.columns if c not in ("timestamp", "log_type")))
    return df.select(message.alias("message"), metadata.alias("metadata"), *(["timestamp"] if "timestamp" in df.columns else []))


def normalize_github(df: DataFrame) -> DataFrame:
    """Web hooks: repository | login | action, and no key that ends in _url at any depth."""
    message = F.concat_ws(" | ", _text(df, "repository.full_name"), _text(df, "sender.login"), _text(df, "action"))
    keep = lambda n: not n.endswith("_url")
    fields = [rebuilt(F.col(f"`{f.name}`"), f.dataType, lambda c, _: c, keep=keep).alias(f.name) for f in df.schema if keep(f.name)]
    return df.select(message.alias("message"), F.struct(*fields).alias("metadata"))


def normalize_cloud_event(df: DataFrame, headers: str = "headers") -> DataFrame:
    """The ce-* headers (a map) as cloud_event, dashes as underscores, and its time as the timestamp."""
    own = F.map_filter(F.col(headers), lambda k, _: F.startswith(F.lower(k), F.lit("ce-")))
    named = F.transform_keys(own, lambda k, _: F.replace(F.substr(F.lower(k), F.lit(4)), F.lit("-"), F.lit("_")))
    return df.withColumn("cloud_event", named).withColumn("timestamp", F.try_element_at("cloud_event", F.lit("time"))).drop(headers)


def parse_lambda_report(df: DataFrame, column: str, out: str = "report") -> DataFrame:
    """A serverless platform's log text: the report's numbers, its lines, and whether it was cut off."""
    text = F.col(column)

    def found(pattern: str, kind: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast(kind)

    lines = F.filter(F.split(text, "\n"), lambda x: (x != "") & ~F.rlike(x, F.lit(r"^(START|END|REPORT) RequestId")))
    return df.withColumn(out, F.struct(
        found(r"RequestId: ([0-9a-fA-F-]{36})", "string").alias("request_id"), found(r"\bDuration: ([0-9.]+) ms", "double").alias("duration_ms"),
        found(r"Billed Duration: ([0-9.]+) ms", "double").cast("long").alias("billed_duration_ms"), found(r"Memory Size: (\d+) MB", "long").alias("memory_size_mb"),
        found(r"Max Memory Used: (\d+) MB", "long").alias("max_memory_used_mb"), found(r"Init Duration: ([0-9.]+) ms", "double").alias("init_duration_ms"),
        (~F.contains(text, F.lit("REPORT RequestId"))).alias("message_truncated"), lines.alias("lines"),
    ))


#: Names of the severities 0 to 7 and of the facilities 0 to 23.
SEVERITIES = ("emerg", "alert", "crit", "err", "warning", "notice", "info", "debug")
FACILITIES = ("kernel", "user", "mail", "system", "auth", "syslogd", "print", "nntp", "uucp", "clock", "auth_priv", "ftp", "ntp", "log_audit", "log_alert", "clock2", *(f"local{n}" for n in range(8)))
_FIELDS = ("length", "priority", "version", "timestamp", "hostname", "appname", "process_id", "message_id", "structured", "message_text")


def parse_syslog(df: DataFrame, column: str, dialect: str | None = None, out: str = "syslog") -> DataFrame:
    """RFC 5424 lines as columns; null where a line is none. dialect "heroku": a length comes first and
    structured data may be missing. Router and database lines have logfmt pairs."""
    text = F.trim(F.col(column))
    word = r"([^\s\x01]+)"
    length = r"^(\d+) " if dialect == "heroku" else r"^(?:(\d+) )?"
    data = r"(-|(?:\[(?:[^\]\\\"\x01]|\\[^\x01]|\"(?:[^\"\\\x01]|\\[^\x01])*\")*\])+)"
    pattern = length + r"<(\d{1,3})>(\d{1,3}) " + " ".join([word] * 5) + (rf"(?: {data})?" if dialect == "heroku" else f" {data}") + r"(?: ?([\s\S]*))?$"
    # one match for each line: its groups between marks, which no field but the last may hold
    joined = "\x01".join(f"${i + 1}" for i in range(len(_FIELDS)))
    split = df.withColumn("syslog_parts_", F.split(F.regexp_replace(text, pattern, joined), "\x01", len(_FIELDS)))
    part = {n: F.get("syslog_parts_", F.lit(i)) for i, n in enumerate(_FIELDS)}
    some = {n: F.when(~p.isin("", "-"), p) for n, p in part.items()}
    priority = part["priority"].try_cast("int")
    message = some["message_text"]

    def unquoted(x: Column) -> Column:
        return F.when(F.length(x) > 1, F.regexp_replace(x, '^"([^"]*)"$', "$1")).otherwise(x)

    def entries(found: Column, value) -> Column:
        return F.transform(found, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), value(F.substr(x, F.instr(x, "=") + 1)).alias("value")))

    pairs = entries(F.regexp_extract_all(message, F.lit(r'([A-Za-z0-9_.#-]+=(?:"[^"]*"|\S*))'), F.lit(1)), unquoted)
    logfmt = F.map_from_entries(F.filter(pairs, lambda e, i: F.array_position(F.transform(pairs, lambda x: x["key"]), e["key"]) == i + 1))
    sd = F.when(some["structured"].isNotNull(), entries(F.regexp_extract_all(some["structured"], F.lit(r'([A-Za-z0-9_.@-]+="(?:[^"\\]|\\.)*")'), F.lit(1)), lambda v: F.substr(v, F.lit(2), F.length(v) - 2)))
    is_json = F.startswith(F.ltrim(message), F.lit("{")) & F.endswith(F.rtrim(message), F.lit("}"))
    fields = F.struct(
        part["length"].try_cast("int").alias("length"), priority.alias("priority"), F.get(F.array(*map(F.lit, FACILITIES)), F.floor(priority / 8).cast("int")).alias("facility"),
        F.get(F.array(*map(F.lit, SEVERITIES)), priority % 8).alias("severity"), part["version"].try_cast("int").alias("version"),
        F.try_to_timestamp(some["timestamp"]).alias("timestamp"), some["hostname"].alias("hostname"), some["appname"].alias("appname"), some["process_id"].alias("process_id"),
        some["message_id"].alias("message_id"), F.nullif(F.regexp_extract(some["structured"], r"^\[([^ \]]+)", 1), F.lit("")).alias("sd_id"), sd.alias("sd"), message.alias("message"),
        F.when(is_json, F.try_parse_json(message)).cast("string").alias("json"), F.when((some["process_id"] == "router") | F.startswith(some["process_id"], F.lit("heroku")), logfmt).alias("logfmt"), text.alias("message_raw"),
    )
    return split.withColumn(out, F.when((F.size("syslog_parts_") == len(_FIELDS)) & (priority < 192), fields)).drop("syslog_parts_")

