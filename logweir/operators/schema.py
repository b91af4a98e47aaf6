"""Schema on write: inferred from JSON events, merged additively, flattened, and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, MapType, StringType, StructField, StructType, TimestampType

from .nested import node_types

#: The fields that every event table has, and the most that one may have.
BASE_SCHEMA = StructType([StructField("event_message", StringType()), StructField("id", StringType()), StructField("timestamp", TimestampType(), False)])
MAX_FIELDS = 500
#: Fields at the top whose types are not held against the schema.
UNCHECKED = ("timestamp", "start_time", "end_time")


def infer_schema(df: DataFrame, column: str) -> StructType:
    """The nested type of JSON texts: one aggregate over the column. Lists of lists are left out."""
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(column)).alias("s")).first()["s"]
    if found is None or not found.startswith("OBJECT"):
        return StructType()
    return _cleaned(_parsed(df.sparkSession, found))


def _parsed(spark: SparkSession, text: str) -> StructType:
    """An OBJECT<...> type as a struct type; a value of several types is a text, one without any goes."""
    ddl = text.replace("OBJECT<", "STRUCT<").replace("VARIANT", "STRING").replace("VOID", "STRING")
    return DataType.fromDDL(ddl) if not ddl.startswith("STRUCT") else spark.createDataFrame([], f"x {ddl}").schema["x"].dataType


def _cleaned(kind: StructType) -> StructType:
    return StructType([StructField(f.name, _typed(f.dataType)) for f in kind if not (isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, ArrayType))])


def _typed(kind: DataType) -> DataType:
    """Whole numbers as long, fractions as double."""
    if isinstance(kind, StructType):
        return _cleaned(kind)
    if isinstance(kind, ArrayType):
        return ArrayType(_typed(kind.elementType))
    return {"decimal": DoubleType(), "float": DoubleType(), "byte": LongType(), "short": LongType(), "integer": LongType()}.get(kind.typeName(), kind)


def merge_types(old: StructType, new: StructType, protect: tuple[str, ...] = ()) -> StructType:
    """Fields of both, sorted by name: those of both take the new type, structs are merged, and protected
    ones stay as they are."""
    held = {f.name: f for f in old}
    for f in new:
        have = held.get(f.name)
        if f.name in protect and have:
            continue
        if have and isinstance(have.dataType, StructType) and isinstance(f.dataType, StructType):
            f = StructField(f.name, merge_types(have.dataType, f.dataType), have.nullable)
        held[f.name] = f
    return StructType([held[n] for n in sorted(held)])


def merge_schema(old: StructType, df: DataFrame, column: str) -> StructType:
    """A table's schema with what the JSON events of a batch add."""
    return merge_types(merge_types(BASE_SCHEMA, old), infer_schema(df, column), protect=("id", "timestamp", "event_message"))


def flat_types(schema: StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(path, type) of every node; structs are `map`, lists `list<...>`."""
    out = []
    for f in schema:
        kind, path = f.dataType, f"{prefix}{f.name}"
        inner = kind.elementType if isinstance(kind, ArrayType) else kind
        name = "map" if isinstance(inner, StructType | MapType) else _plain(inner)
        out.append((path, f"list<{name}>" if isinstance(kind, ArrayType) and name != "map" else name))
        if isinstance(inner, StructType):
            out += flat_types(inner, f"{path}.")
    return out


def _plain(kind: DataType) -> str:
    return {"bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer", "double": "float", "float": "float", "timestamp": "datetime", "timestamp_ntz": "datetime"}.get(kind.simpleString(), kind.simpleString())


def flatten_schema(spark: SparkSession, schema: StructType) -> DataFrame:
    """The schema's nodes as rows (path, type)."""
    return spark.createDataFrame(flat_types(schema), "path string, type string")


def variant_paths(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, type) of every node of JSON events, at any depth and in the objects of lists; values that
    are null, and lists that are empty or of lists, have no type and are left out."""
    nodes = node_types(df.select(F.col(key).alias("key"), F.explode(F.array(F.try_parse_json(column))).alias("nodes")), "nodes")
    return nodes.select("key", F.explode("nodes").alias("n")).select("key", "n.path", "n.type")


def schema_conflicts(df: DataFrame, schema: StructType, key: str, column: str) -> DataFrame:
    """(key, path, type, expected) where an event's value is not of the schema's type. Whole numbers may
    stand for fractions; paths that the schema lacks are allowed."""
    wanted = flatten_schema(df.sparkSession, schema).withColumnRenamed("type", "expected")
    found = variant_paths(df, key, column).filter(~F.col("path").isin(*UNCHECKED))
    widened = (F.col("type") == "integer") & (F.col("expected") == "float") | (F.col("type") == "list<integer>") & (F.col("expected") == "list<float>")
    wanted = F.broadcast(wanted) if len(flat_types(schema)) <= MAX_FIELDS else wanted
    met = found.join(wanted, "path").filter((F.col("type") != F.col("expected")) & ~widened)
    return met.select(F.col("key").alias(key), "path", "type", "expected")


def sample_rate(events_per_second: float) -> float:
    return min(1.0, max(1e-5, 1 / events_per_second)) if events_per_second > 0 else 1.0


def schema_updates(df: DataFrame, schema: StructType, column: str, events_per_second: float = 1.0, locked: bool = False, limit: int = MAX_FIELDS, seed: int | None = None) -> StructType:
    """The schema after a batch, of which a sample is looked at; a locked schema or one that would grow
    beyond the limit stays."""
    if locked:
        return schema
    rate = sample_rate(events_per_second)
    merged = merge_schema(schema, df if rate >= 1 else df.sample(rate, seed), column)
    return merged if len(flat_types(merged)) <= limit else schema


def field_counts(paths: DataFrame, source: str = "source", limit: int = MAX_FIELDS) -> DataFrame:
    """Distinct fields of each source, and whether they reach the limit. paths: (source, path)."""
    return paths.groupBy(source).agg(F.count_distinct("path").alias("fields")).withColumn("at_limit", F.col("fields") >= limit)
