"""Key-value tables: (key, value), the value as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accessor_value(value, accessor: str | None):
    """A part of a JSON value, by dotted or JSON path; whole values come unquoted."""
    if accessor is None:
        return F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"), value)
    path = accessor if accessor.startswith("$") else f"$.{accessor}"
    return F.get_json_object(value, path)


def upsert(table: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Values replaced by key, other keys added. Of a key that comes twice the value that is last by the
    column `order` stays; without one, rows have no order and the greatest value stays."""
    fresh = new.groupBy("key").agg((F.max_by("value", F.struct(order, "value")) if order else F.max("value")).alias("value"))
    return table.join(fresh, "key", "left_anti").select("key", "value").unionByName(fresh)


def delete_keys(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys.select("key"), "key", "left_anti")


def delete_values(table: DataFrame, accessor: str | None, values: list[str]) -> DataFrame:
    """Without the rows whose value (at a path) is one of these."""
    found = accessor_value(F.col("value"), accessor)
    return table.filter(~F.coalesce(found.isin(*values), F.lit(False))) if values else table


def lookup(table: DataFrame, keys: DataFrame, accessor: str | None = None) -> DataFrame:
    """(key, value) of the keys that the table has."""
    return keys.select("key").distinct().join(table, "key").select("key", accessor_value(F.col("value"), accessor).alias("value"))
