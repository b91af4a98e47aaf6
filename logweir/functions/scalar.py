"""The scalar functions that stored queries name, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.charts import PERIODS


def regexp_contains(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def timestamp_trunc(time: Column, unit: str, zone: str | None = None) -> Column:
    """The start of a time's unit, in a zone's time where one is given (as UTC)."""
    if zone is None:
        return F.date_trunc(unit, time)
    return F.to_utc_timestamp(F.date_trunc(unit, F.from_utc_timestamp(time.cast("timestamp"), zone)), zone)


def timestamp_sub(time: Column, n: int, unit: str) -> Column:
    return time - F.expr(f"interval {int(n)} {unit}")


def timestamp_add(time: Column, n: int, unit: str) -> Column:
    return time + F.expr(f"interval {int(n)} {unit}")


def safe_cast(value: Column, kind: str) -> Column:
    return value.try_cast({"INT64": "bigint", "FLOAT64": "double", "STRING": "string", "BOOL": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date"}.get(kind.upper(), kind))


def strpos(text: Column, part: str) -> Column:
    """Where a part first occurs, from 1; 0 where it does not."""
    return F.instr(text, F.lit(part))


def matches_like(text: Column, pattern: str, ignore_case: bool = False, negate: bool = False) -> Column:
    found = text.ilike(pattern) if ignore_case else text.like(pattern)
    return ~found if negate else found


def is_in(value: Column, values: list) -> Column:
    """An empty list holds nothing."""
    return value.isin(*values) if values else F.lit(False)


def extract_date(time: Column) -> Column:
    return F.to_date(time)


def timestamp_micros(number: Column) -> Column:
    return F.timestamp_micros(number).cast("timestamp_ntz")


def json_value(text: Column, path: str) -> Column:
    return F.get_json_object(text, path if path.startswith("$") else f"$.{path}")


def has(values: Column, value) -> Column:
    return F.array_contains(values, F.lit(value))


def array_exists(values: Column, pattern: str) -> Column:
    return F.exists(values, lambda x: F.rlike(x, F.lit(pattern)))


def start_of_interval(time: Column, n: int, unit: str) -> Column:
    """The start of the n units (counted from 1970) that a time lies in."""
    if n == 1 and unit in PERIODS:
        return F.date_trunc(unit, time)
    return F.window(time.cast("timestamp"), f"{n} {unit}").getField("start").cast("timestamp_ntz")


def map_value(values: Column, key: str, kind: str = "string") -> Column:
    """A map's value as a type: null without the key, and where it can't be."""
    return F.try_element_at(values, F.lit(key)).try_cast(kind)
