"""Predicates over events: search filters, level ranges, time bounds.

A filter on a path through arrays holds if any element passes; it never multiplies rows. Negation keeps
rows whose value is null, but for `= NULL`, where it is plain not; a negated range is null or outside.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, IntegralType, MapType, NumericType, StringType, TimestampNTZType, TimestampType

from ..paths import any_at, type_at
from ..rules import FilterRule

#: Fixed value: levels in order, and the names that count as each.
LEVELS = {"debug": 0, "info": 1, "notice": 2, "warning": 3, "error": 4, "critical": 5, "alert": 6, "emergency": 7}
#: Periods that an open-ended chart range spans at the most.
MAX_PERIODS = 1000
UNITS = ("microsecond", "millisecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year")


def typed(value: Any, kind: DataType) -> Any:
    """The value as the field's type has it; ValueError if it can't be."""
    if value is None:
        return None
    if isinstance(kind, ArrayType):
        return typed(value, kind.elementType)
    try:
        if isinstance(kind, IntegralType):
            return int(value)
        if isinstance(kind, NumericType):
            return float(value)
        if isinstance(kind, BooleanType):
            if not isinstance(value, bool) and str(value).lower() not in ("true", "false"):
                raise ValueError(value)
            return value if isinstance(value, bool) else str(value).lower() == "true"
        if isinstance(kind, TimestampNTZType | TimestampType | DateType):
            return value if isinstance(value, dt.date) else time_literal(str(value))
        return str(value) if isinstance(kind, StringType) else value
    except (TypeError, ValueError) as e:
        raise ValueError(f"not a {kind.simpleString()}: {value!r}") from e


def _operand(column: Column, kind: DataType, value: Any) -> Column:
    """Values of text maps are read as the literal's type; what can't be is null."""
    if isinstance(kind, StringType) and not isinstance(value, str) and value is not None:
        return column.try_cast("boolean" if isinstance(value, bool) else "double")
    return column


def _test(rule: FilterRule, column: Column, kind: DataType, below_map: bool) -> Column:
    def value(x: Any) -> Any:
        return x if below_map else typed(x, kind)

    if rule.op == "=":
        return column.isNull() if rule.value is None else _operand(column, kind, value(rule.value)) == F.lit(value(rule.value))
    if rule.op == "range":
        low, high = map(value, rule.values)
        return _operand(column, kind, low).between(F.lit(low), F.lit(high))
    if rule.op == "in":
        return column.isin(*map(value, rule.values)) if rule.values else F.lit(False)
    if rule.op == "~":
        return F.rlike(column.cast("string"), F.lit(str(rule.value)))
    if rule.op == "contains":
        return F.contains(column.cast("string"), F.lit(str(rule.value)))
    if rule.op == "list_includes":
        return F.array_contains(column, F.lit(value(rule.value)))
    if rule.op == "list_includes_regexp":
        return F.exists(column, lambda x: F.rlike(x.cast("string"), F.lit(str(rule.value))))
    own = _operand(column, kind, value(rule.value))
    other = F.lit(value(rule.value))
    return {">": own > other, ">=": own >= other, "<": own < other, "<=": own <= other}[rule.op]


def _below_map(df: DataFrame, path: str) -> bool:
    parts = path.split(".")
    return any(isinstance(type_at(df.schema, ".".join(parts[:i])), MapType) for i in range(1, len(parts)))


def predicate(df: DataFrame, rule: FilterRule) -> Column:
    """A rule as a condition for searches."""
    held = any_at(df, rule.path, lambda column, kind: _test(rule, column, kind, _below_map(df, rule.path)))
    if not rule.negate:
        return held
    if rule.op == "=" and rule.value is None:
        return ~held
    missing = any_at(df, rule.path, lambda column, _: column.isNull())
    return F.coalesce(missing, F.lit(True)) | ~F.coalesce(held, F.lit(False))


def filter_events(df: DataFrame, rules: Iterable[FilterRule]) -> DataFrame:
    """Events that all rules hold for."""
    return reduce(lambda out, rule: out.filter(predicate(df, rule)), rules, df)


def level_range(path: str, low: str, high: str, negate: bool = False) -> FilterRule:
    """The rule that a level lies between two levels, both included."""
    names = {"warn": "warning"}
    a, b = (LEVELS[names.get(x, x)] for x in (low, high))
    if a > b:
        raise ValueError(f"no levels from {low} to {high}")
    return FilterRule(path, "in", values=tuple(x for x, n in LEVELS.items() if a <= n <= b), negate=negate)


# time


def time_literal(text: str) -> dt.datetime:
    """A date, a date and time (with an offset: in UTC), or unix time of 10, 13 or 16 digits."""
    if re.fullmatch(r"\d{10}|\d{13}|\d{16}", text):
        return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(text.ljust(16, "0")))
    value = dt.datetime.fromisoformat(text)
    return value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value


def brace_range(text: str) -> tuple[dt.datetime, dt.datetime]:
    """The bounds of a time with a range in braces: 2023-01-{01..05}, 2023-01-01T{00..06}:00:00."""
    found = re.search(r"\{(\d+)\.\.(\d+)\}", text)
    if not found:
        raise ValueError(f"no range: {text}")
    return tuple(time_literal(text[: found.start()] + found[i] + text[found.end() :]) for i in (1, 2))


def truncated(at: dt.datetime, unit: str) -> dt.datetime:
    at = at.replace(microsecond=0)
    if unit in ("week", "weeks"):
        return truncated(at - dt.timedelta(days=at.weekday()), "day")
    order = ("year", "month", "day", "hour", "minute", "second")
    defaults = {"month": 1, "day": 1, "hour": 0, "minute": 0, "second": 0}
    keep = order.index(unit.rstrip("s"))
    return at.replace(**{x: defaults[x] for x in order[keep + 1 :]})


def shifted(at: dt.datetime, n: int, unit: str) -> dt.datetime:
    """n units later; a month's last day stays a last day."""
    unit = unit.rstrip("s")
    if unit in ("month", "year", "quarter"):
        months = at.year * 12 + at.month - 1 + n * {"month": 1, "quarter": 3, "year": 12}[unit]
        year, month = divmod(months, 12)
        last = (dt.date(year + (month == 11), (month + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
        return at.replace(year=year, month=month + 1, day=min(at.day, last))
    return at + n * dt.timedelta(**{f"{unit}s": 1})


_SHORT = {"s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week", "mm": "month", "q": "quarter", "y": "year"}


def relative_range(text: str, now: dt.datetime) -> tuple[dt.datetime, dt.datetime | None]:
    """Bounds of now, today, yesterday, this@unit and last@N unit (last@2h, last@15 minutes); None: open."""
    if text == "now":
        return now, None
    if text == "today":
        return truncated(now, "day"), None
    if text == "yesterday":
        day = truncated(now, "day")
        return day - dt.timedelta(days=1), day - dt.timedelta(microseconds=1)
    if m := re.fullmatch(r"this@(\w+)", text):
        return truncated(now, _SHORT.get(m[1], m[1])), None
    if m := re.fullmatch(r"last@(\d+) ?([a-z]+)", text):
        unit = _SHORT.get(m[2], m[2])
        return shifted(truncated(now, unit if unit != "quarter" else "month"), -int(m[1]), unit), None
    raise ValueError(f"not a relative time: {text}")


def in_utc(bound: dt.datetime, zone: str) -> dt.datetime:
    """A bound in local time, as UTC. Absolute bounds (with an offset) are UTC already."""
    import zoneinfo

    return bound.replace(tzinfo=zoneinfo.ZoneInfo(zone)).astimezone(dt.timezone.utc).replace(tzinfo=None)


def where_time(df: DataFrame, low: dt.datetime | None, high: dt.datetime | None, column: str = "timestamp", date_column: str | None = None) -> DataFrame:
    """Events between two times, both included. With date_column, the days are bounded too, so that a
    table partitioned by it is read only in part."""
    for bound, name in ((low, ">="), (high, "<=")):
        if bound is not None:
            time, day = F.col(column), F.lit(bound.date())
            df = df.filter(time >= F.lit(bound) if name == ">=" else time <= F.lit(bound))
            if date_column:
                df = df.filter(F.col(date_column) >= day if name == ">=" else F.col(date_column) <= day)
    return df


def where_timestamp_ago(df: DataFrame, n: int, unit: str, now: dt.datetime, column: str = "timestamp") -> DataFrame:
    """Events of the last n units before `now`."""
    return df.filter(F.col(column) >= F.lit(shifted(now, -n, unit)))


def effective_range(ranges: Iterable[tuple[dt.datetime | None, dt.datetime | None]]) -> tuple[dt.datetime | None, dt.datetime | None]:
    """What several ranges leave together: the latest lower bound and the earliest upper one."""
    ranges = list(ranges)
    lows, highs = [a for a, _ in ranges if a], [b for _, b in ranges if b]
    return max(lows, default=None), min(highs, default=None)


def chart_range(low: dt.datetime | None, high: dt.datetime | None, period: str, now: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """Open ends closed at MAX_PERIODS; a single moment widened by a period to both sides."""
    if low is not None and low == high:
        return shifted(low, -1, period), shifted(high, 1, period)
    high = high or (now if low is None else min(now, shifted(low, MAX_PERIODS, period)))
    return low or shifted(high, -MAX_PERIODS, period), high
