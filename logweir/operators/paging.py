"""Newest events, keyset pages, lookups and the events around one."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..paths import any_at
from ..rules import FilterRule, SelectRule
from .filters import filter_events, shifted, where_time
from .projection import select_fields, select_search_defaults

ORDER = ("timestamp", "id")
DEFAULT_LIMIT, MAX_ROWS = 100, 1000


def latest(df: DataFrame, n: int = DEFAULT_LIMIT) -> DataFrame:
    """The newest n events."""
    return df.orderBy(*(F.desc(c) for c in ORDER)).limit(n)


def page(df: DataFrame, cursor: tuple[dt.datetime, str] | None = None, direction: str = "older", n: int = DEFAULT_LIMIT) -> DataFrame:
    """n events beyond a cursor and one more, which tells that there are others and is the next cursor.
    Older pages include the cursor's own event, newer ones do not. Newest first."""
    if direction not in ("older", "newer"):
        raise ValueError(f"unknown direction: {direction}")
    if cursor:
        at, event = F.lit(cursor[0]), F.lit(cursor[1])
        time, own = F.col("timestamp"), F.col("id")
        df = df.filter((time < at) | (time == at) & (own <= event) if direction == "older" else (time > at) | (time == at) & (own > event))
    if direction == "older":
        return latest(df, n + 1)
    return df.orderBy(*ORDER).limit(n + 1).orderBy(*(F.desc(c) for c in ORDER))


def search(df: DataFrame, rules: Iterable[FilterRule], now: dt.datetime, selects: Iterable[SelectRule] = (), cursor=None, direction: str = "older", n: int = DEFAULT_LIMIT, date_column: str | None = None) -> DataFrame:
    """A page of the events that the rules hold for; without a time rule, of the last two days."""
    rules, selects = list(rules), list(selects)
    if not any(r.path == "timestamp" for r in rules):
        df = where_time(df, shifted(now, -2, "day"), None, date_column=date_column)
    found = page(filter_events(df, rules), cursor, direction, n)
    return select_fields(found, selects) if selects else select_search_defaults(found)


def event_by_id(df: DataFrame, event_id: str, at: dt.datetime | None = None, now: dt.datetime | None = None, days: int = 7) -> DataFrame:
    """The event of an id within an hour of a known time, or of the last days (7 at most). Two rows mean
    that the id is not unique; one_event() raises then."""
    low, high = (shifted(at, -1, "hour"), shifted(at, 1, "hour")) if at else (shifted(now, -min(days, 7), "day"), None)
    return where_time(df, low, high).filter(F.col("id") == event_id).limit(2)


def one_event(df: DataFrame):
    """The only row of event_by_id(), or None."""
    rows = df.take(2)
    if len(rows) > 1:
        raise ValueError("several events have this id")
    return rows[0] if rows else None


def event_by_path(df: DataFrame, path: str, value) -> DataFrame:
    return df.filter(any_at(df, path, lambda column, _: column == F.lit(value)))


def event_context(df: DataFrame, event_id: str, at: dt.datetime, n: int = 50, hours: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """The n events before and after one, with `rank`, the distance to it (0 for itself).

    Two bounded sorts around the known time instead of numbering the table: the rows of a side are
    numbered after its limit.
    """
    target = F.struct(F.lit(at).alias("timestamp"), F.lit(event_id).alias("id"))
    near, own = where_time(df, shifted(at, -hours, "hour"), shifted(at, hours, "hour")), F.struct("timestamp", "id")
    before = near.filter(own <= target).orderBy(*(F.desc(c) for c in ORDER)).limit(n + 1)
    after = near.filter(own > target).orderBy(*ORDER).limit(n)
    down = Window.orderBy(*(F.desc(c) for c in ORDER))  # over n + 1 rows
    return before.withColumn("rank", 1 - F.row_number().over(down)).unionByName(after.withColumn("rank", F.row_number().over(Window.orderBy(*ORDER))))


def recent(df: DataFrame, by: str, n: int = DEFAULT_LIMIT) -> DataFrame:
    """The last n events of each source, oldest first. Spark keeps n rows a source in each task before
    the shuffle (a limit on the rank), so a hot source sends no more."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*(F.desc(c) for c in ORDER)))
    return df.withColumn("rank_", rank).filter(F.col("rank_") <= n).drop("rank_").orderBy(by, *ORDER)


def ordered(df: DataFrame, *keys: tuple[str, str, str]) -> DataFrame:
    """Sorted by (column, asc|desc, first|last): the place of nulls is given."""
    return df.orderBy(*(getattr(F.col(c), f"{way}_nulls_{nulls}")() for c, way, nulls in keys))


def cap_rows(df: DataFrame, most: int | None = MAX_ROWS) -> DataFrame:
    """No more rows than a stored query may return; a smaller limit of its own holds. None: all rows."""
    return df if most is None else df.limit(most)


def ranked(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...] = ORDER, name: str = "rank") -> DataFrame:
    """Rows numbered in time order within each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def framed(column: Column, by: tuple[str, ...], order: tuple[str, ...], before: int, after: int = 0) -> Column:
    """An aggregate over the rows around each row."""
    return column.over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-before, after))
