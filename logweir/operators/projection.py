"""Choosing and reshaping the columns of events."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..paths import child, col_at, has_path, split_path
from ..rules import FilterRule, SelectRule

DEFAULT_FIELDS = ("timestamp", "id", "event_message")
LEVEL_FIELDS = ("metadata.level", "level")


def select_fields(df: DataFrame, selects: Iterable[SelectRule]) -> DataFrame:
    """The chosen fields, each once; a wildcard beats all others."""
    selects = list(dict.fromkeys(selects))
    if any(s.path == "*" for s in selects):
        return df
    named: dict[str, SelectRule] = {}
    for s in selects:
        named.setdefault(s.alias or "_".join(split_path(s.path)), s)
    return df.select(*(col_at(df, s.path).alias(name) for name, s in named.items()))


def select_search_defaults(df: DataFrame, recommended: Iterable[str] = ()) -> DataFrame:
    """What a search shows when nothing is chosen: those of the usual and the recommended fields that exist."""
    wanted = [*DEFAULT_FIELDS, *LEVEL_FIELDS, *recommended]
    return select_fields(df, [SelectRule(p) for p in dict.fromkeys(wanted) if has_path(df, p)])


def select_inferred(df: DataFrame, filters: Iterable[FilterRule]) -> DataFrame:
    """Without a choice: the filtered fields, or the timestamp."""
    paths = list(dict.fromkeys(f.path for f in filters)) or ["timestamp"]
    return select_fields(df, [SelectRule(p) for p in paths])


def unnest(df: DataFrame, path: str, outer: bool = False, alias: str | None = None) -> DataFrame:
    """A row for each element of the arrays along a path, with its value as a column; `outer` keeps rows
    whose array is empty or missing."""
    explode = F.explode_outer if outer else F.explode
    parts, name = split_path(path), alias or "_".join(split_path(path))
    out, column, kind = df.withColumn(name, F.col(f"`{parts[0]}`")), F.col(f"`{name}`"), df.schema[parts[0]].dataType
    for part in [*parts[1:], None]:
        while isinstance(kind, ArrayType):
            out = out.withColumn(name, explode(column))
            kind = kind.elementType
        if part is not None:
            value, kind = child(column, kind, part)
            out = out.withColumn(name, value)
    return out
