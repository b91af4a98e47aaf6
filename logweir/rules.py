"""Rule records: what a query asks for, in parsed form."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

OPERATORS = ("=", ">", ">=", "<", "<=", "range", "~", "contains", "list_includes", "list_includes_regexp", "in")


@dataclass(frozen=True)
class FilterRule:
    """A predicate on the value at a path. `range` and `in` take `values`; value None with "=" is null."""

    path: str
    op: str = "="
    value: Any = None
    values: tuple = ()
    negate: bool = False

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator: {self.op}")


@dataclass(frozen=True)
class SelectRule:
    """A field to show; "*" is all. Without an alias a.b.c is shown as a_b_c."""

    path: str
    alias: str | None = None


@dataclass(frozen=True)
class ChartRule:
    """An aggregate over time buckets."""

    aggregate: str = "count"
    path: str = "timestamp"
    period: str = "minute"


@dataclass(frozen=True)
class RoutingRule:
    """Events that all filters match go to the target."""

    rule_id: int
    filters: tuple[FilterRule, ...]
    target: str = ""


@dataclass(frozen=True)
class PrepareConfig:
    """How a source prepares its events. Specs are lists as in copy_fields, drop_fields and enrich_from_key_values."""

    copy: tuple[tuple[str, str], ...] = ()
    enrich: tuple[tuple[str, str, str | None], ...] = ()
    drop: tuple[str, ...] = ()
    drop_filters: tuple[FilterRule, ...] = ()
    message_keys: tuple[str, ...] = ()
    casts: dict[str, str] = field(default_factory=dict)
    floats: bool = False
