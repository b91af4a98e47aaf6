"""Thousands of rules of every operator against each event, without a rule being looked at in vain.

Rules come to different conditions, each tested once for an event, whichever rules have it:

- equal values (and lists of them): found in a sorted array by binary search;
- comparisons and ranges of numbers, those of a rule on one path as one: the bounds of a path cut its numbers
  into slots; a condition covers a stretch of slots, which is a few nodes of a binary tree over them; a
  value's slot lies under one node of each height, and the conditions of these nodes hold;
- contained texts: one pattern, a trie of all of them, looked for at every place;
- others (regular expressions, lists, times, paths through lists): a Column each, as in match_rules().

The conditions that hold are an array of numbers. Each rule is filed under the one of its conditions that
holds least often in a bounded sample of events, and only rules filed under what holds are checked for
the rest; so the sample bears on the work alone. All tables are
literals of the plan, looked up by place; nothing is shuffled. Beyond MAX_RULES the rules go in turns.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, IntegralType, StringType

from ..paths import any_at, col_at, has_path, type_at
from ..rules import FilterRule, RoutingRule
from .filters import predicate, typed
from .nested import let

#: Rules of one pass over the events.
MAX_RULES = 20_000
#: Events that tell how often conditions hold.
SAMPLE_EVENTS = 1000
#: Kinds of conditions, the likeliest to fail first.
EQUAL, CONTAINS, RANGE, OTHER, PRESENT = range(5)
COMPARISONS = (">", ">=", "<", "<=", "range")


def table(values: list, kind: str) -> Column:
    """A constant array. It is written as one text, which the optimiser reads once."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def place(value: Column, bounds: Column, n: int) -> Column:
    """How many of n sorted bounds are less than the value."""
    steps = F.array(*(F.lit(1 << k) for k in range(max(n, 1).bit_length() - 1, -1, -1)))
    further = lambda at, step: F.when((at + step <= n) & (F.get(bounds, at + step - 1) < value), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), further)


def trie_pattern(needles: Iterable[str]) -> str:
    """A pattern that matches, at a place, the longest needle that begins there."""
    root: dict = {}
    for needle in needles:
        node = root
        for sign in needle:
            node = node.setdefault(sign, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [re.escape(sign) + written(node[sign]) for sign in sorted(node) if sign]
        if not ways:
            return ""
        both = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return f"{both}?" if "" in node else both

    return written(root)


class Conditions:
    """The different conditions of some rules over a table, numbered."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.number: dict[tuple, int] = {}
        self.kind: list[int] = []
        self.equal: dict[str, dict] = defaultdict(lambda: defaultdict(list))
        self.ranges: dict[str, list[tuple]] = defaultdict(list)
        self.needles: dict[str, dict[str, int]] = defaultdict(dict)
        self.others: list[tuple[int, Column]] = []

    def _new(self, key: tuple, kind: int) -> int:
        self.number[key] = len(self.kind)
        self.kind.append(kind)
        return len(self.kind) - 1

    def _plain(self, path: str) -> DataType | None:
        """The type of a path that no list or map lies on."""
        schema = self.df.schema
        for step in path.split("."):
            found = next((f.dataType for f in getattr(schema, "fields", ()) if f.name == step), None)
            if found is None:
                return None
            schema = found
        return schema

    def present(self, path: str) -> int:
        key = (path, "present")
        if key in self.number:
            return self.number[key]
        n = self._new(key, PRESENT)
        self.others.append((n, F.coalesce(any_at(self.df, path, lambda c, _: c.isNotNull()), F.lit(False))))
        return n

    def is_range(self, rule: FilterRule) -> bool:
        return rule.op in COMPARISONS and isinstance(self._plain(rule.path), IntegralType | DoubleType | FloatType)

    def add_ranges(self, path: str, rules: list[FilterRule]) -> int:
        """The condition that all of them hold, comparisons of one path."""
        kind = self._plain(path)
        parts = tuple(sorted({(r.op, *((typed(v, kind) for v in r.values) if r.op == "range" else (typed(r.value, kind),) * 2)) for r in rules}))
        key = (path, "ranges", repr(parts))
        if key in self.number:
            return self.number[key]
        n = self._new(key, RANGE)
        self.ranges[path].append((n, parts))
        return n

    def add(self, rule: FilterRule) -> int:
        if self.is_range(rule):
            return self.add_ranges(rule.path, [rule])
        rule = replace(rule, negate=False)
        key = (rule.path, rule.op, repr(rule.value), repr(rule.values))
        if key in self.number:
            return self.number[key]
        kind = self._plain(rule.path)
        number = isinstance(kind, IntegralType | DoubleType | FloatType)
        values = [rule.value] if rule.op == "=" else list(rule.values) if rule.op == "in" else []
        if values and (number or isinstance(kind, StringType) and all(isinstance(v, str) for v in values)):
            n = self._new(key, EQUAL)
            for v in {typed(v, kind) for v in values}:
                self.equal[rule.path][v].append(n)
        elif rule.op == "contains" and isinstance(kind, StringType) and rule.value:
            n = self._new(key, CONTAINS)
            self.needles[rule.path][str(rule.value)] = n
        else:
            n = self._new(key, OTHER)
            self.others.append((n, F.coalesce(predicate(self.df, rule), F.lit(False))))
        return n

    def hold(self, only: set[int] | None = None) -> Column:
        """The numbers of the conditions that hold for an event; of some alone, if they are given."""
        keep = lambda numbers: [n for n in numbers if only is None or n in only]
        found = [self._equal(p, v, keep) for p, v in self.equal.items()] + [self._ranges(p, r, keep) for p, r in self.ranges.items()] + [self._needles(p, x, keep) for p, x in self.needles.items()]
        others = [(n, test) for n, test in self.others if keep([n])]
        if others:
            found.append(F.array_compact(F.array(*(F.when(test, F.lit(n)) for n, test in others))))
        none = F.array().cast("array<int>")
        return F.concat(none, *(F.coalesce(x, none) for x in found))

    def _column(self, path: str) -> tuple[Column, str]:
        kind = type_at(self.df.schema, path)
        name = "string" if isinstance(kind, StringType) else "bigint" if isinstance(kind, IntegralType) else "double"
        return col_at(self.df, path).cast(name), name

    def _equal(self, path: str, by_value: dict, keep: Callable) -> Column:
        column, name = self._column(path)
        values = sorted(by_value, key=(lambda v: v.encode()) if name == "string" else None)
        known, numbers = table(values, name), table([keep(by_value[v]) for v in values], "array<int>")
        found = let(column, lambda v: let(place(v, known, len(values)), lambda at: F.when(F.get(known, at) == v, F.get(numbers, at))))
        return F.when(column.isNotNull(), found)

    def _ranges(self, path: str, conditions: list[tuple], keep: Callable) -> Column:
        column, name = self._column(path)
        bounds = sorted({x for _, parts in conditions for _, low, high in parts for x in (low, high)})
        at = {x: i for i, x in enumerate(bounds)}
        slots = 2 * len(bounds) + 1  # of each bound itself (odd), and of what lies before, between and after them
        size = 1 << (slots - 1).bit_length()
        nodes: dict[int, list[int]] = defaultdict(list)
        for n, parts in conditions:
            first, last = 0, slots - 1
            for op, low, high in parts:
                a, b = 2 * at[low] + 1, 2 * at[high] + 1
                x, y = {">": (a + 1, slots - 1), ">=": (a, slots - 1), "<": (0, a - 1), "<=": (0, a), "range": (a, b)}[op]
                first, last = max(first, x), min(last, y)
            x, y = first + size, last + size + 1
            while x < y:
                if x & 1:
                    nodes[x].append(n)
                    x += 1
                if y & 1:
                    y -= 1
                    nodes[y].append(n)
                x, y = x >> 1, y >> 1
        known, held = table(bounds, name), table([keep(nodes.get(i, [])) for i in range(2 * size)], "array<int>")
        slot = lambda v: let(place(v, known, len(bounds)), lambda i: F.when(F.get(known, i) == v, 2 * i + 1).otherwise(2 * i))
        heights = F.array(*map(F.lit, range(size.bit_length())))
        found = let(let(column, slot), lambda s: F.flatten(F.transform(heights, lambda h: F.get(held, F.call_function("shiftright", s + size, h)))))
        return F.when(column.isNotNull(), found)

    def _needles(self, path: str, needles: dict[str, int], keep: Callable) -> Column:
        column, _ = self._column(path)
        names = sorted(needles, key=lambda x: x.encode())
        whole = [[m for i in range(1, len(x) + 1) if (m := needles.get(x[:i])) is not None] for x in names]  # and those that it begins with
        known, numbers = table(names, "string"), table([keep(x) for x in whole], "array<int>")
        found = F.array_distinct(F.regexp_extract_all(column, F.lit(f"(?=({trie_pattern(names)}))"), F.lit(1)))
        return F.when(column.isNotNull(), F.array_distinct(F.flatten(F.transform(found, lambda x: F.get(numbers, place(x, known, len(names)))))))


def _matched(df: DataFrame, rules: list[RoutingRule], key: str) -> DataFrame:
    conditions, kept = Conditions(df), []
    for r in rules:
        if not r.filters or not all(has_path(df, f.path) for f in r.filters):
            continue
        needed, forbidden, ranges = set(), set(), defaultdict(list)
        for f in r.filters:
            if not f.negate and conditions.is_range(f):
                ranges[f.path].append(f)
            elif f.op == "=" and f.value is None:
                needed.add(conditions.present(f.path) if f.negate else -1)  # a missing value never matches
            elif f.negate:
                needed.add(conditions.present(f.path))
                forbidden.add(conditions.add(f))
            else:
                needed.add(conditions.add(f))
        needed |= {conditions.add_ranges(path, own) for path, own in ranges.items()}
        if -1 not in needed and not needed & forbidden:
            kept.append((r.rule_id, sorted(needed), sorted(forbidden)))
    if not kept:
        return df.select(key, F.array().cast("array<long>").alias("rule_ids")).limit(0)
    uses = Counter(n for _, needed, _ in kept for n in needed)
    often = Counter() if df.isStreaming else Counter(n for r in df.limit(SAMPLE_EVENTS).select(conditions.hold().alias("holds")).collect() for n in r.holds)
    filed: list[list[int]] = [[] for _ in conditions.kind]
    rest = []
    for i, (_, needed, _) in enumerate(kept):
        first, *more = sorted(needed, key=lambda n: (often[n], conditions.kind[n], uses[n], n))
        filed[first].append(i)
        rest.append(more)  # the likeliest to fail first
    checked = {n for more in rest for n in more} | {n for _, _, forbidden in kept for n in forbidden}
    files, ids = table(filed, "array<int>"), table([i for i, _, _ in kept], "bigint")
    need, forbid = table(rest, "array<int>"), table([x for _, _, x in kept], "array<int>")

    def of_event(holds: Column, some: Column) -> Column:
        fits = lambda r: F.forall(F.get(need, r), lambda c: F.array_contains(holds, c)) & ~F.exists(F.get(forbid, r), lambda c: F.array_contains(holds, c))
        return F.transform(F.filter(F.flatten(F.transform(some, lambda c: F.get(files, c))), fits), lambda r: F.get(ids, r))

    # generators of one row: a plain column would be put, as an expression, into every place that reads it
    both = F.struct(conditions.hold(checked).alias("all"), conditions.hold({n for n, x in enumerate(filed) if x}).alias("some"))
    held = df.select(key, F.explode(F.array(both)).alias("holds_"))
    found = held.select(key, F.explode(F.array(F.array_sort(F.array_distinct(of_event(F.col("holds_.all"), F.col("holds_.some")))))).alias("rule_ids"))
    return found.filter(F.size("rule_ids") > 0)


def match_rules_index(df: DataFrame, rules: Iterable[RoutingRule], key: str = "id") -> DataFrame:
    """(key, rule_ids) of the events that match a rule, with the semantics of match_rules(), for thousands of
    rules of any operators."""
    rules = list(rules)
    parts = [_matched(df, rules[i : i + MAX_RULES], key) for i in range(0, max(len(rules), 1), MAX_RULES)]
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("rule_ids")))).alias("rule_ids"))
