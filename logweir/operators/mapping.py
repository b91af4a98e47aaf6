"""Mapping of events to fixed tables: one select, with an expression for each field.

Events are a table with a VARIANT column (see as_variant), so that a path may be missing, or hold other
types, from row to row. All paths are read by a cast of the event to a struct or a few, not one by one: a path
alone looks through the event's keys. What is read as text is text in that struct already. Coercions are taken
in steps, each over the whole column or list, so that no step's value is computed twice. Every option is a
Column expression (flat maps: nested.py).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nested import LEVELS, entries_map, flat_entries, top_entries

#: Bounds of the unsigned and small types.
BOUNDS = {"uint8": (0, 2**8 - 1), "uint32": (0, 2**32 - 1), "uint64": (0, 2**64 - 1), "int32": (-(2**31), 2**31 - 1)}
#: The columns' types: uint64 needs more than a long.
COLUMN_TYPES = {"uint8": "smallint", "uint32": "bigint", "uint64": "decimal(20,0)", "int32": "int", "float64": "double", "bool": "boolean", "string": "string", "enum8": "tinyint", "datetime64": "bigint"}


#: Arrays whose elements are looked into; those of the others are read as texts.
VARIANT_ARRAYS = ("array_json", "array_map", "array_flat_map")


@dataclass(frozen=True)
class Condition:
    """A predicate on the value at a path: exists, not_exists, is_zero, not_zero, greater_than, less_than,
    is_empty, not_empty, equals, not_equals, in, is_string, is_number, is_list, is_map."""

    path: str
    predicate: str
    value: Any = None


@dataclass(frozen=True)
class Infer:
    """The label of an enum when any of `any` and all of `all` hold."""

    result: str
    any: tuple[Condition, ...] = ()
    all: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Field:
    """A column of the mapped table. kind: a key of COLUMN_TYPES, json, flat_map, or array_<kind>."""

    name: str
    kind: str
    paths: tuple[str, ...] = ()
    default: Any = None
    from_output: str | None = None
    transform: str | None = None
    allowed: tuple[str, ...] = ()
    value_map: dict[str, Any] = field(default_factory=dict)
    bytes: tuple[str, int] | None = None  # (eq|gt|gte|lt|lte, length)
    chars: str | None = None  # alpha, numeric, alphanumeric
    precision: int = 9
    labels: dict[str, int] = field(default_factory=dict)
    infer: tuple[Infer, ...] = ()
    pick: tuple[tuple[str, tuple[str, ...]], ...] = ()
    exclude: tuple[str, ...] = ()
    elevate: tuple[str, ...] = ()
    filter_nil: bool = False


def as_variant(df: DataFrame, column: str | None = None, out: str = "event") -> DataFrame:
    """df with the event as a VARIANT: of a JSON text column, or of all columns. It is made by a generator
    of one row, as a plain column would be parsed anew for every path that reads it."""
    event = F.try_parse_json(column) if column else F.parse_json(F.to_json(F.struct(*df.columns)))
    return df.withColumn(out, F.explode(F.array(event)))


# paths


_STEP = r"\.[^.\[\]'\"]+|\[\d+\]|\['[^']+'\]|\[\"[^\"]+\"\]"
PATH = re.compile(rf"\$(?:{_STEP}|\[\*\])*")


def parts(path: str) -> list[str]:
    """A path cut at its [*], each part a path of its own; others than $, keys, places and [*] are refused."""
    if not PATH.fullmatch(path):
        raise ValueError(f"not a path: {path}")
    first, *rest = path.split("[*]")
    return [first, *(f"${x}" for x in rest)]


def _keys(path: str) -> tuple[tuple[str, ...], str]:
    """The leading keys of a path, and the rest of it as a path of its own, from its first place or [*] on."""
    first = parts(path)[0]
    steps = re.findall(_STEP, first)
    n = next((i for i, x in enumerate(steps) if re.fullmatch(r"\[\d+\]", x)), len(steps))
    keys = tuple(x[1:] if x.startswith(".") else x[2:-2] for x in steps[:n])
    return keys, "$" + path[1 + sum(map(len, steps[:n])) :]


class Event:
    """The values at the paths of some fields. The keys are read together, by casts of the event to structs of
    variants (`columns`): one of the top, and one more for each value that is read whole and by its keys, too.
    Those of `texts` are read likewise, as strings."""

    def __init__(self, event: Column, paths: Iterable[str], texts: Iterable[str] = ()):
        self.event = event
        self.variants, self.texts = _Structs(event, "variant", "at", paths), _Structs(event, "string", "text", texts)
        self.columns = self.variants.columns | self.texts.columns

    def at(self, path: str) -> tuple[Column, str]:
        """The variant at the path's keys, and the rest of the path."""
        keys, rest = _keys(path)
        return self.variants.at(keys), rest

    def text(self, path: str) -> Column | None:
        """The text at the path, if it is one of those that are read as texts."""
        keys, rest = _keys(path)
        return self.texts.at(keys) if rest == "$" and keys in self.texts.read and keys else None


class _Structs:
    """Casts of an event to structs of one type, for some paths."""

    def __init__(self, event: Column, kind: str, name: str, paths: Iterable[str]):
        self.event, self.kind = event, kind
        self.read = {_keys(p)[0] for p in paths} | {()}
        trees: dict[tuple[str, ...], dict] = {}
        self.alone = {keys for keys in sorted(self.read) if keys and not self._plant(trees.setdefault(self._base(keys), {}), keys[len(self._base(keys)) :])}
        self.names = {base: f"{name}:{i}" for i, base in enumerate(trees)}
        self.columns = {self.names[base]: F.try_variant_get(event, _path(base), _struct(tree, kind)) for base, tree in trees.items() if tree}

    def _base(self, keys: tuple[str, ...]) -> tuple[str, ...]:
        return next(keys[:n] for n in range(len(keys) - 1, -1, -1) if keys[:n] in self.read)

    def _plant(self, tree: dict, keys: tuple[str, ...]) -> bool:
        """Puts the keys into a tree, unless one differs only by its case from another there: Spark takes such
        fields for one."""
        at = tree
        for key in keys:
            if any(k != key and k.lower() == key.lower() for k in at):
                return False
            at = at.get(key, {})
        at = tree
        for key in keys:
            at = at.setdefault(key, {})
        return True

    def at(self, keys: tuple[str, ...]) -> Column:
        if not keys or keys in self.alone:
            return F.try_variant_get(self.event, _path(keys), self.kind) if keys else self.event
        base = self._base(keys)
        value = F.col(f"`{self.names[base]}`")
        for key in keys[len(base) :]:
            value = value.getField(key)
        return value


def _path(keys: tuple[str, ...]) -> str:
    return "$" + "".join(f'["{k}"]' if "'" in k else f"['{k}']" for k in keys)


def _struct(tree: dict, kind: str) -> str:
    return "struct<" + ",".join(f"`{k.replace('`', '``')}`:{_struct(below, kind) if below else kind}" for k, below in tree.items()) + ">"


def _get(event: Event, path: str, kind: str) -> Column:
    """The value at a path as a type; null if it is missing or can't be. A path with [*] gives a list."""
    if "[*]" not in path:
        if kind == "string" and (text := event.text(path)) is not None:
            return text
        value, rest = event.at(path)
        return value if (rest, kind) == ("$", "variant") else F.try_variant_get(value, rest, kind)
    found = _many(event, path)
    return F.to_variant_object(found) if kind == "variant" else F.when(found.isNotNull(), F.lit("")).try_cast(kind)


def _many(event: Event, path: str, kind: str = "variant") -> Column:
    """The values (variants or texts) at a path: its list's, or for each [*] those in each element."""

    def walk(value: Column, rest: list[str], kind: str) -> Column:
        if len(rest) == 1 or rest[1:] == ["$"]:
            return F.try_variant_get(value, rest[0], f"array<{kind}>")
        items = F.try_variant_get(value, rest[0], "array<variant>")
        if len(rest) == 2:
            return F.transform(items, lambda x: F.try_variant_get(x, rest[1], kind))
        found = F.transform(items, lambda x: F.to_variant_object(walk(x, rest[1:], "variant")))
        return found if kind == "variant" else F.transform(found, lambda x: F.try_variant_get(x, "$", kind))

    value, rest = event.at(path)
    return walk(value, parts(rest), kind)


def _text(event: Event, path: str) -> Column:
    """The text at a path, null if it is empty."""
    text = _get(event, path, "string")
    return text if "[*]" in path else F.when(text != "", text)


def _first(event: Event, paths: Iterable[str], kind: str = "variant") -> Column:
    found = [_text(event, p) if kind == "string" else _get(event, p, kind) for p in paths]
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def _zero(kind: str) -> Column:
    return F.lit("").cast("string") if kind == "string" else F.lit(0).cast(COLUMN_TYPES[kind]) if kind != "bool" else F.lit(False)


# coercions


def coerce(text: Column, kind: str) -> Column:
    """A value (as text) as a kind: numbers are truncated and clamped, true counts as 1, what can't be is null."""
    for step in steps(kind):
        text = step(text)
    return text


def steps(kind: str) -> list[Callable[[Column], Column]]:
    """coerce() in steps. Each reads the last one's value more than once, so that it should be a column or a lambda's
    parameter by then."""
    low = lambda text: F.lower(F.trim(text))
    number = lambda low: F.when(low == "true", "1").when(low == "false", "0").otherwise(low)
    if kind == "string":
        return []
    if kind == "bool":
        return [low, lambda x: F.when(x.isin("true", "1", "t", "yes"), True).when(x.isin("false", "0", "f", "no"), False).otherwise(x.try_cast("double") != 0)]
    if kind == "float64":
        return [low, lambda x: number(x).try_cast("double")]
    a, b = BOUNDS[kind]
    exact = lambda x: F.when(F.rlike(x, F.lit(r"^[+-]?\d+$")), x.try_cast("decimal(38,0)")).otherwise(_truncated(x.try_cast("double")))
    clamped = lambda x: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(a).cast("decimal(38,0)")), F.lit(str(b)).cast("decimal(38,0)")).cast(COLUMN_TYPES[kind]))
    return [low, number, exact, clamped]


def _truncated(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).try_cast("decimal(38,0)")


def coerce_time(text: Column, precision: int) -> Column:
    """A time (as text) in units of 10^-precision seconds: of a number the size tells seconds, milli-,
    micro- or nanoseconds; ISO text may have a space; what can't be is 0."""
    return _time(text, _number(text), precision)


def _number(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")), F.coalesce(text.try_cast("decimal(38,0)"), _truncated(text.try_cast("double"))))


def _time(text: Column, number: Column, precision: int) -> Column:
    size = F.abs(number)
    nanos = F.when(size < 100_000_000_000, number * 1_000_000_000).when(size < 100_000_000_000_000, number * 1_000_000).when(size < 100_000_000_000_000_000, number * 1000).otherwise(number)
    said = F.unix_micros(F.try_to_timestamp(F.regexp_replace(text, " ", "T"))).cast("decimal(38,0)") * 1000
    both = F.coalesce(nanos, F.when(number.isNull(), said), F.lit(0).cast("decimal(38,0)"))
    scale = 10 ** (9 - precision)
    return F.floor(both / F.lit(scale)).cast("bigint") if scale > 1 else both.cast("bigint")


# options


def _checked(text: Column, f: Field) -> Column:
    """Null where a string filter refuses the value: its length first, then its characters."""
    test = F.lit(True)
    if f.bytes:
        n, m = F.octet_length(text), F.lit(f.bytes[1])
        test = {"eq": n == m, "gt": n > m, "gte": n >= m, "lt": n < m, "lte": n <= m}[f.bytes[0]]
    if f.chars:
        test = test & F.rlike(text, F.lit({"alpha": "^[A-Za-z]+$", "numeric": "^[0-9]+$", "alphanumeric": "^[A-Za-z0-9]+$"}[f.chars]))
    return F.when(test, text) if f.bytes or f.chars else text


def holds(event: Event, c: Condition) -> Column:
    """A condition, false where it can't be told."""
    value, kind = _get(event, c.path, "variant"), F.schema_of_variant(_get(event, c.path, "variant"))
    text, number = _get(event, c.path, "string"), _get(event, c.path, "double")
    present = value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(True))
    empty = (text == "") | (kind == "OBJECT<>") | (kind == "ARRAY<VOID>") | ~present
    test = {
        "exists": present, "not_exists": ~present, "is_zero": number == 0, "not_zero": number != 0,
        "greater_than": number > F.lit(c.value), "less_than": number < F.lit(c.value), "is_empty": empty, "not_empty": ~empty,
        "equals": text == F.lit(None if c.value is None else str(c.value)), "not_equals": ~F.coalesce(text == F.lit(str(c.value)), F.lit(False)),
        "in": text.isin(*map(str, c.value)) if c.predicate == "in" and c.value else F.lit(False),
        "is_string": kind == "STRING", "is_number": F.rlike(kind, F.lit("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")),
        "is_list": F.startswith(kind, F.lit("ARRAY")), "is_map": F.startswith(kind, F.lit("OBJECT")),
    }[c.predicate]
    return F.coalesce(test, F.lit(False))


def _rule(event: Event, rule: Infer) -> Column:
    out = F.lit(True)
    for c in rule.all:
        out = out & holds(event, c)
    if rule.any:
        some = F.lit(False)
        for c in rule.any:
            some = some | holds(event, c)
        out = out & some
    return out


def _source(event: Event, f: Field) -> Column:
    """What a field is made of, as the event has it: a text, a variant, an array, or the picked values (an enum's label is told
    here). It is one column and no struct, since Catalyst would put what a struct holds in the place of each of its fields."""
    if f.pick:
        return F.array(*(_first(event, ps, "string" if f.kind == "flat_map" else "variant") for _, ps in f.pick))
    if f.kind == "flat_map":
        return top_entries(_first(event, f.paths), f.exclude, f.elevate)
    if f.kind == "json":
        return F.to_json(_first(event, f.paths))
    if f.kind.startswith("array_"):
        return F.coalesce(*(_many(event, p, "variant" if f.kind in VARIANT_ARRAYS else "string") for p in f.paths))
    if f.kind == "enum8":
        return _label(event, _first(event, f.paths, "string"), f)
    return F.coalesce(*(_get(event, p, "string") if "[*]" in p else _checked(_text(event, p), f) for p in f.paths))


def _label(event: Event, source: Column, f: Field) -> Column:
    text = F.lower(source)
    out = F.when(F.lit(False), F.lit(0))
    for label, n in f.labels.items():
        out = out.when(text == label.lower(), F.lit(n))
    for rule in f.infer:
        out = out.when(_rule(event, rule), F.lit(f.labels[rule.result]))
    return out.otherwise(F.lit(f.default or 0)).cast("tinyint")


def _picked(source: Column, f: Field) -> Column:
    """The map of the picked values that are there."""
    pairs = F.arrays_zip(F.array(*(F.lit(k) for k, _ in f.pick)).alias("key"), source.alias("value"))
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def _some(source: Column, f: Field) -> Column:
    """The map of the picked values; null if none of them is there."""
    return F.when(F.exists(source, lambda x: x.isNotNull()), _picked(source, f))


def _array(items: Column, f: Field) -> Column:
    kind = f.kind.removeprefix("array_")
    if kind in ("json", "map", "flat_map"):
        if kind == "json":
            return F.coalesce(F.transform(items, lambda x: F.to_json(x)), F.array().cast("array<string>"))
        return F.transform(items, entries_map)
    texts = F.filter(items, lambda x: x.isNotNull()) if f.filter_nil else items
    if kind == "datetime64":
        pairs = F.transform(texts, lambda x: F.struct(x.alias("text"), _number(x).alias("number")))
        found = F.transform(pairs, lambda x: _time(x["text"], x["number"], f.precision))
    else:
        found = texts
        for step in steps(kind):
            found = F.transform(found, step)
    zero = F.lit(0).cast("bigint") if kind == "datetime64" else _zero(kind)
    return F.coalesce(F.transform(found, lambda x: F.coalesce(x, zero)), F.array().cast(f"array<{COLUMN_TYPES[kind]}>"))


def expression(source: Column, f: Field) -> Column:
    """A field's value, from what _source() gives (flat_entries, for flat maps)."""
    if f.kind == "flat_map":
        return entries_map(source)
    if f.kind.startswith("array_"):
        return _array(source, f)
    if f.kind == "json":
        return F.to_json(_picked(source, f)) if f.pick else F.coalesce(source, F.lit("{}"))
    if f.kind == "enum8":
        return source
    if f.kind == "datetime64":
        return coerce_time(_chosen(source, f), f.precision)
    return _or_default(coerce(_chosen(source, f), f.kind), f)


def _chosen(source: Column, f: Field) -> Column:
    """A scalar field's text after its options."""
    text = {"upcase": F.upper, "downcase": F.lower}.get(f.transform, lambda x: x)(source)
    if f.allowed:
        text = F.when(text.isin(*f.allowed), text)
    if f.value_map:
        text = F.try_element_at(F.create_map(*(x for k, v in f.value_map.items() for x in (F.lit(k.lower()), F.lit(str(v))))), F.lower(text))
    return text


def _or_default(value: Column, f: Field) -> Column:
    return F.coalesce(value, F.lit(f.default).cast(COLUMN_TYPES[f.kind]) if f.default is not None else _zero(f.kind))


def _texts(f: Field) -> list[str]:
    """The paths that a field reads as texts."""
    if f.pick:
        paths = [p for _, ps in f.pick for p in ps] if f.kind == "flat_map" else []
    else:
        paths = [] if f.kind in ("json", "flat_map") or f.kind.startswith("array_") else f.paths
    return [p for p in paths if "[*]" not in p and _keys(p)[1] == "$" and _keys(p)[0]]


def _others(f: Field) -> list[str]:
    """The paths that a field reads otherwise."""
    texts, picked = set(_texts(f)), [p for _, ps in f.pick for p in ps]
    return [*(p for p in picked if p not in texts), *(p for p in f.paths if f.pick or p not in texts)]


def _coerced(df: DataFrame, fields: list[Field]) -> DataFrame:
    """df with the numbers and booleans among the fields' source columns coerced, a select for each step."""
    left = {f"source:{f.name}": [lambda x, f=f: _chosen(x, f), *steps(f.kind)] for f in fields}
    while left:
        df = df.withColumns({c: todo[0](F.col(f"`{c}`")) for c, todo in left.items()})
        left = {c: todo[1:] for c, todo in left.items() if todo[1:]}
    return df


def map_events(df: DataFrame, fields: Iterable[Field], event: str = "event", keep: tuple[str, ...] = (), levels: int = LEVELS) -> DataFrame:
    """The mapped table of events in a VARIANT column; fields that read mapped ones come in a second select.
    Flat maps follow so many levels of objects; what lies deeper is JSON text."""
    fields = list(fields)
    own = [f for f in fields if not f.from_output]
    conditions = [c for f in own for rule in f.infer for c in (*rule.all, *rule.any)]
    read = Event(F.col(event), [*(p for f in own for p in _others(f)), *(c.path for c in conditions)], [p for f in own for p in _texts(f)])
    # first what the event has at the paths, each once; then what the options make of it
    source, picked = (lambda f: F.col(f"`source:{f.name}`")), [f for f in own if f.kind == "flat_map" and f.pick]
    found = df.select(*keep, event, *(c.alias(n) for n, c in read.columns.items()))
    found = found.select(*keep, *(_source(read, f).alias(f"source:{f.name}") for f in own), *(_first(read, f.paths).alias(f"whole:{f.name}") for f in picked))
    found = found.withColumns({f"whole:{f.name}": F.when(~F.exists(source(f), lambda x: x.isNotNull()), top_entries(F.col(f"`whole:{f.name}`"), f.exclude, f.elevate)) for f in picked}) if picked else found
    flat = [f"source:{f.name}" for f in own if f.kind == "flat_map" and not f.pick] + [f"whole:{f.name}" for f in picked]
    found = flat_entries(found, flat, levels, tuple(f"source:{f.name}" for f in own if f.kind in ("array_map", "array_flat_map")))
    numbers = [f for f in own if f.kind in BOUNDS or f.kind in ("float64", "bool")]
    found = _coerced(found, numbers)
    value = lambda f: F.coalesce(_some(source(f), f), entries_map(F.col(f"`whole:{f.name}`"))) if f in picked else _or_default(source(f), f) if f in numbers else expression(source(f), f)
    first = found.select(*keep, *(value(f).alias(f.name) for f in own))
    if len(own) < len(fields):
        told = lambda x, f: _label(Event(F.lit(None), ()), x, f) if f.kind == "enum8" else expression(x, f)
        first = first.select("*", *(told(F.col(f"`{f.from_output}`").cast("string"), f).alias(f.name) for f in fields if f.from_output))
    return first.select(*keep, *(F.col(f"`{f.name}`") for f in fields))
