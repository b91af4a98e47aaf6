"""Nested values of any shape as flat entries, and as paths with types: built-in functions over VARIANTs.

Each level is a select that takes the entries whose values are objects apart from those that are
flat, and goes on with the children of the former alone; Spark makes one expression of the selects. LEVELS are followed unless others are asked for, and object_depth() finds by one aggregate how many a
table needs. Objects that lie deeper stay what they are: an entry with JSON text, a node of type map.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of objects that are followed, and those in the objects of lists.
LEVELS, LIST_LEVELS = 8, 8
OBJECT = "map<string,variant>"
ENTRIES = "array<struct<key:string,value:variant>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body's value, with `value` computed once (and not copied, as by a transform of a list of one)."""
    return F.aggregate(F.array(), value, lambda a, _: a, body)


def children(value: Column) -> Column:
    """An object's values by key; null for what is no object."""
    return F.try_variant_get(value, "$", OBJECT)


def object_depth(df: DataFrame, column: str) -> int:
    """The most objects that lie within each other in the column (VARIANT): one aggregate over its texts."""
    bare = F.regexp_replace(F.to_json(F.col(column)), r'"(?:[^"\\]|\\.)*"|[^{}]', "")
    steps = F.aggregate(F.split(bare, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), _nested, lambda s: s["most"])
    return df.agg(F.max(steps)).first()[0] or 0


def _nested(state: Column, sign: Column) -> Column:
    now = state["now"] + F.when(sign == "{", 1).when(sign == "}", -1).otherwise(0)
    return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))


# flat entries


def top_entries(value: Column, exclude: tuple[str, ...] = (), elevate: tuple[str, ...] = ()) -> Column:
    """The entries of an object's keys; empty for what is none. Some keys are excluded, and the children of
    some come in their place, unless the object has the child's key itself."""
    top = F.coalesce(F.map_entries(children(value)), F.array().cast(ENTRIES))
    top = F.filter(top, lambda e: ~e["key"].isin(*exclude)) if exclude else top
    for name in elevate:
        top = _elevated(top, name)
    return top


def _object(value: str) -> str:
    return f"try_variant_get({value}, '$', '{OBJECT}')"


def _let(value: str, name: str, body: str) -> str:
    return f"aggregate(array(), {value}, ({name}, none) -> {name}, {name} -> {body})"


def _below(found: str) -> str:
    """The children of the entries s.deep, found in each entry e, under dotted keys."""
    return f"flatten(transform(s.deep, e -> transform({found}, c -> struct(concat(e.key, '.', c.key) AS key, c.value AS value))))"


def _opened(entries: str) -> str:
    """The entries with their objects' own entries (null for what is no object), each looked into once."""
    return f"transform({entries}, e -> struct(e.key AS key, e.value AS value, map_entries({_object('e.value')}) AS inner))"


def _elevated(top: Column, name: str) -> Column:
    """The entries with those of one entry's object in its place. (A lambda's second parameter would be a place.)"""

    def lifted(entries: Column) -> Column:
        goes = lambda e: (e["key"] == name) & children(e["value"]).isNotNull()
        below = F.flatten(F.transform(F.filter(entries, goes), lambda e: F.map_entries(children(e["value"]))))
        own = lambda kept: let(F.transform(kept, lambda e: e["key"]), lambda keys: F.filter(below, lambda e: ~F.array_contains(keys, e["key"])))
        return let(F.filter(entries, lambda e: ~goes(e)), lambda kept: F.concat(kept, own(kept)))

    return let(top, lifted)


def flat_entries(df: DataFrame, columns: list[str], levels: int = LEVELS, lists: tuple[str, ...] = ()) -> DataFrame:
    """df with arrays of entries (from top_entries) made flat, the less deep first; and with some columns that are lists of
    variants (LIST_LEVELS) as lists of the flat entries of their objects."""
    flat, deep = "filter(n, e -> e.inner IS NULL)", "filter(n, e -> e.inner IS NOT NULL)"
    top = lambda entries: _let(_opened(entries), "n", f"struct({flat} AS flat, {deep} AS deep)")
    below = _let(_opened(_below("e.inner")), "n", f"struct(concat(s.flat, {flat}) AS flat, {deep} AS deep)")
    deeper = f"CASE WHEN s IS NULL OR size(s.deep) = 0 THEN s ELSE {below} END"
    whole = "concat(s.flat, s.deep)"

    def each(one: str, many: str) -> dict[str, Column]:
        return {c: F.expr(x.replace("`", f"`{c}`")) for x, names in ((one, columns), (many, lists)) for c in names}

    if columns or lists:
        df = df.withColumns(each(top("`"), f"transform(filter(`, x -> {_object('x')} IS NOT NULL), x -> {top(f'map_entries({_object("x")})')})"))
        one, many = _let("`", "s", deeper), _let("`", "l", f"CASE WHEN exists(l, s -> size(s.deep) > 0) THEN transform(l, s -> {deeper}) ELSE l END")
        for n in range(1, max(levels, LIST_LEVELS)):
            more = each(one, many)
            df = df.withColumns({c: x for c, x in more.items() if n < (LIST_LEVELS if c in lists else levels)})
        df = df.withColumns(each(_let("`", "s", whole), f"transform(`, s -> {whole})"))
    return df


def entries_map(entries: Column) -> Column:
    """The map of keys and texts (scalars plain, lists and objects as JSON). Nulls are left out; of entries that
    come to one key the first stays."""

    def once(x: Column) -> Column:
        def firsts(keys: Column) -> Column:
            return F.when(F.size(F.array_distinct(keys)) == F.size(keys), x).otherwise(F.filter(x, lambda e, i: F.array_position(keys, e["key"]) == i + 1))

        return let(F.transform(x, lambda e: e["key"]), firsts)

    kept = let(F.filter(entries, lambda e: ~F.is_variant_null(e["value"])), once)
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"].alias("key"), F.try_variant_get(e["value"], "$", "string").alias("value"))))


# paths and types


def _scalar(value: Column) -> Column:
    def named(kind: Column) -> Column:
        whole = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT")
        return F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(whole, "integer").when(F.rlike(kind, F.lit("^(DECIMAL|DOUBLE|FLOAT)")), "float").when(kind == "VOID", None).otherwise("string")

    return let(F.schema_of_variant(value), named)


def _items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _type(value: Column) -> Column:
    """As schemas name it; null for null, empty lists and lists of lists."""

    def of_list(items: Column) -> Column:
        def named(kinds: Column) -> Column:
            numbers = F.array_contains(kinds, "integer") & F.array_contains(kinds, "float") & (F.size(kinds) == 2)
            one = F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).when(numbers, "float").otherwise("variant")
            return F.when(F.get(kinds, F.lit(0)).eqNullSafe("map") & (F.size(kinds) == 1), "map").otherwise(F.concat(F.lit("list<"), one, F.lit(">")))

        kinds = F.array_distinct(F.transform(items, lambda x: F.when(children(x).isNotNull(), "map").otherwise(_scalar(x))))
        return F.when((F.size(items) == 0) | F.exists(items, lambda x: _items(x).isNotNull()), None).otherwise(let(kinds, named))

    there = let(_items(value), lambda items: F.filter(items, lambda x: ~F.is_variant_null(x)))
    return F.when(children(value).isNotNull(), "map").otherwise(let(there, lambda items: F.when(items.isNull(), _scalar(value)).otherwise(of_list(items))))


def node_types(df: DataFrame, column: str, levels: int = LEVELS) -> DataFrame:
    """df with the column (VARIANT) as an array of (path, type) of the nodes of an object, each once: through
    the objects of lists, too."""
    items = "filter(try_variant_get(e.value, '$', 'array<variant>'), x -> " + _object("x") + " IS NOT NULL)"
    holds = f"filter(n, e -> {_object('e.value')} IS NOT NULL OR coalesce(size({items}), 0) > 0)"
    found = f"coalesce(map_entries({_object('e.value')}), flatten(transform({items}, x -> map_entries({_object('x')}))))"
    below = _let(_below(found), "n", f"struct(concat(s.nodes, n) AS nodes, {holds} AS deep)")
    df = df.withColumn("nodes:", top_entries(F.col(f"`{column}`"))).withColumn("nodes:", F.expr(_let("`nodes:`", "n", f"struct(n AS nodes, {holds} AS deep)")))
    for _ in range(1, levels):
        df = df.withColumn("nodes:", F.expr(_let("`nodes:`", "s", f"CASE WHEN size(s.deep) = 0 THEN s ELSE {below} END")))
    df = df.withColumn("nodes:", F.col("`nodes:`.nodes"))
    typed = F.transform(F.col("`nodes:`"), lambda n: F.struct(n["key"].alias("path"), _type(n["value"]).alias("type")))
    return df.withColumn(column, F.array_distinct(F.filter(typed, lambda x: x["type"].isNotNull()))).drop("nodes:")
