"""Dotted paths into nested columns, and rebuilding of nested columns from their schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType


def split_path(path: str) -> list[str]:
    """`m.` is short for `metadata.`."""
    parts = path.split(".")
    return ["metadata", *parts[1:]] if parts[0] == "m" and len(parts) > 1 else parts


def type_at(schema: DataType, path: str) -> DataType | None:
    """The type at a path, looking through arrays; None where the schema has no such path."""
    kind: DataType = schema
    for part in split_path(path):
        while isinstance(kind, ArrayType):
            kind = kind.elementType
        if isinstance(kind, StructType) and part in kind.names:
            kind = kind[part].dataType
        elif isinstance(kind, MapType):
            kind = kind.valueType
        else:
            return None
    return kind


def has_path(df: DataFrame, path: str) -> bool:
    return type_at(df.schema, path) is not None


def child(column: Column, kind: DataType, name: str) -> tuple[Column, DataType]:
    """A field of a struct, or the value of a map's key (null without it)."""
    if isinstance(kind, MapType):
        return F.try_element_at(column, F.lit(name)), kind.valueType
    return column.getField(name), kind[name].dataType


def type_of(kind: DataType, name: str) -> DataType:
    return kind.valueType if isinstance(kind, MapType) else kind[name].dataType


def part_of(kind: DataType, name: str) -> Callable[[Column], Column]:
    return lambda x: child(x, kind, name)[0]


def col_at(df: DataFrame, path: str) -> Column:
    """The value at a path. Below an array it is the array of the values."""
    if not has_path(df, path):
        raise ValueError(f"no such field: {path}")
    parts = split_path(path)
    column, kind = F.col(f"`{parts[0]}`"), df.schema[parts[0]].dataType
    for part in parts[1:]:
        if isinstance(kind, ArrayType):
            column, kind = F.transform(column, part_of(kind.elementType, part)), ArrayType(type_of(kind.elementType, part))
        else:
            column, kind = child(column, kind, part)
    return column


def value_or_null(df: DataFrame, path: str, cast: str | None = None) -> Column:
    """The value at a path, null where the schema lacks it."""
    column = col_at(df, path) if has_path(df, path) else F.lit(None)
    return column.cast(cast) if cast else column


def any_at(df: DataFrame, path: str, test: Callable[[Column, DataType], Column]) -> Column:
    """Whether the value at a path passes the test, for any element of the arrays on the way to it."""
    parts = split_path(path)

    def walk(column: Column, kind: DataType, rest: list[str]) -> Column:
        if not rest:
            return test(column, kind)
        if isinstance(kind, ArrayType):
            return F.exists(column, lambda x: walk(x, kind.elementType, rest))
        return walk(*child(column, kind, rest[0]), rest[1:])

    if not has_path(df, path):
        raise ValueError(f"no such field: {path}")
    return walk(F.col(f"`{parts[0]}`"), df.schema[parts[0]].dataType, parts[1:])


def rebuilt(column: Column, kind: DataType, leaf: Callable[[Column, DataType], Column], name: Callable[[str], str] = str, keep: Callable[[str], bool] = lambda _: True) -> Column:
    """A nested column made anew: leaf() of every scalar, name() of every key, without the keys that
    keep() refuses. Map keys are renamed in the data, the others in the schema; of two keys that get the
    same name, a struct keeps the later one, a map the last."""
    if isinstance(kind, StructType):
        fields = {name(f.name): rebuilt(column.getField(f.name), f.dataType, leaf, name, keep).alias(name(f.name)) for f in kind if keep(f.name)}
        return F.when(column.isNotNull(), F.struct(*fields.values())) if fields else F.lit(None).cast("string")
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: rebuilt(x, kind.elementType, leaf, name, keep))
    if isinstance(kind, MapType):
        return F.transform_values(column, lambda k, v: rebuilt(v, kind.valueType, leaf, name, keep))
    return leaf(column, kind)


def rebuild(df: DataFrame, leaf: Callable[[Column, DataType], Column], only: tuple[str, ...] | None = None) -> DataFrame:
    """Applies leaf() to every scalar of the columns (of some, with `only`), at any depth."""
    return df.select(*(rebuilt(F.col(f"`{f.name}`"), f.dataType, leaf).alias(f.name) if only is None or f.name in only else F.col(f"`{f.name}`") for f in df.schema))


def strings(change: Callable[[Column], Column]) -> Callable[[Column, DataType], Column]:
    """A leaf function that changes strings alone."""
    return lambda column, kind: change(column) if isinstance(kind, StringType) else column


def set_at(df: DataFrame, path: str, value: Column) -> DataFrame:
    """df with the value at a path; missing structs on the way are made."""
    parts = split_path(path)

    def put(column: Column | None, kind: DataType | None, rest: list[str]) -> Column:
        if not rest:
            return value
        if isinstance(kind, MapType):
            if len(rest) > 1:
                raise ValueError(f"a map holds no parents: {path}")
            return F.map_concat(F.map_filter(column, lambda k, _: k != rest[0]), F.create_map(F.lit(rest[0]), value.cast(kind.valueType)))
        if not isinstance(kind, StructType):
            return F.struct(put(None, None, rest[1:]).alias(rest[0]))
        fields = [column.getField(f.name).alias(f.name) for f in kind if f.name != rest[0]]
        inner = kind[rest[0]].dataType if rest[0] in kind.names else None
        return F.struct(*fields, put(column.getField(rest[0]) if inner else None, inner, rest[1:]).alias(rest[0]))

    top = parts[0] in df.columns
    return df.withColumn(parts[0], put(F.col(f"`{parts[0]}`") if top else None, df.schema[parts[0]].dataType if top else None, parts[1:]))


def drop_at(df: DataFrame, path: str) -> DataFrame:
    """df without the field at a path; a struct that loses its last field goes too."""
    parts = split_path(path)
    if not has_path(df, path):
        return df
    if len(parts) == 1:
        return df.drop(parts[0])

    def cut(column: Column, kind: DataType, rest: list[str]) -> Column | None:
        if isinstance(kind, ArrayType):
            inner = cut(column, kind.elementType, rest)
            return None if inner is None else F.transform(column, lambda x: cut(x, kind.elementType, rest))
        if isinstance(kind, MapType):
            return F.map_filter(column, lambda k, _: k != rest[0])
        fields = []
        for f in kind:
            part: Column | None = column.getField(f.name)
            if f.name == rest[0]:
                part = cut(part, f.dataType, rest[1:]) if len(rest) > 1 else None
            if part is not None:
                fields.append(part.alias(f.name))
        return F.when(column.isNotNull(), F.struct(*fields)) if fields else None

    left = cut(F.col(f"`{parts[0]}`"), df.schema[parts[0]].dataType, parts[1:])
    return df.drop(parts[0]) if left is None else df.withColumn(parts[0], left)


def leaves(schema: StructType, prefix: str = "") -> list[tuple[str, DataType]]:
    """(dotted path, type) of every field below structs; arrays and maps are leaves."""
    out = []
    for f in schema:
        path = f"{prefix}{f.name}"
        out += leaves(f.dataType, f"{path}.") if isinstance(f.dataType, StructType) else [(path, f.dataType)]
    return out


def flat_map(df: DataFrame, columns: list[str] | None = None, delimiter: str = ".") -> Column:
    """The columns as one map from dotted key to text: nulls left out, arrays as JSON, maps entry by entry."""
    def entry(key: str, text: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda e: F.struct(F.concat(F.lit(key + delimiter), e["key"]).alias("key"), text(e["value"]).alias("value"))

    parts = []
    for path, kind in leaves(StructType([f for f in df.schema if columns is None or f.name in columns])):
        column, key = col_at(df, path), path.replace(".", delimiter)
        if isinstance(kind, MapType):
            text = (lambda v: v) if isinstance(kind.valueType, StringType) else (lambda v: v.cast("string") if not isinstance(kind.valueType, ArrayType | StructType | MapType) else F.to_json(v))
            entries = F.transform(F.map_entries(column), entry(key, text))
            parts.append(F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")))
        else:
            text = F.to_json(column) if isinstance(kind, ArrayType) else column.cast("string")
            parts.append(F.array(F.struct(F.lit(key).alias("key"), text.alias("value"))))
    none = F.array().cast("array<struct<key:string,value:string>>")
    return F.map_from_entries(F.filter(F.concat(*parts) if parts else none, lambda e: e["value"].isNotNull()))
