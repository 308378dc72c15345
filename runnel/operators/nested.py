"""Operations on nested and JSON data: paths, each, merge, fields, references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_value(json: Column, path: str, kind: str = "string") -> Column:
    """The value at a path such as ``$.a[0].b`` of a JSON text; null if there is none."""
    return F.try_variant_get(F.try_parse_json(json), path, kind)


def data_path(path: str) -> str:
    return "$.data" + path[1:] if path.startswith("$") else f"$.data.{path}"


def data_value(json: Column, path: str, kind: str = "string") -> Column:
    return source_value(json, data_path(path), kind)


def source(json: Column, path: str, kind: str = "string") -> Column:
    """Always an array: the items at the path, or the one value, or none."""
    v = F.try_parse_json(json)
    many, one = F.try_variant_get(v, path, f"array<{kind}>"), F.try_variant_get(v, path, kind)
    return F.when(many.isNotNull(), many).when(one.isNotNull(), F.array(one)).otherwise(F.expr(f"cast(array() as array<{kind}>)"))


def each(items: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``op(item, index)`` for every item, in order."""
    return F.transform(F.coalesce(items, F.array()), op)


def last_reference(references: Column) -> Column:
    return F.try_element_at(references, F.lit(-1))


def compose_next_state(data: Column, references: Column, response: Column) -> tuple[Column, Column]:
    """(data, references): the response becomes the data, the old data the last reference."""
    return response, F.concat(references, F.array(data))


def field(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.alias("value"))


def fields(*pairs: Column) -> Column:
    """Pairs to a map; of equal keys the last wins."""
    items = F.array(*pairs)
    last = F.filter(items, lambda p, i: ~F.exists(F.slice(items, i + 2, F.size(items)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def merge_fields(items: Column, extra: Column) -> Column:
    """The map ``extra`` merged into every map of an array; its keys win."""
    return F.transform(items, lambda x: F.map_zip_with(x, extra, lambda k, a, b: F.when(F.map_contains_key(extra, k), b).otherwise(a)))


def join_path(target: Column, value: Column, name: str) -> Column:
    """A struct with ``value`` copied into it under ``name``."""
    return target.withField(name, value)


def to_array(x: Column) -> Column:
    return F.array(x)


def array_to_string(items: Column, separator: str = ",") -> Column:
    return F.array_join(items, separator)


def human_proper(s: Column) -> Column:
    return F.initcap(F.translate(s, "_", " "))
