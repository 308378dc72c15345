"""Keyed collections: tables (collection, key, value, updated_at) of JSON values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class NotFound(LookupError):
    pass


class Conflict(ValueError):
    pass


def like(pattern: str) -> str:
    """A key pattern with ``*`` as a LIKE pattern."""
    return re.sub(r"([%_\\])", r"\\\1", pattern).replace("*", "%")


def matches(pattern: str, updated_after=None, updated_before=None) -> Column:
    c = F.col("key").like(like(pattern)) if "*" in pattern else F.col("key") == pattern
    if updated_after is not None:
        c = c & (F.col("updated_at") >= F.lit(updated_after))
    if updated_before is not None:
        c = c & (F.col("updated_at") <= F.lit(updated_before))
    return c


def get(items: DataFrame, pattern: str, limit: int | None = None, after: str | None = None, **dates) -> DataFrame:
    """Matching items by key; ``after`` is the last key of the page before.  A key without ``*`` gives one item at most."""
    out = items.where(matches(pattern, **dates))
    if after is not None:
        out = out.where(F.col("key") > after)
    out = out.orderBy("key")
    limit = 1 if "*" not in pattern else limit
    return out if limit is None else out.limit(limit)


def decode(value: Column) -> Column:
    """The value as a variant; what is no JSON stays a string."""
    return F.coalesce(F.try_parse_json(value), value.cast("variant"))


def set_items(items: DataFrame, new: DataFrame, order: str = "updated_at") -> DataFrame:
    """Upsert: of items with one key the new one stays, of several new ones the last by ``order``."""
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(order), F.desc("value")))
    new = new.withColumn("__n", last).where("__n = 1").drop("__n")
    return new.unionByName(items.join(new.select("key"), "key", "left_anti"), allowMissingColumns=True)


def remove(items: DataFrame, pattern: str, **dates) -> DataFrame:
    return items.where(~F.coalesce(matches(pattern, **dates), F.lit(False)))


def check_set(key: str | None, value: str | None, items: str | None) -> None:
    """One key with a value, or a file of items; not both."""
    if items and (key or value):
        raise Conflict("give a key and a value, or items")
    if not items and not key:
        raise NotFound("no key")
