"""Version hashes, differences and merges of workflow tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def version_hash(rows: DataFrame, group: str, parts: list[Column], order: Column, source: str = "app") -> DataFrame:
    """Per group ``source:`` and twelve digits of the hash of its rows' defined values, in ``order``."""
    text = F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    ordered = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))  # the steps of one workflow
    joined = F.array_join(F.transform(ordered, lambda x: x["t"]), "")
    return rows.groupBy(group).agg(F.concat(F.lit(f"{source}:"), F.substring(F.sha2(joined, 256), 1, 12)).alias("version"))


def diff(a: DataFrame, b: DataFrame, key: list[str], tracked: list[str]) -> DataFrame:
    """Keys with ``change`` added, removed or changed, and the names of changed columns; equal ones drop out."""
    x, y = a.select(*key, F.struct(*tracked).alias("x")), b.select(*key, F.struct(*tracked).alias("y"))
    both = x.join(y, key, "full_outer")
    names = F.array_compact(F.array(*[F.when(~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), F.lit(c)) for c in tracked]))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.size(names) > 0, "changed")
    columns = F.when(change == "changed", F.array_join(names, ",")).otherwise("")
    return both.select(*key, change.alias("change"), columns.alias("columns")).where("change IS NOT NULL")


def line_delta(before: Column, after: Column) -> Column:
    """``+n lines`` or ``-n lines`` between two bodies."""
    lines = lambda c: F.size(F.split(c, "\n"))
    d = lines(after) - lines(before)
    return F.when(d >= 0, F.concat(F.lit("+"), (d + 1).cast("string"), F.lit(" lines"))).otherwise(F.concat(d.cast("string"), F.lit(" lines")))


def split_zip(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer match of two keyed tables (key, ord, ...): the left's order first, then new keys of the right."""
    l, r = left.withColumn("__l", F.lit(True)), right.withColumnRenamed("ord", "__ro").withColumn("__r", F.lit(True))
    out = l.join(r, key, "full_outer")
    side = F.when(F.col("__l").isNull(), "right").when(F.col("__r").isNull(), "left").otherwise("both")
    return out.withColumn("side", side).withColumn("ord", F.coalesce("ord", F.col("__ro") + (1 << 40))).drop("__l", "__r", "__ro")


def spec_into_state(spec: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Per key: new rows of the spec, rows to delete, and rows that keep the state's ``uuid``."""
    both = spec.withColumn("__s", F.lit(True)).join(state.select(key, "uuid"), key, "full_outer")
    action = F.when(F.col("uuid").isNull(), "create").when(F.col("__s").isNull(), "delete").otherwise("update")
    return both.withColumn("action", action).drop("__s")


def union_missing(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """``target`` and the rows of ``source`` whose key it lacks."""
    return target.unionByName(source.join(target.select(key), key, "left_anti"), allowMissingColumns=True)


def merge(source: DataFrame, target: DataFrame, key: str = "id", mode: str = "sandbox") -> DataFrame:
    """The source's content under the target's uuids.  ``sandbox`` keeps targets that the source lacks, ``replace`` drops them."""
    ids = target.select(key, F.col("uuid").alias("__uuid"))
    out = source.join(ids, key, "left").withColumn("uuid", F.coalesce("__uuid", "uuid")).drop("__uuid")
    if mode == "replace":
        return out
    return out.unionByName(target.join(source.select(key), key, "left_anti"), allowMissingColumns=True)


def map_by_structure(source_edges: DataFrame, target_edges: DataFrame, known: DataFrame) -> DataFrame:
    """Matches of unmapped steps by shared parents: per source step the target step whose parents' matches agree most.

    ``known`` (src_id, dst_id) has the matches so far; call again with the result
    to go one level deeper.
    """
    s = source_edges.join(known.withColumnsRenamed({"src_id": "src", "dst_id": "p"}), "src").select(F.col("dst").alias("src_id"), "p")
    t = target_edges.select(F.col("src").alias("p"), F.col("dst").alias("dst_id"))
    votes = s.join(t, "p").groupBy("src_id", "dst_id").agg(F.count("*").alias("n"))
    votes = votes.join(known.select("src_id"), "src_id", "left_anti").join(known.select("dst_id"), "dst_id", "left_anti")
    best = votes.groupBy("src_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "dst_id")).alias("b")).select("src_id", "b.*")
    return best.groupBy("dst_id").agg(F.min(F.struct("n", "src_id")).alias("b")).select(F.col("b.src_id").alias("src_id"), "dst_id")


def roots(edges: DataFrame) -> DataFrame:
    """Steps that lead somewhere and to which nothing leads."""
    return edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def terminals(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps without an edge out, where a new step can be appended."""
    return steps.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def can_merge(target_head: Column, source_history: Column, source_version: Column) -> Column:
    """True if the target's head is in the source's past; the part before the colon does not count."""
    tail = lambda v: F.try_element_at(F.split(v, ":"), F.lit(-1))
    return F.array_contains(F.transform(F.concat(source_history, F.array(source_version)), tail), tail(target_head))


def changed_since(current: DataFrame, base: DataFrame, key: str = "id") -> DataFrame:
    """(key, change) of workflows whose version differs from the one they forked from."""
    return diff(base, current, [key], ["version"]).select(key, "change")
