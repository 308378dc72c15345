"""Why steps and runs ended, from tables of executed steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def step_reason(severity: Column, error_type: Column, state_error: Column) -> Column:
    """(reason, error_type): a thrown error's severity (``crash`` if it has none), else ``fail`` for an error in the state, else success."""
    reason = F.when(error_type.isNotNull(), F.coalesce(severity, F.lit("crash"))).when(state_error.isNotNull(), F.lit("fail")).otherwise("success")
    return F.struct(reason.alias("reason"), F.coalesce(error_type, state_error).alias("error_type"))


def leaves(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Executed steps (run_id, step_id, ...) none of whose next steps was executed."""
    ran = steps.select("run_id", F.col("step_id").alias("dst")).distinct()
    went = steps.select("run_id", F.col("step_id").alias("src")).distinct().join(edges.select("src", "dst"), "src").join(ran, ["run_id", "dst"])
    return steps.join(went.select("run_id", F.col("src").alias("step_id")).distinct(), ["run_id", "step_id"], "left_anti")


def run_reason(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Per run: the first leaf with ``fail`` in order of ``ord`` gives reason and step, else success."""
    failed = F.min(F.when(F.col("reason") == "fail", F.struct("ord", "reason", "step_id")))
    out = leaves(steps, edges).groupBy("run_id").agg(failed.alias("f"))
    return out.select("run_id", F.coalesce(F.col("f.reason"), F.lit("success")).alias("reason"), F.col("f.step_id").alias("failed_step"))


def duplicates(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def versions_by_adaptor(df: DataFrame, name: Column, version: Column) -> DataFrame:
    """Per adaptor its versions as one sorted text."""
    return df.groupBy(name.alias("adaptor")).agg(F.array_join(F.array_sort(F.collect_set(version)), ",").alias("versions"))  # the versions of one adaptor


def distinct_adaptors(df: DataFrame, adaptors: str) -> DataFrame:
    """The different adaptors of all steps, from an array column."""
    return df.select(F.explode(adaptors).alias("adaptor")).distinct()
