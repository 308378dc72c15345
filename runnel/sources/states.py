"""Reading and writing states: JSON lines in, JSON lines out, and a cache of step outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def load(spark: SparkSession, path: str | None = None, cache: str | None = None) -> DataFrame:
    """States as (run_id, data JSON): from a file of lines, else a cached step output, else one default state."""
    if path:
        rows = spark.read.text(path).where(F.try_parse_json("value").isNotNull())  # bad lines drop out
        n = F.row_number().over(Window.partitionBy("value").orderBy(F.lit(1)))  # equal states are runs of their own
        return rows.select(F.concat_ws("-", F.sha2("value", 256), F.when(n > 1, n)).alias("run_id"), F.col("value").alias("data"))
    if cache:
        return spark.read.parquet(cache)
    return spark.createDataFrame([("run-1", '{"data":{}}')], "run_id string, data string")


def save(states: DataFrame, path: str, drop: tuple[str, ...] = ("configuration",)) -> None:
    states.drop(*drop).write.mode("overwrite").json(path)


def cached(states: DataFrame, base: str, workflow: str, step: str) -> DataFrame:
    """Writes a step's output under ``base/workflow/step`` and reads it back."""
    path = f"{base}/{workflow}/{step}"
    states.write.mode("overwrite").parquet(path)
    return states.sparkSession.read.schema(states.schema).parquet(path)


def resolve(states: DataFrame, clips: DataFrame, column: str) -> DataFrame:
    """Ids in ``column`` replaced by the bodies of ``clips`` (id, body); others stay."""
    known = clips.select(F.col("id").alias(column), F.col("body").alias("__body"))
    return states.join(known, column, "left").withColumn(column, F.coalesce("__body", column)).drop("__body")
