"""Claims of queued runs by priority and capacity."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parse_loops(text: str) -> list[tuple[list[str], int]]:
    """``bulk:2 urgent>*:3`` to [(queues by priority, slots)]."""
    out = []
    for part in text.split():
        m = re.fullmatch(r"([A-Za-z0-9_*]+(?:>[A-Za-z0-9_*]+)*):([1-9]\d*)", part)
        if not m:
            raise ValueError(f"not a work loop: {part}")
        queues = m[1].split(">")
        if any("*" in q and q != "*" for q in queues) or "*" in queues[:-1]:
            raise ValueError(f"the wildcard must stand alone and last: {part}")
        out.append((queues, int(m[2])))
    if not out:
        raise ValueError("no work loop")
    return out


def priorities(spark: SparkSession, queues: list[str]) -> DataFrame:
    return spark.createDataFrame([(q, i) for i, q in enumerate(queues)], "queue string, priority int")


def claim(runs: DataFrame, queues: list[str], capacity: int, active: int = 0) -> DataFrame:
    """The next runs (queue, arrival, run_id) for one loop, by priority, then arrival, then id; strict without ``*``."""
    known = [q for q in queues if q != "*"]
    table = F.create_map(*[F.lit(x) for i, q in enumerate(known) for x in (q, i)]) if known else None
    own = F.element_at(table, F.col("queue")) if known else F.lit(None).cast("int")
    rank = F.coalesce(own, F.lit(len(known))) if "*" in queues else own
    rows = runs.withColumn("priority", rank).where("priority IS NOT NULL")
    return rows.orderBy("priority", "arrival", "run_id").limit(max(0, capacity - active))


def positions(runs: DataFrame, group: str) -> DataFrame:
    """Place of every run in its group's queue, by arrival and id."""
    return runs.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy("arrival", "run_id")))
