"""Connected components of an edge table, in joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b) and of ``known``: label is the smallest node of its component.

    ``known`` has labels (node, label) of the components of earlier edges, which are not read again.  In each round
    every node takes the smallest label among its neighbours and then the label
    of that label (pointer jumping); then the edges are drawn between labels,
    and those inside one label go, until none is left.  Stars are one node after a
    round.  Minima are combined before they are shuffled, and labels are unique
    on their side of each join, so a node with a huge number of neighbours only
    makes a skewed join that Spark splits.
    """
    label, edges = known, edges.select("a", "b")
    nodes = saved(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    label = saved(nodes.withColumn("label", F.col("node")) if known is None else nodes.join(known, "node", "full").select("node", F.coalesce("label", "node").alias("label")))
    left = saved(contracted(edges, label) if known is not None else edges.where("a != b").distinct())
    while left.limit(1).count():
        both = left.union(left.select(F.col("b"), F.col("a")))
        low = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).withColumn("low", F.least("low", "node")))
        up = low.select(F.col("node").alias("low"), F.col("low").alias("up"))
        step = saved(low.join(up, "low", "left").select("node", F.coalesce("up", "low").alias("label")))
        moved = step.select(F.col("node").alias("label"), F.col("label").alias("to"))
        new = saved(label.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        rest = saved(contracted(left, step))
        dropped(label, low, step, left)
        label, left = new, rest
    return label.select("node", "label")


def contracted(edges: DataFrame, label: DataFrame) -> DataFrame:
    """Distinct edges between the labels of the ends of ``edges``; none inside a label."""
    ends = edges.join(label.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(label.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
    return ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
