"""Conditional dataflow: a batch of states goes through the steps of a workflow.

One row is one state of one run.  Each step is a function from DataFrame to
DataFrame that keeps the row's other columns; each edge is a filter, and edges do
not exclude each other.  A step with several inputs is visited once for each.  All
states are one DataFrame with the step they stand at: a step works on its own
rows, and one ``explode`` of the taken edges sends them on, so the plan grows with
the steps and reads its input once, however often paths part and meet.  Visits of a step are numbered per run in the order of a first-in,
first-out walk, which is the order of (depth, path of edge numbers).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.workflow import Edge, Workflow, validate

Operation = Callable[[DataFrame], DataFrame]
DEPTH, PATH, AT = "__depth", "__path", "__at"


class Update:
    """An operation on columns alone; it runs inside the one pass over all states."""

    def __init__(self, columns: dict[str, Column]) -> None:
        self.columns = columns

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns)


def update(**columns: Column) -> Update:
    return Update(columns)


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder that driver and executors share, and read back."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="runnel-")
    path = f"{root.rstrip('/')}/states-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pipeline(*operations: Operation) -> Operation:
    """Operations one after the other."""
    return lambda df: reduce(lambda d, op: op(d), operations, df)


combine = execute = pipeline


def truthy(c: Column, kind: str) -> Column:
    """False for null, false, 0, NaN and the empty string; true for everything else."""
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind in ("float", "double"):
        return F.coalesce((c != 0) & ~F.isnan(c), F.lit(False))
    if kind == "string":
        return F.coalesce(c != "", F.lit(False))
    if kind in ("int", "bigint", "smallint", "tinyint") or kind.startswith("decimal"):
        return F.coalesce(c != 0, F.lit(False))
    return c.isNotNull()


def _failed(upstream: str) -> Column:
    return F.coalesce(F.map_contains_key("errors", upstream), F.lit(False)) & F.element_at(F.col("errors"), upstream).isNotNull()


def always(edge: Edge) -> bool:
    """Whether the edge takes every state."""
    return not edge.disabled and (edge.condition is True or (isinstance(edge.condition, str) and edge.condition == "always"))


def condition(edge: Edge, upstream: str, df: DataFrame) -> Column:
    """The edge's filter over the rows of ``df``; never null.  A condition that is no boolean counts by its truthiness."""
    c = edge.condition
    if edge.disabled or c is None or c is False or (isinstance(c, str) and not c):
        return F.lit(False)
    if always(edge):
        return F.lit(True)
    if isinstance(c, str):
        if c in ("on_job_success", "on_upstream_success"):
            return ~_failed(upstream)
        if c in ("on_job_failure", "on_upstream_fail"):
            return _failed(upstream)
        c = F.expr(c)
    return truthy(c, df.select(c).schema[0].dataType.simpleString())


def fail_when(step: str, when: Column, name: str = "JobError", message: Column | str = "") -> Update:
    """Writes ``errors[step]`` for the rows that ``when`` holds for; they keep their state and route on."""
    message = F.lit(message) if isinstance(message, str) else message
    error = F.create_map(F.lit(step), F.struct(F.lit(name).alias("name"), message.alias("message"), F.lit("fail").alias("severity")))
    old = F.map_filter("errors", lambda k, v: k != step)
    return update(errors=F.when(F.coalesce(when, F.lit(False)), F.map_concat(old, error)).otherwise(F.col("errors")))


def no_errors(df: DataFrame) -> DataFrame:
    """Adds the empty ``errors`` map that named conditions read."""
    return df.withColumn("errors", F.expr("cast(map() as map<string, struct<name:string,message:string,severity:string>>)"))


def run(workflow: Workflow, states: DataFrame, steps: dict[str, Operation] | None = None, run_id: str = "run_id") -> DataFrame:
    """Leaf states in long form: the columns of the state, ``step`` and ``leaf_id``.

    A state is a leaf when no edge took it, or its step is ``options.end``; the
    walk of its run stops at the first visit of that step.  The first visit of a
    step has its id as leaf id, later ones ``id-1``, ``id-2``, ...
    """
    steps, end, start = steps or {}, workflow.options.get("end"), workflow.first
    df = states.withColumns({DEPTH: F.lit(0), PATH: F.expr("cast(array() as array<int>)"), AT: F.lit(start), "__visit": F.lit(0)})
    paths = {start: 1}
    visit = F.row_number().over(Window.partitionBy(run_id, AT).orderBy(DEPTH, PATH)) - 1
    for id_ in validate(workflow):
        if id_ not in paths:
            continue
        here = F.col(AT) == id_
        edges = workflow.step(id_).edges if id_ != end else ()
        if paths[id_] > 1 and not any(always(e) for e in edges):  # a single path visits once, and where all go on no leaf needs a number: no window, no shuffle
            df = df.withColumn("__visit", F.when(here, visit).otherwise(F.col("__visit")))
        op = steps.get(id_)
        if isinstance(op, Update):
            df = df.withColumns({k: F.when(here, c).otherwise(F.col(k) if k in df.columns else F.lit(None)) for k, c in op.columns.items()})
        elif op is not None:  # of any kind: its rows and the others part, so what stands above is written first
            df = materialised(df)
            df = op(df.where(here)).unionByName(df.where(~here), allowMissingColumns=True)
        taken = []
        for k, e in enumerate(edges):
            taken.append(F.when(here & condition(e, id_, df), F.struct(F.lit(e.target).alias("at"), F.lit(k).alias("edge"))))
            paths[e.target] = paths.get(e.target, 0) + paths[id_]
        if edges:
            stay = F.array(F.struct(F.col(AT).alias("at"), F.lit(-1).alias("edge")))
            df = df.withColumn("__to", F.array_compact(F.array(*taken)))
            df = df.withColumn("__to", F.explode(F.when(F.size("__to") > 0, F.col("__to")).otherwise(stay)))
            went = F.col("__to.edge") >= 0
            df = df.withColumns({
                AT: F.col("__to.at"),
                DEPTH: F.when(went, F.col(DEPTH) + 1).otherwise(F.col(DEPTH)),
                PATH: F.when(went, F.concat(PATH, F.array("__to.edge"))).otherwise(F.col(PATH)),
                "__visit": F.when(went, 0).otherwise(F.col("__visit")),
            }).drop("__to")
    name = F.when(F.col("__visit") == 0, F.col(AT)).otherwise(F.concat(F.col(AT), F.lit("-"), F.col("__visit")))
    out = df.withColumns({"step": F.col(AT), "leaf_id": name})
    if end in paths:
        place = F.struct(DEPTH, PATH)
        stop = F.min(F.when(F.col("step") == end, place)).over(Window.partitionBy(run_id))
        out = out.withColumn("__stop", stop).where(F.col("__stop").isNull() | (place <= F.col("__stop"))).drop("__stop")
    return out.drop("__visit", AT)


def results(leaves: DataFrame, run_id: str = "run_id") -> DataFrame:
    """Per run: the leaf ids in walk order and their number."""
    rows = F.array_sort(F.collect_list(F.struct(DEPTH, PATH, "leaf_id")))  # the leaves of one run
    return leaves.groupBy(run_id).agg(rows.alias("r")).select(run_id, F.transform("r", lambda x: x["leaf_id"]).alias("leaf_ids"), F.size("r").cast("long").alias("n_leaves"))
