"""Ordered run events: batches, log lines and their steps, in batch and in Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window

from ..operators.flow import Operation, condition
from ..plans.workflow import Workflow

# Names of events on the wire.
WIRE_NAMES = {"workflow-start": "run:start", "workflow-complete": "run:complete", "job-start": "step:start", "job-complete": "step:complete", "workflow-log": "run:log"}


def batches(events: DataFrame, limit: int, run_id: str = "run_id", order: str = "seq", kind: str = "type", gap: tuple[str, float] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Adds ``batch``: neighbours of one type, at most ``limit`` of them, of one run; events of types not in ``kinds`` stand alone.

    ``gap`` (column of seconds, seconds) also closes a batch when that much time has gone by since the event before.
    """
    w = Window.partitionBy(run_id).orderBy(order)
    new = ~F.col(kind).eqNullSafe(F.lag(kind).over(w)) | F.lag(order).over(w).isNull()
    if kinds is not None:
        new = new | ~F.coalesce(F.col(kind).isin(kinds), F.lit(False))
    if gap:
        new = new | (F.col(gap[0]) - F.lag(gap[0]).over(w) > gap[1])
    df = events.withColumn("__new", new.cast("int")).withColumn("__island", F.sum("__new").over(w))
    inside = Window.partitionBy(run_id, "__island").orderBy(order)
    df = df.withColumn("__full", ((F.row_number().over(inside) - 1) % limit == 0).cast("int"))
    return df.withColumn("batch", F.sum("__full").over(w)).drop("__new", "__island", "__full")


def attach_steps(events: DataFrame, run_id: str = "run_id", order: str = "seq", step: str = "step_id", ended: Column | None = None) -> DataFrame:
    """Every event with the step that is active in its run: the last that started, until an event with ``ended``, which still belongs to it."""
    w = Window.partitionBy(run_id).orderBy(order)
    ended = F.lit(False) if ended is None else F.coalesce(ended, F.lit(False))
    mark = F.when(ended, F.struct(F.lit(None).cast(events.schema[step].dataType).alias("s"))).when(F.col(step).isNotNull(), F.struct(F.col(step).alias("s")))
    df = events.withColumns({"__mark": mark, "__ended": ended})
    upto = lambda k: F.last("__mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, k))
    return df.withColumn("active_step", F.when(F.col("__ended"), upto(-1)["s"]).otherwise(upto(0)["s"])).drop("__mark", "__ended")


def wire_name(column: str):
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in WIRE_NAMES.items() for x in kv]), F.col(column)), F.col(column))


def problems(events: DataFrame) -> DataFrame:
    """Adds ``problem``: why an event (reason, error_type, message, type) breaks the contract; null if it does not."""
    reason = F.when(~F.col("reason").isin("success", "fail", "crash", "kill", "cancel", "exception"), "unknown reason")
    consistent = F.when((F.col("reason") == "success") & F.col("error_type").isNotNull(), "success with an error").when(
        (F.col("reason") != "success") & F.col("error_type").isNull(), "no error type"
    )
    log = F.when((F.col("type") == "run:log") & F.col("message").isNull(), "log without a message")
    return events.withColumn("problem", F.coalesce(reason, consistent, log))


def stream_route(workflow: Workflow, states: DataFrame, steps: dict[str, Operation] | None = None) -> DataFrame:
    """A workflow in which every step has one input, over a stream: all leaves with their ``step``."""
    steps, ins, out = steps or {}, {workflow.first: states}, []
    from ..plans.workflow import validate

    for id_ in validate(workflow):
        if id_ not in ins:
            continue
        df, rest = steps.get(id_, lambda d: d)(ins[id_]), F.lit(True)
        for e in workflow.step(id_).edges:
            if e.target in ins:
                raise ValueError("several inputs need run() in a micro-batch")
            c = condition(e, id_, df)
            ins[e.target], rest = df.where(c), rest & ~c
        out.append(df.where(rest).withColumn("step", F.lit(id_)))
    whole = out[0]
    for d in out[1:]:
        whole = whole.unionByName(d, allowMissingColumns=True)
    return whole


def in_order(stream: DataFrame, handle: Callable[[DataFrame, int], None], run_id: str = "run_id", order: str = "seq") -> DataStreamWriter:
    """One micro-batch after the other; the events of a run are in one partition, in order."""
    return stream.writeStream.foreachBatch(lambda df, n: handle(df.repartition(run_id).sortWithinPartitions(run_id, order), n))
