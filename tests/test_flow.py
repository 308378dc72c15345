"""Plans of workflows, the text notation, plans from the wire, and what they must reject."""

import pytest
from pyspark.sql import functions as F

from runnel import queries
from runnel.operators import flow
from runnel.plans.workflow import Edge, Step, ValidationError, Workflow, from_wire, parse
from runnel.sources import collections

SF = "/root/testdata/sf0.001"


def test_diamonds_read_their_input_once(spark):
    plan = queries.diamonds(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_only_steps_where_a_state_can_stay_number_their_visits(spark):
    """Before: 13 windows, one for each step of the diamonds that several paths reach."""
    plan = queries.diamonds(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 1
    w = Workflow((Step("a", edges=(Edge("b"), Edge("c"))), Step("b", edges=(Edge("m"),)), Step("c", edges=(Edge("m"),)), Step("m", edges=(Edge("z", "run_id = 1"),)), Step("z")))
    leaves = flow.run(w, flow.no_errors(spark.range(2).withColumnRenamed("id", "run_id")))
    assert sorted((r.run_id, r.leaf_id) for r in leaves.collect()) == [(0, "m"), (0, "m-1"), (1, "z"), (1, "z-1")]


def test_steps_of_any_kind_are_written_before_rows_part(spark):
    w = Workflow((Step("a", edges=(Edge("b", "run_id % 2 = 0"), Edge("c"))), Step("b", edges=(Edge("z"),)), Step("c", edges=(Edge("z"),)), Step("z")))
    states = flow.no_errors(spark.range(10).withColumnRenamed("id", "run_id"))
    leaves = flow.run(w, states, {"b": lambda df: df.withColumn("x", F.lit("b")), "c": lambda df: df.where("run_id < 8")})
    got = sorted((r.run_id, r.leaf_id, r.x) for r in leaves.collect())
    assert got == sorted([(i, "z", "b") for i in range(0, 10, 2)] + [(i, "z-1" if i % 2 == 0 else "z", None) for i in range(8)])


def test_parse_balances_brackets_and_quotes_and_reads_comments():
    w = parse("@name x\na-(condition=coalesce(x,0) > 1, label='p,q')-b # a-c\nb(name=last, adaptor=common)\n# nothing\na-b-d")
    assert [s.id for s in w.steps] == ["a", "b", "d"] and w.name == "x"
    assert w.step("a").edges[0] == Edge("b", "coalesce(x,0) > 1", "'p,q'") and w.step("b").name == "last" and w.step("b").adaptors == ("common",)
    for bad in ("a-(condition=f(x)-b", "a-(x)-b", "a-", "a->b", "a-(condition=true)b", "a(colour=red)"):
        with pytest.raises(ValidationError):
            parse(bad)


def test_from_wire():
    w = from_wire({
        "id": "r1", "triggers": [{"id": "t"}], "jobs": [{"id": "j", "body": "x", "adaptor": "common"}, {"id": "k", "body": "y"}], "starting_node_id": "j",
        "edges": [{"source_trigger_id": "t", "target_job_id": "j"}, {"source_job_id": "j", "target_job_id": "k", "condition": "on_job_failure", "enabled": False}],
    })
    assert w.first == "j" and w.step("t").trigger and w.step("t").edges == (Edge("j", True),)
    assert w.step("j").edges == (Edge("k", "on_job_failure", None, True),) and w.step("j").adaptors == ("common",)
    with pytest.raises(ValidationError):
        from_wire({"jobs": [{"id": "j"}], "edges": [{"source_job_id": "j", "target_job_id": "q"}]})


def test_upsert_keeps_the_last_of_new_items(spark):
    kind = "key string, value string, updated_at long"
    out = collections.set_items(spark.createDataFrame([("a", "0", 0), ("b", "0", 0)], kind), spark.createDataFrame([("a", "1", 1), ("a", "2", 2)], kind))
    assert sorted((r.key, r.value) for r in out.collect()) == [("a", "2"), ("b", "0")]
