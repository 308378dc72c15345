import json

import pytest
from pyspark.sql import functions as F

from runnel.operators import claims, flow
from runnel.plans import workflow as W


def run(spark, w, rows, steps=None, schema="run_id long, x double"):
    leaves = flow.run(w, flow.no_errors(spark.createDataFrame(rows, schema)), steps)
    return sorted((r.run_id, r.leaf_id) for r in leaves.select("run_id", "leaf_id").collect())


def test_diamond_is_no_join(spark):
    w = W.parse("a-b a-c b-z c-z")
    assert run(spark, w, [(1, 0.0), (2, 0.0)]) == [(1, "z"), (1, "z-1"), (2, "z"), (2, "z-1")]


def test_conditions_are_not_exclusive_and_null_is_false(spark):
    w = W.parse("a-(condition=x > 1)-b a-(condition=x > 2)-c")
    assert run(spark, w, [(1, 3.0), (2, 2.0), (3, None)]) == [(1, "b"), (1, "c"), (2, "b"), (3, "a")]


def test_end_stops_the_walk(spark):
    w = W.from_dict({"options": {"end": "c"}, "workflow": {"steps": [{"id": "a", "next": {"b": True, "c": True}}, {"id": "b", "next": "d"}, {"id": "c", "next": "d"}, {"id": "d"}]}})
    assert run(spark, w, [(1, 0.0)]) == [(1, "c")]
    assert run(spark, w.only("b"), [(1, 0.0)]) == [(1, "b")]


def test_disabled_and_bare_edges_never_fire(spark):
    w = W.from_dict({"steps": [{"id": "a", "next": {"b": {"condition": "true", "disabled": True}, "c": {"label": "x"}, "d": False}}, {"id": "b"}, {"id": "c"}, {"id": "d"}]})
    assert run(spark, w, [(1, 0.0)]) == [(1, "a")]


def test_errors_route_and_branches_are_isolated(spark):
    w = W.parse("a-(condition=on_job_failure)-fix a-(condition=on_job_success)-ok")
    steps = {"a": flow.fail_when("a", F.col("x") < 0)}
    assert run(spark, w, [(1, -1.0), (2, 1.0)], steps) == [(1, "fix"), (2, "ok")]
    w = W.parse("a-b a-c")
    leaves = flow.run(w, spark.createDataFrame([(1, 1)], "run_id long, x int"), {"b": lambda d: d.withColumn("x", F.col("x") + 1)})
    assert sorted((r.leaf_id, r.x) for r in leaves.collect()) == [("b", 2), ("c", 1)]


def test_empty_input(spark):
    assert run(spark, W.parse("a-b a-c b-z c-z"), []) == []


def test_validation_reports_all_problems():
    with pytest.raises(W.ValidationError) as e:
        W.validate(W.Workflow((W.Step("a", edges=(W.Edge("x"),)),), start="q"))
    assert len(e.value.problems) == 2
    with pytest.raises(W.ValidationError, match="cycle"):
        W.validate(W.parse("a-b b-a"))
    with pytest.raises(W.ValidationError, match="adaptor"):
        W.from_dict({"steps": [{"id": "a", "adaptor": "x"}]})


def test_edge_order_and_matching():
    assert W.ordered_keys(["b", "10", "2", "a", "01"]) == ["2", "10", "b", "a", "01"]
    w = W.from_dict({"jobs": [{"expression": "1", "name": "Get all", "next": "job-2"}, {"expression": "2"}]})
    assert [s.id for s in w.steps] == ["job-1", "job-2"] and w.upstream("job-2") == "job-1"
    assert W.match_step(w, "Get") == "job-1"
    with pytest.raises(LookupError, match="ambiguous"):
        W.match_step(w, "job")


def test_load(tmp_path):
    (tmp_path / "a.sql").write_text("select 1")
    (tmp_path / "plan.json").write_text(json.dumps({"workflow": {"steps": [{"id": "a", "expression": "a.sql"}]}}))
    assert W.load(str(tmp_path / "plan.json")).steps[0].expression == "select 1"


def test_truthy(spark):
    row = spark.sql("SELECT 0 AS a, '' AS b, double('NaN') AS c, array() AS d, 'x' AS e, cast(null AS int) AS f")
    got = row.select(*[flow.truthy(F.col(c), t).alias(c) for c, t in row.dtypes]).first()
    assert tuple(got) == (False, False, False, True, True, False)


def test_loops(spark):
    assert claims.parse_loops("bulk:2 urgent>*:3") == [(["bulk"], 2), (["urgent", "*"], 3)]
    for bad in ("", "a", "a:0", "*>a:1", "a b:1", "a:x"):
        with pytest.raises(ValueError):
            claims.parse_loops(bad)
    runs = spark.createDataFrame([("a", 1, 1), ("b", 0, 2), ("c", 0, 3)], "queue string, arrival int, run_id int")
    assert [r.run_id for r in claims.claim(runs, ["a", "*"], 2).collect()] == [1, 2]
    assert [r.run_id for r in claims.claim(runs, ["c"], 5, 1).collect()] == [3]
