from pyspark.sql import functions as F

from runnel.functions import text
from runnel.operators import graph, nested, reasons, state
from runnel.plans.workflow import parse
from runnel.sources import collections, states
from runnel.streaming import events


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_text(spark):
    assert one(spark, text.slugify(F.lit(" My Flow/_x! "))) == "my-flow-_x"
    assert [one(spark, text.duration(F.lit(x))) for x in (999, 2500, 65000)] == ["999ms", "2.5s", "1m 5s"]
    assert one(spark, text.name_of(F.lit("@a/b@1.0"))) == "@a/b" and one(spark, text.version_of(F.lit("@a/b"))) is None
    assert text.regex_from("/ab/i") == "(?i)ab" and text.regex_from("ab") == "ab"
    assert one(spark, text.host_port(F.lit("h:90"))).port == 90 and one(spark, text.host_port(F.lit("h"))) is None
    assert one(spark, text.sanitize(F.lit("[1,2]"))) == "(array with 2 items)"
    assert one(spark, text.sanitize(F.lit('{"b":1,"a":2}'))) == "(object with keys a, b)"
    assert one(spark, text.sanitize(F.lit("{}"))) == "(empty object)" and one(spark, text.sanitize(F.lit("[]"))) == "(empty array)"
    assert one(spark, text.canonical_json(F.lit('{"b":1,"a":2}'))) == '{"a":2,"b":1}'
    assert one(spark, text.expand_adaptor(F.lit("http"), "p/")) == "p/http"
    assert one(spark, text.logged(F.lit("debug"), "info")) is False
    assert one(spark, text.is_uuid(F.lit("123e4567-e89b-12d3-a456-426614174000"))) is True


def test_nested(spark):
    j = F.lit('{"data":{"a":[1,2],"b":"x"}}')
    assert one(spark, nested.source(j, "$.data.a")) == ["1", "2"] and one(spark, nested.source(j, "$.data.b")) == ["x"] and one(spark, nested.source(j, "$.q")) == []
    assert one(spark, nested.data_value(j, "$.b")) == "x" and one(spark, nested.data_value(F.lit("bad"), "$.b")) is None
    assert one(spark, nested.fields(nested.field("a", F.lit(1)), nested.field("a", F.lit(2)))) == {"a": 2}
    assert one(spark, nested.human_proper(F.lit("first_name"))) == "First Name"


def test_state(spark):
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(None).cast("string"))
    assert one(spark, state.omit_null(m)) == {"a": "1"} and one(spark, state.rename_keys(m, {"a": "z"})) == {"z": "1", "b": None}
    assert one(spark, state.merge_maps(F.create_map(F.lit("b"), F.lit("0")), m)) == {"b": None, "a": "1"}
    df = state.redact(spark.createDataFrame([("äö",), ("a",), (None,)], "p string"), "p", 3)
    assert [tuple(r) for r in df.collect()] == [("[REDACTED]", True), ("a", False), (None, False)]


def test_reasons(spark):
    steps = spark.createDataFrame([(1, "a", 1, "fail"), (1, "b", 2, "success"), (2, "a", 1, "fail")], "run_id int, step_id string, ord int, reason string")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert {r.run_id: r.reason for r in reasons.run_reason(steps, edges).collect()} == {1: "success", 2: "fail"}


def test_graph(spark):
    e = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c")], "src string, dst string")
    assert [r.id for r in graph.roots(e).collect()] == ["r"]
    t = spark.createDataFrame([("R", "A"), ("A", "C")], "src string, dst string")
    known = spark.createDataFrame([("r", "R"), ("b", "X")], "src_id string, dst_id string")
    found = graph.map_by_structure(e, t, known)
    assert [tuple(r) for r in found.collect()] == [("a", "A")]
    assert one(spark, graph.can_merge(F.lit("cli:1"), F.array(F.lit("app:1")), F.lit("app:2"))) is True
    assert one(spark, graph.line_delta(F.lit("a\nb"), F.lit("a"))) == "-1 lines"


def test_collections(spark):
    items = spark.createDataFrame([("a1", "1"), ("a%", "x"), ("b", "{}")], "key string, value string")
    assert [r.key for r in collections.get(items, "a*", after="a%").collect()] == ["a1"]
    assert [r.key for r in collections.get(items, "a%").collect()] == ["a%"]
    assert [r.v for r in items.orderBy("key").select(collections.decode(F.col("value")).cast("string").alias("v")).collect()] == ["x", "1", "{}"]


def test_states(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"data":{"x":1}}\nnot json\n')
    assert states.load(spark, str(tmp_path / "s.json")).count() == 1 and states.load(spark).first().data == '{"data":{}}'
    df = spark.createDataFrame([("a", "id1"), ("b", "q")], "run_id string, data string")
    clips = spark.createDataFrame([("id1", "{}")], "id string, body string")
    assert dict(states.resolve(df, clips, "data").select("run_id", "data").collect()) == {"a": "{}", "b": "q"}
    assert states.cached(df, str(tmp_path), "w", "s").count() == 2


def test_batches_and_stream(spark, tmp_path):
    rows = [(1, i, t) for i, t in enumerate("aaabba")]
    df = spark.createDataFrame(rows, "run_id int, seq int, type string")
    assert [r.batch for r in events.batches(df, 2).orderBy("seq").collect()] == [1, 1, 2, 3, 3, 4]
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = events.stream_route(parse("s-(condition=type = 'a')-x"), stream)
    q = out.writeStream.format("memory").queryName("leaves").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.step: r.n for r in spark.sql("SELECT step, count(*) AS n FROM leaves GROUP BY step").collect()} == {"x": 4, "s": 2}
