"""Queries of the workflow engine over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import claims, flow, graph, nested, reasons, state
from .plans.workflow import Edge, Step, Workflow, parse
from .sources import collections
from .streaming import events as run_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    """An exact sum of money: whole cents."""
    return F.sum(F.round(F.col(column) * 100).cast("long"))


def event_states(spark, sf_dir, *columns: str) -> DataFrame:
    return flow.no_errors(table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), *columns))


def order_states(spark, sf_dir) -> DataFrame:
    return flow.no_errors(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), "o_orderstatus", "o_totalprice"))


# Routing ---------------------------------------------------------------------------------------


@query("""SELECT leaf, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_cents FROM (
SELECT 'on_error' AS leaf, value FROM events WHERE event_type = 'error' UNION ALL SELECT 'high', value FROM events WHERE value > 10
UNION ALL SELECT 'start', value FROM events WHERE NOT (coalesce(event_type = 'error', false) OR coalesce(value > 10, false))) GROUP BY leaf""")
def route_events(spark, sf_dir):
    w = Workflow((Step("start", edges=(Edge("on_error", "event_type = 'error'"), Edge("high", "value > 10"), Edge("audit", False)), trigger=True), Step("on_error"), Step("high"), Step("audit")))
    leaves = flow.run(w, event_states(spark, sf_dir, "event_type", "value"))
    return leaves.groupBy(F.col("leaf_id").alias("leaf")).agg(F.count("*").alias("n"), cents("value").alias("total_cents"))


@query("""SELECT leaf, count(*) AS n FROM (SELECT 'all' AS leaf FROM events UNION ALL SELECT 'click' FROM events WHERE event_type = 'click'
UNION ALL SELECT 'big' FROM events WHERE value >= 50) GROUP BY leaf""")
def route_nonexclusive(spark, sf_dir):
    w = Workflow((Step("start", edges=(Edge("all"), Edge("click", F.col("event_type") == "click"), Edge("big", "value >= 50"), Edge("off", True, disabled=True), Edge("bare", None))), *[Step(x) for x in ("all", "click", "big", "off", "bare")]))
    return flow.run(w, event_states(spark, sf_dir, "event_type", "value")).groupBy(F.col("step").alias("leaf")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN o_orderstatus = 'F' THEN 'repair' ELSE 'ship' END AS leaf, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
count(*) FILTER (WHERE o_orderstatus = 'F') AS n_errors FROM orders GROUP BY 1""")
def edge_named_conditions(spark, sf_dir):
    w = parse("check-(condition=on_job_success)-ship check-(condition=on_job_failure)-repair")
    leaves = flow.run(w, order_states(spark, sf_dir), {"check": flow.fail_when("check", F.col("o_orderstatus") == "F", message="finished")})
    return leaves.groupBy(F.col("step").alias("leaf")).agg(F.count("*").alias("n"), cents("o_totalprice").alias("cents"), F.count_if(F.map_contains_key("errors", "check")).alias("n_errors"))


@query("""SELECT leaf_id, count(*) AS n, CAST(sum(mark) AS BIGINT) AS mark FROM (
SELECT CASE WHEN row_number() OVER (PARTITION BY k ORDER BY ord) = 1 THEN 'z' ELSE 'z-' || (row_number() OVER (PARTITION BY k ORDER BY ord) - 1) END AS leaf_id, mark FROM (
SELECT o_orderkey AS k, 0 AS ord, 1 AS mark FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT o_orderkey, 1, 2 FROM orders)) GROUP BY leaf_id""")
def visit_ids(spark, sf_dir):
    w = Workflow((Step("a", edges=(Edge("b", "o_totalprice > 100000"), Edge("c"))), Step("b", edges=(Edge("z"),)), Step("c", edges=(Edge("z"),)), Step("z")))
    leaves = flow.run(w, order_states(spark, sf_dir), {"b": flow.update(mark=F.lit(1)), "c": flow.update(mark=F.lit(2))})
    return leaves.groupBy("leaf_id").agg(F.count("*").alias("n"), F.sum("mark").alias("mark"))


@query("""SELECT n_leaves, count(*) AS n_runs FROM (SELECT (1 + CAST(k % 2 = 0 AS BIGINT)) * (1 + CAST(k % 3 = 0 AS BIGINT)) * (1 + CAST(k % 4 = 0 AS BIGINT)) * (1 + CAST(k % 5 = 0 AS BIGINT))
* (1 + CAST(k % 6 = 0 AS BIGINT)) AS n_leaves FROM (SELECT o_orderkey AS k FROM orders)) GROUP BY 1""")
def diamonds(spark, sf_dir):
    """Five diamonds in a row; the plan reads its input once."""
    sides = [x for i in range(5) for x in (Step(f"d{i}", edges=(Edge(f"l{i}", f"run_id % {i + 2} = 0"), Edge(f"r{i}"))), Step(f"l{i}", edges=(Edge(f"d{i + 1}"),)), Step(f"r{i}", edges=(Edge(f"d{i + 1}"),)))]
    leaves = flow.run(Workflow((*sides, Step("d5"))), order_states(spark, sf_dir))
    return leaves.groupBy("run_id").agg(F.countDistinct("leaf_id").alias("n_leaves")).groupBy("n_leaves").agg(F.count("*").alias("n_runs"))


@query("""SELECT event_type AS step, count(*) AS n FROM (SELECT CASE WHEN props->>'$.k' <> '' THEN 'yes' ELSE 'start' END AS event_type FROM events) GROUP BY 1""")
def string_condition(spark, sf_dir):
    """A condition that gives a string counts by its truthiness."""
    states = event_states(spark, sf_dir, "props").withColumn("k", nested.source_value(F.col("props"), "$.k"))
    return flow.run(parse("start-(condition=coalesce(k, ''))-yes"), states).groupBy("step").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CAST(1700000000123456999 + event_id AS BIGINT) // 1000 || '' AS micros FROM events""")
def nanos_to_micros(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.micros_text(F.lit(1700000000123456999) + F.col("event_id")).alias("micros"))


@query("""SELECT leaf_id, count(*) AS n FROM (SELECT 'c' AS leaf_id FROM orders UNION ALL SELECT 'b' FROM orders WHERE NOT o_totalprice > 250000) GROUP BY leaf_id""")
def end_node_cut(spark, sf_dir):
    w = Workflow((Step("a", edges=(Edge("b"), Edge("c"))), Step("b", edges=(Edge("d", "o_totalprice > 250000"),)), Step("c"), Step("d")), options={"end": "c"})
    return flow.run(w, order_states(spark, sf_dir)).groupBy("leaf_id").agg(F.count("*").alias("n"))


@query("""SELECT event_id AS run_id, coalesce(nullif(concat_ws(',', CASE WHEN event_type = 'error' THEN 'on_error' END, CASE WHEN value > 10 THEN 'high' END), ''), 'start') AS leaf_ids,
greatest(1, CAST(event_type = 'error' AS INT) + CAST(value > 10 AS INT))::BIGINT AS n_leaves FROM events""")
def multi_leaf_result(spark, sf_dir):
    w = parse("start-(condition=event_type = 'error')-on_error start-(condition=value > 10)-high")
    out = flow.results(flow.run(w, event_states(spark, sf_dir, "event_type", "value")))
    return out.select("run_id", F.array_join("leaf_ids", ",").alias("leaf_ids"), "n_leaves")


@query("SELECT n_nationkey AS id, n_regionkey AS depth FROM nation WHERE n_nationkey % 5 = 0")
def trigger_pass_through(spark, sf_dir):
    w = Workflow((Step("hook", edges=(Edge("job", "id % 5 = 0"),), trigger=True), Step("job")), options={"end": "job"})
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("run_id"), F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("depth"))
    return flow.run(w, rows).where("step = 'job'").select("id", "depth")


# State -----------------------------------------------------------------------------------------


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'NONE' END AS segment, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'unset' END AS note,
CASE WHEN c_custkey % 5 = 0 THEN 'step' ELSE 'global' END AS mode FROM customer""")
def assemble_defaults(spark, sf_dir):
    s, k = F.lit, F.col("c_custkey")
    default = F.create_map(s("segment"), s("NONE"), s("note"), s("unset"))
    given = F.map_filter(F.create_map(s("segment"), F.col("c_mktsegment"), s("note"), s(None).cast("string")), lambda n, v: ((n == "segment") & (k % 2 == 0)) | ((n == "note") & (k % 3 == 0)))
    step = F.map_filter(F.create_map(s("mode"), s("step")), lambda n, v: k % 5 == 0)
    data, config = state.assemble(default, given, F.create_map(s("mode"), s("global")), step)
    df = table(spark, sf_dir, "customer").select("c_custkey", data.alias("data"), config.alias("configuration"))
    return df.select("c_custkey", F.col("data")["segment"].alias("segment"), F.col("data")["note"].alias("note"), F.col("configuration")["mode"].alias("mode"))


@query("""SELECT event_id, leaf FROM (SELECT *, count(*) OVER (PARTITION BY event_id) AS n FROM (
SELECT event_id, 'a' AS leaf, CASE WHEN value > 20 THEN '{"v":1}' ELSE '{}' END AS data FROM events UNION ALL
SELECT event_id, 'b', '{"data": {}}' FROM events WHERE event_type <> 'click')) WHERE n = 1 OR data = '{"v":1}'""")
def prune_empty(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.select("event_id", F.lit("a").alias("leaf"), F.when(F.col("value") > 20, '{"v":1}').otherwise("{}").alias("data"))
    b = e.where("event_type <> 'click'").select("event_id", F.lit("b").alias("leaf"), F.lit('{"data": {}}').alias("data"))
    return state.prune(a.union(b), "data", "event_id").select("event_id", "leaf")


@query("""SELECT doc_id, coalesce(octet_length(encode(text)) > 4000, false) AS redacted, CASE WHEN octet_length(encode(text)) > 4000 THEN 10 ELSE length(text) END AS shown FROM documents""")
def payload_redaction(spark, sf_dir):
    df = state.redact(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 4000)
    return df.select("doc_id", "redacted", F.length("text").cast("long").alias("shown"))


# Operations on nested data ---------------------------------------------------------------------


@query("""SELECT conv_id, count(*) AS n, string_agg((turn_no - 1) || ':' || role || ':' || length(text), ' ' ORDER BY turn_no) AS items FROM (
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS turn_no FROM conversations) GROUP BY conv_id""")
def each_collect(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("data"))  # one conversation
    items = nested.each(F.col("data"), lambda x, i: F.concat_ws(":", i.cast("string"), x["role"], F.length(x["text"]).cast("string")))
    return turns.select("conv_id", F.size("data").cast("long").alias("n"), nested.array_to_string(items, " ").alias("items"))


@query("SELECT CAST(props->>'$.k' AS BIGINT) AS k, count(*) AS n, count(props->>'$.missing') AS missing FROM events GROUP BY 1")
def jsonpath_value(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(nested.source_value(F.col("props"), "$.k", "bigint").alias("k"), nested.source_value(F.col("props"), "$.missing").alias("m"))
    return e.groupBy("k").agg(F.count("*").alias("n"), F.count("m").alias("missing"))


@query("SELECT event_id, 1 AS n_source, CAST(props->>'$.k' AS BIGINT) AS first_value FROM events")
def data_value(spark, sf_dir):
    wrapped = F.concat(F.lit('{"data":'), "props", F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", F.size(nested.source(wrapped, "$.data.k")).alias("n_source"), nested.data_value(wrapped, "$.k", "bigint").alias("first_value"))


@query("""SELECT o_orderpriority AS priority, count(*) AS n_lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(*) FILTER (WHERE l_returnflag = 'R') AS returned
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def merge_fields(spark, sf_dir):
    line = F.create_map(F.lit("quantity"), F.col("l_quantity").cast("long").cast("string"), F.lit("flag"), F.col("l_returnflag"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("line")).groupBy("l_orderkey").agg(F.collect_list("line").alias("lines"))  # one order
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    merged = orders.select(F.explode(nested.merge_fields(F.col("lines"), nested.fields(nested.field("priority", F.col("o_orderpriority"))))).alias("x"))
    x = F.col("x")
    return merged.groupBy(x["priority"].alias("priority")).agg(F.count("*").alias("n_lines"), F.sum(x["quantity"].cast("long")).alias("quantity"), F.count_if(x["flag"] == "R").alias("returned"))


@query("SELECT p_partkey, 'brand=' || p_brand AS left_part, 'size=' || p_size || ',type=' || p_type AS right_part FROM part")
def split_keys(spark, sf_dir):
    m = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type"))
    one, two = state.split_keys(m, ["brand"])
    show = lambda x: F.array_join(F.transform(F.array_sort(F.map_entries(x)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return table(spark, sf_dir, "part").select("p_partkey", show(one).alias("left_part"), show(two).alias("right_part"))


@query("""SELECT p_partkey, upper(p_brand[1:1]) || lower(p_brand[2:]) AS proper, CAST(1 AS INT) AS n FROM part""")
def human_proper(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", nested.human_proper(F.col("p_brand")).alias("proper"), F.size(nested.to_array(F.col("p_size"))).alias("n"))


@query("SELECT n_nationkey AS id, n_name AS data, r_name AS last_reference FROM nation JOIN region ON n_regionkey = r_regionkey")
def compose_next_state(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    data, refs = nested.compose_next_state(F.col("r_name"), F.array(F.lit("first")), F.col("n_name"))
    return rows.select(F.col("n_nationkey").alias("id"), data.alias("data"), nested.last_reference(refs).alias("last_reference"))


# Runs ------------------------------------------------------------------------------------------

_STEPS = """steps AS (SELECT user_id AS run_id, event_type AS step_id, min(event_id) AS ord, CASE WHEN max(value) > 150 THEN 'fail' ELSE 'success' END AS reason FROM events GROUP BY 1, 2),
edges(src, dst) AS (VALUES ('view', 'click'), ('click', 'purchase'), ('signup', 'error'))"""


@query(f"""WITH {_STEPS}, leaf AS (SELECT * FROM steps s WHERE NOT EXISTS (SELECT 1 FROM edges e JOIN steps t ON t.step_id = e.dst AND t.run_id = s.run_id WHERE e.src = s.step_id))
SELECT run_id, coalesce(arg_min(reason, ord) FILTER (WHERE reason <> 'success'), 'success') AS reason, arg_min(step_id, ord) FILTER (WHERE reason <> 'success') AS failed_step FROM leaf GROUP BY run_id""")
def run_exit_reason(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("step_id"))
    steps = e.agg(F.min("event_id").alias("ord"), F.max("value").alias("v"))
    why = reasons.step_reason(F.lit(None).cast("string"), F.lit(None).cast("string"), F.when(F.col("v") > 150, "JobError"))
    edges = spark.createDataFrame([("view", "click"), ("click", "purchase"), ("signup", "error")], "src string, dst string")
    return reasons.run_reason(steps.select("run_id", "step_id", "ord", why["reason"].alias("reason")), edges)


@query("""SELECT event_type AS queue, event_id AS run_id FROM (SELECT * FROM events WHERE event_type IN ('purchase', 'signup') OR true ORDER BY
CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, ts, event_id LIMIT 37)""")
def claim_by_priority(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("queue"), F.col("ts").alias("arrival"), F.col("event_id").alias("run_id"))
    queues, slots = claims.parse_loops("purchase>signup>*:40")[0]
    return claims.claim(runs, queues, slots, active=3).select("queue", "run_id")


@query("""SELECT event_id, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS batch FROM (
SELECT *, CASE WHEN (row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) - 1) % 2 = 0 THEN 1 ELSE 0 END AS f FROM (
SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM (
SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS n FROM events)))""")
def batch_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return run_events.batches(e, 2, "user_id", "event_id", "event_type").select("event_id", "batch")


@query("""SELECT event_id, nullif(CASE WHEN event_type = 'purchase' THEN last_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
ELSE last_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END, -1) AS active_step FROM (
SELECT *, CASE event_type WHEN 'signup' THEN event_id WHEN 'purchase' THEN -1 END AS m FROM events)""")
def step_log_attach(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr("CASE WHEN event_type = 'signup' THEN event_id END").alias("step_id"))
    return run_events.attach_steps(e, "user_id", "event_id", ended=F.col("event_type") == "purchase").select("event_id", "active_step")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events")
def queue_positions(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").alias("arrival"), F.col("event_id").alias("run_id"))
    return claims.positions(runs, "user_id").select("user_id", "event_id", "position")


@query("""SELECT problem, count(*) AS n FROM (SELECT CASE WHEN event_type = 'view' THEN 'unknown reason' WHEN event_type = 'click' AND value > 50 THEN 'success with an error'
WHEN event_type NOT IN ('click', 'view') AND value <= 50 THEN 'no error type' END AS problem FROM events) GROUP BY problem""")
def event_contract(spark, sf_dir):
    reason = F.expr("CASE event_type WHEN 'view' THEN 'odd' WHEN 'click' THEN 'success' ELSE 'fail' END")
    e = table(spark, sf_dir, "events").select(reason.alias("reason"), F.expr("CASE WHEN value > 50 THEN 'JobError' END").alias("error_type"), F.lit("m").alias("message"), F.lit("run:log").alias("type"))
    return run_events.problems(e).groupBy("problem").agg(F.count("*").alias("n"))


# Collections -----------------------------------------------------------------------------------


def _items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"), F.col("c_custkey").alias("updated_at"))


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name LIKE '%1%' AND c_custkey >= 50 ORDER BY c_name LIMIT 120")
def collections_get_like(spark, sf_dir):
    return collections.get(_items(spark, sf_dir), "*1*", 120, updated_after=50).select("key", "value")


@query("SELECT c_name AS key, CASE WHEN c_custkey % 7 = 0 THEN 'NEW' ELSE c_mktsegment END AS value FROM customer UNION ALL SELECT 'extra', 'NEW'")
def collections_upsert(spark, sf_dir):
    items = _items(spark, sf_dir)
    new = items.where("updated_at % 7 = 0").withColumn("value", F.lit("NEW")).union(spark.createDataFrame([("extra", "NEW", 0)], "key string, value string, updated_at long"))
    return collections.set_items(items, new).select("key", "value")


@query("SELECT c_name AS key FROM customer WHERE NOT (c_name LIKE '%9' AND c_custkey <= 700)")
def collections_remove(spark, sf_dir):
    return collections.remove(_items(spark, sf_dir), "*9", updated_before=700).select("key")


# Text ------------------------------------------------------------------------------------------


@query(r"""SELECT p_partkey, lower(regexp_replace(trim(regexp_replace(p_name || ' / ' || p_type, '\W', ' ', 'g')), '\s+', '-', 'g')) AS slug, regexp_replace(p_name, '\s+', '-', 'g') AS hyphenated FROM part""")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slugify(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"), text.hyphenate(F.col("p_name")).alias("hyphenated"))


@query("""SELECT p_partkey, '@x/' || p_type AS name, CASE WHEN p_size % 2 = 0 THEN p_size || '.1.0' END AS version, '@x/' || p_type || CASE WHEN p_size % 2 = 0 THEN '_' || p_size || '.1.0' ELSE '' END AS alias,
CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS major FROM part""")
def name_version(spark, sf_dir):
    s = F.concat(F.lit("@x/"), "p_type", F.expr("CASE WHEN p_size % 2 = 0 THEN concat('@', p_size, '.1.0') ELSE '' END"))
    v = text.version_of(s)
    return table(spark, sf_dir, "part").select("p_partkey", text.name_of(s).alias("name"), v.alias("version"), text.aliased_name(s).alias("alias"), F.coalesce(text.version_key(v)["p1"], F.lit(0)).alias("major"))


@query("""WITH e AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) * 17 AS ms FROM events) SELECT event_id, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN regexp_replace(printf('%.3f', ms / 1000.0), '\\.?0+$', '') || 's'
ELSE (ms // 60000) || 'm ' || regexp_replace(printf('%.3f', (ms % 60000) / 1000.0), '\\.?0+$', '') || 's' END AS duration FROM e""".replace("\\\\", "\\"))
def duration_str(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.duration(F.round(F.col("value") * 100).cast("long") * 17).alias("duration"))


@query("""SELECT event_id, '(object with keys k)' AS summary, '[object]' AS obfuscated, NULL::VARCHAR AS removed FROM events""")
def sanitize_summary(spark, sf_dir):
    p = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", text.sanitize(p).alias("summary"), text.sanitize(p, "obfuscate").alias("obfuscated"), text.sanitize(p, "remove").alias("removed"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'purchase', 'signup') GROUP BY 1")
def log_level_filter(spark, sf_dir):
    level = F.expr("CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'success' WHEN 'view' THEN 'info' ELSE 'debug' END")
    return table(spark, sf_dir, "events").where(text.logged(level, "default")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT p_type AS adaptor, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS versions FROM part GROUP BY 1")
def versions_by_adaptor(spark, sf_dir):
    return reasons.versions_by_adaptor(table(spark, sf_dir, "part"), F.col("p_type"), F.col("p_brand"))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    return reasons.duplicates(table(spark, sf_dir, "part"), "p_name")


# Graphs ----------------------------------------------------------------------------------------


@query("""SELECT p_brand, 'app:' || substr(sha256(string_agg(p_name || p_type || p_size, '' ORDER BY p_partkey)), 1, 12) AS version FROM part GROUP BY p_brand""")
def version_hash(spark, sf_dir):
    return graph.version_hash(table(spark, sf_dir, "part"), "p_brand", [F.col("p_name"), F.col("p_type"), F.col("p_size")], F.col("p_partkey"))


_SNAPSHOTS = """a AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS adaptor, c_nationkey AS nation FROM customer WHERE c_custkey % 10 <> 3),
b AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'NEW' ELSE c_mktsegment END AS adaptor, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_nationkey END AS nation FROM customer WHERE c_custkey % 10 <> 7)"""


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("adaptor"), F.col("c_nationkey").alias("nation"))
    changed = c.withColumns({"adaptor": F.expr("CASE WHEN id % 4 = 0 THEN 'NEW' ELSE adaptor END"), "nation": F.expr("CASE WHEN id % 6 = 0 THEN NULL ELSE nation END")})
    return c.where("id % 10 <> 3"), changed.where("id % 10 <> 7")


@query(f"""WITH {_SNAPSHOTS} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change,
CASE WHEN a.id IS NULL OR b.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.name IS DISTINCT FROM b.name THEN 'name' END, CASE WHEN a.adaptor IS DISTINCT FROM b.adaptor THEN 'adaptor' END, CASE WHEN a.nation IS DISTINCT FROM b.nation THEN 'nation' END) END AS columns
FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.name IS DISTINCT FROM b.name OR a.adaptor IS DISTINCT FROM b.adaptor OR a.nation IS DISTINCT FROM b.nation""")
def step_diff(spark, sf_dir):
    return graph.diff(*_snapshots(spark, sf_dir), ["id"], ["name", "adaptor", "nation"])


@query(f"""WITH {_SNAPSHOTS}, x AS (SELECT nation, 'app:' || substr(sha256(string_agg(name || adaptor, '' ORDER BY id)), 1, 12) AS version FROM a WHERE nation IS NOT NULL GROUP BY nation),
y AS (SELECT nation, 'app:' || substr(sha256(string_agg(name || adaptor, '' ORDER BY id)), 1, 12) AS version FROM b WHERE nation IS NOT NULL GROUP BY nation)
SELECT coalesce(x.nation, y.nation) AS nation, CASE WHEN x.nation IS NULL THEN 'added' WHEN y.nation IS NULL THEN 'removed' ELSE 'changed' END AS change FROM x FULL JOIN y ON x.nation = y.nation WHERE x.version IS DISTINCT FROM y.version""")
def project_diff(spark, sf_dir):
    a, b = (graph.version_hash(s.where("nation IS NOT NULL"), "nation", [F.col("name"), F.col("adaptor")], F.col("id")) for s in _snapshots(spark, sf_dir))
    return graph.changed_since(b, a, "nation")


@query(f"""WITH {_SNAPSHOTS} SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN a.adaptor ELSE b.adaptor END AS adaptor, CASE WHEN a.id IS NULL THEN 'src-' || b.id ELSE 'tgt-' || a.id END AS uuid FROM a FULL JOIN b ON a.id = b.id""")
def merge_sandbox(spark, sf_dir):
    a, b = _snapshots(spark, sf_dir)
    with_uuid = lambda d, p: d.select("id", "adaptor", F.concat(F.lit(p), F.col("id").cast("string")).alias("uuid"))
    return graph.merge(with_uuid(b, "src-"), with_uuid(a, "tgt-"), "id")


@query(f"""WITH {_SNAPSHOTS} SELECT b.id, b.adaptor, CASE WHEN a.id IS NULL THEN 'src-' || b.id ELSE 'tgt-' || a.id END AS uuid FROM b LEFT JOIN a ON a.id = b.id""")
def merge_replace(spark, sf_dir):
    a, b = _snapshots(spark, sf_dir)
    with_uuid = lambda d, p: d.select("id", "adaptor", F.concat(F.lit(p), F.col("id").cast("string")).alias("uuid"))
    return graph.merge(with_uuid(b, "src-"), with_uuid(a, "tgt-"), "id", "replace")


@query(f"""WITH {_SNAPSHOTS} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'create' WHEN b.id IS NULL THEN 'delete' ELSE 'update' END AS action FROM b FULL JOIN a ON a.id = b.id""")
def spec_into_state(spark, sf_dir):
    a, b = _snapshots(spark, sf_dir)
    return graph.spec_into_state(b, a.select("id", F.col("id").cast("string").alias("uuid")), "id").select("id", "action")


@query("""SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT c_nationkey FROM customer)""")
def graph_roots(spark, sf_dir):
    return graph.roots(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst")))


@query(f"""WITH {_SNAPSHOTS} SELECT id, name FROM a UNION ALL SELECT id, name FROM b WHERE id NOT IN (SELECT id FROM a)""")
def credentials_union(spark, sf_dir):
    a, b = (s.select("id", "name") for s in _snapshots(spark, sf_dir))
    return graph.union_missing(a, b, "id")


@query(f"""WITH {_SNAPSHOTS} SELECT CASE WHEN a.id IS NULL THEN 'right' WHEN b.id IS NULL THEN 'left' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b ON a.id = b.id GROUP BY 1""")
def split_zip(spark, sf_dir):
    a, b = _snapshots(spark, sf_dir)
    left, right = a.select("id", F.col("id").alias("ord")), b.select("id", F.col("id").alias("ord"))
    return graph.split_zip(left, right, "id").groupBy("side").agg(F.count("*").alias("n"))
