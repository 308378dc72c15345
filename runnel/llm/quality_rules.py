"""Quality rules with adaptive thresholds, in DataFrame functions only.

Fixed base rules come first (see :func:`metrics`).  Every other cutoff is taken
from the data: per (lang, source) and per lang, each metric has a mergeable
quantile sketch, namely counts of values rounded down to two significant digits
(relative error under ten per cent).  Counts add up in any order, so the sketch
is merged by partial aggregation, a hot source included, and is the same
however often a task is rerun.  They count the documents
that pass the base rules.  The limit of a metric lies ``factor`` times as far
from the median as the quantile of its ``level``, and ``ROUNDING`` beyond (two
steps of the sketch).  Levels are as far out as the share of junk allows:
quartiles for what junk shifts, the last hundredth for what good documents have
in some share, such as repeated lines.  A group's limit and that of its language
are weighed by their documents, the language counting as ``PRIOR`` of them, so a
small group leans on its language.  The limits are joined back to the documents.

Defined results: a null or empty text has no words and fails the base rules; a
null language or source is a group of its own; repeated rows count each; an
empty table gives an empty result; other columns are not touched; texts are read
whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, saved, text_words

PRIOR, ROUNDING = 200, 20
#: Metric: {side: (level of the quantile in per cent, factor)}. All are integers.
METRICS = {
    "symbol_pm": {"hi": (75, 6)},
    "dup_line_pm": {"hi": (99, 2)},
    "repeat_pm": {"hi": (99, 2)},
    "upper_pm": {"hi": (90, 8)},
    "word_len_pc": {"hi": (75, 8), "lo": (25, 8)},
    "distinct_pm": {"lo": (25, 6)},
}
LIMITS = [(side, k, *v) for k, sides in METRICS.items() for side, v in sides.items()]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _per(x: Column, n: Column, scale: int) -> Column:
    return F.floor(x * scale / F.greatest(n, F.lit(1))).cast("long")


def with_metrics(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``__q``: the base counts and the metrics of column ``text``.

    Each step is a projection of its own, as arrays that a lambda reads again
    and again must be there before it starts.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = rows.withColumn("__w", text_words(t))
    df = df.withColumns({"__n": F.size("__w"), "__h": F.transform("__w", lambda w: F.xxhash64(w))})
    five = F.transform(
        F.slice("__h", 1, F.greatest(F.col("__n") - 4, F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get("__h", i + d) for d in range(1, 5)]),
    )
    df = df.withColumn("__g", five)
    pairs = F.array_sort(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__g")) < F.size("__g"), pairs))
    twice = F.transform(
        "__s",
        lambda s, j: F.when((s["h"] == F.get("__s", j - 1)["h"]) | (s["h"] == F.get("__s", j + 1)["h"]), s["i"]),
    )
    df = df.withColumn("__p", F.array_sort(F.filter(twice, lambda i: i.isNotNull())))
    covered = F.aggregate(
        F.transform("__p", lambda i, j: F.least(F.lit(5), F.coalesce(F.get("__p", j + 1) - i, F.lit(5)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"__l": lines, "__r": F.coalesce(covered, F.lit(0).cast("long"))})
    n, chars = F.col("__n").cast("long"), F.length(F.array_join("__w", "")).cast("long")
    symbols = F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))
    upper = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]", ""))
    df = df.withColumns(
        {
            "__c": chars,
            "__y": symbols.cast("long"),
            "__u": upper.cast("long"),
            "__d": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "__nl": F.size("__l").cast("long"),
            "__k": F.size(F.array_distinct("__h")).cast("long"),
        }
    )
    return df.withColumn(
        "__q",
        F.struct(
            n.alias("n_words"),
            F.col("__c").alias("word_chars"),
            F.col("__y").alias("n_symbols"),
            F.col("__d").alias("n_dup_lines"),
            F.col("__r").alias("n_repeat_words"),
            ((n < 10) | (F.col("__r") * 100 > n * 20)).alias("base_failed"),
            _per(F.col("__y"), n, 1000).alias("symbol_pm"),
            _per(F.col("__d"), F.col("__nl"), 1000).alias("dup_line_pm"),
            _per(F.col("__r"), n, 1000).alias("repeat_pm"),
            _per(F.col("__u"), F.col("__c"), 1000).alias("upper_pm"),
            _per(F.col("__c"), n, 100).alias("word_len_pc"),
            _per(F.col("__k"), n, 1000).alias("distinct_pm"),
        ),
    ).drop("__w", "__n", "__h", "__g", "__s", "__p", "__l", "__r", "__c", "__y", "__u", "__d", "__nl", "__k")


def _group(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("\u0000"))


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang and source (null: a mark of its own), base counts and metrics."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _group("lang").alias("lang"), _group("source").alias("source"), "text")
    return with_metrics(rows).select("doc_id", "lang", "source", "__q.*")


def thresholds(m: DataFrame) -> DataFrame:
    """One row per (lang, source) with a document that passes the base rules: ``lo_<metric>`` and ``hi_<metric>``.

    ``m`` is a saved table: a filter on metrics not yet written would be computed once for each of their uses.
    """
    value = F.col("v")
    unit = F.pow(F.lit(10), F.length(value.cast("string")) - 2).cast("long")
    rounded = F.when(value < 100, value).otherwise(value - value % unit)
    long = m.where("NOT base_failed").select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in METRICS])).alias("x"))
    sketch = long.select("lang", "source", "x.*").groupBy("lang", "source", "k", rounded.alias("v")).agg(F.count("*").alias("c"))
    # The sketch of a language is the sum of its sources' sketches.
    sketch = sketch.withColumn("source", F.explode(F.array("source", F.lit("\u0001")))).groupBy("lang", "source", "k", "v").agg(F.sum("c").alias("c"))
    bars = F.array_sort(F.collect_list(F.struct("v", "c")))
    q = sketch.groupBy("lang", "source", "k").agg(bars.alias("bars"), F.sum("c").alias("n"))  # some hundred bars at most

    def quantile(at: int) -> Column:
        need = F.ceil(F.col("n") * at / 100)
        found = F.aggregate(
            "bars",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v")),
            lambda a, b: F.struct((a["seen"] + b["c"]).alias("seen"), F.coalesce(a["v"], F.when(a["seen"] + b["c"] >= need, b["v"])).alias("v")),
        )
        return found["v"]

    levels = sorted({50} | {level for _, _, level, _ in LIMITS})
    q = q.select("lang", "source", "k", "n", *[quantile(x).alias(f"q{x}") for x in levels])

    def limit(side: str, level: int, factor: int) -> Column:
        beyond = factor * (F.col(f"q{level}") - F.col("q50"))
        return F.col("q50") + beyond + (ROUNDING if side == "hi" else -ROUNDING)

    wide = q.groupBy("lang", "source").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("k") == k, limit(side, level, factor))).alias(f"{side}_{k}") for side, k, level, factor in LIMITS])
    names = [f"{side}_{k}" for side, k, _, _ in LIMITS]
    wide = saved(wide)  # a row a group
    whole = saved(wide.where("source = '\u0001'").select("lang", *[F.col(c).alias(f"l_{c}") for c in names]))
    both = joined(wide.where("source != '\u0001'"), whole, "lang", "inner")
    blend = lambda c: F.floor((F.col("n") * F.col(c) + PRIOR * F.col(f"l_{c}")) / (F.col("n") + PRIOR)).cast("long")
    return both.select("lang", "source", *[blend(c).alias(c) for c in names])


def _within(q) -> Column:
    ok = F.lit(True)
    for side, k, _, _ in LIMITS:
        ok = ok & ((q(k) <= F.col(f"hi_{k}")) if side == "hi" else (q(k) >= F.col(f"lo_{k}")))
    return ok


def judge(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept, then the metrics."""
    m = saved(metrics(docs))  # a few integers a document: computed once, used by both passes
    out = joined(m, saved(thresholds(m)), ["lang", "source"])
    kept = ~F.col("base_failed") & F.coalesce(_within(F.col), F.lit(True))
    return out.select("doc_id", *BASE, kept.alias("kept"), *METRICS)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were.

    The metrics are computed once and saved beside the rows; texts are not shuffled.
    """
    rows = docs.select(F.struct("*").alias("__row"))  # so that no column clashes
    rows = with_metrics(rows, "__row.text").withColumns({"__lang": _group("__row.lang"), "__source": _group("__row.source")})
    rows = saved(rows)
    m = rows.select(F.col("__lang").alias("lang"), F.col("__source").alias("source"), "__q.*")
    t = saved(thresholds(m).withColumnsRenamed({"lang": "__lang", "source": "__source"}))
    q = F.col("__q")
    return joined(rows, t, ["__lang", "__source"]).where(~q["base_failed"] & F.coalesce(_within(lambda k: q[k]), F.lit(True))).select("__row.*")


def oracle_sql() -> str:
    """The same for DuckDB."""
    w = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    lines = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
    per = lambda x, n, s: f"({x} * {s}) // greatest({n}, 1)"
    union = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS k, {k} AS v FROM m WHERE NOT base_failed" for k in METRICS)
    levels = sorted({50} | {level for _, _, level, _ in LIMITS})
    quantiles = ", ".join(f"min(v) FILTER (WHERE s >= ceil(n * {x} / 100)) AS q{x}" for x in levels)
    fences = {side: " ".join(f"WHEN '{k}' THEN q50 + {f} * (q{x} - q50) {'+' if side == 'hi' else '-'} {ROUNDING}" for e, k, x, f in LIMITS if e == side) for side in ("hi", "lo")}
    blend = lambda c: f"CAST(floor((a.n * a.{c} + {PRIOR} * b.{c}) / (a.n + {PRIOR})) AS BIGINT)"
    checks = []
    for side, k, _, _ in LIMITS:
        pick = f"(SELECT {side} FROM lim WHERE lim.lang = m.lang AND lim.source = m.source AND lim.k = '{k}')"
        checks.append(f"{k} {'<=' if side == 'hi' else '>='} {pick}")
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(lang, chr(1)) AS lang, coalesce(source, chr(1)) AS source, coalesce(text, '') AS text, {w} AS w, {lines} AS l,
         row_number() OVER () AS rid FROM documents),
win AS (SELECT rid, i, list_slice(w, i, i + 4) AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM base)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, sum(d) AS r FROM (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS d FROM twice) GROUP BY rid),
cnt AS (
  SELECT base.rid, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
         len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, len(list_distinct(w)) AS n_distinct,
         CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words
  FROM base LEFT JOIN rep ON base.rid = rep.rid),
m AS (
  SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed,
    {per("n_symbols", "n_words", 1000)} AS symbol_pm, {per("n_dup_lines", "n_lines", 1000)} AS dup_line_pm,
    {per("n_repeat_words", "n_words", 1000)} AS repeat_pm, {per("n_upper", "word_chars", 1000)} AS upper_pm,
    {per("word_chars", "n_words", 100)} AS word_len_pc, {per("n_distinct", "n_words", 1000)} AS distinct_pm
  FROM cnt),
long AS ({union}),
sk0 AS (SELECT lang, source, k, CASE WHEN v < 100 THEN v ELSE v - v % CAST(pow(10, length(CAST(v AS VARCHAR)) - 2) AS BIGINT) END AS v FROM long),
sk AS (SELECT lang, source, k, v, count(*) AS c FROM (SELECT * FROM sk0 UNION ALL SELECT lang, chr(2), k, v FROM sk0) GROUP BY ALL),
cum AS (SELECT *, sum(c) OVER (PARTITION BY lang, source, k ORDER BY v) AS s, sum(c) OVER (PARTITION BY lang, source, k) AS n FROM sk),
q AS (SELECT lang, source, k, max(n) AS n, {quantiles} FROM cum GROUP BY ALL),
fence AS (SELECT lang, source, k, n, CASE k {fences["hi"]} END AS hi, CASE k {fences["lo"]} END AS lo FROM q),
lim AS (
  SELECT a.lang, a.source, a.k, {blend("hi")} AS hi, {blend("lo")} AS lo
  FROM fence a JOIN fence b ON a.lang = b.lang AND a.k = b.k AND b.source = chr(2) WHERE a.source <> chr(2))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(checks)} AS kept,
       {", ".join(f"CAST({k} AS BIGINT) AS {k}" for k in METRICS)}
FROM m
"""


__all__ = ["judge", "keep_good", "metrics", "oracle_sql", "thresholds", "with_metrics"]
