"""Document fingerprints from closed syncmers, in DataFrame functions only.

Over the word hashes of a text, every window of ``K`` = 5 words holds four
inner windows of ``S`` = 2 words.  The window is kept when the smallest inner
hash lies at its first or last place (a closed syncmer).  The choice looks at
nothing outside the window, so an edit moves only the windows it touches.  The
fingerprint has all of them in the order of the text: eight hexadecimal digits
of the window's hash, then the words since the anchor before (hexadecimal), then
a point.

Likeness matches anchors by position: an anchor of one text is matched when the
other has one of the same hash in its own or a neighbouring cell of ``CELL``
words.  It is the matched share of the anchors of both texts, counted once a
cell.

Defined results: a text of fewer than five words, or without a chosen window,
has its word hashes as anchors; a text without words has an empty fingerprint,
whose likeness to another empty one is 1 and to any other 0; null ids come
first; rows that repeat an id are ordered by their text; a table of one row is
followed by that row; an empty table gives no rows; long texts keep all anchors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import doc_rows, text_words

K, S, CELL = 5, 2, 64


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array<long>, of each anchor its hash in the upper and its place in the lower half, by place.

    Each step is a projection, as lambdas read the arrays again and again.
    """
    df = df.withColumn("__h", F.transform(text_words(F.col(text)), lambda w: F.xxhash64(w)))
    n = F.size("__h")
    df = df.withColumn("__s", F.transform(F.slice("__h", 1, F.greatest(n - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("__h", i + 1))))

    def anchor(x: Column, i: Column) -> Column:
        return F.shiftleft(x, 32).bitwiseOR(i.cast("long"))

    def window(x: Column, i: Column) -> Column:
        inner = [F.get("__s", i + d) for d in range(K - S + 1)]
        closed = F.least(inner[0], inner[-1]) <= F.least(*inner)
        return F.when(closed, anchor(F.xxhash64(x, *[F.get("__h", i + d) for d in range(1, K)]), i))

    df = df.withColumn("__k", F.filter(F.transform(F.slice("__h", 1, F.greatest(n - K + 1, F.lit(0))), window), lambda x: x.isNotNull()))
    return df.withColumn(out, F.when(F.size("__k") > 0, F.col("__k")).otherwise(F.transform("__h", anchor))).drop("__h", "__s", "__k")


def as_text(name: str) -> Column:
    place = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    gap = lambda x, i: place(x) - F.coalesce(place(F.get(name, i - 1)), F.lit(0))
    parts = F.transform(name, lambda x, i: F.concat(F.lpad(F.hex(F.shiftrightunsigned(x, 32)), 8, "0"), F.hex(gap(x, i)), F.lit(".")))
    return F.array_join(parts, "")


def cells(fp: Column) -> Column:
    """The distinct (hash, cell) of a fingerprint."""
    return F.array_distinct(F.transform(fp, lambda x: x.bitwiseAND(F.lit(-1 << 32)).bitwiseOR(F.shiftright(x.bitwiseAND(F.lit(0xFFFFFFFF)), CELL.bit_length() - 1))))


def around(c: Column) -> Column:
    """Cells and their neighbours; the place before the first cell is in no text, so borrows do no harm."""
    return F.flatten(F.transform(c, lambda x: F.array(x - 1, x, x + 1)))


def likeness(a: str, b: str) -> Column:
    """0 to 1, of columns of cells and their neighbours ``<a>_near``, ``<b>_near``; two empty fingerprints are alike."""
    n = F.size(a) + F.size(b)
    same = F.size(F.array_intersect(a, f"{b}_near")) + F.size(F.array_intersect(b, f"{a}_near"))
    return F.when(n == 0, F.lit(1.0)).otherwise(same.cast("double") / F.greatest(n, F.lit(1)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, fingerprint (array<long>)."""
    rows = with_fingerprint(doc_rows(docs), "text", "fingerprint")
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fingerprint")


def with_next(rows: DataFrame, cols: list[str], derive=lambda df: df) -> DataFrame:
    """Adds ``next_<c>`` for each of ``cols``, which ``derive`` may add once rows are dealt: the value in the row that follows in
    ascending (doc_id, text), after the last that of the first.  Null ids come first.

    The rows are dealt once, by ranges of doc_id taken from its approximate
    quantiles; each range's first row also goes to the range before, so no
    window spans the table and nothing is joined.
    """
    spark = rows.sparkSession
    ids = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("i"))
    parts = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = ids.agg(F.percentile_approx("i", [(p + 1) / parts for p in range(parts - 1)], 50 * parts)).first()[0] if parts > 1 else []
    bounds = sorted(set(bounds or []))
    # Two levels, so that a row compares itself with about 2 * sqrt(parts) bounds.
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]

    def bucket(i: Column) -> Column:
        if not groups:
            return F.lit(0)
        array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
        coarse = F.size(F.filter(array([g[0] for g in groups]), lambda b: b <= i))
        fine = F.size(F.filter(F.get(F.array(*[array(g) for g in groups]), coarse - 1), lambda b: b <= i))
        return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + fine)

    firsts = {r["b"]: r["i"] for r in ids.groupBy(bucket(F.col("i")).alias("b")).agg(F.min("i").alias("i")).collect()}  # one row a range
    full = sorted(firsts)
    before = {b: full[k - 1] for k, b in enumerate(full)}
    n = len(bounds) + 1
    first = F.array(*[F.lit(firsts.get(b)).cast("long") for b in range(n)])
    prev = F.array(*[F.lit(before.get(b)).cast("int") for b in range(n)])
    df = rows.withColumn("__i", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("__b", bucket(F.col("__i")))
    own = F.struct(F.col("__b").alias("b"), F.lit(0).alias("guest"))
    guest = F.struct(F.get(prev, F.col("__b")).alias("b"), F.lit(1).alias("guest"))
    df = df.withColumn("__x", F.explode(F.when(F.col("__i") == F.get(first, F.col("__b")), F.array(own, guest)).otherwise(F.array(own))))
    df = df.withColumns({"__b": F.col("__x.b"), "__guest": F.col("__x.guest")}).drop("__x")
    df = derive(df.repartition("__b"))
    w = Window.partitionBy("__b").orderBy("__guest", "__i", "text")
    df = df.withColumns({f"next_{c}": F.lead(c).over(w) for c in cols})
    return df.where("__guest = 0").drop("__i", "__b", "__guest")


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text whose second half is replaced by
    the head of the next document's text, with their likeness."""
    df = with_next(doc_rows(docs), ["text", "fp"], lambda df: with_fingerprint(df, "text", "fp"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    df = df.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    )
    df = df.select("doc_id", "n_chars", "fp", "next_fp", "edited")
    df = with_fingerprint(df, "edited", "edited_fp")
    df = df.withColumns({f"{c}_cells": cells(F.col(c)) for c in ("fp", "next_fp", "edited_fp")})
    df = df.withColumns({f"{c}_cells_near": around(F.col(f"{c}_cells")) for c in ("fp", "next_fp", "edited_fp")})
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("fp").alias("fingerprint"),
        as_text("edited_fp").alias("edited_fingerprint"),
        likeness("fp_cells", "edited_fp_cells").alias("near_edited"),
        likeness("fp_cells", "next_fp_cells").alias("near_next"),
    )
