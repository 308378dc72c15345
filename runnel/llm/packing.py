"""Packing into optimal length buckets.

The token lengths of all documents form one exact histogram, with a bar for each
different length (there can be no more of them than the longest document has
tokens).  Dynamic programming over the bars chooses at most ``BUCKETS``
boundaries that minimise the padding; the cost of a bucket is a line in its
boundary, so the lower hull of the lines of all bars makes a layer linear in the
bars.  Boundaries are lengths that occur, so the last is the longest row.
Inside a bucket every row is padded to the boundary, and a batch
holds as many rows as the token budget has room for (one, if a row alone
exceeds it).

Rows get their place in a bucket from a row number inside (bucket, salt) plus
the counts of the salts before, so that no task holds a bucket.  Texts are read
for their lengths only and are not shuffled.

Defined results: a null or empty text has the end id alone, so length 1;
repeated rows are packed row by row; null ids come first; an empty table gives
no rows; a text longer than the budget is a batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import doc_rows, pieces, saved
from .token_files import Lengths, encoder

BUCKETS, BUDGET, SALTS = 8, 1 << 16, 512


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> tuple[list[int], int]:
    """Ascending boundaries with the least sum of padded lengths, and that sum; in whole numbers."""
    if not len(lengths):
        return [], 0
    length, before = lengths.tolist(), [0, *np.cumsum(counts).tolist()]
    u = len(length)
    cost: list = [0] + [None] * u  # of the first j bars, none: impossible
    back = []
    for _ in range(min(buckets, u)):
        # A bucket of the bars from i + 1 to j costs length[j] * (before[j] - before[i]): with cost[i], a line in length[j].
        new, came, hull, at = [0] + [None] * u, [0] * (u + 1), [], 0
        for j in range(1, u + 1):
            i = j - 1
            if cost[i] is not None:
                m, c = -before[i], cost[i]
                while len(hull) >= 2 and (c - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, c, i))
            x = length[j - 1]
            at = min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            m, c, came[j] = hull[at]
            new[j] = x * before[j] + m * x + c
        cost = new
        back.append(came)
    out, j = [], u
    for came in reversed(back):
        if j:
            out.append(length[j - 1])
            j = came[j]
    return sorted(set(out)), cost[u]


def token_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row: doc_id, n_tokens (ids of the whole text and the end id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, Lengths)
        for b in pieces(batches, "text"):
            n = enc.lengths(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return doc_rows(docs).mapInArrow(run, "doc_id long, n_tokens long")


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """From (doc_id, n_tokens): doc_id, n_tokens, bucket, bucket_len, batch (within the bucket), slot, padding."""
    rows = saved(lengths.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(SALTS))))
    bars = rows.groupBy(F.col("n_tokens").alias("n")).agg(F.count("*").alias("c")).orderBy("n").collect()  # a row a different length
    cuts, _ = boundaries(np.array([r["n"] for r in bars], np.int64), np.array([r["c"] for r in bars], np.int64), buckets)
    cuts = cuts or [1]
    of = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col("n_tokens")))
    rows = rows.withColumn("bucket", of)
    counts = rows.groupBy("bucket", "salt").agg(F.count("*").alias("c"))
    ahead = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", "salt", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("ahead"))
    place = Window.partitionBy("bucket", "salt").orderBy(F.col("n_tokens"), F.col("doc_id").asc_nulls_first())
    rows = rows.withColumn("place", F.row_number().over(place) - 1).join(F.broadcast(starts), ["bucket", "salt"])  # BUCKETS * SALTS rows at most
    size = F.get(F.array(*[F.lit(c).cast("long") for c in cuts]), F.col("bucket"))
    room = F.greatest(F.floor(F.lit(budget) / size), F.lit(1)).cast("long")
    rank = F.col("ahead") + F.col("place")
    return rows.select(
        "doc_id",
        "n_tokens",
        "bucket",
        size.alias("bucket_len"),
        F.floor(rank / room).cast("long").alias("batch"),
        (rank % room).cast("long").alias("slot"),
        (size - F.col("n_tokens")).alias("padding"),
    )
