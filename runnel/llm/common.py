"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session.  Only where the session has
    none (unit tests in local mode) a fresh local folder is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="runnel-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, never a recompute
    of what stands above.  Unlike ``checkpoint()`` the plan runs once.  The
    shuffle files of the write go when it ends; the table itself stays until
    ``dropped``, or for what a result still reads, until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def size_of(df: DataFrame) -> int:
    """Bytes of the rows of a saved table, about: eight a plain value, strings and arrays by their length."""
    parts = [F.lit(16)]
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        long = 8 * F.size(c) if kind.startswith(("array", "map")) else F.octet_length(c) if kind in ("string", "binary") else F.lit(0)
        parts.append(F.coalesce(long, F.lit(0)) + 8)
    return df.select(sum(parts).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0


def joined(left: DataFrame, right: DataFrame, on, how: str = "left", limit: int = 16 << 20) -> DataFrame:
    """Join that broadcasts the saved table ``right`` only if it has at most ``limit`` bytes; else both sides are shuffled."""
    return left.join(F.broadcast(right) if size_of(right) <= limit else right, on, how)


def doc_rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` (long) and ``text`` (null: empty) only, so no other column clashes.

    From now on the session sends at most ``BATCH`` bytes to Python at once: by Spark's
    default, batches of 64 MB stand in the executor and in its workers.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def pieces(batches, column: str, rows: int = 2000, chars: int = 1 << 19):
    """Arrow batches cut to at most ``rows`` rows and about ``chars`` characters of ``column`` (one row at least)."""
    for b in batches:
        start = total = 0
        for i, n in enumerate(pc.binary_length(b.column(column)).to_pylist()):
            n = n or 0
            if i > start and (i - start >= rows or total + n > chars):
                yield b.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < b.num_rows:
            yield b.slice(start)
