"""State assembly, clean-up, limits and redaction, as functions on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_maps(base: Column, over: Column) -> Column:
    """Shallow merge of two maps: a key that ``over`` has wins, also with a null."""
    over = F.coalesce(over, F.map_filter(base, lambda k, v: F.lit(False)))
    return F.map_zip_with(base, over, lambda k, x, y: F.when(F.map_contains_key(over, k), y).otherwise(x))


def assemble(default: Column, given: Column, *configurations: Column) -> tuple[Column, Column]:
    """(data, configuration): ``given`` over ``default``; of the configurations the later win."""
    config = configurations[0]
    for c in configurations[1:]:
        config = merge_maps(config, c)
    return merge_maps(default, given), config


def clean(df: DataFrame, *names: str) -> DataFrame:
    """Without the columns that must not leave a run."""
    return df.drop(*(names or ("configuration",)))


def pick(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, v: k.isin(*keys))


def omit_null(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull())


def rename_keys(m: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.transform_keys(m, lambda k, v: F.coalesce(F.element_at(table, k), k))


def split_keys(m: Column, keys: list[str]) -> tuple[Column, Column]:
    """Entries with one of ``keys``, and the rest."""
    return pick(m, keys), F.map_filter(m, lambda k, v: ~k.isin(*keys))


def is_empty(data: Column) -> Column:
    """For a state in JSON: missing, ``{}`` or ``{"data": {}}``."""
    return F.coalesce(F.regexp_replace(data, r"\s", "").isin("{}", '{"data":{}}'), F.lit(True))


def prune(leaves: DataFrame, data: str, run_id: str = "run_id") -> DataFrame:
    """Drops empty leaves of runs that have several."""
    from pyspark.sql.window import Window

    n = F.count("*").over(Window.partitionBy(run_id))
    return leaves.withColumn("__n", n).where((F.col("__n") == 1) | ~is_empty(F.col(data))).drop("__n")


def payload_size(value: Column) -> Column:
    """Bytes of a JSON text."""
    return F.octet_length(value).cast("long")


def redact(df: DataFrame, column: str, limit: int, size_of: Column | None = None) -> DataFrame:
    """Replaces payloads of more than ``limit`` bytes and sets ``redacted``; other columns stay."""
    large = F.coalesce((size_of if size_of is not None else payload_size(F.col(column))) > limit, F.lit(False))
    return df.withColumns({"redacted": large, column: F.when(large, F.lit("[REDACTED]")).otherwise(F.col(column))})


def limit_size(df: DataFrame, column: str, limit: int) -> DataFrame:
    """Ends the job when a state is larger than ``limit`` bytes."""
    size = payload_size(F.col(column))
    error = F.raise_error(F.concat(F.lit("StateTooLargeError: "), size.cast("string"))).cast("string")
    return df.withColumn(column, F.when(size > limit, error).otherwise(F.col(column)))
