"""The queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import lattice, near_dedup, packing, quality_rules, suffix_dedup, syncmers, token_files, toxicity, weak_quality, wrappers
from .common import read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_lengths(read(spark, sf_dir, "documents"), tokenizer_path()))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read(spark, sf_dir, "documents"), tokenizer_path())


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited(read(spark, sf_dir, "documents"))


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.classify(read(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.round_trip(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(read(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_packing": op2_packing,
    "op3_token_files": op3_token_files,
    "op4_syncmers": op4_syncmers,
    "op5_weak_quality": op5_weak_quality,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_toxicity": op8_toxicity,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_wrappers": op10_wrappers,
}

ORACLE_SQL: dict[str, str] = {"op7_quality_rules": quality_rules.oracle_sql()}
