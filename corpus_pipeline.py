"""The corpus pipeline: five operators of ``runnel.llm`` one after the other.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runnel.llm import near_dedup, packing, quality_rules, suffix_dedup, toxicity
from runnel.llm.common import read, saved
from runnel.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits the toxicity model on the labelled documents; those predicted toxic go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the adaptive thresholds go."""
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the smallest id stays."""
    return near_dedup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that a smaller id has too are cut from the texts."""
    return suffix_dedup.cut_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left gets a length bucket, a batch and a slot."""
    return packing.pack(packing.token_lengths(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_good),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: Stages with a trained model and with tokens have no SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
