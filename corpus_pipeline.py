"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymill.llm import decontaminate, lines, mixing, neardup, rules
from tallymill.llm.common import kept, kept_alone
from tallymill.llm.targets import MIX_SEED, MIX_WEIGHTS, mix_domain

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive limits of their language and source."""
    return rules.keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; ``n_chars`` follows the text."""
    cut = lines.keep_remaining(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least id: first by the whole texts, as line dedup cuts what
    near copies share, then by what it left."""
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return neardup.keep_one(kept(neardup.drop_copies(docs, whole), "without-copies"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.keep_clean(docs, bench)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of each epoch of the target mixture, with ``domain``, ``n_tokens`` and ``epoch``."""
    return mixing.mix(docs, MIX_WEIGHTS, mix_domain(F.col("source")), seed=MIX_SEED)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

# The stages hash and draw as Spark does, which SQL elsewhere can't repeat; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept_alone(lambda: stage(spark, docs, sf_dir), name)
    return docs
