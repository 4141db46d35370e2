"""A training corpus out of `documents`: five stages, each written as Parquet and read again by the next.

Language ID (what has no determined language or is in none of the learned ones goes), near-duplicate join (one document of each group
stays), benchmark decontamination (documents that hold an item go), mixing sources to target weights
(documents are taken as often as the mix says), sharding (a uniform shuffle into 24 shards).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfscope.llm import decontamination, jaccard, language, mixing, sharding
from shelfscope.llm.storage import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document whose best language is less likely than this (of all learned ones) is rejected.
LEAST_LANGUAGE_SCORE = 0.5
SHARDS = 24


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(docs))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shuffle_into_shards(docs, SHARDS)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("shards", shards),
]

#: Trained models, similarity joins and random draws are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
