"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Each stage starts from shrunk executor heaps, as its Python workers and buffers need the memory that the one before has grown into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kestrelite.llm import decontamination, mixing, near_dedup, quality_rules, sharding
from kestrelite.llm.common import read, shrink, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's and source's cloud go."""
    shrink(spark)
    return quality_rules.keep(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the smallest id."""
    shrink(spark)
    return near_dedup.keep(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    shrink(spark)
    return decontamination.keep(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled towards the target weights of source, language and topic."""
    shrink(spark)
    return mixing.keep(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are stored in target-sized shards; each row names its shard and the manifest's version."""
    shrink(spark)
    return sharding.shard(docs)


STAGES = [("quality rules", quality), ("near dedup", near), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The quality estimates, the minwise trees and the randomised SVD are iterative or seeded, which SQL does not express.
ORACLE_SQL = None
