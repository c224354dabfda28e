"""The corpus pipeline: reject, deduplicate, decontaminate, mix and shard documents.

Each stage takes the documents its predecessor kept and returns documents with the same columns;
the last adds ``shard``.  Between stages the documents are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polybag.llm import op3_mixing, op6_quality, op7_sharding, op9_decontamination, op10_simhash
from polybag.llm.common import table
from polybag.session import saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return op6_quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return op10_simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return op9_decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights."""
    return op3_mixing.mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get their ``shard``; equal texts stay together, bytes are balanced."""
    return op7_sharding.shard_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

# A fitted model decides in the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
