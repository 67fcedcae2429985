"""The corpus pipeline: quality rules, near duplicates, benchmark leaks, source mix, shards.

``run`` applies STAGES to ``documents``; each stage's rows are written as Parquet under ``spark.checkpoint.dir`` and
read again as the next one's documents. Words, files of boilerplate and benchmark items are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqedge.llm import jaccard, leaks, mixing, quality, sharding
from seqedge.llm.common import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines go from the others."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays."""
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark windows go from the texts, and documents that are mostly benchmark go."""
    return leaks.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated up to twice; every document stays at least once."""
    return mixing.mix(docs).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shards(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("source_mix", source_mix), ("shard", shard)]
#: SQL can't express the near-duplicate components; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
