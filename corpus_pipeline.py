"""The corpus pipeline: quality, near duplicates, benchmark contamination, mixture, shards.

Each stage is a function of (spark, docs, sf_dir). ``run`` writes what a stage returns to the shared folder as
Parquet and gives it, read again, to the next stage, so a stage works on all that its predecessor kept and nothing
is computed twice; what a stage leaves behind besides is deleted. All stages but the last return the columns of documents; the last returns shards and slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import decontam, mixing, ngramjoin, quality, sharding
from tidemill.llm.common import drop_spool, drop_spooled_since, on_all_cores, spool, spooled, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.7 go."""
    return quality.keep_good(on_all_cores(docs), table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word-shingle Jaccard similarity of 0.8 or more, the smallest id stays."""
    return ngramjoin.keep_one(on_all_cores(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    return decontam.decontaminate(on_all_cores(docs), table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them: not at all, once, or up to three times."""
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sixteen shards of near-equal bytes, equal texts together."""
    return sharding.shard(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can't express the classifier, so the pipeline is tested stage by stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, mark = docs, spooled()
        docs = spool(stage(spark, before, sf_dir), f"stage-{name}")
        drop_spooled_since(mark, keep=docs)
        drop_spool(before)
    return STAGES[-1][1](spark, docs, sf_dir)
