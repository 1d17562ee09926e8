"""Range-sorted parts: rows in a global order, each task holding a contiguous stretch of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import fresh, shared_dir


def part_count(rows: DataFrame, text_col: str, part_bytes: int) -> int:
    """As many parts as texts of ``part_bytes`` each need, and one for each core at least."""
    held = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-held // part_bytes))


def range_sorted(rows: DataFrame, keys: list[Column], parts: int) -> DataFrame:
    """``rows`` over ``parts`` ranges of ``keys``, sorted in each; equal rows are told apart, so they share several ranges.

    Keys should be short: Spark's sample of them passes through the driver.
    """
    (tie,) = fresh(rows, "tie")
    told = rows.withColumn(tie, F.monotonically_increasing_id())
    return told.repartitionByRange(parts, *keys, F.col(tie)).sortWithinPartitions(*keys, F.col(tie)).drop(tie)


def checkpointed(rows: DataFrame) -> DataFrame:
    """``rows`` in reliable checkpoint files: the same partitions, each in the same order, whatever executors are lost."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(rows.sparkSession))
    return rows.checkpoint()
