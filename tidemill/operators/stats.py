"""Statistics of groups and of masked batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import arrays as A


def group_mean_std(df: DataFrame, score: str, *, by: str = "uid", eps: float = 1e-6) -> DataFrame:
    """Adds mean, std and n of each row's group: the sample variance held above ``eps``; a group of one has 0 and 1."""
    from tidemill.operators.estimators import with_group

    out = with_group(df, by=by, n=F.count(score), _mean=F.avg(score), _var=F.var_samp(score))
    alone = F.col("n") <= 1
    return out.withColumns({"mean": F.when(alone, 0.0).otherwise(F.col("_mean")), "std": F.when(alone, 1.0).otherwise(F.sqrt(F.greatest("_var", F.lit(eps))))}).drop("_mean", "_var")


def group_key(label: Column) -> Column:
    """A group's key as text: near-integers (within 1e-6) and integers agree, other labels stay as they are.

    Labels such as "042" and "42" stay apart.
    """
    number = F.try_to_number(label.cast("string"), F.lit("S999999999999999999D999999"))
    whole = label.cast("string").rlike(r"^-?\d+\.\d+$") & (F.abs(number - F.round(number)) < 1e-6)
    return F.when(whole, F.round(number).cast("long").cast("string")).otherwise(label.cast("string"))


def masked_batch(df: DataFrame, values: str, mask: str = "response_mask") -> DataFrame:
    """One row: total, mean (divisor plus 1e-8), var and n of all unmasked values. One value or none raises for var."""
    tokens = df.select(F.explode(F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m"))).alias("t")).select(F.when(F.col("t.m") != 0, F.col("t.v")).alias("v"))
    var = F.when(F.count("v") < 2, F.raise_error(F.lit("the variance of fewer than two values")).cast("double")).otherwise(F.var_samp("v"))
    return tokens.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"), F.coalesce(F.sum("v") / (F.count("v") + A.EPS), F.lit(0.0)).alias("mean"), var.alias("var"), F.count("v").alias("n"))


def moments(df: DataFrame, value: str, mask: str | None = None) -> DataFrame:
    """One row over all partitions: mean, max, min and sample deviation; with a 0/1 mask column only where it is 1."""
    v = F.when(F.col(mask) != 0, F.col(value)) if mask else F.col(value)
    return df.agg(F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.stddev_samp(v).alias("std"))
