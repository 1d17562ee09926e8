"""Batches that are read many times are worked out once, and cells of a resampling grow with the rows."""

from pyspark.sql import functions as F

from tidemill.operators import estimators as E
from tidemill.operators import losses as L


def leaves(df):
    found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [found.apply(k).toString() for k in range(found.size())]


def test_tokens_of_covariance_losses_are_worked_out_once(spark):
    df = spark.range(20).select(F.col("id").alias("row_id"), *[F.array(F.lit(0.1), F.col("id") / 20).alias(c) for c in ("advantages", "log_probs", "old_log_probs")], F.array(F.lit(1), F.lit(1)).alias("response_mask"))
    for loss in (L.clip_cov, L.kl_cov):
        assert not any("Range" in x for x in leaves(loss(df, L.LossConfig())))


def test_resampling_has_a_cell_for_every_four_rows(spark):
    df = spark.range(400).select(F.col("id").alias("row_id"), F.array(F.col("id") / 400).alias("rewards"), F.array(F.lit(1)).alias("response_mask"))
    drawn = E.pf_resample(df, seed=7, chunks=1)
    assert not any("Range" in x for x in leaves(drawn))
    assert "* 100.0" in drawn._jdf.queryExecution().optimizedPlan().toString()
    assert drawn.count() == drawn.select("draw").distinct().count() == 400
