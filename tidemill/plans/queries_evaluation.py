"""Offline evaluation over documents and their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.catalog import query


@query(
    "g25_eval_by_source",
    """SELECT source AS data_source, round(avg((quality + (1 - toxic)) / 2.0), 6) + 0.0 AS test_score, count(*) AS n
       FROM documents JOIN labels USING (doc_id) GROUP BY source""",
)
def g25_eval_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = F.array(F.col("quality").cast("double"), 1.0 - F.col("toxic"))
    per_row = docs.join(labels, "doc_id").select(F.col("source").alias("data_source"), (F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)).alias("s"))
    return per_row.groupBy("data_source").agg((F.round(F.avg("s"), 6) + 0.0).alias("test_score"), F.count("*").alias("n"))
