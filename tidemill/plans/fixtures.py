"""Views of the driver's tables as rollouts: an order is a trajectory, its customer the prompt, its lines the tokens.

``TOKENS`` is the same view as SQL common table expressions, one row a token, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")

#: A token's columns, in SQL that both engines read.
TOKEN_SQL = {
    "response_mask": "CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END",
    "rewards": "l_extendedprice / 97003e0",
    "vals": "l_quantity / 49e0",
    "old_log_probs": "-(5e-2 + l_discount)",
    "rollout_log_probs": "-(5e-2 + l_tax)",
    "ref_log_prob": "-(5e-2 + (l_discount + l_tax) / 2e0)",
    "log_probs": "-(4e-2 + l_discount * 7e-1 + l_tax * 4e-1)",
    "sum_pi_squared": "exp(2e0 * -(5e-2 + l_discount))",
    "advantages": "l_extendedprice / 97003e0 - 35e-2",
    "expert": "CAST(l_suppkey % 8 AS INT)",
    "layer": "CAST(l_linenumber % 4 AS INT)",
    "token_id": "CAST(l_partkey % 100 AS INT)",
}

TOKENS = (
    "WITH tok AS (SELECT o_custkey AS uid, o_orderkey AS row_id, o_orderpriority AS data_source, o_orderstatus AS pred, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY "
    + ", ".join(TOKEN_ORDER)
    + ") - 1 AS INT) AS pos, "
    + ", ".join(f"{sql} AS {name}" for name, sql in TOKEN_SQL.items())
    + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
    + "seq AS (SELECT row_id, min(uid) AS uid, min(data_source) AS data_source, min(pred) AS pred, sum(rewards) AS s, CAST(sum(response_mask) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS t FROM tok GROUP BY row_id)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trajectories(spark: SparkSession, sf_dir: str, *, columns: tuple[str, ...] | None = None, aborted: bool = False) -> DataFrame:
    """A row for each order that has lines (with ``aborted``, for every order): row_id, uid, data_source, pred and token arrays.

    Only the lines' columns that the wanted token columns need are read beside the order of tokens.
    """
    names = columns or tuple(TOKEN_SQL)
    lines = table(spark, sf_dir, "lineitem")
    token = F.struct(*[F.expr(TOKEN_SQL[n]).alias(n) for n in names])
    grouped = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in TOKEN_ORDER], token.alias("token")))).alias("tokens"))
    arrays = grouped.select(F.col("l_orderkey").alias("row_id"), *[F.col(f"tokens.token.{n}").alias(n) for n in names])
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("uid"), F.col("o_orderpriority").alias("data_source"), F.col("o_orderstatus").alias("pred"), F.col("o_orderdate").alias("order_date"))
    joined = orders.join(arrays, "row_id", "left" if aborted else "inner")
    if aborted:
        kinds = dict(arrays.dtypes)
        joined = joined.withColumns({n: F.coalesce(F.col(n), F.array().cast(kinds[n])) for n in names})
    return joined


def rounded(c: str | F.Column) -> F.Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def per_token(df: DataFrame, keep: tuple[str, ...] = ("row_id",), **arrays: str) -> DataFrame:
    """Rows (keep, pos, ...) of equal-length arrays, doubles rounded."""
    zipped = F.arrays_zip(*[F.col(c).alias(n) for n, c in arrays.items()])
    out = df.select(*keep, F.posexplode(zipped).alias("pos", "t"))
    kinds = {f.name: f.dataType.simpleString() for f in out.schema["t"].dataType.fields}
    fields = list(kinds)
    return out.select(*keep, "pos", *[(rounded(F.col("t")[f]) if kinds[f] == "double" else F.col("t")[f]).alias(n) for n, f in zip(arrays, fields, strict=True)])
