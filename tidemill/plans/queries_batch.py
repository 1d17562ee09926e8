"""Batch algebra over orders: position is the rank by order key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import batch as B
from tidemill.operators import sampling as S
from tidemill.plans.catalog import query
from tidemill.plans.fixtures import TOKENS, per_token, table, trajectories

ROWS = "WITH b AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey AS k, o_custkey AS uid, o_totalprice AS price, o_orderstatus AS status FROM orders), c AS (SELECT count(*) AS n FROM b)"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("uid"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    return B.with_dense_id(orders, ["k"])


def padded(k: int) -> str:
    """SQL for the batch padded cyclically to a multiple of ``k``: row_id, k, status."""
    return f"SELECT row_id, k, status FROM b UNION ALL SELECT n + i, k, status FROM c, range({k}) t(i) JOIN b ON b.row_id = i % (SELECT n FROM c) WHERE i < ({k} - n % {k}) % {k}"


def fill(b: DataFrame, k: int) -> DataFrame:
    return B.pad_to_divisor(b, k)[0]


def simple(name: str, sql: str):
    """Registers fn(batch) -> DataFrame under a name."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(rows(spark, sf_dir))

        return query(name, ROWS + " " + sql)(run)

    return register


simple("a01_select", "SELECT row_id, price FROM b")(lambda b: B.select(b, ["price"]))
simple("a02_pop", "SELECT row_id, k, uid, status FROM b")(lambda b: B.pop(b, ["price"])[1])
simple("a03_rename", "SELECT row_id, k AS order_key, uid AS customer, price, status FROM b")(lambda b: B.rename(b, ["k", "uid"], ["order_key", "customer"]))
simple("a04_gather", "SELECT CAST(p.ord AS BIGINT) AS row_id, k FROM (VALUES (0, 5), (1, 0), (2, 5), (3, -1)) p(ord, place) JOIN b ON b.row_id = CASE WHEN place < 0 THEN place + (SELECT n FROM c) ELSE place END")(lambda b: B.gather_list(b, [5, 0, 5, -1]).select("row_id", "k"))
simple("a04_mask", "SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, k FROM b WHERE status = 'F'")(lambda b: B.mask_rows(b, F.col("status") == "F").select("row_id", "k"))
simple("a05_slice", "SELECT row_number() OVER (ORDER BY row_id DESC) - 1 AS row_id, k FROM b, c WHERE row_id <= n - 10 AND row_id > 20 AND (n - 10 - row_id) % 3 = 0")(lambda b: B.slice_rows(b, -10, 20, -3).select("row_id", "k"))
simple("a06_getitem", "SELECT 0::BIGINT AS row_id, k FROM b, c WHERE row_id = n - 2")(lambda b: B.item(b, -2).select("row_id", "k"))
simple("a07_reorder", "SELECT row_number() OVER (ORDER BY uid, row_id) - 1 AS row_id, k FROM b")(lambda b: B.reorder(b, B.with_dense_id(b.select("uid", F.col("row_id").alias("place")), ["uid", "place"], "ord").select("ord", "place")).select("row_id", "k"))
simple("a08_repeat_interleaved", "SELECT row_id * 3 + i AS row_id, k FROM b, range(3) t(i)")(lambda b: B.repeat(b, 3).select("row_id", "k"))
simple("a09_repeat_stacked", "SELECT i * n + row_id AS row_id, k FROM b, c, range(3) t(i)")(lambda b: B.repeat(b, 3, interleave=False).select("row_id", "k"))
simple("a10_repeat_each", "SELECT row_number() OVER (ORDER BY row_id, i) - 1 AS row_id, k FROM b, range(3) t(i) WHERE i < k % 4")(lambda b: B.repeat_each(b.withColumn("times", F.col("k") % 4), "times").select("row_id", "k"))
simple("a12_fold_unfold", f"SELECT row_id, k FROM ({padded(7)})")(lambda b: B.unfold_rows(B.fold(fill(b, 7), 7, ["k"]), ["k"]))
simple("a12_fold", f"SELECT row_id // 7 AS row_id, CAST(sum(k * (row_id % 7 + 1)) AS BIGINT) AS x FROM ({padded(7)}) GROUP BY 1")(lambda b: B.fold(fill(b, 7), 7, ["k"]).select("row_id", F.aggregate(F.transform("k", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x).alias("x")))
simple("a13_chunk", "SELECT row_id, CAST(row_id // CAST(ceil(n / 7.0) AS BIGINT) AS INT) AS chunk FROM b, c")(lambda b: B.chunk(b, 7, padded=True).select("row_id", "chunk"))
simple("a14_split", "SELECT row_id, CAST(row_id // 64 AS INT) AS chunk FROM b")(lambda b: B.split(b, 64).select("row_id", "chunk"))
simple("a15_mini_batches", f"SELECT row_id, CAST(e AS INT) AS epoch, CAST(row_id // 128 AS INT) AS batch, CAST(row_id % 128 AS INT) AS place FROM ({padded(128)}), range(2) t(e)")(lambda b: B.mini_batches(fill(b, 128), 128, epochs=2).select("row_id", "epoch", "batch", "place"))
simple("a16_pad_to_divisor", f"SELECT row_id, k FROM ({padded(4096)})")(lambda b: fill(b, 4096).select("row_id", "k"))
simple("a17_unpad", "SELECT row_id, k FROM b, c WHERE row_id < n - 3")(lambda b: B.unpad(b, 3).select("row_id", "k"))
simple("a18_pad_last", "SELECT row_id, k FROM b UNION ALL SELECT n + i, k FROM b, c, range(4) t(i) WHERE row_id = n - 1")(lambda b: B.pad_with(b, 4, "").select("row_id", "k"))
simple("a19_noop_rows", "SELECT row_id, false AS is_padding FROM b UNION ALL SELECT n + i, true FROM c, range(1000) t(i) WHERE i < (7 - n % 7) % 7")(lambda b: B.pad_with_empty(b.withColumn("uid", F.col("uid").cast("string")), 7).select("row_id", "is_padding"))
simple("a29_prefix", "SELECT row_id, k AS order_k, uid AS order_uid, price AS order_price, status AS order_status FROM b")(lambda b: B.prefix_columns(b, "order_"))
simple("a32_size_report", "SELECT 'status' AS \"column\", CAST(sum(length(status)) AS BIGINT) AS bytes FROM b")(lambda b: B.size_report(b.select("status")))
simple("a36_group_samples", f"SELECT row_id // 7 AS row_id, string_agg(status, '' ORDER BY row_id) AS responses FROM ({padded(7)}) GROUP BY 1")(lambda b: B.fold(fill(b, 7), 7, ["status"]).select("row_id", F.array_join("status", "").alias("responses")))
simple("f07_without_padding", "SELECT row_id FROM b")(lambda b: B.without_padding(B.pad_with_empty(b.withColumn("uid", F.col("uid").cast("string")), 7)).select("row_id"))
simple("j01_zip_join", "SELECT row_id, k, uid, price, status, price * 2 AS double_price FROM b")(lambda b: B.zip_join(b, b.select("row_id", "uid", (F.col("price") * 2).alias("double_price"))))
simple("j17_cross_repeat", "SELECT row_id * 2 + i AS row_id, uid FROM b, range(2) t(i)")(lambda b: B.repeat(b, 2).select("row_id", "uid"))
simple("j18_merge_missing", "SELECT row_id, k, price FROM b UNION ALL SELECT n + row_id, k, NULL FROM b, c")(lambda b: B.concat_filled([b.select("row_id", "k", "price"), b.select("row_id", "k")]))
simple("u01_union_all", "SELECT row_id, k FROM b UNION ALL SELECT n + row_id, k FROM b, c")(lambda b: B.concat([b, b]).select("row_id", "k"))
simple("u07_unpivot", "SELECT row_id, CAST(i AS INT) AS part, CASE i WHEN 0 THEN 'chosen' ELSE 'rejected' END AS source, CASE i WHEN 0 THEN status ELSE CAST(uid AS VARCHAR) END AS text FROM b, range(2) t(i)")(lambda b: B.stack_columns(b.select("row_id", F.col("status").alias("chosen"), F.col("uid").cast("string").alias("rejected")), ["chosen", "rejected"], "text"))
simple("u08_common_columns", "SELECT row_id, k FROM b UNION ALL SELECT n + row_id, k FROM b, c")(lambda b: B.concat_common([b.select("row_id", "k", "price"), b.select("row_id", "k")], ["price"]))
simple("u09_default_fill", "SELECT row_id, k, CAST(1 AS INT) AS scores FROM b UNION ALL SELECT n + row_id, k, 0 FROM b, c")(lambda b: B.concat_filled([b.select("row_id", "k", F.array(F.lit(1)).alias("s")), b.select("row_id", "k")], lists=["s"]).select("row_id", "k", F.size("s").alias("scores")))
simple("o07_head", "SELECT row_id FROM b WHERE row_id < 37")(lambda b: S.head(b, 37).select("row_id"))
DRAW = "('0x' || substr(md5('{}:' || CAST(row_id AS VARCHAR)), 1, 15))::BIGINT"
simple("o07_random_sample", f"SELECT row_id FROM b ORDER BY {DRAW.format(3)}, row_id LIMIT 37")(lambda b: S.sample(b, 37, seed=3).select("row_id"))
simple("o08_oldest_groups", "SELECT row_id, uid FROM b WHERE uid IN (SELECT uid FROM b GROUP BY uid ORDER BY min(k), uid LIMIT 20)")(lambda b: S.oldest_groups(b, 20, age="k").select("row_id", "uid"))
simple("o09_sequential", "SELECT row_id, row_id AS place FROM b")(lambda b: S.epoch_order(b, seed=None).select("row_id", "place"))
simple("o09_shuffled_epoch", "SELECT row_id, row_number() OVER (ORDER BY " + DRAW.format("5:1") + ", row_id) - 1 AS place FROM b")(lambda b: S.epoch_order(b, seed=5, epoch=1).select("row_id", "place"))
simple("o10_equal_split", "SELECT row_id, CAST(row_id // (n // 7) AS INT) AS part FROM b, c WHERE row_id < n // 7 * 7")(lambda b: S.equal_split(b, 7).select("row_id", "part"))
simple("o11_train_test", "SELECT row_id, ((((k % 2147483647) * 48271 + 42) % 2147483647) * 69621 + 11) % 2147483647 < 214748364 AS is_test FROM b")(lambda b: S.train_test(b, 0.1, 42, F.col("k")).select("row_id", "is_test"))
simple("o12_positional_split", "SELECT row_id FROM b, c WHERE row_id >= round(n * 0.75)")(lambda b: S.positional_slice(b, 0.75).select("row_id"))
simple("o13_top_two", "SELECT row_id, CAST(r AS INT) AS rank FROM (SELECT row_id, row_number() OVER (PARTITION BY uid ORDER BY price DESC, row_id) AS r FROM b) WHERE r <= 2")(lambda b: S.top_two(b, "price").select("row_id", "rank"))
simple("w18_first_appearance_rank", "SELECT row_id, r AS rank FROM b JOIN (SELECT uid, row_number() OVER (ORDER BY min(row_id), uid) AS r FROM b GROUP BY uid) USING (uid)")(lambda b: S.first_appearance_rank(b, "uid", ["row_id"]).select("row_id", "rank"))
simple("f14_varied_groups", "SELECT row_id FROM b WHERE uid IN (SELECT uid FROM b GROUP BY uid HAVING min(status) <> max(status))")(lambda b: S.varied_groups(b, "status").select("row_id"))
simple("b08_inverse_permutation", "SELECT row_id, k FROM b")(lambda b: B.reorder(B.reorder(b, p := B.with_dense_id(b.select("uid", F.col("row_id").alias("place")), ["uid", "place"], "ord").select("ord", "place")), B.inverse(p)).select("row_id", "k"))


@query("a11_unfold_chunks", TOKENS + ", f AS (SELECT row_id, count(*) AS t FROM tok GROUP BY row_id HAVING count(*) % 2 = 0) SELECT row_id * 2 + CASE WHEN pos < t / 2 THEN 0 ELSE 1 END AS row_id, CAST(pos % (t // 2) AS INT) AS pos, token_id FROM tok JOIN f USING (row_id)")
def a11_unfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=("token_id",)).filter(F.size("token_id") % 2 == 0)
    return per_token(B.unfold(df, 2, ["token_id"]), token_id="token_id")


@query("a33_deep_equality", "WITH b AS (SELECT * REPLACE (CASE WHEN c_custkey % 7 = 0 THEN 'nan'::DOUBLE ELSE c_acctbal END AS c_acctbal) FROM customer), x AS (SELECT * REPLACE (CASE WHEN c_custkey = 1 THEN 5e-1 ELSE c_acctbal END AS c_acctbal) FROM b) SELECT (SELECT count(*) FROM (FROM b EXCEPT ALL FROM b)) = 0 AS same, (SELECT count(*) FROM (FROM b EXCEPT ALL FROM x)) = 0 AS changed")
def a33_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")))
    changed = b.withColumn("c_acctbal", F.when(F.col("c_custkey") == 1, 0.5).otherwise(F.col("c_acctbal")))
    return spark.createDataFrame([(B.equal(b, b), B.equal(b, changed))], "same boolean, changed boolean")


@query("a35_padding_round_trip", TOKENS + ", p AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY pos) - 1 AS k FROM tok WHERE response_mask = 1) SELECT row_id, CAST(k AS INT) AS pos, token_id FROM p")
def a35_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=("token_id", "response_mask"))
    return per_token(df.withColumn("r", B.to_ragged("token_id", "response_mask")), token_id="r")


@query("f13_consistency", TOKENS + " SELECT row_id FROM tok GROUP BY row_id HAVING row_id % 5 = 0 AND count(*) > 0")
def f13_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth trajectory lacks its first reward."""
    whole = trajectories(spark, sf_dir, columns=("token_id", "response_mask", "rewards")).withColumnRenamed("rewards", "all")
    rows = whole.withColumn("rewards", F.when(F.col("row_id") % 5 == 0, F.slice("all", 2, F.size("all"))).otherwise(F.col("all")))
    return B.consistent(rows, ["token_id", "response_mask", "rewards"])


@query("f02_labelled", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def f02_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return S.labelled(docs, "quality").select("doc_id")


@query("f01_overlong_filter", "SELECT doc_id FROM documents WHERE len(string_split(text, ' ')) <= 300")
def f01_overlong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drop_long(table(spark, sf_dir, "documents"), F.size(F.split("text", " ")), 300).select("doc_id")


@query("j06_semi_join", ROWS + " SELECT row_id FROM b WHERE uid IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j06_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("uid"))
    return rows(spark, sf_dir).join(chosen, "uid", "left_semi").select("row_id")


#: Trajectories as batches of 16 by their dense ids.
DEALT = TOKENS + ", dl AS (SELECT row_id, (dense_rank() OVER (ORDER BY row_id) - 1) // 16 AS batch, pos, token_id, rewards FROM tok)"


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=("token_id", "rewards")).withColumnRenamed("row_id", "k")
    return B.with_dense_id(df, ["k"]).withColumn("batch", F.expr("row_id div 16"))


@query("a26_collate", DEALT + ", o AS (SELECT batch, row_id, min(token_id) AS least FROM dl GROUP BY ALL) SELECT batch, string_agg(least, ',' ORDER BY row_id) AS least, string_agg(least || '-' || row_id % 7, ',' ORDER BY row_id) AS pairs FROM o GROUP BY batch")
def a26_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars and arrays of one length, stacked in order."""
    df = dealt(spark, sf_dir).withColumn("least", F.array_min("token_id")).withColumn("pair", F.array("least", (F.col("k") % 7).cast("int")))
    out = B.collate_stacked(df, ["least", "pair"], batch="batch")
    return out.select("batch", F.array_join("least", ",").alias("least"), F.array_join(F.transform("pair", lambda p: F.concat_ws("-", p.cast("array<string>"))), ",").alias("pairs"))


@query("a27_collate_jagged", DEALT + ", n AS (SELECT batch, row_id, count(*) AS t FROM dl GROUP BY ALL) SELECT batch, v AS tokens, '0,' || o AS offsets FROM (SELECT batch, string_agg(token_id, ',' ORDER BY row_id, pos) AS v FROM dl GROUP BY batch) JOIN (SELECT batch, string_agg(upto, ',' ORDER BY row_id) AS o FROM (SELECT batch, row_id, CAST(sum(t) OVER (PARTITION BY batch ORDER BY row_id) AS BIGINT) AS upto FROM n) GROUP BY batch) USING (batch)")
def a27_jagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.collate_jagged(dealt(spark, sf_dir), ["token_id"], batch="batch")
    return out.select("batch", F.array_join("token_id", ",").alias("tokens"), F.array_join("token_id_offsets", ",").alias("offsets"))


def padded_sql(place: str) -> str:
    return DEALT + f", n AS (SELECT batch, row_id, count(*) AS t FROM dl GROUP BY ALL), m AS (SELECT batch, CAST(ceil(max(t) / 4.0) * 4 AS BIGINT) AS w FROM n GROUP BY batch) SELECT n.row_id, CAST(i AS INT) AS pos, coalesce(token_id, -1) AS x FROM n JOIN m USING (batch), range(100) r(i) LEFT JOIN dl ON dl.row_id = n.row_id AND dl.pos = {place} WHERE i < w"


for _left, _place in ((False, "i"), (True, "i - (w - t)")):

    def _pad(left: bool):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = B.collate_padded(dealt(spark, sf_dir), {"token_id": F.lit(-1)}, batch="batch", left=left, multiple=4)
            return per_token(out.drop("row_id").withColumnRenamed("k", "row_id"), x="token_id")

        return run

    query(f"a27_collate_padded_{'left' if _left else 'right'}", padded_sql(_place))(_pad(_left))


@query("a34_assert_equal", "SELECT n_nationkey AS k, CASE n_nationkey WHEN 0 THEN 'equal' WHEN 1 THEN 'rows' WHEN 2 THEN 'schemas' ELSE 'equal' END AS outcome FROM nation")
def a34_assert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table against itself in another order, with one value changed, and with a column of another type."""
    n = table(spark, sf_dir, "nation")
    others = {1: n.withColumn("n_name", F.when(F.col("n_nationkey") == 7, "x").otherwise(F.col("n_name"))), 2: n.withColumn("n_regionkey", F.col("n_regionkey").cast("string"))}

    def outcome(k: int) -> str:
        try:
            B.assert_equal(n, others.get(k, n.orderBy(F.desc("n_name"))))
        except AssertionError as e:
            return str(e).split()[0]
        return "equal"

    named = {k: outcome(k) for k in range(3)}
    return n.select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") == 1, named[1]).when(F.col("n_nationkey") == 2, named[2]).otherwise(named[0]).alias("outcome"))
