"""Placement, streams and replay over orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.operators import balance as P
from tidemill.operators import metrics as M
from tidemill.operators.batch import with_dense_id
from tidemill.plans.catalog import query
from tidemill.plans.fixtures import rounded, table
from tidemill.streaming import queues as Q
from tidemill.streaming import replay as Y

ROWS = "WITH b AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_custkey AS uid, CAST(floor(o_totalprice / 100) AS BIGINT) % 4000 + 1 AS len FROM orders)"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("uid"), (F.floor(F.col("o_totalprice") / 100) % 4000 + 1).alias("len"))
    return with_dense_id(o, ["k"]).drop("k")


#: Rows of a training batch in these queries; the last batch of a table is shorter.
BATCH = 128


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as training batches of ``BATCH`` rows."""
    return rows(spark, sf_dir).withColumn("batch", F.expr(f"row_id div {BATCH}"))


def loads(df: DataFrame, size: F.Column, *by: str) -> DataFrame:
    """The loads of each batch's parts: by part where that is named, else by falling load."""
    out = df.groupBy("batch", "part").agg(F.sum(size).cast("long").alias("load"))
    if by:
        return out.select("batch", F.col("part").cast("long").alias("rank"), "load")
    rank = F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("load"))) - 1
    return out.select("batch", rank.cast("long").alias("rank"), "load")


COST = "(24576 * len + len * len)"


def differenced_sql(items: str, k: str, *, equal: bool = False) -> str:
    """Common table expressions that end in ``done(batch, v)``: the loads, by falling load, of each batch after differencing.

    ``items`` has batch, s (an item's size) and f (its place); ``k`` is the number of parts, an expression over n and total.
    A state is a partial partition's loads; each step adds the two states of the largest spread, oppositely ordered.
    """
    start = "list(s ORDER BY s DESC, f DESC)" if equal else "[s] || list_transform(range(k - 1), lambda z: 0::BIGINT)"
    group = "GROUP BY batch, k, i // k" if equal else ""
    number = "(i // k)" if equal else "i"
    return f"""it AS ({items}), od AS (SELECT batch, s, f, row_number() OVER (PARTITION BY batch ORDER BY s, f) - 1 AS i, count(*) OVER (PARTITION BY batch) AS n, sum(s) OVER (PARTITION BY batch) AS total FROM it),
    kk AS (SELECT batch, s, f, i, CAST({k} AS BIGINT) AS k FROM od), fs AS (SELECT batch, {number} AS number, {start} AS v FROM kk {group}),
    st AS (SELECT batch, list({{'d': v[-1] - v[1], 'i': number::BIGINT, 'v': v}}) AS st, count(*)::BIGINT AS nxt FROM fs GROUP BY batch),
    go(batch, st, nxt) AS (SELECT batch, list_sort(st), nxt FROM st UNION ALL SELECT batch, list_sort(list_append(st[3:], {{'d': v[-1] - v[1], 'i': nxt, 'v': v}})), nxt + 1
        FROM (SELECT batch, st, nxt, list_reverse_sort(list_transform(range(1, len(st[1].v) + 1), lambda j: st[1].v[j] + st[2].v[len(st[2].v) + 1 - j])) AS v FROM go WHERE len(st) > 1)),
    done AS (SELECT batch, st[1].v AS v FROM go WHERE len(st) = 1)"""


PARTS = " SELECT batch, unnest(range(len(v)))::BIGINT AS rank, unnest(v)::BIGINT AS load FROM done"
RECURSIVE = ROWS.replace("WITH ", "WITH RECURSIVE ", 1) + ", "
ITEMS = f"SELECT row_id // {BATCH} AS batch, {{}} AS s, row_id AS f FROM b"


@query("b01_workload", ROWS + " SELECT row_id, 24576 * len + len * len AS cost FROM b")
def b01_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("row_id", P.workload(F.col("len")).alias("cost"))


@query("b02_karmarkar_karp", RECURSIVE + differenced_sql(ITEMS.format("len"), "7") + PARTS)
def b02_kk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loads(P.partition(batches(spark, sf_dir), 7, size=F.col("len"), batch="batch"), F.col("len"))


@query("b04_equal_counts", RECURSIVE + differenced_sql(ITEMS.format(COST), "4", equal=True) + PARTS.replace(" SELECT", f" SELECT least({BATCH}, (SELECT count(*) FROM b) - batch * {BATCH}) // 4 AS n,"))
def b04_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = P.workload(F.col("len"))
    df = P.partition(batches(spark, sf_dir), 4, size=cost, equal=True, batch="batch")
    counts = df.groupBy("batch", "part").agg(F.count("*").alias("n")).groupBy("batch").agg(F.max("n").alias("n"), F.min("n").alias("least")).filter("n = least").select("batch", "n")
    return loads(df, cost).join(counts, "batch")


@query("b03_greedy", RECURSIVE + f"""od AS (SELECT row_id // {BATCH} AS batch, list(len ORDER BY row_id) AS s FROM b GROUP BY 1),
    go(batch, s, i, v, p) AS (SELECT batch, s, 0::BIGINT, list_transform(range(7), lambda z: 0::BIGINT), NULL::BIGINT FROM od UNION ALL
        SELECT batch, s, i + 1, list_transform(range(1, 8), lambda j: v[j] + CASE WHEN j = spot THEN s[i + 1] ELSE 0 END), spot - 1 FROM (SELECT *, list_position(v, list_min(v))::BIGINT AS spot FROM go WHERE i < len(s)))
    SELECT batch * {BATCH} + i - 1 AS row_id, p AS part FROM go WHERE i > 0""")
def b03_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.partition_greedily(batches(spark, sf_dir), 7, size=F.col("len"), batch="batch").select("row_id", F.col("part").cast("long").alias("part"))


#: Customers by their first order, in batches of 60; the last batch is filled up with customers that have no tokens.
GROUPS = ", g AS (SELECT uid, sum(len)::BIGINT AS s, min(row_id) AS f FROM b GROUP BY uid), r AS (SELECT s, f, row_number() OVER (ORDER BY f) - 1 AS i FROM g), e AS (SELECT count(*) AS n FROM r), p AS (SELECT s, f, i FROM r UNION ALL SELECT 0, 1000000000 + k, n + k FROM e, range(59) q(k) WHERE k < (60 - n % 60) % 60)"


@query("b04_whole_table", ROWS + ", n AS (SELECT count(*) // 8 * 8 AS n FROM b) SELECT p AS part, n // 8 AS rows, true AS near FROM n, range(8) r(p)")
def b04_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows are one batch: as many in each part, and loads that are no further apart than the largest row's."""
    df = rows(spark, sf_dir)
    df = df.filter(F.col("row_id") < F.floor(df.agg(F.count("*")).scalar() / 8) * 8)
    cost = P.workload(F.col("len"))
    loaded = P.partition(df, 8, size=cost, equal=True).groupBy("part").agg(F.count("*").alias("rows"), F.sum(cost).alias("load"), F.max(cost).alias("largest"))
    ends = loaded.agg((F.max("load") - F.min("load") <= F.max("largest")).alias("near"))
    return loaded.select(F.col("part").cast("long").alias("part"), "rows", ends.scalar().alias("near"))


@query("b05_groups_stay_together", RECURSIVE.removesuffix(", ") + GROUPS + ", " + differenced_sql("SELECT i // 60 AS batch, s, f FROM p", "6", equal=True) + PARTS.replace("AS load", "AS load, 10::BIGINT AS groups"))
def b05_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir)
    ranked = with_dense_id(df.groupBy("uid").agg(F.min("row_id").alias("f")), ["f"], out="i").drop("f")
    numbered = df.join(ranked, "uid").select("row_id", "len", "i")
    end = numbered.agg(F.max("i").alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(58)))).filter("k < (60 - (n + 1) % 60) % 60")
    filled = numbered.unionByName(end.select((F.col("k") + 1_000_000_000).alias("row_id"), F.lit(0).cast("long").alias("len"), (F.col("n") + 1 + F.col("k")).alias("i")))
    out = P.partition_groups(filled.withColumn("batch", F.expr("i div 60")), 6, size=F.col("len"), by="i", batch="batch")
    groups = out.groupBy("batch", "i").agg(F.min("part").alias("part"), F.max("part").alias("last"), F.sum("len").alias("len"))
    counted = groups.groupBy("batch", "part").agg(F.count_if(F.col("part") == F.col("last")).alias("groups")).groupBy("batch").agg(F.min("groups").alias("groups"))
    return loads(groups, F.col("len")).join(counted, "batch")


MICRO = "least(n, ceil(ceil(tokens / 2e4) / 2) * 2)"
#: Parts by falling load: every other one backwards, then those between them.
MIDDLE = " SELECT batch, unnest(range(len(v)))::BIGINT AS rank, unnest(list_reverse(list_filter(v, lambda x, j: j % 2 = 1)) || list_filter(v, lambda x, j: j % 2 = 0))::BIGINT AS load FROM done"


@query("b06_micro_batches", RECURSIVE + differenced_sql(ITEMS.format(COST), MICRO.replace("tokens", "(SELECT sum(len) FROM b WHERE row_id // 128 = od.batch)")) + MIDDLE)
def b06_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = P.micro_batches(batches(spark, sf_dir), length="len", most_tokens=20_000, multiple=2, batch="batch")
    return loads(df, P.workload(F.col("len")), "part")


@query("b07_prepare_and_restore", ROWS + f", m AS (SELECT row_id // {BATCH} AS batch, least(count(*), ceil(sum(len) / 2e4))::BIGINT AS parts FROM b GROUP BY 1) SELECT row_id, len, parts FROM b JOIN m ON row_id // {BATCH} = batch")
def b07_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order of their micro-batches, then back by the inverse of that order."""
    df = P.micro_batches(batches(spark, sf_dir), length="len", most_tokens=20_000, batch="batch")
    prepared = with_dense_id(df, ["batch", "part", "row_id"], out="place")
    back = prepared.select("place", "row_id")
    parts = prepared.groupBy("batch").agg(F.count_distinct("part").alias("parts"))
    return prepared.select("place", "len", "batch").join(back, "place").join(parts, "batch").select("row_id", "len", "parts")


@query("b10_balance_batch", RECURSIVE + differenced_sql(ITEMS.format(COST), "4", equal=True) + PARTS.replace(" SELECT", f" SELECT least({BATCH}, (SELECT count(*) FROM b) - batch * {BATCH}) // 4 AS n,"))
def b10_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are stretches of the new ids, each with its smallest row at one end and its second at the other."""
    df = P.balance_batch(batches(spark, sf_dir), 4, length="len", batch="batch")
    cost, part = P.workload(F.col("len")), ["batch", "part"]
    by_place = Window.partitionBy(*part).orderBy("row_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = df.withColumns({"head": F.first("len").over(by_place), "foot": F.last("len").over(by_place)})
    sums = ends.groupBy(*part).agg(F.sum(cost).alias("load"), F.count("*").alias("n"), (F.max("row_id") - F.min("row_id") + 1).alias("width"), F.sort_array(F.collect_list("len")).alias("sorted"), F.first("head").alias("head"), F.first("foot").alias("foot"))
    sound = (F.col("width") == F.col("n")) & (F.col("head") == F.col("sorted")[0]) & (F.col("foot") == F.col("sorted")[1])
    return sums.filter(sound).select("batch", F.col("part").cast("long").alias("rank"), F.col("load").cast("long").alias("load"), "n")


@query("b11_integers", "SELECT n_nationkey, CAST(ceil(c / 7e0) AS BIGINT) AS ceil, CAST(ceil(c / 4e0) * 4 AS BIGINT) AS round, lcm(lcm(c % 12 + 1, s % 8 + 1), 6)::BIGINT AS multiple FROM (SELECT n_nationkey, count(*) AS c FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS s FROM supplier GROUP BY 1) USING (n_nationkey)")
def b11_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of nations' batches: workers and mini-batches by their customers and suppliers."""
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    both = customers.join(table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("s")), "n_nationkey")
    multiple = P.batch_multiple_of(F.col("c") % 12 + 1, [F.col("s") % 8 + 1, F.lit(6)])
    return both.select("n_nationkey", F.ceil(F.col("c") / 7).alias("ceil"), (F.ceil(F.col("c") / 4) * 4).alias("round"), multiple.alias("multiple"))


@query("b12_dispatch_and_gather", ROWS + " SELECT row_id, uid, len FROM b")
def b12_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.gather(P.DISPATCH["dp_compute_proto"](rows(spark, sf_dir), 7))


@query("b12_broadcast", ROWS + " SELECT row_id, CAST(w AS INT) AS worker FROM b, range(3) r(w)")
def b12_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.DISPATCH["one_to_all"](rows(spark, sf_dir), 3).select("row_id", "worker")


@query("b13_shared_prefixes", ROWS + " SELECT count(DISTINCT uid) AS prompts, count(*) AS n FROM b")
def b13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir).withColumn("prompt", F.concat(F.lit("p"), F.col("uid")))
    prompts, rest = P.shared_prefixes(df)
    return rest.join(prompts, "uid").agg(F.count_distinct("prompt").alias("prompts"), F.count("*").alias("n"))


@query("g30_imbalance", ROWS + ", c AS (SELECT row_id % 5 AS p, row_id // 100 AS k, len FROM b), x AS (SELECT sum(len) AS s FROM c GROUP BY k), y AS (SELECT sum(len) AS s FROM c GROUP BY p) " + " UNION ALL ".join(f"SELECT 'global_seqlen/{k}' AS metric, round({v}, 6) + 0.0 AS value FROM {t}" for k, v, t in (("min", "min(s)", "x"), ("max", "max(s)", "x"), ("minmax_diff", "max(s) - min(s)", "x"), ("balanced_min", "min(s)", "y"), ("balanced_max", "max(s)", "y"), ("mean", "avg(s)", "y"))))
def g30_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir).withColumns({"part": F.col("row_id") % 5, "chunk": F.expr("row_id div 100")})
    return M.imbalance(df, length="len", part="part", chunk="chunk").select("metric", rounded("value").alias("value"))


# Streams
def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "purchase", "get").otherwise("put")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("queue"), "event_id", op.alias("op"))


@query("t01_bounded_queue", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id DESC) AS k FROM events) WHERE k <= 10")
def t01_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    puts = operations(spark, sf_dir).withColumn("op", F.lit("put"))
    return Q.bounded_queue(puts, 10, by="queue", order=["event_id"]).filter("fate = 'queued'").select("event_id")


@query("t01_newest", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def t01_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.newest(table(spark, sf_dir, "events").select("event_id", "ts"), 100, order=["ts", "event_id"]).select("event_id")


G34 = """WITH RECURSIVE e AS (SELECT user_id % 8 AS q, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS i, event_type = 'purchase' AS is_get FROM events), n AS (SELECT q, count(*) AS n FROM e GROUP BY q),
    go(q, i, size, consumed, dropped, puts) AS (SELECT q, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM n UNION ALL
        SELECT go.q, e.i, CASE WHEN is_get THEN greatest(size - 1, 0) ELSE least(size + 1, 10) END, consumed + CASE WHEN is_get AND size > 0 THEN 1 ELSE 0 END, dropped + CASE WHEN NOT is_get AND size = 10 THEN 1 ELSE 0 END, puts + CASE WHEN is_get THEN 0 ELSE 1 END FROM go JOIN e ON e.q = go.q AND e.i = go.i + 1)
    SELECT sum(puts)::BIGINT AS total_produced, sum(consumed)::BIGINT AS total_consumed, sum(dropped)::BIGINT AS dropped_samples, sum(size)::BIGINT AS queue_size FROM go JOIN n ON n.q = go.q AND go.i = n.n"""


@query("g34_queue_stats", G34)
def g34_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.queue_stats(Q.bounded_queue(operations(spark, sf_dir), 10, by="queue", order=["event_id"]))


@query("t04_count_windows", "SELECT CAST(k // 50 AS BIGINT) AS \"window\", count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS k, count(*) OVER () AS n FROM events) WHERE k // 50 < n // 50 GROUP BY 1")
def t04_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Q.count_windows(table(spark, sf_dir, "events").select("event_id", "ts", "value"), 50, order=["ts", "event_id"])
    return w.groupBy("window").agg(F.count("*").alias("n"), rounded(F.sum("value")).alias("total"))


@query("t03_assemble", "SELECT CAST(k // 100 AS BIGINT) AS \"window\", count(*) AS items, round(quantile_cont(value, 0.95), 6) + 0.0 AS tp95, count(DISTINCT event_id % 5) AS versions FROM (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS k, count(*) OVER () AS n FROM events) WHERE k // 100 < n // 100 GROUP BY 1")
def t03_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.col("value").alias("seconds"), F.lit(0.0).alias("tools"), (F.col("event_id") % 5).alias("max_global_steps"), F.lit(0).alias("min_global_steps"))
    out = Q.assemble(Q.count_windows(e, 100, order=["ts", "event_id"]), seconds="seconds", tool_seconds="tools")
    return out.select("window", "items", rounded(F.col("`processing_time/tp95`")).alias("tp95"), "versions")


TAGS = "WITH p AS (SELECT o_orderkey AS uid, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'running' ELSE 'failure' END AS status, CAST(o_orderkey % 12 AS BIGINT) AS global_steps FROM orders)"


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "O", "running").otherwise("failure")
    now = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.lit(True).alias("is_prompt"), status.alias("status"), (F.col("o_orderkey") % 12).alias("global_steps"), F.lit(2).alias("version"))
    old = now.withColumns({"status": F.lit("pending"), "version": F.lit(1)})
    return Y.latest(now.unionByName(old))


@query("t05_latest_status", TAGS + " SELECT status, count(*) AS n FROM p GROUP BY status")
def t05_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("t06_readiness", TAGS + " SELECT count(CASE WHEN status <> 'running' THEN 1 END) >= 50 AND count(CASE WHEN status = 'running' AND (11 - global_steps + 1) >= 12 THEN 1 END) = 0 AS ready, count(CASE WHEN status <> 'running' THEN 1 END) AS done, count(CASE WHEN status = 'running' AND (11 - global_steps + 1) >= 12 THEN 1 END) AS waiting_for FROM p")
def t06_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.ready(prompts(spark, sf_dir), batch=50, now=11, threshold=12)


@query("f10_staleness_drop", TAGS + " SELECT uid FROM p WHERE NOT (status <> 'running' AND (11 - global_steps + 1) / 2e0 > 3)")
def f10_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.drop_stale(prompts(spark, sf_dir), now=11, threshold=3, sync=2)[0].select("uid")


@query("t07_dropped_counts", TAGS + " SELECT count(CASE WHEN status <> 'running' AND (11 - global_steps + 1) / 2e0 > 3 THEN 1 END) AS dropped, count(*) - count(CASE WHEN status <> 'running' AND (11 - global_steps + 1) / 2e0 > 3 THEN 1 END) AS kept FROM p")
def t07_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.drop_stale(prompts(spark, sf_dir), now=11, threshold=3, sync=2)[1]


@query("t08_oldest_first", TAGS + " SELECT l_orderkey AS uid, l_linenumber AS line FROM lineitem WHERE l_orderkey IN (SELECT uid FROM p WHERE status = 'finished' ORDER BY global_steps, uid LIMIT 40)")
def t08_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("line"))
    return Y.sample(prompts(spark, sf_dir), lines, batch=40)


@query("t09_back_pressure", "SELECT event_id, (event_id % 20 >= 15) OR (user_id % 9 >= 8) AS pause FROM events")
def t09_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", Q.should_pause(F.col("event_id") % 20, F.col("user_id") % 9, max_queue=15, max_required=8).alias("pause"))


@query("t10_capacity", "SELECT c_custkey, m AS max_required_samples, m AS max_queue_size, CAST(least(16 * (c_nationkey % 5 + 1), m) AS INT) AS max_concurrent_samples FROM (SELECT *, CAST(floor((c_custkey % 90 + 1) * (c_nationkey % 4 * 25e-2 + 1) * (c_custkey % 3 + 1)) AS INT) AS m FROM customer)")
def t10_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    sizes = Q.queue_capacities(required=key % 90 + 1, staleness=nation % 4 * 0.25, sync=key % 3 + 1, replicas=nation % 5 + 1)
    return table(spark, sf_dir, "customer").select("c_custkey", sizes.alias("q")).select("c_custkey", "q.*")


@query("t11_staleness_reset", "SELECT event_id, event_id % 7 + user_id % 5 AS stale FROM events")
def t11_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", Q.staleness_after_sync(F.col("event_id") % 7, F.col("user_id") % 5).alias("stale"))


@query("t12_version_span", "SELECT o_custkey AS uid, min(o_orderkey % 12) AS first, max(o_orderkey % 12 + 1) AS last FROM orders GROUP BY 1")
def t12_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), (F.col("o_orderkey") % 12).alias("min_global_steps"), (F.col("o_orderkey") % 12 + 1).alias("max_global_steps"))
    return Y.version_span(o)
