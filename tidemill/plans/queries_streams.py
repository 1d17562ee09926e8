"""Queries over streams: tables that arrive file by file, a run that is stopped inside, and another that goes on after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.batch import with_dense_id
from tidemill.plans.catalog import query
from tidemill.plans.fixtures import rounded, table
from tidemill.sources.storage import work_path
from tidemill.streaming import queues as Q
from tidemill.streaming import states as S


def arriving(df: DataFrame, order: list[str], files: int, rows: int = 1_000_000) -> DataFrame:
    """``df`` as a stream of ``files`` folders' worth of rows in order, one a micro-batch, in files of ``rows`` rows at most."""
    spark = df.sparkSession
    path = work_path(spark, "arriving")
    placed, n = with_dense_id(df, order, "arrives_at"), df.count()
    size = max(1, -(-n // files))
    each = -(-size // rows)  # files of a micro-batch; only the last can have fewer
    for k in range(files):
        part = placed.filter(F.col("arrives_at").between(k * size, (k + 1) * size - 1))
        of = F.expr(f"(arrives_at - {k * size}) div {rows}").cast("int")
        part = part.repartitionById(each, of) if each > 1 else part.coalesce(1)
        part.drop("arrives_at").write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


def stopped_and_resumed(stream: DataFrame, sink: S.Sink, stop_after: int, mode: str = "append") -> None:
    """A run that fails after a micro-batch's sink, and one that goes on from the checkpoint and comes to the end."""
    checkpoint = work_path(stream.sparkSession, "stream-state")
    ended = S.run(stream, sink, checkpoint, mode=mode, stop_after=stop_after)
    if ended or not S.run(stream, sink, checkpoint, mode=mode):
        raise RuntimeError("the stream wasn't stopped and resumed")


def collected(stream: DataFrame, schema: str, stop_after: int = 1, mode: str = "append") -> DataFrame:
    """What a stopped and resumed stream has written."""
    out = S.Batches(stream.sparkSession, work_path(stream.sparkSession, "stream-rows"))
    stopped_and_resumed(stream, out, stop_after, mode)
    return out.read(schema)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "purchase", "get").otherwise("put")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("queue"), "event_id", "ts", "value", op.alias("op"))


def fates_sql(key: str, order: str, capacity: int) -> str:
    """Fates of puts and gets by going through each queue's operations one by one; items that wait are ``queued``."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT {key} AS q, event_id, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS i, event_type = 'purchase' AS is_get FROM events),
  go(q, i, size, puts, outs, event_id, is_get, gone) AS (SELECT DISTINCT q, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BOOLEAN, NULL::BOOLEAN FROM e UNION ALL
   SELECT e.q, e.i, CASE WHEN e.is_get THEN greatest(size - 1, 0) ELSE least(size + 1, {capacity}) END, puts + (NOT e.is_get)::BIGINT, outs + CASE WHEN e.is_get THEN size > 0 ELSE size = {capacity} END::BIGINT, e.event_id, e.is_get, CASE WHEN e.is_get THEN size > 0 ELSE size = {capacity} END FROM go JOIN e ON e.q = go.q AND e.i = go.i + 1),
  f AS (SELECT event_id, CASE WHEN go.is_get THEN CASE WHEN gone THEN 'got' ELSE 'empty' END WHEN r.r_get IS NULL THEN 'queued' WHEN r.r_get THEN 'consumed' ELSE 'dropped' END AS fate
    FROM go LEFT JOIN (SELECT q AS r_q, outs AS k, is_get AS r_get FROM go WHERE gone) r ON NOT go.is_get AND r.k = go.puts AND r_q = q WHERE i > 0)
  SELECT event_id, fate FROM f"""


@query("t01_one_queue", fates_sql("0", "ts, event_id", 100))
def t01_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events are of one queue."""
    items = events(spark, sf_dir).withColumn("queue", F.lit(0))
    return Q.bounded_queue(items, 100, by="queue", order=["ts", "event_id"]).select("event_id", "fate")


@query("t02_queue_stream", fates_sql("user_id % 8", "ts, event_id", 10) + " WHERE fate <> 'queued'")
def t02_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = S.queue_fates(arriving(events(spark, sf_dir), ["ts", "event_id"], 4), 10, by="queue", order=["ts", "event_id"])
    return collected(stream, S.schema_of(stream)).select("event_id", "fate")


@query("t02_drain", "SELECT event_id, user_id % 8 AS queue FROM events")
def t02_drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that has arrived is read and written before the stream ends."""
    items = events(spark, sf_dir).select("event_id", "queue", "ts")
    out = S.Batches(spark, work_path(spark, "drained"))
    Q.drain(arriving(items, ["ts", "event_id"], 3), out, work_path(spark, "stream-state"))
    return out.read(S.schema_of(items)).select("event_id", "queue")


PLACED = "SELECT *, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id % 3) AS n FROM events"


@query("t04_windows_stream", f'SELECT user_id % 3 AS trainer, CAST(k // 50 AS BIGINT) AS "window", count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM ({PLACED}) WHERE k // 50 < n // 50 GROUP BY 1, 2')
def t04_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("trainer"), "event_id", "ts", "value")
    sink = S.WindowSink(spark, work_path(spark, "windows"), 50, by="trainer", order=["ts", "event_id"])
    stopped_and_resumed(arriving(items, ["ts", "event_id"], 3), sink, 1)
    rows = sink.windows.read(f"{S.schema_of(items)}, window long")
    return rows.groupBy("trainer", "window").agg(F.count("*").alias("n"), rounded(F.sum("value")).alias("total"))


@query("t03_assemble_stream", "SELECT CAST(k // 100 AS BIGINT) AS \"window\", count(*) AS items, round(quantile_cont(value, 0.95), 6) + 0.0 AS tp95, count(DISTINCT event_id % 5) AS versions FROM (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS k, count(*) OVER () AS n FROM events) WHERE k // 100 < n // 100 GROUP BY 1")
def t03_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows come out whole, so each micro-batch assembles its own."""
    items = table(spark, sf_dir, "events").select(F.lit(0).alias("trainer"), "event_id", "ts", F.col("value").alias("seconds"), F.lit(0.0).alias("tools"), (F.col("event_id") % 5).alias("max_global_steps"), F.lit(0).alias("min_global_steps"))
    shape = lambda df: Q.assemble(df, seconds="seconds", tool_seconds="tools").select("window", "items", rounded(F.col("`processing_time/tp95`")).alias("tp95"), "versions")
    sink = S.WindowSink(spark, work_path(spark, "windows"), 100, by="trainer", order=["ts", "event_id"], shape=shape)
    stopped_and_resumed(arriving(items, ["ts", "event_id"], 3), sink, 1)
    return sink.windows.read("window long, items long, tp95 double, versions long").drop("batch")


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'running' ELSE 'failure' END"


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tags of each order as a prompt: pending on its day, its status ten days later."""
    day = F.col("o_orderdate").cast("timestamp")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.expr(STATUS).alias("last"), (F.col("o_orderkey") % 12).alias("global_steps"), day.alias("day"))
    first = orders.select("uid", F.lit("pending").alias("status"), "global_steps", F.lit(1).cast("long").alias("version"), F.col("day").alias("ts"))
    then = orders.select("uid", F.col("last").alias("status"), "global_steps", F.lit(2).cast("long").alias("version"), (F.col("day") + F.expr("INTERVAL 10 DAYS")).alias("ts"))
    return first.unionByName(then)


@query("t05_status_stream", f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN s = 'running' AND o_orderdate + INTERVAL 40 DAY < (SELECT max(o_orderdate) FROM orders) + INTERVAL 10 DAY - INTERVAL 1 HOUR THEN 'failure' ELSE s END AS status FROM (SELECT o_orderdate, {STATUS} AS s FROM orders)) GROUP BY status")
def t05_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt that runs for 30 days without a tag has failed, by a timer on the time of the tags."""
    stream = S.prompt_changes(arriving(tags(spark, sf_dir), ["ts", "uid", "version"], 3), patience_ms=30 * 86_400_000, delay="1 hour")
    changes = collected(stream, S.PROMPT, mode="update")
    newest = changes.groupBy("uid").agg(F.max_by("status", F.struct("version", "batch")).alias("status"))
    return newest.groupBy("status").agg(F.count("*").alias("n"))


def _replay_sql(files: int, batch: int, threshold: int) -> str:
    """What each micro-batch emits, from the orders that have come by then less those emitted before."""
    ctes = [f"p AS (SELECT o_orderkey AS uid, {STATUS} AS status, CAST(o_orderkey % 12 AS BIGINT) AS steps, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)"]
    taken = "SELECT NULL::BIGINT AS uid WHERE false"
    for k in range(files):
        # All statuses are known at once: in flight and as stale as the threshold blocks; done and staler is dropped.
        stale = f"{k} + 12 - steps + 1"
        ctes.append(f"q{k} AS (SELECT uid, status, steps FROM p WHERE k // ((n + {files - 1}) // {files}) <= {k} AND NOT (status <> 'running' AND {stale} > {threshold}) AND uid NOT IN ({taken}))")
        ctes.append(f"e{k} AS (SELECT uid, steps FROM q{k} WHERE status = 'finished' AND (SELECT count(*) FILTER (status <> 'running') >= {batch} AND count(*) FILTER (status = 'running' AND {stale} >= {threshold}) = 0 FROM q{k}) ORDER BY steps, uid LIMIT {batch})")
        taken = " UNION ALL ".join(f"SELECT uid FROM e{j}" for j in range(k + 1))
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT {k} AS batch, uid, steps AS global_steps FROM e{k}" for k in range(files))


@query("t08_replay_stream", _replay_sql(3, 40, 15))
def t08_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of the oldest finished prompts as orders come in; a batch needs 40 that are done and none in flight that is too old."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.expr(STATUS).alias("status"), (F.col("o_orderkey") % 12).alias("global_steps"), F.lit(2).cast("long").alias("version"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    stream = S.prompt_changes(arriving(orders, ["ts", "uid"], 3))
    sink = S.ReplaySink(spark, work_path(spark, "replay"), batch=40, threshold=15, now=lambda batch: batch + 12)
    stopped_and_resumed(stream, sink, 1, "update")
    return sink.emitted.read("uid long, global_steps long").select("batch", "uid", "global_steps")
