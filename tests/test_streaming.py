"""Streams that run to their end: a bounded queue with state, a drain, and micro-batches into a replay buffer."""

import pandas as pd
from pyspark.sql import functions as F

from tidemill.streaming import queues as Q


def test_queue_fates(spark):
    ops = "p p p g p p p g g g g".split()
    rows = [("q", k, {"p": "put", "g": "get"}[o]) for k, o in enumerate(ops)]
    found = Q.bounded_queue(spark.createDataFrame(rows, "queue string, at int, op string"), 2, by="queue", order=["at"])
    fate = [r["fate"] for r in found.orderBy("at").collect()]
    assert fate == ["dropped", "consumed", "dropped", "got", "dropped", "consumed", "consumed", "got", "got", "empty", "empty"]
    assert tuple(Q.queue_stats(found).first()) == (6, 3, 3, 0)


def test_stream_of_puts(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame(pd.DataFrame({"queue": ["a"] * 4 + ["b"], "item": [*range(part * 4, part * 4 + 4), part]})).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("queue string, item long").option("maxFilesPerTrigger", 1).parquet(source)
    seen: list = []
    query = Q.stream_queue(stream, 5, by="queue", item="item").writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {r["key"]: (r["dropped"], r["size"]) for r in seen}
    assert last == {"a": (7, 5), "b": (0, 3)}


def test_drain_reads_everything_and_stops(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    folder = str(tmp_path / "events")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(4).write.parquet(folder)
    counts: list[int] = []
    Q.drain(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), lambda df, _: counts.append(df.count()), str(tmp_path / "state"))
    assert sum(counts) == spark.read.parquet(folder).count() and len(counts) == 4


def test_count_windows_leave_the_rest(spark):
    df = spark.range(23).withColumnRenamed("id", "at")
    assert Q.count_windows(df, 5, order=["at"]).count() == 20
    kept = Q.count_windows(df, 5, order=["at"], keep_rest=True).groupBy("window").agg(F.count("*").alias("n"))
    assert {r["window"]: r["n"] for r in kept.collect()} == {0: 5, 1: 5, 2: 5, 3: 5, 4: 3}
