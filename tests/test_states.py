"""Queues of one hot key against plain simulation, and streams with state that are stopped, resumed and repeated."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tidemill.streaming import queues as Q
from tidemill.streaming import states as S


def simulate(ops, capacity):
    """Fates of (id, op) of one queue."""
    waiting, fate = deque(), {}
    for i, op in ops:
        if op == "put":
            if len(waiting) >= capacity:
                fate[waiting.popleft()] = "dropped"
            waiting.append(i)
        elif waiting:
            fate[waiting.popleft()] = "consumed"
            fate[i] = "got"
        else:
            fate[i] = "empty"
    return fate | dict.fromkeys(waiting, "queued")


@pytest.mark.parametrize("capacity,chunk,seed", [(1, 3, 1), (3, 4, 2), (5, 7, 3), (40, 16, 4), (3, 65_536, 5)])
def test_fates_of_hot_and_null_keys(spark, capacity, chunk, seed):
    rng, rows, want = random.Random(seed), [], {}
    keys = ["hot"] * 12 + [None, "a", "b"]
    for i in range(700):
        rows.append((rng.choice(keys), i, rng.choice(["put", "put", "get"]), "x", 5))
    for k in {r[0] for r in rows}:
        want |= simulate([(r[1], r[2]) for r in rows if r[0] == k], capacity)
    items = spark.createDataFrame(rows, "queue string, i long, op string, size string, at int").repartition(3)
    found = Q.bounded_queue(items, capacity, by="queue", order=["i"], chunk=chunk)
    assert found.columns == [*items.columns, "fate"]
    assert {r["i"]: r["fate"] for r in found.collect()} == want
    assert Q.bounded_queue(items.filter("i < 0"), capacity, by="queue", order=["i"]).count() == 0


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_queue_stream_resumes_where_it_stopped(spark, tmp_path):
    rng = random.Random(8)
    ops = [("q", i, rng.choice(["put", "put", "get"])) for i in range(90)]
    schema, source = "queue string, i long, op string", str(tmp_path / "in")
    for k in range(3):
        feed(spark, source, ops[k * 30 : k * 30 + 30], schema)
    stream = S.queue_fates(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), 4, by="queue", order=["i"])
    out = S.Batches(spark, str(tmp_path / "out"))
    assert not S.run(stream, out, str(tmp_path / "state"), stop_after=0)
    assert not S.run(stream, out, str(tmp_path / "state"), stop_after=1)
    assert S.run(stream, out, str(tmp_path / "state"))
    feed(spark, source, [("q", 90, "get"), ("r", 91, "get")], schema)
    assert S.run(stream, out, str(tmp_path / "state"))
    want = {i: f for i, f in simulate([(o[1], o[2]) for o in [*ops, ("q", 90, "get")]], 4).items() if f != "queued"} | {91: "empty"}
    rows = [(r["i"], r["fate"]) for r in out.read(S.schema_of(stream)).collect()]
    assert sorted(rows) == sorted(want.items())


def test_late_versions_and_timers(spark, tmp_path):
    schema, source = "uid long, status string, global_steps long, version long, ts timestamp", str(tmp_path / "in")
    day = lambda d: __import__("datetime").datetime(2024, 1, d)
    feed(spark, source, [(1, "running", 3, 2, day(1)), (1, "pending", 3, 1, day(1)), (2, "running", 4, 1, day(2))], schema)
    feed(spark, source, [(1, "pending", 9, 1, day(3)), (2, "finished", 4, 2, day(3)), (3, "pending", 5, 1, day(20))], schema)
    stream = S.prompt_changes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), patience_ms=5 * 86_400_000, delay="1 hour")
    out = S.Batches(spark, str(tmp_path / "out"))
    assert S.run(stream, out, str(tmp_path / "state"), mode="update")
    newest = out.read(S.PROMPT).groupBy("uid").agg(F.max_by("status", F.struct("version", "batch")).alias("status"), F.max_by("global_steps", F.struct("version", "batch")).alias("steps"))
    assert {tuple(r) for r in newest.collect()} == {(1, "failure", 3), (2, "finished", 4), (3, "pending", 5)}


def test_a_micro_batch_that_is_done_again_leaves_the_same(spark, tmp_path):
    sink = S.ReplaySink(spark, str(tmp_path), batch=2, threshold=3, now=lambda b: 5)
    change = lambda rows: spark.createDataFrame(rows, S.PROMPT)
    first = change([(1, "finished", 4, 1), (2, "finished", 5, 1), (3, "finished", 3, 1), (4, "finished", 0, 1), (5, "running", 5, 1)])
    sink(first, 0)
    sink(first, 0)
    second = change([(5, "finished", 5, 2), (6, "failure", 5, 1)])
    sink(second, 1)
    once = {tuple(r) for r in sink.emitted.read("uid long, global_steps long").collect()}
    sink(second, 1)
    assert {tuple(r) for r in sink.emitted.read("uid long, global_steps long").collect()} == once == {(3, 3, 0), (1, 4, 0), (2, 5, 1), (5, 5, 1)}


def test_waiting_for_one_in_flight(spark, tmp_path):
    sink = S.ReplaySink(spark, str(tmp_path), batch=1, threshold=3, now=lambda b: 5)
    sink(spark.createDataFrame([(1, "finished", 4, 1), (2, "running", 3, 1)], S.PROMPT), 0)
    assert sink.emitted.read("uid long, global_steps long").count() == 0
    sink(spark.createDataFrame([(2, "failure", 3, 2)], S.PROMPT), 1)
    assert [r["uid"] for r in sink.emitted.read("uid long, global_steps long").collect()] == [1]


def test_prompts_share_state_and_timers(spark, tmp_path):
    """Few calls to the state: as many keys as there are groups, whatever the prompts; null ids are one prompt."""
    schema, source = "uid long, status string, global_steps long, version long, ts timestamp", str(tmp_path / "in")
    day = lambda d: __import__("datetime").datetime(2024, 1, d)
    feed(spark, source, [(k, "running", k, 1, day(1 + k % 3)) for k in range(600)] + [(None, "running", 7, 1, day(1))], schema)
    feed(spark, source, [(k, "finished", k, 2, day(4)) for k in range(0, 600, 2)] + [(1, "pending", 1, 0, day(4))], schema)
    feed(spark, source, [(9000, "finished", 0, 1, day(8)), (3, "pending", 3, 0, day(8))], schema)
    stream = S.prompt_changes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), patience_ms=5 * 86_400_000, delay="1 hour", groups=4)
    out, keys = S.Batches(spark, str(tmp_path / "out")), []
    with_keys = lambda df, batch: (out(df, batch), keys.append(df.count()))
    assert not S.run(stream, with_keys, str(tmp_path / "state"), mode="update", stop_after=1)
    assert S.run(stream, with_keys, str(tmp_path / "state"), mode="update")
    newest = out.read(S.PROMPT).groupBy("uid").agg(F.max_by("status", F.struct("version", "batch")).alias("status"))
    found = {r["uid"]: r["status"] for r in newest.collect()}
    # The watermark comes to 23:00 of the 7th: prompts of the first two days have failed, those of the third wait.
    want = {k: "finished" if k % 2 == 0 else "failure" if k % 3 < 2 else "running" for k in range(600)} | {None: "failure", 9000: "finished"}
    assert found == want
    state = spark.read.format("statestore").option("stateVarName", "newest").load(str(tmp_path / "state"))
    assert state.count() <= 6


def test_prompts_without_timers_are_an_aggregate(spark):
    tags = spark.readStream.format("rate").load().selectExpr("value AS uid", "'running' AS status", "value AS global_steps", "value AS version", "timestamp AS ts")
    plan = S.prompt_changes(tags)._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan


def test_micro_batches_of_many_files(spark, tmp_path):
    """A micro-batch's rows are in as many files as they need, not in one task's."""
    from tidemill.plans.queries_streams import arriving

    stream = arriving(spark.range(103).withColumnRenamed("id", "at"), ["at"], 3, rows=10)
    seen = {}
    S.run(stream, lambda df, batch: seen.update({batch: sorted(r["at"] for r in df.collect())}), str(tmp_path / "state"))
    assert {b: (rows[0], rows[-1], len(rows)) for b, rows in seen.items()} == {0: (0, 34, 35), 1: (35, 69, 35), 2: (70, 102, 33)}


def test_windows_of_hot_and_null_keys_over_micro_batches(spark, tmp_path):
    """A window comes out whole and once; keys without news keep what waits; no task gets a key's items."""
    rng, rows = random.Random(3), []
    for i in range(300):
        rows.append((rng.choice(["hot"] * 8 + [None, "a"]) if i < 200 else "hot", i))
    schema, source = "k string, i long", str(tmp_path / "in")
    for part in (rows[:100], rows[100:200], rows[200:]):
        feed(spark, source, rng.sample(part, len(part)), schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    sink = S.WindowSink(spark, str(tmp_path / "out"), 7, by="k", order=["i"])
    assert not S.run(stream, sink, str(tmp_path / "state"), stop_after=1)
    assert S.run(stream, sink, str(tmp_path / "state"))
    feed(spark, source, [("a", 300), (None, 301)], schema)
    assert S.run(stream, sink, str(tmp_path / "state"))
    want = set()
    for k in ("hot", None, "a"):
        mine = [i for key, i in [*rows, ("a", 300), (None, 301)] if key == k]
        want |= {(k, i, n // 7) for n, i in enumerate(mine) if n // 7 < len(mine) // 7}
    found = [(r["k"], r["i"], r["window"]) for r in sink.windows.read(f"{schema}, window long").collect()]
    assert len(found) == len(want) and set(found) == want
