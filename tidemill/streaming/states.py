"""Streams with state that outlives the program: bounded queues, count windows and prompts, and sinks that can be repeated.

State is kept per key by ``transformWithStateInPandas`` in checkpointed stores (list and value state, event-time timers),
so a stream that was stopped goes on where its checkpoint says. The micro-batch in which it stopped is done again; sinks
write a micro-batch's rows under its number and overwrite what is there, so nothing is there twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.functions.names import fresh
from tidemill.operators.batch import with_dense_id
from tidemill.sources.storage import drop_stored_since, stored, stored_tables
from tidemill.streaming import replay

Sink = Callable[[DataFrame, int], None]
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STOPPED = "stopped after micro-batch"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting while a query starts, which takes a copy of all settings."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def run(stream: DataFrame, sink: Sink, checkpoint: str, *, mode: str = "append", stop_after: int | None = None) -> bool:
    """Run a stream over all that is there, from where its checkpoint says; whether it came to the end.

    With ``stop_after`` it fails once that micro-batch's sink is done but before the micro-batch is committed, as a lost
    driver would.
    """

    def each(df: DataFrame, batch: int) -> None:
        sink(df, batch)
        if batch == stop_after:
            raise RuntimeError(f"{_STOPPED} {batch}")

    with _setting(stream.sparkSession, "spark.sql.streaming.stateStore.providerClass", STORE):
        query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as error:
        if _STOPPED not in str(error):
            raise
        return False
    return True


class Batches:
    """A table of micro-batches: each is written under its number, over what a stopped run may have left there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __call__(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self, schema: str, before: int | None = None) -> DataFrame:
        """All rows, or those of micro-batches before one, with ``batch``."""
        rows = self.spark.read.schema(f"{schema}, batch int").parquet(self.path)
        return rows if before is None else rows.filter(F.col("batch") < before)


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame.from_records(rows, columns=columns)


def _plain(row: tuple) -> tuple:
    """A row of a frame as state takes it: Python's own numbers, None for what is missing."""
    return tuple(None if x is None or x is pd.NaT or x != x else x.item() if hasattr(x, "item") else x for x in row)


class QueueProcessor(StatefulProcessor):
    """Puts and gets of one queue: the items that wait are a list, in the order of ``order`` within a micro-batch."""

    def __init__(self, schema: str, columns: list[str], capacity: int, order: list[str], kind: str):
        self.schema, self.columns, self.capacity, self.order, self.kind = schema, columns, capacity, order, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        out, at = [], self.columns.index(self.kind)
        arrived = pd.concat(list(rows)).sort_values(self.order, kind="stable")[self.columns]
        head = 0
        for row in map(_plain, arrived.itertuples(index=False, name=None)):
            size = len(waiting) - head
            if row[at] == "put":
                if size >= self.capacity:
                    out.append((*waiting[head], "dropped"))
                    head += 1
                waiting.append(row)
            elif size:
                out += [(*waiting[head], "consumed"), (*row, "got")]
                head += 1
            else:
                out.append((*row, "empty"))
        self.waiting.put(waiting[head:]) if len(waiting) > head else self.waiting.clear()
        yield _frame(out, [*self.columns, "fate"])

    def close(self) -> None:
        pass


def queue_fates(stream: DataFrame, capacity: int, *, by: str, order: list[str], kind: str = "op") -> DataFrame:
    """``queues.bounded_queue`` over a stream: items and gets with their fates once these are settled; the rest waits in state."""
    processor = QueueProcessor(schema_of(stream), stream.columns, capacity, order, kind)
    return stream.groupBy(by).transformWithStateInPandas(processor, f"{schema_of(stream)}, fate string", "Append", "None")


PROMPT = "uid long, status string, global_steps long, version long"
PROMPT_COLUMNS = ["uid", "status", "global_steps", "version"]
#: Groups of prompts with timers that share state; each is a task's call a micro-batch.
PROMPT_GROUPS = 1024
#: The deadline of a prompt that isn't in flight.
NEVER = 2**63 - 1


class PromptProcessor(StatefulProcessor):
    """The newest status of a group of prompts. Older versions that come late change nothing. One that is still in flight when
    the watermark has passed ``patience`` after its newest tag has failed.

    A group's prompts are one value, a table in Arrow's format, and its timer is that of the earliest deadline: a call to
    the state for each prompt costs far more than the prompt.
    """

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "prompts binary")
        self.timer = handle.getValueState("timer", "at long")

    def _known(self) -> pd.DataFrame:
        return pa.ipc.open_stream(self.newest.get()[0]).read_pandas()

    def _keep(self, known: pd.DataFrame) -> None:
        table = pa.Table.from_pandas(known, preserve_index=False)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            writer.write_table(table)
        self.newest.update((out.getvalue().to_pybytes(),))
        at = int(known["deadline"].min())
        before = self.timer.get()[0] if self.timer.exists() else NEVER
        if at == before:
            return
        if before != NEVER:
            self.handle.deleteTimer(before)
        if at == NEVER:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    @staticmethod
    def _changes(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[PROMPT_COLUMNS]
        return out if key[0] >= 0 else out.assign(uid=pd.array([None] * len(out), "Int64"))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tags = pd.concat(list(rows))
        at = tags["at"].to_numpy("int64") + self.patience_ms
        tags = tags[PROMPT_COLUMNS].astype({"global_steps": "int64", "version": "int64"})
        tags = tags.assign(deadline=np.where(tags["status"].isin(replay.ACTIVE), at, NEVER), new=True)
        if self.newest.exists():
            tags = pd.concat([self._known().assign(new=False), tags])
        # Of equal versions and statuses the first that came stays.
        tags = tags.sort_values(["version", "status"], ascending=False, kind="stable").drop_duplicates("uid")
        changed = tags[tags["new"]]
        if len(changed):
            self._keep(tags.drop(columns="new"))
        yield self._changes(key, changed)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self._known()
        late = (known["deadline"] <= expiredTimerInfo.getExpiryTimeInMs()) | (known["deadline"] < timerValues.getCurrentWatermarkInMs())
        known.loc[late, "status"], known.loc[late, "deadline"] = "failure", NEVER
        self.timer.clear()  # it has gone off
        self._keep(known)
        yield self._changes(key, known[late])

    def close(self) -> None:
        pass


def prompt_changes(tags: DataFrame, *, patience_ms: int | None = None, delay: str = "0 seconds", groups: int = PROMPT_GROUPS) -> DataFrame:
    """Changes of prompts' newest status from a stream of tags (uid, status, global_steps, version, ts).

    Without ``patience_ms`` that is an aggregate of Spark's own; with it ``groups`` groups of prompts have timers, so there
    should be as many as keep a group's prompts well within a task.
    """
    if patience_ms is None:
        newest = F.max(F.struct("version", "status", "global_steps")).alias("newest")
        return tags.groupBy("uid").agg(newest).select("uid", "newest.status", "newest.global_steps", "newest.version")
    # Prompts without an id are one prompt, in a group of its own.
    group = F.when(F.col("uid").isNull(), -1).otherwise(F.pmod(F.xxhash64("uid"), F.lit(groups))).cast("long")
    timed = tags.withWatermark("ts", delay).select(group.alias("prompts"), F.coalesce("uid", F.lit(0)).cast("long").alias("uid"), "status", "global_steps", "version", F.unix_millis("ts").alias("at"), "ts")
    return timed.groupBy("prompts").transformWithStateInPandas(PromptProcessor(patience_ms), PROMPT, "Update", "EventTime")


class ReplaySink:
    """Changes of prompts to batches of the oldest finished ones: late ones are dropped, a batch is emitted when it is ready.

    Everything is written under a micro-batch's number and made of what earlier ones have left, so a micro-batch that is
    done again leaves the same. ``now`` gives the version at a micro-batch.
    """

    def __init__(self, spark: SparkSession, path: str, *, batch: int, threshold: float, sync: int = 1, now: Callable[[int], int] = lambda batch: batch):
        self.changes, self.emitted = Batches(spark, f"{path}/changes"), Batches(spark, f"{path}/emitted")
        self.batch, self.threshold, self.sync, self.now = batch, threshold, sync, now

    def pool(self, before: int) -> DataFrame:
        """The newest status of each prompt that no micro-batch before has emitted."""
        newest = F.struct("version", "batch")
        pool = self.changes.read(PROMPT, before).groupBy("uid").agg(F.max_by("status", newest).alias("status"), F.max_by("global_steps", newest).alias("global_steps"))
        return pool.join(self.emitted.read("uid long, global_steps long", before - 1), "uid", "left_anti") if before > 1 else pool

    def __call__(self, df: DataFrame, batch: int) -> None:
        self.changes(df, batch)
        kept, _ = replay.drop_stale(self.pool(batch + 1), now=self.now(batch), threshold=self.threshold, sync=self.sync)
        ready = replay.ready(kept, batch=self.batch, now=self.now(batch), threshold=self.threshold, sync=self.sync).first()["ready"]
        chosen = kept.filter("status = 'finished'").orderBy("global_steps", "uid").limit(self.batch if ready else 0)
        self.emitted(chosen.select("uid", "global_steps"), batch)


class WindowSink:
    """Items with the number of their window among those ``by`` key; a window comes out whole, in one micro-batch, as ``shape`` of it.

    Items have dense ids in their order, so a key that holds all items is spread over all tasks. What is left of a key's last
    window and how many windows it has had are written under the micro-batch's number, so one that is done again leaves
    the same.
    """

    def __init__(self, spark: SparkSession, path: str, size: int, *, by: str, order: list[str], shape: Callable[[DataFrame], DataFrame] = lambda df: df):
        self.windows, self.rest, self.done = Batches(spark, f"{path}/windows"), Batches(spark, f"{path}/rest"), Batches(spark, f"{path}/done")
        self.size, self.by, self.order, self.shape = size, by, order, shape

    def __call__(self, df: DataFrame, batch: int) -> None:
        mark = stored_tables()
        place, at, key, first, n, before = fresh(df, "place", "at", "key", "first", "n", "before")
        items, done = df.withColumn(place, F.lit(None).cast("long")), None
        if batch:
            last = F.col("batch") == batch - 1
            held = self.rest.read(f"{schema_of(df)}, `{place}` long").filter(last).drop("batch")
            done = self.done.read(f"{schema_of(df.select(F.col(self.by).alias('key')))}, windows long").filter(last).select(F.col("key").alias(key), F.col("windows").alias(before))
            items = items.unionByName(held)
        # What waited comes first.
        placed = with_dense_id(items, [self.by, F.col(place).asc_nulls_last(), *self.order], at)
        keys = placed.groupBy(F.col(self.by).alias(key)).agg(F.min(at).alias(first), F.count("*").alias(n))
        if done is None:
            keys = keys.withColumn(before, F.lit(0).cast("long"))
        else:
            known = done.withColumnRenamed(key, f"{key}_")
            keys = known.join(keys, F.col(key).eqNullSafe(F.col(f"{key}_")), "full")
            keys = keys.select(F.coalesce(key, f"{key}_").alias(key), F.coalesce(first, F.lit(0)).alias(first), F.coalesce(n, F.lit(0)).alias(n), F.coalesce(before, F.lit(0)).alias(before))
        keys = stored(keys, "window-keys")
        rows = placed.join(keys, F.col(self.by).eqNullSafe(F.col(key))).withColumn(place, F.col(at) - F.col(first))
        full = F.expr(f"`{n}` div {self.size}")
        whole = F.expr(f"`{place}` div {self.size}") < full
        self.windows(self.shape(rows.filter(whole).select(*df.columns, (F.col(before) + F.expr(f"`{place}` div {self.size}")).alias("window"))), batch)
        self.rest(rows.filter(~whole).select(*df.columns, place), batch)
        self.done(keys.select(F.col(key).alias("key"), (F.col(before) + full).alias("windows")), batch)
        drop_stored_since(mark)
