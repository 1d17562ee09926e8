"""A bounded first-in-first-out queue and count windows.

The queue's batch form is a parallel prefix over clamp functions, exact for keys of any size; ``states`` has the forms that
keep state over streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.names import fresh
from tidemill.operators.batch import with_dense_id
from tidemill.sources.storage import stored

#: Beyond every size of a queue.
WIDE = 1 << 40


def _compose(first: tuple, then: tuple) -> tuple:
    """The clamp function (d, low, high) of x -> min(high, max(low, x + d)) that does ``first`` and ``then``."""
    d, low, high = then
    return first[0] + d, np.clip(first[1] + d, low, high), np.clip(first[2] + d, low, high)


def _scan(d: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each operation the composition of all up to it: log n passes, each over all of them."""
    held, shift = [d, low, high], 1
    while shift < len(d):
        joined = _compose(tuple(x[:-shift] for x in held), tuple(x[shift:] for x in held))
        held = [np.concatenate([x[:shift], y]) for x, y in zip(held, joined, strict=True)]
        shift *= 2
    return tuple(held)


def clamped(steps: DataFrame, *, at: str, chunk: int = 65_536) -> DataFrame:
    """``at`` and ``size``, what 0 has become before each of a sequence of clamp functions (columns d, low, high; ``at`` is 0, 1, ...).

    Clamp functions compose to clamp functions, so chunks of them are composed by themselves, the chunks' functions by
    the same means, and a row's size follows from its chunk's first. No task holds more than a chunk.
    """

    def inside(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        d, low, high = (table.column(c).to_numpy() for c in ("d", "low", "high"))
        after = _scan(d, low, high)
        none = (np.int64(0), np.int64(-WIDE), np.int64(WIDE))
        before = [np.concatenate([[n], x[:-1]]) for n, x in zip(none, after, strict=True)]
        last = np.arange(len(d)) == len(d) - 1
        ends = [pa.array(x, pa.int64(), mask=~last) for x in after]
        return pa.table([table.column("chunk"), table.column("at"), *[pa.array(x, pa.int64()) for x in before], *ends], ["chunk", "at", "d", "low", "high", "end_d", "end_low", "end_high"])

    rows = steps.select(F.col(at).alias("at"), "d", "low", "high", F.expr(f"`{at}` div {chunk}").alias("chunk"))
    scanned = stored(rows.groupBy("chunk").applyInArrow(inside, "chunk long, at long, d long, low long, high long, end_d long, end_low long, end_high long"), "clamps")
    ends = scanned.filter("end_d is not null").select("chunk", F.col("end_d").alias("d"), F.col("end_low").alias("low"), F.col("end_high").alias("high"))
    moved = lambda start: F.least("high", F.greatest("low", start + F.col("d")))
    if ends.limit(2).count() < 2:
        return scanned.select(F.col("at").alias(at), moved(F.lit(0)).alias("size"))
    starts = clamped(ends, at="chunk", chunk=chunk).withColumnRenamed("size", "start")
    return scanned.join(starts, "chunk").select(F.col("at").alias(at), moved(F.col("start")).alias("size"))


def bounded_queue(items: DataFrame, capacity: int, *, by: str, order: list[str], kind: str = "op", chunk: int = 65_536) -> DataFrame:
    """What becomes of each "put" of a sequence of puts and gets (column ``op``) of queues ``by`` key: ``consumed``, ``dropped``
    (a later put found the queue full) or ``queued``, and for gets ``got`` or ``empty``.

    A put or get clamps the queue's size, so sizes come from a parallel prefix over clamp functions (``clamped``), a key's
    first operation being constant. First in, first out: the k-th item that leaves a queue is the k-th that was put, so
    puts meet what removes them by number. A key that holds all rows is spread over all tasks; a null key is a key.
    """
    columns = items.columns
    at, part, size, put, out, first, k, leaves = fresh(items, "at", "part", "size", "put", "out", "first", "k", "leaves")
    placed = with_dense_id(items, [by, *order], at).withColumn(part, F.expr(f"`{at}` div {chunk}"))
    starts = placed.groupBy(by).agg(F.min(at).alias(at)).select(at, F.lit(True).alias(first))  # a row for each key
    placed = stored(placed.join(starts, at, "left"), "queue")
    is_put = F.col(kind) == "put"
    after_none = F.when(is_put, min(1, capacity)).otherwise(0).cast("long")
    is_first = F.col(first).isNotNull()
    step = placed.select(at, F.when(is_put, 1).otherwise(-1).cast("long").alias("d"), F.when(is_first, after_none).otherwise(0).cast("long").alias("low"), F.when(is_first, after_none).otherwise(capacity).cast("long").alias("high"))
    sizes = clamped(step, at=at, chunk=chunk).withColumnRenamed("size", size)
    sized = placed.join(sizes, at).withColumn(size, F.when(F.col(first).isNotNull(), 0).otherwise(F.col(size)))
    sized = sized.withColumn(put, is_put.cast("int")).withColumn(out, F.when(is_put, F.col(size) >= capacity).otherwise(F.col(size) > 0).cast("int"))
    inside = Window.partitionBy(part, by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    numbered = stored(sized.withColumn(k, F.sum(put).over(inside)).withColumn(leaves, F.sum(out).over(inside)), "queue-numbered")
    # What a key's earlier chunks have put and removed.
    before = Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy(part, by).agg(F.sum(put).alias("p"), F.sum(out).alias("o"))
    counts = counts.select(F.col(part).alias("chunk_of"), F.col(by).alias("key_of"), F.coalesce(F.sum("p").over(before), F.lit(0)).alias("puts_before"), F.coalesce(F.sum("o").over(before), F.lit(0)).alias("outs_before"))
    plain = numbered.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(by).alias("key"), F.col(part).alias("chunk"), F.col(put).alias("put"), F.col(out).alias("out"), F.col(k).alias("k"), F.col(leaves).alias("leaves"))
    plain = plain.join(counts, (F.col("chunk") == F.col("chunk_of")) & F.col("key").eqNullSafe(F.col("key_of")))
    puts = plain.filter("put = 1").withColumn("number", F.col("k") + F.col("puts_before"))
    removals = plain.filter("out = 1").select(F.col("key").alias("of"), (F.col("leaves") + F.col("outs_before")).alias("nth"), F.when(F.col("put") == 1, "dropped").otherwise("consumed").alias("how"))
    met = puts.join(removals, (F.col("number") == F.col("nth")) & F.col("key").eqNullSafe(F.col("of")), "left")
    names = [F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]
    fates = met.select(*names, F.coalesce("how", F.lit("queued")).alias("fate"))
    return fates.unionByName(plain.filter("put = 0").select(*names, F.when(F.col("out") == 1, "got").otherwise("empty").alias("fate")))


def newest(items: DataFrame, capacity: int, *, order: list[str | Column]) -> DataFrame:
    """What a queue without consumers holds after all puts: the newest ``capacity`` items."""
    at, n = fresh(items, "at", "n")
    many = items.agg(F.count("*").alias("n")).scalar()
    return with_dense_id(items, order, at).withColumn(n, many).filter(F.col(at) >= F.col(n) - capacity).drop(at, n)


def queue_stats(fates: DataFrame) -> DataFrame:
    """One row: produced, consumed, dropped and queued."""
    count = lambda *f: F.count_if(F.col("fate").isin(*f))
    return fates.agg(count("consumed", "dropped", "queued").alias("total_produced"), count("consumed").alias("total_consumed"), count("dropped").alias("dropped_samples"), count("queued").alias("queue_size"))


def stream_queue(stream: DataFrame, capacity: int, *, by: str, item: str) -> DataFrame:
    """A stream of puts as a stream of (key, dropped, size) after each micro-batch: state is the waiting items of a key."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting = list(state.get[0]) if state.exists else []
        total = state.get[1] if state.exists else 0
        for pdf in frames:
            waiting += [int(x) for x in pdf[item].sort_values()]
        over = max(0, len(waiting) - capacity)
        waiting, total = waiting[over:], total + over
        state.update((waiting, total))
        yield pd.DataFrame({"key": [str(key[0])], "dropped": [total], "size": [len(waiting)]})

    return stream.groupBy(by).applyInPandasWithState(update, "key string, dropped long, size long", "waiting array<long>, total long", "update", "NoTimeout")


def count_windows(items: DataFrame, size: int, *, order: list[str | Column], keep_rest: bool = False) -> DataFrame:
    """Adds ``window``: complete windows of ``size`` items in order; the rest waits (or is kept as a short last window)."""
    at, n = fresh(items, "at", "n")
    many = items.agg(F.count("*").alias("n")).scalar()
    placed = with_dense_id(items, order, at).withColumn("window", F.expr(f"`{at}` div {size}")).withColumn(n, many)
    if not keep_rest:
        placed = placed.filter(F.col("window") < F.expr(f"`{n}` div {size}"))
    return placed.drop(at, n)


def assemble(windows: DataFrame, *, seconds: str, tool_seconds: str) -> DataFrame:
    """A row for each window: items, percentiles of processing times, times of tools, share and span of partial rollouts."""
    span = F.col("max_global_steps") - F.col("min_global_steps")
    pct = [F.percentile(seconds, F.lit(p)).alias(f"processing_time/tp{round(p * 100)}") for p in (0.5, 0.95, 0.99)]
    return windows.groupBy("window").agg(
        F.count("*").alias("items"), F.avg(seconds).alias("processing_time/avg"), F.max(seconds).alias("processing_time/max"), F.min(seconds).alias("processing_time/min"), *pct,
        F.avg(tool_seconds).alias("tool_time/avg"), F.count_if(span != 0).alias("partial"), F.max(span).alias("max_span"), F.count_distinct("max_global_steps").alias("versions"),
    )


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream over all that is there and stops: a shutdown that drains first."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def queue_capacity(*, required: int, staleness: float, sync: int, replicas: int) -> dict[str, int]:
    """The most samples in flight, the queue's size and the concurrency of generation."""
    most = int(required * (staleness + 1) * sync)
    return {"max_required_samples": most, "max_queue_size": most, "max_concurrent_samples": min(16 * replicas, most)}


def queue_capacities(*, required: Column, staleness: Column, sync: Column, replicas: Column) -> Column:
    """``queue_capacity`` of columns, as a struct."""
    most = (required * (staleness + 1) * sync).cast("int")
    return F.struct(most.alias("max_required_samples"), most.alias("max_queue_size"), F.least(16 * replicas, most).cast("int").alias("max_concurrent_samples"))


def should_pause(queued: Column, stale: Column, *, max_queue: int, max_required: int) -> Column:
    """Back-pressure: the queue is full, or as many samples are stale as are needed."""
    return (queued >= max_queue) | (stale >= max_required)


def staleness_after_sync(active: Column, queued: Column) -> Column:
    """Samples that count as stale right after a new version: those in flight and those queued."""
    return active + queued
