"""Placement: workloads, balanced partitions, micro-batches and the orders that go with them.

A table holds any number of training batches, named by ``batch``. Each batch is planned by itself, in a task that has the ids
and workloads of its rows alone, by Karmarkar-Karp differencing; the plan goes back as a join on the batch and the id. A
table that is one batch (``batch`` is None) may be of any size: balanced partitions of it are differenced leaf by leaf and then
level by level (``_divided``), which is the one-task plan where one leaf holds all. Micro-batches and greedy partitions
follow one order of rows, so there a batch must fit a task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.names import fresh
from tidemill.functions.registry import Registry
from tidemill.operators.batch import with_dense_id
from tidemill.sources.storage import stored

#: Fixed value: linear cost of a token against the square of the length.
LINEAR_COST = 24_576
DISPATCH: Registry[Callable[..., DataFrame]] = Registry("dispatch mode")


def workload(length: Column) -> Column:
    """Cost of a sequence: a linear and a quadratic part of its length."""
    return F.lit(LINEAR_COST) * length + length * length


def karmarkar_karp(sizes: Sequence[int], k: int, *, equal: bool = False) -> list[list[int]]:
    """``k`` parts of near-equal sums by largest differencing; with ``equal`` all parts have as many items (the count must be
    divisible). Ties go by sums, counts and items, so plans are reproducible."""
    n = len(sizes)
    if equal and n % k:
        raise ValueError(f"{n} items can't make {k} equal parts")
    order = sorted(range(n), key=lambda i: (sizes[i], i))
    empty = (0, ())
    if equal:
        states = [[(sizes[i], (i,)) for i in order[a : a + k]] for a in range(0, n, k)]
    else:
        states = [[(sizes[i], (i,)), *[empty] * (k - 1)] for i in order]
    key = lambda part: (part[0], len(part[1]), part[1])
    heap = []
    for number, s in enumerate(states):
        s.sort(key=key, reverse=True)
        heap.append((-(s[0][0] - s[-1][0]), number, s))
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = [(x + y, tuple(sorted(t + u))) for (x, t), (y, u) in zip(a, reversed(b), strict=True)]
        merged.sort(key=key, reverse=True)
        heapq.heappush(heap, (-(merged[0][0] - merged[-1][0]), number, merged))
        number += 1
    return [sorted(items) for _, items in heap[0][2]] if heap else [[] for _ in range(k)]


def greedy(sizes: Sequence[int], k: int, *, equal: bool = False) -> list[list[int]]:
    """Items in their order to the lightest part; with ``equal`` a constant that outweighs all sizes evens out the counts."""
    bias = sum(sizes) + 1 if equal else 0
    heap, parts = [(0, p) for p in range(k)], [[] for _ in range(k)]
    for i, s in enumerate(sizes):
        load, p = heapq.heappop(heap)
        parts[p].append(i)
        heapq.heappush(heap, (load + s + bias, p))
    if equal and len({len(p) for p in parts}) > 1:
        raise ValueError("parts differ in their number of items")
    return parts


def check_parts(parts: list[list[int]], n: int) -> list[list[int]]:
    """The parts with sorted items; empty parts and parts that don't cover all items once raise."""
    if any(not p for p in parts) or sorted(i for p in parts for i in p) != list(range(n)):
        raise ValueError("parts must be non-empty and hold each item once")
    return [sorted(p) for p in parts]


def balanced(sizes: Sequence[int], k: int, *, equal: bool = False) -> list[list[int]]:
    if len(sizes) < k:
        raise ValueError(f"{len(sizes)} items can't make {k} parts")
    return check_parts(karmarkar_karp(sizes, k, equal=equal), len(sizes))


def _planned(df: DataFrame, plan: Callable[[list[int], list], dict[str, list]], *, item: str, size: Column, first: Column | None = None, batch: str | None = None, adds: str = "part int") -> DataFrame:
    """``df`` with what ``plan`` gives for the (sizes, first places) of each batch's items, in order of ``first`` (the item itself)."""
    of_batch, of_item = fresh(df, "of_batch", "of_item")
    keys = [F.lit(0).alias(of_batch) if batch is None else F.col(batch).alias(of_batch), F.col(item).alias(of_item)]
    items = df.groupBy(*keys).agg(F.sum(size.cast("long")).alias("size"), F.min(F.col(item) if first is None else first).alias("first"))
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    names = [part.split()[0] for part in adds.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first", kind="stable")
        out = plan(pdf["size"].tolist(), pdf["first"].tolist())
        return pd.DataFrame({of_batch: pdf[of_batch].to_numpy(), of_item: pdf[of_item].to_numpy()} | {n: out[n] for n in names})

    planned = items.groupBy(of_batch).applyInPandas(run, f"{of_batch} {kinds[of_batch]}, {of_item} {kinds[of_item]}, {adds}")
    here = F.col(of_item).eqNullSafe(F.col(item)) & (F.lit(True) if batch is None else F.col(of_batch).eqNullSafe(F.col(batch)))
    return df.join(planned, here).drop(of_batch, of_item)


#: Items of a leaf, and partial partitions that are differenced together.
LEAF_ITEMS, FAN_IN = 8192, 256


def difference_bins(sums: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Differences partial partitions of k bins each: the sums of what is left and, of each, the part that every bin becomes."""
    k = len(sums[0])
    heap = [(min(s) - max(s), n, list(s), [(n, list(range(k)))]) for n, s in enumerate(sums)]
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        (_, _, a, of_a), (_, _, b, of_b) = heapq.heappop(heap), heapq.heappop(heap)
        joined, members = [0] * k, []
        for bins, found, falling in ((a, of_a, True), (b, of_b, False)):
            order = sorted(range(k), key=lambda j: ((-bins[j] if falling else bins[j]), j))  # noqa: B023
            place = [0] * k
            for at, j in enumerate(order):
                place[j] = at
                joined[at] += bins[j]
            members += [(n, [place[p] for p in parts]) for n, parts in found]
        heapq.heappush(heap, (min(joined) - max(joined), number, joined, members))
        number += 1
    _, _, last, members = heap[0]
    return last, [parts for _, parts in sorted(members)]


def _divided(df: DataFrame, k: int, *, item: str, size: Column, first: Column | None, equal: bool, leaf_items: int = LEAF_ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """``df`` with ``part``: the items' balanced partition, however many they are; no task has more than a leaf of them.

    Leaves of ``leaf_items`` items, in order, make partial partitions of ``k`` bins with as many items each where counts
    are ``equal``; ``fan_in`` of them at a time are differenced until one is left. Every step is stored.
    """
    at, of_item, part = fresh(df, "at", "of_item", "part")
    items = df.groupBy(F.col(item).alias(of_item)).agg(F.sum(size.cast("long")).alias("size"), F.min(F.col(item) if first is None else first).alias("first"))
    items = stored(with_dense_id(items, ["first", of_item], at), "balance-items")
    n = items.count()
    if n < k or (equal and n % k):
        raise ValueError(f"{n} items can't make {k} {'equal ' if equal else ''}parts")
    leaf_items = max(k, leaf_items - leaf_items % k)

    def bins(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", kind="stable")
        places = _places(karmarkar_karp(pdf["size"].tolist(), k, equal=equal), len(pdf))
        return pd.DataFrame({"at": pdf["at"].to_numpy(), "leaf": pdf["leaf"].to_numpy(), "bin": places, "size": pdf["size"].to_numpy()})

    leaves = items.select(F.col(at).alias("at"), F.expr(f"`{at}` div {leaf_items}").alias("leaf"), "size")
    binned = stored(leaves.groupBy("leaf").applyInPandas(bins, "at long, leaf long, bin int, size long"), "balance-bins")
    loads = binned.groupBy("leaf", "bin").agg(F.sum("size").alias("s")).groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("bin", "s"))).alias("m"))
    level = loads.select(F.col("leaf").alias("node"), F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0).cast("long"))).alias("sums"))
    level = stored(level, "balance-sums")
    place = level.select(F.col("node").alias("leaf"), "node", F.sequence(F.lit(0), F.lit(k - 1)).alias("parts"))

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        last, parts = difference_bins([[int(x) for x in s] for s in pdf["sums"]])
        return pd.DataFrame({"node": pdf["node"].to_numpy(), "parent": pdf["parent"].to_numpy(), "step": parts, "sums": [last] * len(parts)})

    while not level.filter("node > 0").isEmpty():
        done = stored(level.withColumn("parent", F.expr(f"node div {fan_in}")).groupBy("parent").applyInPandas(combine, "node long, parent long, step array<int>, sums array<long>"), "balance-level")
        place = stored(place.join(done.select("node", "parent", "step"), "node").select("leaf", F.col("parent").alias("node"), F.transform("parts", lambda b: F.element_at("step", b + 1)).alias("parts")), "balance-place")
        level = done.groupBy(F.col("parent").alias("node")).agg(F.first("sums").alias("sums"))
    found = binned.join(place, "leaf").select("at", F.element_at("parts", F.col("bin") + 1).alias(part))
    planned = items.select(F.col(at).alias("at"), of_item).join(found, "at").drop("at")
    return df.join(planned, F.col(of_item).eqNullSafe(F.col(item))).drop(of_item)


def _places(parts: list[list[int]], n: int) -> list[int]:
    """The part of each item."""
    out = [0] * n
    for p, items in enumerate(parts):
        for i in items:
            out[i] = p
    return out


def partition(df: DataFrame, k: int, *, size: Column, row: str = "row_id", equal: bool = False, batch: str | None = None) -> DataFrame:
    """Adds ``part`` by balanced partitions of each batch's sizes."""
    if batch is None:
        return _divided(df, k, item=row, size=size, first=None, equal=equal)
    return _planned(df, lambda sizes, _: {"part": _places(balanced(sizes, k, equal=equal), len(sizes))}, item=row, size=size, batch=batch)


def partition_greedily(df: DataFrame, k: int, *, size: Column, row: str = "row_id", equal: bool = False, batch: str | None = None) -> DataFrame:
    """Adds ``part``: each batch's rows in order of id, each to the lightest part so far."""
    return _planned(df, lambda sizes, _: {"part": _places(greedy(sizes, k, equal=equal), len(sizes))}, item=row, size=size, batch=batch)


def partition_groups(df: DataFrame, k: int, *, size: Column, by: str = "uid", row: str = "row_id", batch: str | None = None) -> DataFrame:
    """Adds ``part``: a batch's groups stay together and every part has as many groups."""
    if batch is None:
        return _divided(df, k, item=by, size=size, first=F.col(row), equal=True)

    def plan(sizes: list[int], _: list) -> dict[str, list]:
        if len(sizes) % k:
            raise ValueError(f"{len(sizes)} groups can't make {k} equal parts")
        return {"part": _places(balanced(sizes, k, equal=True), len(sizes))}

    return _planned(df, plan, item=by, size=size, first=F.col(row), batch=batch)


def _cost(length: int) -> int:
    return LINEAR_COST * length + length * length


def micro_batches(df: DataFrame, *, length: str, most_tokens: int, row: str = "row_id", multiple: int = 1, least: int = 1, batch: str | None = None) -> DataFrame:
    """Adds ``part``: as few balanced micro-batches of a batch as keep near ``most_tokens`` each, rounded up to a multiple; the
    largest workloads stand in the middle."""

    def plan(lengths: list[int], _: list) -> dict[str, list]:
        if max(lengths) > most_tokens:
            raise ValueError(f"a sequence is longer than {most_tokens}")
        count = min(len(lengths), max(least, ceildiv(sum(lengths), most_tokens)))
        count = min(len(lengths), roundup(count, multiple))
        costs = list(map(_cost, lengths))
        parts = sorted(balanced(costs, count), key=lambda p: (-sum(costs[i] for i in p), min(p)))
        return {"part": _places(parts[::2][::-1] + parts[1::2], len(lengths))}

    return _planned(df, plan, item=row, size=F.col(length), batch=batch)


def small_ends(order: Sequence[int]) -> list[int]:
    """Items by rising cost to an order with small ones at both ends."""
    return [*order[::2], *list(order[1::2])[::-1]]


def balance_batch(df: DataFrame, k: int, *, length: str, row: str = "row_id", batch: str | None = None) -> DataFrame:
    """New ids for the rows of a batch, among its own: rows of a part stand together, each part with its small rows at both ends;
    parts are equal in rows. Adds ``part``."""

    def plan(lengths: list[int], ids: list) -> dict[str, list]:
        costs = list(map(_cost, lengths))
        order = [i for p in balanced(costs, k, equal=True) for i in small_ends(sorted(p, key=lambda i: (costs[i], i)))]
        at = {i: ids[n] for n, i in enumerate(order)}
        part = {i: n // (len(order) // k) for n, i in enumerate(order)}
        return {"_at": [at[i] for i in range(len(order))], "part": [part[i] for i in range(len(order))]}

    out = _planned(df, plan, item=row, size=F.col(length), batch=batch, adds=f"_at {df.schema[row].dataType.simpleString()}, part long")
    return out.drop(row).withColumnRenamed("_at", row)


def ceildiv(a: int, b: int) -> int:
    return -(-a // b)


def roundup(n: int, multiple: int) -> int:
    return ceildiv(n, multiple) * multiple


def batch_multiple(workers: int, mini_batches: Sequence[int]) -> int:
    """What a batch's size must be divisible by."""
    return math.lcm(workers, *mini_batches)


def greatest_divisor(a: Column, b: Column) -> Column:
    """The greatest common divisor of two positive longs, by Euclid's steps (fewer than 92)."""
    pair = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), (p["a"] % F.when(p["b"] != 0, p["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, step)["a"]


def batch_multiple_of(workers: Column, mini_batches: Sequence[Column]) -> Column:
    """``batch_multiple`` of columns."""
    out = workers.cast("long")
    for size in mini_batches:
        out = F.call_function("div", out, greatest_divisor(out, size)) * size
    return out


@DISPATCH.register("one_to_all")
def to_all(df: DataFrame, workers: int) -> DataFrame:
    """Every worker gets all rows."""
    return df.withColumn("worker", F.explode(F.sequence(F.lit(0), F.lit(workers - 1))))


@DISPATCH.register("all_to_all", "dp_compute", "dp_compute_proto", "dp_compute_proto_with_func", "dp_compute_metric", "nd_compute")
def by_chunk(df: DataFrame, workers: int) -> DataFrame:
    """Contiguous chunks, padded cyclically to equal size; padding is marked for the gathering side to drop."""
    from tidemill.operators.batch import chunk, pad_to_divisor

    n = df.agg(F.count("*")).first()[0]
    padded, _ = pad_to_divisor(df, workers)
    return chunk(padded, workers).withColumnRenamed("chunk", "worker").withColumn("is_padding", F.col("row_id") >= n)


@DISPATCH.register("rank_zero", "direct_rollout_method")
def to_first(df: DataFrame, workers: int) -> DataFrame:
    return df.withColumn("worker", F.lit(0))


def gather(df: DataFrame) -> DataFrame:
    """What workers gave back, in order and without padding."""
    kept = df.filter(~F.col("is_padding")) if "is_padding" in df.columns else df
    return kept.drop("worker", "is_padding")


def shared_prefixes(df: DataFrame, *, by: str = "uid", prompt: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """(prompts, rows without them): each prompt once, joined by its group when it is needed."""
    return df.groupBy(by).agg(F.first(prompt).alias(prompt)), df.drop(prompt)
