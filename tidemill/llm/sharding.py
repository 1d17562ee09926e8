"""Sharding by Karmarkar-Karp differencing: near-equal bytes in every shard, equal texts kept together.

A partial partition is a tuple of one sum per shard. Differencing repeatedly takes the two partial partitions
with the largest spread and adds them oppositely ordered, largest onto smallest. Groups of equal texts are the
first partial partitions. They are dealt over leaves of bounded size, each leaf is differenced by itself, and the
leaves' results, again partial partitions, are differenced level by level until one is left. No task sees more
than a leaf or a bounded number of partial partitions, and the driver sees none; rows of a text that many share find
their shard by broadcast.

Defined results: a null text is no bytes and its rows are one group, apart from empty texts; a row's size is its
text's UTF-8 bytes plus 1; repeated rows belong to one group; a group larger than an even share has a shard that
is larger than the others; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import join_unique, prefix_sums, runs, spool


def difference(partials: list[list[tuple[int, object]]]) -> list[tuple[int, object]]:
    """Difference partial partitions, each a list of (sum, tree) of equal length; returns the last, by falling sum.

    A tree is None (nothing), a leaf's mark or a pair of trees. Ties go by order of arrival, so reruns agree.
    """
    heap = []
    for k, p in enumerate(partials):
        p = sorted(p, key=lambda x: -x[0])
        heap.append((p[-1][0] - p[0][0], k, p))
    heapq.heapify(heap)
    arrived = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = [(x + y, t if u is None else u if t is None else (t, u)) for (x, t), (y, u) in zip(a, reversed(b), strict=True)]
        joined.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], arrived, joined))
        arrived += 1
    return heap[0][2]


def marks(tree: object) -> Iterator[object]:
    """The leaves' marks of a tree."""
    stack = [tree]
    while stack:
        t = stack.pop()
        if isinstance(t, tuple):
            stack += t
        elif t is not None:
            yield t


def _difference_leaves(groups: DataFrame, shards: int) -> DataFrame:
    """(gkey, leaf, bin, bytes) of (gkey, leaf, bytes): each leaf differenced by itself."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leaf in runs(batches, ["leaf"]):
            sizes = leaf.column("bytes").to_pylist()
            bins = [0] * len(sizes)
            last = difference([[(s, k), *[(0, None)] * (shards - 1)] for k, s in enumerate(sizes)])
            for b, (_, tree) in enumerate(last):
                for k in marks(tree):
                    bins[k] = b
            yield from leaf.append_column("bin", pa.array(bins, pa.int32())).select(["gkey", "leaf", "bin", "bytes"]).combine_chunks().to_batches()

    return groups.repartition("leaf").sortWithinPartitions("leaf", "gkey").mapInArrow(leaves, "gkey binary, leaf long, bin int, bytes long")


def _difference_upwards(sums: DataFrame, shards: int, fan_in: int) -> DataFrame:
    """(leaf, perm): the final shard of each leaf's bins, from (leaf, sums), by levels of ``fan_in`` partial partitions."""

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        last = difference([[(int(s), (("at", node, b),)) for b, s in enumerate(row)] for node, row in zip(pdf["node"], pdf["sums"], strict=True)])
        perm = {node: [0] * shards for node in pdf["node"]}
        for b, (_, tree) in enumerate(last):
            for mark in _bin_marks(tree):
                perm[mark[1]][mark[2]] = b
        top = [s for s, _ in last]
        return pd.DataFrame({"node": list(perm), "perm": list(perm.values()), "parent": int(pdf["node"].iloc[0]) // fan_in, "top": [top] * len(perm)})

    place = sums.select("leaf", F.col("leaf").alias("node"), F.array(*[F.lit(b) for b in range(shards)]).alias("perm"))
    level = sums.select(F.col("leaf").alias("node"), "sums")
    while True:
        done = spool(level.withColumn("parent", F.expr(f"node div {fan_in}")).groupBy("parent").applyInPandas(combine, "node long, perm array<int>, parent long, top array<long>"), "shard-level")
        step = done.select("node", F.col("perm").alias("step"), "parent")
        place = spool(place.join(step, "node").select("leaf", F.col("parent").alias("node"), F.transform("perm", lambda b: F.element_at("step", b + 1)).alias("perm")), "shard-place")
        level = done.groupBy(F.col("parent").alias("node")).agg(F.first("top").alias("sums"))
        if level.limit(2).count() < 2:
            return place.select("leaf", "perm")


def _bin_marks(tree: object) -> Iterator[tuple]:
    """Marks ("at", node, bin) of a tree whose leaves are one-tuples of marks."""
    stack = [tree]
    while stack:
        t = stack.pop()
        if t is None:
            continue
        if len(t) == 1:
            yield t[0]
        else:
            stack += t


def shard(docs: DataFrame, *, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", leaf_groups: int = 20_000, fan_in: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: this law doesn't grow by one shard)."""
    text = F.col(text_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    key = F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b"null"))
    rows = spool(docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), key.alias("gkey")), "shard-rows")
    groups = spool(rows.groupBy("gkey").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies")), "shard-groups")
    n_rows = rows.count()
    leaves = max(1, -(-n_rows // leaf_groups))
    binned = spool(_difference_leaves(groups.select("gkey", "bytes").withColumn("leaf", F.pmod(F.xxhash64("gkey"), F.lit(leaves))), shards), "shard-leaves")
    per_bin = binned.groupBy("leaf", "bin").agg(F.sum("bytes").alias("b"))
    sums = per_bin.groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("bin", "b"))).alias("m"))
    sums = sums.select("leaf", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0).cast("long"))).alias("sums"))
    place = _difference_upwards(spool(sums, "shard-sums"), shards, fan_in)
    home = spool(binned.join(place, "leaf").join(groups.select("gkey", "copies"), "gkey").select("gkey", "copies", F.element_at("perm", F.col("bin") + 1).alias("shard")), "shard-home")
    # Slots: rows are dealt over chunks by a hash; a chunk's first slot is a prefix sum of counts. Rows that agree in all
    # that is returned are one row with their number for each part of the table, so no chunk holds all of them.
    chunks = max(64, n_rows // 100_000)
    dealt = join_unique(rows, home, ["gkey"], weight="copies", total=n_rows).withColumn("mix", F.xxhash64("doc_id", "text_crc32", "size")).withColumn("chunk", F.pmod("mix", F.lit(chunks)))
    dealt = dealt.withColumn("part", F.spark_partition_id()).groupBy("doc_id", "size", "text_crc32", "shard", "mix", "chunk", "part").agg(F.count("*").alias("equal"))
    dealt = spool(dealt, "shard-dealt")
    first = prefix_sums(dealt.groupBy("shard", "chunk").agg(F.sum("equal").alias("n")), ["shard"], "chunk", "n", "base").select("shard", "chunk", "base")
    inside = Window.partitionBy("shard", "chunk").orderBy("mix", "doc_id", "size", "text_crc32", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("at", F.coalesce(F.sum("equal").over(inside), F.lit(0))).join(first, ["shard", "chunk"])
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("equal") - 1)))
    return each.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("at") + F.col("copy")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
