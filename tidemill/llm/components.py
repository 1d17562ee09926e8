"""Connected components by alternating large-star and small-star steps over a table of edges.

Each step is a minimum per node and a join of the edges with these minima. Minima are aggregated before they are
shuffled, and a node with many edges (the root of a large component has one for each of its nodes) is joined by broadcast,
so its edges stay dealt over the tasks. Tables between the steps are written to the shared folder. The steps end when
the edges no longer change, which takes a logarithmic number of rounds on practical graphs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import drop_spool, join_unique, spool


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One step: link neighbours to the smallest node of each neighbourhood. ``edges`` are (a, b) with a > b, about ``total`` of them."""
    near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = near.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("degree"))
    joined = join_unique(near, least, ["a"], weight="degree", total=total * (2 if large else 1))
    if large:  # neighbours larger than a are linked to the smallest of a and its neighbours
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # smaller neighbours, and a itself, are linked to the smallest neighbour
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); the root is the component's smallest node.

    Edges with a null end and self-loops are left out; repeated edges count once; no edges give an empty table.
    """
    ordered = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = spool(ordered, "cc")
    sign = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = sign(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        half = spool(_star(now, large=True, total=before[0]), "cc")
        after = spool(_star(half, large=False, total=before[0]), "cc")
        drop_spool(now)
        drop_spool(half)
        now, found = after, sign(after)
        if found == before:
            break
        before = found
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
