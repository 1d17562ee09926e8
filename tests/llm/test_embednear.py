import math
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import embednear


def brute(rows, least):
    def valid(r):
        v = r[1]
        return r[2] is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ok = [k for k, r in enumerate(rows) if valid(r)]
    near = {k: set() for k in range(len(rows))}
    by = {}
    for k in ok:
        by.setdefault((rows[k][2], len(rows[k][1])), []).append(k)
    for at in by.values():
        v = np.array([rows[k][1] for k in at], np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(np.triu(v @ v.T >= least, 1)), strict=True):
            near[at[i]].add(at[j])
            near[at[j]].add(at[i])
    out = []
    for k, r in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        first = min(ids) if ids else None
        out.append((r[0], len(near[k]), first, r[0] == first))
    return Counter(out)


@pytest.mark.parametrize(("cell_rows", "block", "least"), [(4096, 1024, 0.93), (8, 7, 0.93), (5, 1000, 0.6)])
def test_against_all_pairs(spark, sf_dir, cell_rows, block, least):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    found = embednear.near_vectors(table, cell_rows=cell_rows, block=block, least=least).collect()
    assert Counter(map(tuple, found)) == brute(rows, least)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(0, v, 1), (1, v, 1), (2, [2.0, 4.0, 6.0], 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [nan, 1.0, 1.0], 1), (8, [inf, 1.0, 1.0], 1), (9, [None, 1.0, 1.0], 1), (10, [], 1), (11, [1.0, 2.0], 1), (None, v, 1), (0, v, 1), (12, [-1.0, -2.0, -3.0], 1), (13, [1e30, 2e30, 3e30], 1), (14, [1e-30, 2e-30, 3e-30], 1), (15, [-0.0, 1.0, 0.0], 3), (16, [0.0, 1.0, 0.0], 3)]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<float>, label int, vkey string, copies int").repartition(2)
    found = embednear.near_vectors(table).collect()
    assert Counter(map(tuple, found)) == brute([(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()], 0.93)
    assert embednear.near_vectors(table.limit(0)).count() == 0


def test_bounds_lose_no_neighbour():
    rng = np.random.default_rng(0)
    vectors = embednear.unit(np.repeat(rng.normal(size=(40, 8)), 25, axis=0) + 0.15 * rng.normal(size=(1000, 8)))
    pivots = vectors[::50]
    home, visited = embednear.visits(vectors, pivots, math.sqrt(2 - 2 * 0.93))
    for i, j in zip(*np.nonzero(vectors @ vectors.T >= 0.93), strict=True):
        assert visited[i, home[j]]
    assert visited.mean() < 0.9


def test_clusters_and_copies(spark):
    """Clustered vectors whose cells are divided more than once, a third of all rows one vector."""
    rng = np.random.default_rng(3)
    centres = embednear.unit(rng.normal(size=(30, 6)))
    vectors = [(k, [float(x) for x in centres[k % 30] + 0.04 * rng.normal(size=6)], 1) for k in range(600)]
    vectors += [(1000 + k, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 1) for k in range(300)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").repartition(4)
    found = embednear.near_vectors(table, cell_rows=20, fan=3, block=16).collect()
    assert Counter(map(tuple, found)) == brute(vectors, 0.93)
