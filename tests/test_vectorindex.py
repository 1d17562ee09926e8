"""The index against a scan: clustered and random vectors, ties, copies, odd rows, and what is read."""

import numpy as np
import pytest

from tidemill.operators.vectorindex import VectorIndex


def scan(vectors, queries, k, among=None):
    ids = [i for i in vectors if vectors[i] is not None and np.linalg.norm(vectors[i]) > 0 and (among is None or i in among)]
    unit = {i: np.array(vectors[i]) / np.linalg.norm(vectors[i]) for i in ids}
    out = {}
    for q, v in queries.items():
        v = np.array(v) / np.linalg.norm(v)
        out[q] = sorted((round(-float(unit[i] @ v), 9), i) for i in ids)[:k]
    return out


@pytest.mark.parametrize("kind,lists,block", [("clusters", 12, 40), ("random", 9, 4096), ("copies", 5, 16), ("random", 1, 7)])
def test_equal_to_a_scan(spark, tmp_path, kind, lists, block):
    rng = np.random.default_rng(3)
    if kind == "clusters":
        centres = rng.normal(size=(12, 8)) * 10
        vectors = {i: (centres[i % 12] + rng.normal(size=8) * 0.2).tolist() for i in range(600)}
    elif kind == "copies":
        vectors = {i: ([1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(300)}
    else:
        vectors = {i: rng.normal(size=8).tolist() for i in range(400)}
    dim = len(vectors[0])
    odd = [(9000, None), (9001, [0.0] * dim), (9002, [float("nan")] * dim), (9003, [1.0]), (9004, [])]
    df = spark.createDataFrame([*vectors.items(), *odd], "memory_id long, embedding array<double>").repartition(4)
    index = VectorIndex.build(df, str(tmp_path / "index"), lists=lists, block_rows=block)
    queries = {f"q{i}": vectors[i] for i in range(0, 60, 7)}
    asked = spark.createDataFrame([*queries.items(), ("none", None), ("zero", [0.0] * dim)], "query string, v array<double>")
    for k, among in ((1, None), (10, None), (7, set(range(0, 1000, 5)))):
        chosen = None if among is None else spark.createDataFrame([(i,) for i in among], "id long")
        found, read = index.search(asked, k, among=chosen, query_chunk=4)
        got = {}
        for r in found.collect():
            got.setdefault(r["query"], []).append((round(-r["score"], 9), r["id"]))
        assert {q: sorted(x) for q, x in got.items()} == scan(vectors, queries, k, among)
        shares = [r["read"] / r["lists"] for r in read.collect()]
        assert len(shares) == len(queries) and max(shares) <= 1
        if kind == "clusters" and among is None and k == 10:
            assert max(shares) <= 0.25
    folders = index._read(spark).filter("list = 0").inputFiles()
    assert folders


def test_nothing_to_index(spark, tmp_path):
    with pytest.raises(ValueError):
        VectorIndex.build(spark.createDataFrame([(1, None)], "memory_id long, embedding array<double>"), str(tmp_path / "index"))
