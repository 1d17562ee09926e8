"""Batches larger than a task: the one-task plan where one leaf holds all, equal counts, and loads near it else."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import balance as P


def loads(df, k, column="part"):
    rows = df.groupBy(column).agg(F.sum("len").alias("s"), F.count("*").alias("n")).collect()
    assert {r[column] for r in rows} == set(range(k))
    return sorted(r["s"] for r in rows), {r["n"] for r in rows}


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    return spark.createDataFrame([(k, f"u{k % 250}", rng.randrange(1, 4000), 1, 2) for k in range(2000)], "row_id long, uid string, len long, at int, of_item int").repartition(4).cache()


def test_one_leaf_is_the_one_task_plan(table):
    sizes = [r["len"] for r in table.orderBy("row_id").collect()]
    for equal in (False, True):
        want = {i: p for p, items in enumerate(P.balanced(sizes, 8, equal=equal)) for i in items}
        assert {r["row_id"]: r["part"] for r in P.partition(table, 8, size=F.col("len"), equal=equal).collect()} == want


@pytest.mark.parametrize("leaf,fan", [(64, 3), (100, 256), (8, 2)])
def test_many_leaves(table, leaf, fan):
    sizes = [r["len"] for r in table.orderBy("row_id").collect()]
    best = [sum(sizes[i] for i in p) for p in P.balanced(sizes, 8)]
    for equal in (False, True):
        df = P._divided(table, 8, item="row_id", size=F.col("len"), first=None, equal=equal, leaf_items=leaf, fan_in=fan)
        assert df.columns == [*table.columns, "part"] and df.count() == 2000
        found, counts = loads(df, 8)
        assert found[-1] - found[0] <= max(sizes) and found[-1] <= 1.001 * max(best)
        assert not equal or counts == {250}


def test_groups_stay_together(table):
    df = P.partition_groups(table.filter("row_id < 1920"), 5, size=F.col("len"))
    per = df.groupBy("uid").agg(F.count_distinct("part").alias("parts"), F.min("part").alias("part")).collect()
    assert all(r["parts"] == 1 for r in per) and len(per) == 250
    assert all(sum(r["part"] == p for r in per) == 50 for p in range(5))
    with pytest.raises(ValueError):
        P.partition_groups(table, 7, size=F.col("len"))
    with pytest.raises(ValueError):
        P.partition(table.limit(3), 8, size=F.col("len"))


def test_differencing_bins_by_hand():
    last, parts = P.difference_bins([[9, 1], [4, 3], [6, 0]])
    for n, sums in enumerate(([9, 1], [4, 3], [6, 0])):
        for b, p in enumerate(parts[n]):
            last[p] -= sums[b]
    assert last == [0, 0]
    assert max(P.difference_bins([[9, 1], [4, 3], [6, 0]])[0]) == 12
