"""Joins with hot keys: the same rows with and without them, and no broadcasts where there are none."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import common, quality


@pytest.mark.parametrize("least", [0, 1000])
@pytest.mark.parametrize("outer", [False, True])
def test_join_unique_by_either_way(spark, monkeypatch, least, outer):
    monkeypatch.setattr(common, "HOT_ROWS", least)
    keys = ["hot"] * 900 + [f"k{k}" for k in range(300)] + [None] * 40
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, key string").repartition(3)
    one = rows.filter("key is not null and key <> 'k7'").groupBy("key").agg(F.max("id").alias("most"), F.count("*").alias("n"))
    found = common.join_unique(rows, one, ["key"], weight="n", total=len(keys), outer=outer)
    most = {k: i for i, k in enumerate(keys) if k not in (None, "k7")}
    want = Counter((i, k, most.get(k)) for i, k in enumerate(keys) if outer or k in most)
    assert Counter(tuple(r) for r in found.collect()) == want
    for having in (True, False):
        left = common.keep_keys(rows, one, "key", weight="n", total=len(keys), having=having)
        assert Counter(r["id"] for r in left.collect()) == Counter(i for i, k in enumerate(keys) if (k in most) == having)


def test_no_broadcast_without_hot_keys(spark):
    rows = spark.range(500).select("id", (F.col("id") % 250).alias("key"))
    one = rows.groupBy("key").agg(F.max("id").alias("most"), F.count("*").alias("n"))
    plan = common.join_unique(rows, one, ["key"], weight="n", total=500, merge=True)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Union" not in plan


def test_unit_table_is_unit_rows():
    table = np.random.default_rng(3).normal(size=(1000, 8))
    table[5] = 0
    found = quality.unit_table(table, at_once=77)
    assert found.dtype == np.float32 and (found == quality.unit_rows(table).astype(np.float32)).all()
