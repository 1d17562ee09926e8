"""The bootstrap as a relation against draws from arrays."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import metrics as M


def test_same_draws_for_groups_of_any_size(spark):
    rng, rows = random.Random(6), []
    for uid, n in (("a", 1), ("b", 2), ("c", 40), ("d", 40), (None, 7), ("hot", 900)):
        rows += [(uid, k, rng.uniform(-5, 5), 1) for k in range(n)]
    df = spark.createDataFrame(rows, "uid string, row_id long, value double, at int").repartition(4)
    found = {(r["uid"], r["fn"]): (r["mean"], r["std"]) for r in M.bootstrap(df, size=3, fns={"best": F.max, "worst": F.min, "mean": F.avg}, draws=50, seed=7).collect()}
    assert len(found) == 18
    for uid in {r[0] for r in rows}:
        data = np.array([r[2] for r in rows if r[0] == uid])
        picks = np.random.RandomState(7).choice(len(data), size=(50, 3), replace=True)
        for name, fn in (("best", np.max), ("worst", np.min), ("mean", np.mean)):
            draws = np.array([fn(data[p]) for p in picks])
            assert found[uid, name] == pytest.approx((draws.mean(), draws.std()), abs=1e-12)
    assert M.bootstrap(df.limit(0), size=3, fns={"best": F.max}).count() == 0


def test_draws_of_small_groups_are_not_shuffled(spark):
    rows = [(uid, k, float(k * 7 % 11)) for uid in range(40) for k in range(1 + uid % 9)]
    found = M.bootstrap(spark.createDataFrame(rows, "uid long, row_id long, value double"), size=2, fns={"best": F.max}, draws=20)
    assert found.count() == 40 and len(found.collect()) == 40
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert not re.search(r"hashpartitioning\(base#\d+L?, draw", plan)


@pytest.mark.parametrize("n", [39, 40, 41, 79, 80, 81, 125])
def test_groups_about_the_size_of_an_array(spark, n):
    """40 rows are an array no more; groups begin anywhere in slices of 40 rows."""
    sizes = [3, n, 17, n, 40, n]
    rows = [(uid, k, float((k * 31 + uid) % 97)) for uid, m in enumerate(sizes) for k in range(m)]
    df = spark.createDataFrame(rows, "uid long, row_id long, value double")
    found = {r["uid"]: (r["mean"], r["std"]) for r in M.bootstrap(df, size=2, fns={"best": F.max}, draws=20).collect()}
    for uid, m in enumerate(sizes):
        data = np.array([r[2] for r in rows if r[0] == uid])
        draws = data[np.random.RandomState(42).choice(m, size=(20, 2), replace=True)].max(axis=1)
        assert found[uid] == pytest.approx((draws.mean(), draws.std()), abs=1e-12)
