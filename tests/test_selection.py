"""Exact percentiles by refining histograms, against sorting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import metrics as M
from tidemill.operators import selection as S

EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, 1.0, 0.9999999999999999, 1.0000000000000002, 2.0, 4.0, 1e15, 3.0, -1.0, float("inf"), float("-inf"), 0.1, 1e-300]


def test_keys_have_the_order_of_doubles(spark):
    rng = random.Random(1)
    values = EDGES + [2.0**k for k in range(-1074, 1024, 7)] + [math.nextafter(2.0**k, 0) for k in range(-1070, 1024, 11)] + [rng.uniform(-1, 1) * 10 ** rng.uniform(-300, 300) for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", S.order_key(F.col("x")).alias("k")).collect()
    rows.sort(key=lambda r: r["x"])
    for a, b in zip(rows, rows[1:], strict=False):
        assert (a["x"] < b["x"]) == (a["k"] < b["k"]) and (a["x"] == b["x"]) == (a["k"] == b["k"]), (a, b)
    assert spark.sql("select double('NaN') x").select(S.order_key(F.col("x")).alias("k")).first()["k"] > rows[-1]["k"]


@pytest.mark.parametrize("draw", [lambda r: r.gauss(0, 1), lambda r: 10 ** r.uniform(-200, 200), lambda r: r.randrange(3), lambda r: 7.0 if r.random() < 0.4 else r.random(), lambda r: r.random() * 1e-12 + 1])
def test_against_sorting(spark, draw):
    rng = random.Random(2)
    values = [draw(rng) for _ in range(3001)]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(5)
    at = (0.0, 0.013, 0.5, 0.95, 0.99, 1.0)
    assert list(S.percentiles(df, "x", at).first()) == pytest.approx([float(np.quantile(values, p)) for p in at], rel=1e-9)


def test_few_and_none(spark):
    df = spark.createDataFrame([(1, 3.5)], "k int, x double")
    assert tuple(S.percentiles(df, "x", (0.0, 0.5, 1.0)).first()) == (3.5, 3.5, 3.5)
    assert tuple(S.percentiles(df.filter("k > 1"), "x", (0.5,)).first()) == (None,)
    assert {r["metric"]: r["value"] for r in M.percentiles(df, "x").collect()} == {"tp50": 3.5, "tp95": 3.5, "tp99": 3.5}


def test_no_task_holds_the_values(spark, sf_dir):
    plan = S.percentiles(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", (0.5,))._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "collect_list" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
