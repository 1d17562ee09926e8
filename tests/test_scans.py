"""Affine scans over batches of rows against loops over tokens, with resets, gaps, odd lengths and values that aren't finite."""

import random

import numpy as np
import pytest

from tidemill.operators import estimators as E


def loop(rows):
    out = []
    for a, b in rows:
        s, found = 0.0, [0.0] * len(a)
        for t in range(len(a) - 1, -1, -1):
            s = found[t] = b[t] + a[t] * s if a[t] else b[t]
        out += found
    return out


@pytest.mark.parametrize("seed", range(20))
def test_affine_scan(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(rng.randrange(0, 40)):
        n = rng.choice([0, 1, 2, 3, 17, 64, 65])
        rows.append(([rng.choice([0.0, 1.0, 0.9, -0.5]) for _ in range(n)], [rng.uniform(-1, 1) for _ in range(n)]))
    ends = np.cumsum([len(a) for a, _ in rows], dtype=np.int32) if rows else np.zeros(0, np.int32)
    flat = [np.array([x for row in rows for x in row[k]], float) for k in (0, 1)]
    assert np.allclose(E.affine_scan(*flat, ends), loop(rows), rtol=1e-12, atol=1e-12)


def test_what_is_not_finite_stays_in_its_row():
    a, b = np.ones(4), np.array([1.0, 2.0, np.inf, np.nan])
    found = E.affine_scan(a, b, np.array([2, 4], np.int32))
    assert found[:2].tolist() == [3.0, 2.0] and np.isnan(found[2:]).all()


def test_estimators_against_loops(spark):
    rng = random.Random(3)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(n)], [rng.choice([0.0, 1.0, 1.0]) for _ in range(n)], [rng.uniform(-1, 1) for _ in range(n)]) for k, n in enumerate([0, 1, 5, 33, 2, 7, 0, 12])] + [(8, None, None, None)]
    df = spark.createDataFrame(rows, "row_id long, rewards array<double>, response_mask array<double>, vals array<double>").repartition(2)
    gamma, lam = 0.9, 0.8
    returns = {r["row_id"]: r["returns"] for r in E.reinforce_pp(df, gamma=gamma).collect()}
    raw = {r["row_id"]: r["returns"] for r in E.gae(df, gamma=gamma, lam=lam).collect()}
    to_go = {r["row_id"]: r["returns"] for r in E.reward_to_go(df).collect()}
    for k, rewards, mask, vals in rows:
        if rewards is None:
            assert returns[k] is None and raw[k] is None and to_go[k] is None
            continue
        carry = last = following = total = 0.0
        want_pp, want_gae, want_go = [0.0] * len(rewards), [0.0] * len(rewards), [0.0] * len(rewards)
        for t in range(len(rewards) - 1, -1, -1):
            want_pp[t] = carry = rewards[t] + gamma * carry
            carry *= mask[t]
            if mask[t]:
                last = rewards[t] + gamma * following - vals[t] + gamma * lam * last
                following = vals[t]
            want_gae[t] = last + vals[t]
            total += rewards[t] * mask[t]
            want_go[t] = total
        assert returns[k] == pytest.approx(want_pp) and raw[k] == pytest.approx(want_gae) and to_go[k] == pytest.approx(want_go)
