"""Hand-computed values and traps: singletons, epsilons, NaN, ties, boundaries."""

import math
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.functions import text as T
from tidemill.functions.registry import Registry, load_object
from tidemill.functions.tool_parsers import PARSERS
from tidemill.operators import balance as P
from tidemill.operators import batch as B
from tidemill.operators import correction as C
from tidemill.operators import estimators as E
from tidemill.operators import losses as L
from tidemill.operators import metrics as M
from tidemill.operators import retrieval as R
from tidemill.operators import stats
from tidemill.sources import datasets as D

TRAJ = "row_id long, uid string, rewards array<double>, response_mask array<int>"


def trajectories(spark, rows, extra="", values=()):
    return spark.createDataFrame([(*r, *v) for r, v in zip(rows, values or [()] * len(rows), strict=True)], TRAJ + extra)


def advantages(df, column="advantages"):
    return [r[column] for r in df.orderBy("row_id").collect()]


def close(found, want):
    assert len(found) == len(want)
    for f, w in zip(found, want, strict=True):
        assert f == pytest.approx(w, abs=1e-9)


def test_singletons_differ_by_estimator(spark):
    df = trajectories(spark, [(0, "a", [0.0, 2.0], [1, 1])])
    close(advantages(E.grpo(df)), [[2 / (1 + 1e-6)] * 2])
    close(advantages(E.rloo(df)), [[2.0, 2.0]])
    close(advantages(E.rloo_vectorized(df)), [[0.0, 0.0]])
    close(advantages(E.opo(df)), [[2.0, 2.0]])
    with pytest.raises(PySparkException):
        E.grpo_passk(df).collect()


def test_scores_sum_unmasked_rewards_and_advantages_are_masked(spark):
    df = trajectories(spark, [(0, "a", [1.0, 3.0], [1, 0]), (1, "a", [0.0, 0.0], [0, 1])])
    close(advantages(E.rloo(df)), [[4.0, 0.0], [0.0, -4.0]])


def test_gae_state_passes_masked_tokens(spark):
    rows = [(0, "a", [0.0, 0.0, 1.0], [1, 0, 1])]
    raw = E.gae(trajectories(spark, rows, ", vals array<double>", [([0.5, 0.4, 0.3],)]), gamma=0.9, lam=0.95)
    returns = raw.first()["returns"]
    close([[r - v for r, v in zip(returns, [0.5, 0.4, 0.3], strict=True)]], [[0.3685, 0.7, 0.7]])
    other = E.gae(trajectories(spark, rows, ", vals array<double>", [([0.5, 99.0, 0.3],)]), gamma=0.9, lam=0.95)
    assert other.first()["advantages"] == raw.first()["advantages"]


def test_loop_and_numpy_agree_on_random_groups(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(k, f"g{k % 5}", rng.normal(size=6).tolist(), rng.integers(0, 2, 6).tolist()) for k in range(40)]
    s = np.array([sum(r[2]) for r in rows])
    g = np.arange(40) % 5
    mean, std, n = (np.array([f(s[g == x]) for x in range(5)])[g] for f in (np.mean, lambda v: v.std(ddof=1), len))
    mask = np.array([r[3] for r in rows])
    df = trajectories(spark, rows)
    close(advantages(E.grpo(df)), ((s - mean) / (std + 1e-6))[:, None] * mask)
    close(advantages(E.rloo(df)), ((s - mean) * n / (n - 1))[:, None] * mask)


def test_pf_resample_draws_as_many_in_proportion(spark):
    df = trajectories(spark, [(k, "a", [float(k % 2) * 3], [1]) for k in range(400)])
    drawn = E.pf_resample(df, seed=3)
    assert drawn.count() == 400 and drawn.filter("row_id % 2 = 0").count() == 0
    assert sorted(r["row_id"] for r in drawn.collect()) == sorted(r["row_id"] for r in E.pf_resample(df.repartition(5), seed=3).collect())


def test_masked_sums_kill_nan_and_means_keep_their_epsilon(spark):
    df = spark.createDataFrame([([1.0, float("nan")], [1, 0])], "v array<double>, m array<int>")
    row = df.select(A.masked_sum("v", "m").alias("s"), A.masked_mean("v", "m").alias("a")).first()
    assert row["s"] == 1.0 and row["a"] == 1 / (1 + 1e-8)
    one = spark.createDataFrame([(0, [1.0], [1])], "row_id long, v array<double>, response_mask array<int>")
    with pytest.raises(PySparkException):
        stats.masked_batch(one, "v").collect()


def test_loss_modes_and_their_refusals(spark):
    df = spark.createDataFrame([([1.0, 2.0, 5.0], [1, 1, 0]), ([7.0], [0]), ([3.0], [1])], "x array<double>, response_mask array<int>")
    get = lambda **how: L.aggregate_loss(df, "x", **how).first()["loss"]
    assert get() == 2.0 and get(mode="seq-mean-token-sum") == 3.0 and get(mode="seq-mean-token-sum-norm", scale=10) == pytest.approx(0.3)
    assert get(mode="seq-mean-token-mean") == pytest.approx((3 / (2 + 1e-8) + 3 / (1 + 1e-8)) / 2) and get(global_tokens=12, parts=2) == 1.0
    assert math.isnan(L.aggregate_loss(df.withColumn("response_mask", F.transform("response_mask", lambda _: F.lit(0))), "x").first()["loss"])
    with pytest.raises(ValueError):
        get(parts=2)
    with pytest.raises(ValueError):
        get(mode="nothing")


def test_penalties(spark):
    row = spark.range(1).select(*[L.kl_penalty(F.lit(-1.0), F.lit(-2.0), n).alias(n.replace("+", "p")) for n in ("kl", "kl+", "abs", "mse", "k3+", "low_var_kl")]).first()
    assert tuple(row) == pytest.approx((1.0, 1.0, 1.0, 0.5, math.exp(-1), math.exp(-1)))
    with pytest.raises(ValueError):
        L.kl_penalty(F.lit(0.0), F.lit(0.0), "full")


def test_cov_losses_touch_as_many_tokens_as_they_should(spark):
    rows = [(k, [0.1 * (k % 7) - 0.2], [-0.3 - 0.01 * k], [-0.3], [1]) for k in range(200)]
    df = spark.createDataFrame(rows, "row_id long, advantages array<double>, log_probs array<double>, old_log_probs array<double>, response_mask array<int>")
    cfg = L.LossConfig(cov_ratio=0.05, cov_low=-10.0, cov_high=10.0, clip=100.0)
    assert L.clip_cov(df, cfg).first()["clipfrac"] == pytest.approx(10 / 200)
    plain = sum(-a[0] * math.exp(lp[0] - o[0]) for _, a, lp, o, _ in rows) / 200
    mean_a, mean_l = (sum(r[c][0] for r in rows) / 200 for c in (1, 2))
    top = sorted(rows, key=lambda r: (-(r[1][0] - mean_a) * (r[2][0] - mean_l), r[0]))[:10]
    assert L.kl_cov(df, cfg).first()["loss"] == pytest.approx(plain + sum(abs(r[2][0] - r[3][0]) for r in top) / 200)


def test_thresholds():
    assert C.parse_is_threshold(2.0) == (2.0, None) and C.parse_is_threshold("0.5_5.0") == (5.0, 0.5)
    assert C.parse_rs("token_k1, seq_mean_k2", "4,0.1") == {"token_k1": (0.25, 4.0), "seq_mean_k2": (None, 0.1)}
    for bad in (True, "5_1", "-1", "1_2_3"):
        with pytest.raises((TypeError, ValueError)):
            C.parse_is_threshold(bad)
    for options, t in (("nope", 1.0), ("", 1.0), ("token_k1", None), ("token_k1,token_k2", "1,2,3"), ("token_k2", "1_2")):
        with pytest.raises(ValueError):
            C.parse_rs(options, t)


def test_icepop_zeroes_weights_and_leaves_the_mask(spark):
    df = spark.createDataFrame([([0.0, 1.0, -3.0], [0.0, 0.0, 0.0], [1, 1, 1])], "old_log_probs array<double>, rollout_log_probs array<double>, response_mask array<int>")
    row = C.importance_weights(df, threshold="0.5_2.0").first()
    assert row["is_weights"] == [1.0, 0.0, 0.0] and row["response_mask"] == [1, 1, 1]


def test_eos_mask_and_places(spark):
    df = spark.createDataFrame([([20, 10, 34, 1, 0, 0, 0],)], "ids array<int>")
    row = df.select(A.eos_mask("ids", 1).alias("m"), A.place_reward(F.lit(2.0), F.lit(0)).alias("none"), A.place_reward(F.lit(2.0), F.lit(3)).alias("r")).first()
    assert row["m"] == [1, 1, 1, 1, 0, 0, 0] and row["none"] == [] and row["r"] == [0.0, 0.0, 2.0]
    with pytest.raises(PySparkException):
        df.select(A.fit_length("ids", 3, F.lit(0))).collect()


def batch(spark, n):
    return spark.createDataFrame([(k, chr(97 + k)) for k in range(n)], "row_id long, label string")


def labels(df):
    return "".join(r["label"] for r in df.orderBy("row_id").collect())


def test_padding_is_cyclic_from_the_head(spark):
    b = batch(spark, 3)
    for divisor, want, more in ((2, "abca", 1), (3, "abc", 0), (7, "abcabca", 4)):
        padded, n = B.pad_to_divisor(b, divisor)
        assert labels(padded) == want and n == more and labels(B.unpad(padded, n)) == "abc"
    assert labels(B.pad_with(b, 2, "first")) == "abcaa" and labels(B.pad_with(b, 2, "x")) == "abccc"


def test_batch_algebra(spark):
    b = batch(spark, 4)
    assert labels(B.repeat(b, 2)) == "aabbccdd" and labels(B.repeat(b, 2, interleave=False)) == "abcdabcd"
    assert labels(B.slice_rows(b, None, None, -1)) == "dcba" and labels(B.item(b, slice(1, -1))) == "bc" and labels(B.gather_list(b, [3, -4, 3])) == "dad"
    assert labels(B.concat([b, b])) == "abcdabcd" and labels(B.mask_rows(b, F.col("label") > "b")) == "cd"
    with pytest.raises(ValueError):
        B.chunk(b, 3)
    with pytest.raises(PySparkException):
        B.zip_join(b, b.withColumn("label", F.lit("x"))).collect()
    with pytest.raises(PySparkException):
        B.zip_join(b, B.slice_rows(b, 0, 2)).collect()
    nan = b.withColumn("x", F.lit(float("nan")))
    assert B.zip_join(nan, nan.select("row_id", "x")).count() == 4
    with pytest.raises(ValueError):
        B.merge_dicts({"a": 1}, {"a": 2})


def test_metric_names(spark):
    df = spark.createDataFrame([("a/max", 1.0), ("a/max", 3.0), ("minibatch", 1.0), ("minibatch", 3.0), ("x", 1.0), ("x", 3.0)], "key string, value double")
    assert {r["metric"]: r["value"] for r in M.reduce_by_name(df).collect()} == {"a/max": 3.0, "minibatch": 1.0, "x": 2.0}
    ranks = spark.createDataFrame([("k", 0, 0, 1.0), ("k", 0, 1, 2.0), ("k", 1, 0, 3.0)], "key string, rank int, slot int, value double")
    with pytest.raises(PySparkException):
        M.reduce_ranks(ranks, "mean").collect()
    assert M.reduce_ranks(ranks, "max").first()["value"] == 3.0


def test_bootstrap_estimates_the_closed_form(spark):
    import numpy as np

    df = spark.createDataFrame([("s", "u", v, k) for k, v in enumerate([0.7, 0.8, 0.9, 0.1])], "data_source string, uid string, value double, row_id int")
    exact = {r["metric"]: r["value"] for r in M.validation_metrics(df).collect()}
    assert exact["best@2/mean"] == pytest.approx(0.78125) and exact["mean@4"] == pytest.approx(0.625)
    boot = {r["fn"]: r["mean"] for r in M.bootstrap(df, size=2, fns={"best": F.max, "worst": F.min}).collect()}
    assert boot["best"] == pytest.approx(exact["best@2/mean"], abs=0.02) and boot["worst"] == pytest.approx(exact["worst@2/mean"], abs=0.02)


def test_staleness_boundaries(spark):
    from tidemill.streaming import replay as Y

    p = spark.createDataFrame([("a", "finished", 0), ("b", "finished", 4), ("c", "finished", 5), ("d", "running", 4)], "uid string, status string, global_steps long")
    kept, counts = Y.drop_stale(p, now=5, threshold=2)
    assert {r["uid"] for r in kept.collect()} == {"b", "c", "d"} and counts.first()["dropped"] == 1
    assert not Y.ready(p, batch=3, now=5, threshold=2).first()["ready"] and Y.ready(p, batch=3, now=5, threshold=3).first()["ready"]


def test_balanced_partitions():
    sizes = [100] * 4 + [200] * 4 + [150] * 4 + [50] * 4
    for equal in (False, True):
        parts = P.balanced(sizes, 4, equal=equal)
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert sorted(i for p in parts for i in p) == list(range(16)) and max(sums) - min(sums) <= 50
        assert not equal or {len(p) for p in parts} == {4}
    assert P.greedy([5, 1, 1, 1], 2) == [[0], [1, 2, 3]] and P.small_ends([0, 1, 2, 3, 4]) == [0, 2, 4, 3, 1]
    with pytest.raises(ValueError):
        P.balanced([1], 2)


def test_groups_and_micro_batches(spark):
    rows = [(k, f"u{k // 4}", s) for k, s in enumerate([100] * 4 + [200] * 4 + [150] * 4 + [50] * 4)]
    df = spark.createDataFrame(rows, "row_id long, uid string, len long")
    placed = P.partition_groups(df, 2, size=F.col("len")).collect()
    assert {len({r["part"] for r in placed if r["uid"] == u}) for u in ("u0", "u1", "u2", "u3")} == {1}
    assert sorted(sum(r["len"] for r in placed if r["part"] == p) for p in (0, 1)) == [1000, 1000]
    micro = P.micro_batches(df, length="len", most_tokens=500).collect()
    assert sorted(r["row_id"] for r in micro) == list(range(16)) and len({r["part"] for r in micro}) == 4


def test_scores_of_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(T.final_number(F.lit("a #### 1,234 b #### -5.0"))) == "-5.0" and one(T.final_number(F.lit("so 7 or ."), "flexible")) == "7" and one(T.final_number(F.lit("none"))) is None
    assert one(T.normalize_answer(F.lit("  The  Cat's a hat!"))) == "cats hat"
    tags = "<answer>x</answer>" * 11
    assert one(T.score_qa(F.lit(tags), F.array(F.lit("X")))) == 0.25 and one(T.score_qa(F.lit(tags), F.array(F.lit("X")), contains=True)) == 1.0
    assert T.boxed(r"\boxed{a} \boxed{{b}+\frac{1}{2}}") == r"{b}+\frac{1}{2}" and T.boxed(r"\boxed{a") is None
    assert T.same_latex(r"\dfrac12", "0.5") and T.same_latex("1/2", r"\frac{1}{2}") and T.same_latex(r"x=\sqrt3", r"\sqrt{3}") and not T.same_latex("2", "3") and T.same_latex(r"5\text{ cm}", "5")
    dapo = one(T.score_dapo(F.lit("Answer: $\\frac12$"), F.lit("\\frac{1}{2}")))
    assert dapo["score"] == 1.0 and one(T.score_dapo(F.lit(r"so \boxed{4}"), F.lit("4"), strict_box=True))["acc"]
    with pytest.raises(PySparkException):
        one(T.score_by_source(F.lit("unknown"), F.lit("a"), F.lit("b")))
    assert one(T.preview(F.lit("abc def"), 4)) == "abc...(truncated)"
    assert one(T.retrieval_tokens(F.lit("Tabby 猫在 sofa"))) == ["tabby", "猫", "在", "sofa", "猫在"]
    assert T.query_variants("find the red cat. then go. and see the dog now") == ["find the red cat. then go. and see the dog now", "find the red cat.", "and see the dog now"]


def test_tool_calls():
    gold = [{"name": "f", "parameters": {"x": 1}}]
    assert T.tool_match(gold, gold) == 3.0 and T.tool_match(gold, []) == -3.0
    assert T.tool_match(gold, [{"name": "f", "parameters": {"x": 2}}]) == pytest.approx(-3 + 6 * (1 + 1) / 3)
    assert T.tool_shape("<think>a</think>\n<response>b</response>", "<response>") == 1.0 and T.tool_shape("<response>b</response>", "<response>") == 0.0
    tools = [{"name": "search_web", "required": ["q"]}]
    assert PARSERS["kimi"]('<|tool_calls_section_begin|><|tool_call_begin|>functions.search-web:0<|tool_call_argument_begin|>{"q": 1}<|tool_call_end|>', tools)[1] == [("search_web", '{"q": 1}')]
    assert PARSERS["hermes"]("a <tool_call>no json</tool_call> b") == ("a  b", []) and PARSERS["hermes"]("plain") == ("plain", [])
    assert PARSERS["qwen3_coder"]("x <tool_call><function=f><parameter=a>1")[1] == [("f", '{"a": "1"}')]
    assert PARSERS["gemma4"]('<|tool_call>call:f{a:<|"|>x y<|"|>,b:true,c:1.5}<tool_call|>')[1] == [("f", '{"a": "x y", "b": true, "c": 1.5}')]
    with pytest.raises(ValueError):
        PARSERS["nope"]


MEMORY = "memory_id string, turn_id string, timestamp string, author string, content string, summary string, raw_pointer string, session_key string, turn_index int"


def memory(spark):
    rows = [("n_prev", "D1:1", "2026-01-01 10:00", "user", "a dog", None, None, "a:D1", 1), ("n_mid", "D1:2", "2026-01-01 10:01", "user", "a tabby cat on the sofa", None, None, "a:D1", 2), ("n_next", "D1:3", "2026-01-02 09:00", "bot", "", "a bird", None, "a:D1", 3), ("n_far", "D1:5", "2026/1/3 08:00", "bot", "rain", None, "p.png", "a:D1", 5), ("n_other", "E1:3", "2026-01-01 11:00", "user", "snow", None, None, "b:D1", 3)]
    return spark.createDataFrame(rows, MEMORY)


def ids(df):
    return [r["memory_id"] for r in df.orderBy("ord").collect()]


def test_neighbours_and_traces(spark):
    store = memory(spark)
    found = R.run_trace([{"tool": "RETRIEVE", "query": "tabby cat sofa", "method": "bm25", "top_k": 1}, {"tool": "EXPAND_NEIGHBORS", "window": 1}], "q", store)
    assert ids(found.pool) == ["n_mid", "n_prev", "n_next"] and not found.error
    assert found.evidence.orderBy("ord").first()["memory_id"] == "n_mid" and found.evidence.filter("memory_id = 'n_next'").first()["content"] == "a bird"
    empty = R.run_trace([{"tool": "FILTER", "field": "author", "op": "eq", "value": "nobody"}, {"tool": "EXPAND_NEIGHBORS"}, {"tool": "STOP"}], "q", store)
    assert empty.error and not empty.stopped and len(empty.steps) == 2


def test_timestamp_filters(spark):
    pool = R.initial_pool(memory(spark))
    get = lambda op, v: {r["memory_id"] for r in R.filter_pool(pool, "timestamp", op, v).collect()}
    day = {"n_prev", "n_mid", "n_other"}
    assert get("eq", "2026-01-01") == day and get("contains", "2026/1/1") == day and get("before", "2026-01-02") == day and get("after", "2026-01-02") == {"n_far"}
    assert get("after", "2026-01-01 10:30") == {"n_other", "n_next", "n_far"} and get("neq", "2026-01-01") == {"n_next", "n_far"}


def test_language_refuses(spark):
    for trace in ([], [{"tool": "DROP"}], [{"tool": "TOPK", "k": 0}], [{"tool": "STOP"}, {"tool": "TOPK", "k": 1}], [{"tool": "SORT", "field": "memory_id"}], [{"tool": "RETRIEVE", "query": "memory_id: m1"}], [{"tool": "FILTER", "field": "author", "op": "eq", "value": "x", "extra": 1}], [{"tool": "EXPAND_NEIGHBORS", "window": 4}]):
        with pytest.raises(ValueError):
            R.validate(trace)
    session = R.Session("cat", memory(spark), budget=1)
    assert session.execute({"tool": "TOPK", "k": 2})["size"] == 2 and session.execute({"tool": "TOPK", "k": 1})["error"]


def test_registries_and_loading(tmp_path):
    r = Registry("thing", allow_same=True)
    f = r.register("a")(lambda: 1)
    assert r.register("a")(f) is f and "a" in r and list(r) == ["a"]
    with pytest.raises(ValueError):
        r.register("a")(lambda: 2)
    with pytest.raises(ValueError):
        r["b"]
    path = tmp_path / "mine.py"
    path.write_text("def build(spark, n=1):\n    return n\n")
    assert load_object(str(path), "build")(None, n=5) == 5 and load_object("pkg://math", "pi") == math.pi
    with pytest.raises(AttributeError):
        load_object(str(path), "other")
    with pytest.raises(TypeError):
        D.custom_dataset(str(path), "build", None)


def test_scan_by_extension(spark, tmp_path):
    with pytest.raises(ValueError):
        D.scan(spark, str(tmp_path / "x.csv"))
    assert D.flat_ids({"input_ids": [[1, 2]]}) == [1, 2] and D.flat_ids([3]) == [3]
    with pytest.raises(ValueError):
        D.flat_ids([[1], [2]])


def test_token_bucket_and_limits(spark):
    from tidemill.operators import rewards as W

    clock = [0.0]
    bucket = W.TokenBucket(2.0, 4.0, now=lambda: clock[0])
    assert [bucket.reserve() for _ in range(6)] == [0, 0, 0, 0, 0.5, 1.0]  # full at first, then two a second
    clock[0] = 2.0
    assert bucket.reserve(10.0) == pytest.approx(4.0)  # more than the capacity is waited for ahead of time
    df = spark.range(12).withColumnRenamed("id", "row_id")

    def judge(row):
        if row["row_id"] == 3:
            time.sleep(30)
        if row["row_id"] == 4:
            raise KeyError("no")
        return row["row_id"] * 2

    began = time.monotonic()
    rows = {r["row_id"]: r for r in W.rate_limited(df, judge, requests_per_minute=60_000, max_concurrent=3, timeout=0.5).collect()}
    assert time.monotonic() - began < 20
    assert (rows[3]["reward_score"], rows[3]["error"]) == (0.0, "timeout") and rows[4]["error"] == "KeyError"
    assert all(rows[k]["reward_score"] == 2 * k and rows[k]["error"] is None for k in range(12) if k not in (3, 4))
    began = time.monotonic()
    assert W.rate_limited(df, lambda row: 1.0, tokens_per_minute=600, tokens=5.0).count() == 12  # 60 tokens at ten a second, ten of them at once
    assert time.monotonic() - began > 4
    with pytest.raises(ValueError):
        W.reward_manager("naive", source="importlib")


def test_answers_that_mean_the_same():
    from tidemill.functions import math_equal as E

    for given, truth, same in (("1,234", "1234", True), ("(1,234)", "(1,234)", True), ("\\frac{\\sqrt{2}}{2}", "0.70711", True), ("-(2)^2", "-4", True), ("2(3)", "6", True), ("\\pi r", "\\pi r", True), ("12\\%", "0.12", True), ("(1,2]", "(1,2)", False), ("", "1", False), ("x", "y", False), ("\\sqrt{-1}", "1", False), ("9" * 400, "1", False)):
        assert E.same_answer(given, truth) is same, (given, truth)
    assert E.stated_answer("First. The answer is $7$.") == "$7$."


def test_placement_by_batches(spark):
    """Loads and parts of every batch are those of the plans for it alone."""
    from collections import defaultdict

    rows = [(b * 100 + k, b, (k * k * 7 + b * 13) % 97 + 1) for b in range(4) for k in range(12)]
    df = spark.createDataFrame(rows, "row_id long, batch long, len long").repartition(3)
    for equal in (False, True):
        parts = {r["row_id"]: r["part"] for r in P.partition(df, 3, size=F.col("len"), equal=equal, batch="batch").collect()}
        for b in range(4):
            mine = [r for r in rows if r[1] == b]
            want = P.karmarkar_karp([r[2] for r in mine], 3, equal=equal)
            assert all(parts[mine[i][0]] == p for p, items in enumerate(want) for i in items)
    placed = P.balance_batch(df, 3, length="len", batch="batch").collect()
    assert sorted(r["row_id"] for r in placed) == sorted(r[0] for r in rows)
    spots = defaultdict(list)
    for r in placed:
        spots[r["batch"], r["part"]].append(r["row_id"])
    assert all(max(s) - min(s) == 3 and len(s) == 4 for s in spots.values())


def test_collation_refuses_ragged_arrays(spark):
    df = spark.createDataFrame([(0, 0, [1, 2]), (1, 0, [3])], "row_id long, batch long, x array<int>")
    with pytest.raises(Exception, match="different lengths"):
        B.collate_stacked(df, ["x"], batch="batch").collect()
    assert B.collate_jagged(df, ["x"], batch="batch").first().asDict() == {"batch": 0, "x": [1, 2, 3], "x_offsets": [0, 2, 3]}


def test_background_write_raises(spark, tmp_path):
    from tidemill.sources import files

    path = f"file://{tmp_path}/t"
    files.write_in_background(spark.range(3), path).result()
    with pytest.raises(Exception, match="already exists"):
        files.write_in_background(spark.range(3), path).result()
