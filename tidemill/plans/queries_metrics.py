"""Metrics over orders as trajectories and over long metric tables made of events and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.operators import estimators as E
from tidemill.operators import metrics as M
from tidemill.operators import stats
from tidemill.plans.catalog import query
from tidemill.plans.fixtures import TOKENS, rounded, table, trajectories


def shown(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*(keep or ("metric",)), rounded("value").alias("value"))


def rows_sql(values: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS metric, round({v}, 6) + 0.0 AS value FROM {source}" for k, v in values.items())


THREE = (("mean", "avg"), ("max", "max"), ("min", "min"))
#: A long metric table of events: the key names the reduction.
KEYED = "WITH k AS (SELECT CASE event_type WHEN 'click' THEN 'a/max' WHEN 'view' THEN 'minibatch/x' WHEN 'error' THEN 'timing_s/step' ELSE 'loss/mean' END AS key, value / 7 AS value, event_id AS step, user_id % 4 AS rank FROM events)"


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    key = F.when(kind == "click", "a/max").when(kind == "view", "minibatch/x").when(kind == "error", "timing_s/step").otherwise("loss/mean")
    return table(spark, sf_dir, "events").select(key.alias("key"), (F.col("value") / 7).alias("value"), F.col("event_id").alias("step"), (F.col("user_id") % 4).alias("rank"))


@query("g01_masked_sums", TOKENS + " SELECT row_id, round(sum(vals * response_mask), 6) + 0.0 AS total, round(sum(vals * response_mask) / (sum(response_mask) + 1e-8), 6) + 0.0 AS mean, round(coalesce(max(CASE WHEN response_mask = 1 THEN vals END), 0), 6) + 0.0 AS top FROM tok GROUP BY row_id")
def g01_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=("vals", "response_mask"))
    return df.select("row_id", rounded(A.masked_sum("vals", "response_mask")).alias("total"), rounded(A.masked_mean("vals", "response_mask")).alias("mean"), rounded(A.masked_max("vals", "response_mask")).alias("top"))


@query("g02_masked_mean", TOKENS + " SELECT row_id, round(sum(rewards * response_mask) / (sum(response_mask) + 1e-8), 6) + 0.0 AS rewards, round(sum(old_log_probs * response_mask) / (sum(response_mask) + 1e-8), 6) + 0.0 AS log_probs FROM tok GROUP BY row_id")
def g02_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=("rewards", "old_log_probs", "response_mask"))
    return df.select("row_id", *[rounded(A.masked_mean(c, "response_mask")).alias(n) for n, c in (("rewards", "rewards"), ("log_probs", "old_log_probs"))])


@query("g03_masked_variance", TOKENS + " SELECT round(sum(vals), 6) + 0.0 AS total, round(sum(vals) / (count(*) + 1e-8), 6) + 0.0 AS mean, round(var_samp(vals), 6) + 0.0 AS var, count(*) AS n FROM tok WHERE response_mask = 1")
def g03_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.masked_batch(trajectories(spark, sf_dir, columns=("vals", "response_mask")), "vals")
    return out.select(*[rounded(c).alias(c) for c in ("total", "mean", "var")], "n")


@query("g04_whiten", TOKENS + ", mv AS (SELECT sum(vals) / (count(*) + 1e-8) AS mu, var_samp(vals) AS va FROM tok WHERE response_mask = 1) SELECT row_id, pos, round((vals - mu) / sqrt(va + 1e-8) + mu, 6) + 0.0 AS w FROM tok, mv")
def g04_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.plans.fixtures import per_token

    return per_token(E.whiten(trajectories(spark, sf_dir, columns=("vals", "response_mask")), "vals", "w", shift_mean=False), w="w")


@query("g06_group_keys", "SELECT count(DISTINCT CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'c' || o_custkey END) AS groups FROM orders")
def g06_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit("c"), F.col("o_custkey")))
    return table(spark, sf_dir, "orders").agg(F.count_distinct(stats.group_key(label)).alias("groups"))


@query("g07_reduce_by_name", KEYED + " SELECT key AS metric, round(CASE WHEN key LIKE '%max%' THEN max(value) WHEN key LIKE '%min%' THEN min(value) ELSE avg(value) END, 6) + 0.0 AS value FROM k GROUP BY key")
def g07_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(M.reduce_by_name(keyed(spark, sf_dir)))


@query("g08_accumulate", KEYED + " " + " UNION ALL ".join(f"SELECT '{n}' AS how, key AS metric, round({f}(value), 6) + 0.0 AS value FROM k GROUP BY key" for n, f in (("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max"))))
def g08_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, out = keyed(spark, sf_dir), None
    for how in ("mean", "sum", "min", "max"):
        one = M.accumulate(k, how).select(F.lit(how).alias("how"), F.col("key").alias("metric"), rounded("value").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("g09_reduce_ranks", TOKENS + " SELECT key, round(avg(v), 6) + 0.0 AS value FROM (SELECT data_source AS key, pos AS slot, avg(vals) AS v FROM tok JOIN (SELECT row_id AS r FROM tok GROUP BY 1 HAVING count(*) = 4) ON r = row_id GROUP BY 1, 2) GROUP BY key")
def g09_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=("vals",)).filter(F.size("vals") == 4)
    long = df.select(F.col("data_source").alias("key"), F.col("row_id").alias("rank"), F.posexplode("vals").alias("slot", "value"))
    return M.reduce_ranks(long, "mean").select("key", rounded("value").alias("value"))


@query("g10_reduce_steps", KEYED + " SELECT key AS metric, round(CASE key WHEN 'a/max' THEN max(value) WHEN 'minibatch/x' THEN min(value) WHEN 'timing_s/step' THEN sum(value) ELSE avg(value) END, 6) + 0.0 AS value FROM k GROUP BY key")
def g10_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(M.reduce_steps(keyed(spark, sf_dir)))


BATCH = TOKENS + """, a AS (SELECT o_orderkey AS row_id, coalesce(s, 0) AS score, coalesce(n, 0) AS len, CAST(o_custkey % 50 AS DOUBLE) AS prompt FROM orders LEFT JOIN seq ON row_id = o_orderkey), u AS (SELECT * FROM tok WHERE response_mask = 1) """
BATCH_SQL = {f"critic/{k}/{s}": f"(SELECT {f}(score) FROM a WHERE len <> 0)" for k in ("score", "rewards") for s, f in THREE}
BATCH_SQL |= {f"response_length/{s}": f"(SELECT {f}(len) FROM a)" for s, f in THREE} | {f"response_length_non_aborted/{s}": f"(SELECT {f}(len) FROM a WHERE len <> 0)" for s, f in THREE} | {f"prompt_length/{s}": f"(SELECT {f}(prompt) FROM a)" for s, f in THREE}
BATCH_SQL |= {"response_length/clip_ratio": "(SELECT avg(CASE WHEN len = 7 THEN 1 ELSE 0 END) FROM a)", "response_length_non_aborted/clip_ratio": "(SELECT avg(CASE WHEN len = 7 THEN 1 ELSE 0 END) FROM a WHERE len <> 0)", "response/aborted_ratio": "(SELECT avg(CASE WHEN len = 0 THEN 1 ELSE 0 END) FROM a)", "prompt_length/clip_ratio": "(SELECT avg(CASE WHEN prompt = 49 THEN 1 ELSE 0 END) FROM a)"}
BATCH_SQL |= {f"critic/{n}/{s}": f"(SELECT {f}({c}) FROM u)" for n, c in (("advantages", "advantages"), ("returns", "rewards"), ("values", "vals")) for s, f in THREE} | {"critic/vf_explained_var": "(SELECT 1 - var_samp(rewards - vals) / (var_samp(rewards) + 1e-5) FROM u)"}


@query("g11_data_metrics", BATCH + rows_sql(BATCH_SQL, "(SELECT 1) z"))
def g11_data_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=("rewards", "vals", "advantages", "response_mask"), aborted=True)
    df = df.withColumns({"scores": F.col("rewards"), "returns": F.col("rewards"), "response_length": A.mask_count("response_mask").cast("long"), "prompt_length": F.col("uid") % 50})
    return shown(M.data_metrics(df, max_response=7, max_prompt=49))


LENGTHS = "WITH a AS (SELECT o_orderkey, CAST(o_custkey % 50 AS DOUBLE) AS prompt, CAST(o_orderkey % 9 AS DOUBLE) AS len FROM orders) "


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).cast("double").alias("prompt_length"), (F.col("o_orderkey") % 9).cast("double").alias("response_length"))


@query("g12_timing", LENGTHS + rows_sql({"timing_s/gen": "5e-1", "timing_s/ref": "3e-1", "timing_s/step": "2e0", "timing_per_token_ms/gen": "(SELECT 500 / sum(len) FROM a)", "timing_per_token_ms/ref": "(SELECT 300 / sum(len + prompt) FROM a)"}, "(SELECT 1) z"))
def g12_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(M.timing_metrics(lengths(spark, sf_dir), {"gen": 0.5, "ref": 0.3, "step": 2.0}))


@query("g13_throughput", LENGTHS + rows_sql({"perf/total_num_tokens": "(SELECT sum(len + prompt) FROM a)", "perf/time_per_step": "2e0", "perf/throughput": "(SELECT sum(len + prompt) / 16 FROM a)"}, "(SELECT 1) z"))
def g13_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(M.throughput_metrics(lengths(spark, sf_dir), seconds=2.0, workers=8))


PROXY = TOKENS + ", p AS (SELECT row_id, sum(advantages * response_mask) / (sum(response_mask) + 1e-8) AS a, sum((1 - 2 * exp(old_log_probs) + sum_pi_squared) * response_mask) AS w FROM tok GROUP BY row_id) "


@query("g14_variance_proxies", PROXY + rows_sql({f"variance_proxy/{k}": v for k, v in {"proxy1_signal_strength": "4e-6", "proxy2_total_power": "(SELECT avg(a * a * greatest(w, 0)) FROM p)", "proxy3_pure_noise": "(SELECT greatest(0, (avg(a * a * greatest(w, 0)) - 4e-6) / (count(*) - 1)) FROM p)", "expected_a_squared": "(SELECT avg(a * a) FROM p)", "expected_w": "(SELECT avg(w) FROM p)"}.items()}, "(SELECT 1) z"))
def g14_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(M.variance_proxies(trajectories(spark, sf_dir, columns=("advantages", "old_log_probs", "sum_pi_squared", "response_mask")), 0.002))


MOE = TOKENS + """, cnt AS (SELECT layer, expert, count(*) AS n FROM tok WHERE response_mask = 1 GROUP BY ALL), grid AS (SELECT l.layer, e.e AS expert, coalesce(n, 0) AS n FROM (SELECT DISTINCT layer FROM cnt) l CROSS JOIN range(8) e(e) LEFT JOIN cnt ON cnt.layer = l.layer AND cnt.expert = e.e),
    dev AS (SELECT layer, n * 8e0 / sum(n) OVER (PARTITION BY layer) - 1 AS d FROM grid), lay AS (SELECT layer, max(d) AS max_vio, min(d) AS min_vio, avg(abs(d)) AS avg_vio FROM dev GROUP BY layer) """


@query("g15_expert_counts", TOKENS + " SELECT layer, expert, count(*) AS n FROM tok WHERE response_mask = 1 GROUP BY ALL")
def g15_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.expert_counts(trajectories(spark, sf_dir, columns=("layer", "expert", "response_mask")), experts=8)


@query("g16_expert_imbalance", MOE + " UNION ALL ".join([f"SELECT 'rollout/moe/{k}/layer_' || layer AS metric, round({k}, 6) + 0.0 AS value FROM lay" for k in ("max_vio", "min_vio", "avg_vio")] + [f"SELECT 'rollout/moe/{k}/{s}' AS metric, round({f}({k}), 6) + 0.0 AS value FROM lay" for k in ("max_vio", "min_vio", "avg_vio") for s, f in (("max", "max"), ("avg", "avg"))]))
def g16_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = M.expert_counts(trajectories(spark, sf_dir, columns=("layer", "expert", "response_mask")), experts=8)
    return shown(M.expert_imbalance(counts, experts=8))


@query("g17_expert_accumulator", "SELECT l_orderkey % 20 // 5 AS \"window\", l_linenumber AS layer, l_suppkey % 8 AS expert, count(*) AS n FROM lineitem GROUP BY ALL")
def g17_accumulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 20).alias("step"), F.col("l_linenumber").alias("layer"), (F.col("l_suppkey") % 8).alias("expert")).agg(F.count("*").alias("n"))
    return M.accumulated_counts(counts, every=5)


@query("g18_speculative", "WITH s AS (SELECT CASE WHEN o_orderkey % 5 > 0 THEN (o_custkey % 4) / (o_orderkey % 5 * 1e0) ELSE 0 END AS r, CASE WHEN o_orderkey % 3 > 0 THEN 1 + (o_custkey % 4) / (o_orderkey % 3 * 1e0) ELSE 0 END AS l FROM orders) " + rows_sql({"spec_decode/accept_rate": "(SELECT avg(r) FROM s)", "spec_decode/accept_length": "(SELECT avg(l) FROM s)"}, "(SELECT 1) z"))
def g18_speculative(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 4).alias("accepted"), (F.col("o_orderkey") % 5).alias("drafted"), (F.col("o_orderkey") % 3).alias("verified"))
    return shown(M.speculative_rates(o))


@query("g20_drift", TOKENS + ", d AS (SELECT exp(old_log_probs) AS a, exp(rollout_log_probs) AS b FROM tok WHERE response_mask = 1) " + rows_sql({"rollout_probs_diff_max": "(SELECT max(abs(a - b)) FROM d)", "rollout_probs_diff_mean": "(SELECT avg(abs(a - b)) FROM d)", "rollout_probs_diff_std": "(SELECT stddev_samp(abs(a - b)) FROM d)", "rollout_actor_probs_pearson_corr": "(SELECT corr(a, b) FROM d)"}, "(SELECT 1) z"))
def g20_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(M.drift_metrics(trajectories(spark, sf_dir, columns=("old_log_probs", "rollout_log_probs", "response_mask"))))


@query("g21_token_differences", TOKENS + " SELECT row_id, CAST(sum(CASE WHEN response_mask = 1 AND token_id <> expert THEN 1 ELSE 0 END) AS INT) AS n FROM tok GROUP BY row_id")
def g21_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories(spark, sf_dir, columns=("token_id", "expert", "response_mask")).select("row_id", M.token_differences("token_id", "expert", "response_mask").alias("n"))


@query("g22_percentiles", rows_sql({f"tp{p}": f"(SELECT quantile_cont(value, {p / 100}) FROM events)" for p in (50, 95, 99)}, "(SELECT 1) z"))
def g22_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(M.percentiles(table(spark, sf_dir, "events"), "value"))


STEPS = "WITH s AS (SELECT o_orderkey AS row_id, CAST(o_orderkey % 40 AS BIGINT) AS lo, CAST(o_orderkey % 40 + o_custkey % 3 AS BIGINT) AS hi FROM orders) "


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("o_orderkey") % 40
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), low.alias("min_global_steps"), (low + F.col("o_custkey") % 3).alias("max_global_steps"))


@query("g23_partial_rollouts", STEPS + rows_sql({"partial/total_partial_num": "(SELECT count(*) FROM s WHERE hi <> lo)", "partial/partial_ratio": "(SELECT avg(CASE WHEN hi <> lo THEN 1 ELSE 0 END) FROM s)", "partial/max_partial_span": "(SELECT max(hi - lo) FROM s)", "partial/versions": "(SELECT count(DISTINCT hi) FROM s)"}, "(SELECT 1) z"))
def g23_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(M.partial_stats(steps(spark, sf_dir)))


@query("g24_staleness", STEPS + rows_sql({f"trajectory/{k}/{s}": f"(SELECT {f}(({x}) / 2e0) FROM s)" for k, x in (("span", "hi - lo + 1"), ("staleness", "44 - hi"), ("worst_staleness", "44 - lo")) for s, f in THREE}, "(SELECT 1) z"))
def g24_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(M.staleness_stats(steps(spark, sf_dir), now=F.lit(45), sync=2))


VAL = """WITH v AS (SELECT o_orderpriority AS data_source, o_custkey AS uid, o_orderkey AS row_id, o_totalprice / 97003e0 AS value, o_orderstatus AS pred FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY data_source, uid ORDER BY value) AS i, count(*) OVER (PARTITION BY data_source, uid) AS n FROM v),
    ks AS (SELECT DISTINCT n, k FROM (SELECT DISTINCT n FROM r WHERE n > 1) a, (SELECT CAST(pow(2, x) AS BIGINT) AS k FROM range(1, 20) t(x)) b WHERE k < n UNION SELECT DISTINCT n, n FROM r WHERE n > 1),
    u AS (SELECT data_source, uid, 'mean@' || n AS metric, avg(value) AS value FROM r GROUP BY data_source, uid, n UNION ALL SELECT data_source, uid, 'std@' || n, stddev_pop(value) FROM r WHERE n > 1 GROUP BY data_source, uid, n
    UNION ALL SELECT data_source, uid, 'best@' || k || '/mean', sum(value * (pow(i / (n * 1e0), k) - pow((i - 1) / (n * 1e0), k))) FROM r JOIN ks USING (n) GROUP BY data_source, uid, k
    UNION ALL SELECT data_source, uid, 'worst@' || k || '/mean', sum(value * (pow((n - i + 1) / (n * 1e0), k) - pow((n - i) / (n * 1e0), k))) FROM r JOIN ks USING (n) GROUP BY data_source, uid, k)
    SELECT data_source, metric, round(avg(value), 6) + 0.0 AS value FROM u GROUP BY data_source, metric"""


def validation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("data_source"), F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") / 97003.0).alias("value"), F.col("o_orderstatus").alias("pred"))


@query("g26_best_at_n_exact", VAL)
def g26_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(M.validation_metrics(validation_rows(spark, sf_dir)), "data_source", "metric")


@query("g27_bootstrap_seeded")
def g27_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bootstrap(validation_rows(spark, sf_dir), size=2, fns={"best": F.max, "worst": F.min}, draws=100)


@query("g28_majority_vote", "WITH v AS (SELECT o_custkey AS uid, o_orderstatus AS vote, count(*) AS n, min(o_orderkey) AS f, min_by(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1, 2) SELECT uid, vote, value FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, f) AS k FROM v) WHERE k = 1")
def g28_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderstatus").alias("pred"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("row_id"))
    return M.majority_value(o)


@query("g29_sections", "WITH c AS (SELECT o_custkey, count(*) AS n, max(count(*)) OVER () AS most FROM orders GROUP BY 1), m AS (SELECT *, unnest(['mean@' || n, 'maj@' || n || '/mean', 'worst@' || n || '/mean']) AS metric, CASE WHEN o_custkey % 2 = 0 THEN 'core' ELSE 'other' END AS variable FROM c) SELECT o_custkey, metric, CASE WHEN variable = 'core' AND n = most AND metric NOT LIKE 'worst%' THEN 'val-core' ELSE 'val-aux' END AS section FROM m")
def g29_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of customers with n orders, of which the largest n counts."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").cast("string")).scalar()
    size = F.col("n").cast("string")
    names = F.array(F.concat(F.lit("mean@"), size), F.concat(F.lit("maj@"), size, F.lit("/mean")), F.concat(F.lit("worst@"), size, F.lit("/mean")))
    rows = counts.select("o_custkey", F.explode(names).alias("metric"), F.when(F.col("o_custkey") % 2 == 0, "core").otherwise("other").alias("variable"))
    return rows.withColumn("most", most).select("o_custkey", "metric", M.section(F.col("variable"), F.col("metric"), F.col("most")).alias("section"))


@query("g31_timing_spread", "WITH q AS (SELECT quantile_cont(value, 0.8) AS q FROM events) " + rows_sql({"mean": "(SELECT avg(value) FROM events)", "topk_ratio": "(SELECT avg(CASE WHEN value > q THEN 1 ELSE 0 END) FROM events, q)", "min": "(SELECT min(value) FROM events)", "max": "(SELECT max(value) FROM events)"}, "(SELECT 1) z"))
def g31_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(M.timing_spread(table(spark, sf_dir, "events")))


@query("g32_moments", "SELECT round(avg(value), 6) + 0.0 AS mean, max(value) AS max, min(value) AS min, round(stddev_samp(value), 6) + 0.0 AS std FROM events WHERE user_id % 3 <> 0")
def g32_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.moments(table(spark, sf_dir, "events").withColumn("m", F.when(F.col("user_id") % 3 != 0, 1).otherwise(0)), "value", "m")
    return out.select(rounded("mean").alias("mean"), "max", "min", rounded("std").alias("std"))


@query("g33_distillation", TOKENS + ", u AS (SELECT * FROM tok WHERE response_mask = 1) " + rows_sql({f"distillation/vals/{s}": f"(SELECT {f}(vals) FROM u)" for s, f in THREE}, "(SELECT 1) z"))
def g33_distillation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(M.distillation_metrics(trajectories(spark, sf_dir, columns=("vals", "response_mask")), ("vals",)))


@query("g35_flops", "SELECT round(sum(6e0 * (28e0 * (3584 * 4608 + 3584 * 3584 + 3 * 3584 * 18944) + 2e0 * 152064 * 3584) * (o_orderkey % 9) + 6e0 * (o_orderkey % 9) * (o_orderkey % 9) * 128 * 28 * 28) / 1e15, 6) + 0.0 AS pflops FROM orders")
def g35_flops(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") % 9).cast("double")
    flops = M.transformer_flops(n, n * n, layers=28, hidden=3584, ffn=18944, vocab=152064, heads=28, kv_heads=4, head_dim=128)
    return table(spark, sf_dir, "orders").agg(rounded(F.sum(flops) / 1e15).alias("pflops"))


@query("g37_slowest", TOKENS + ", t AS (SELECT row_id, sum(rewards) AS a, sum(vals) AS b FROM tok GROUP BY row_id), w AS (SELECT * FROM t ORDER BY a + b DESC, row_id LIMIT 1) " + rows_sql({f"{c}/{s}": f"(SELECT {f}({c}) FROM t)" for c in ("a", "b") for s, f in THREE} | {f"slowest/{c}": f"(SELECT {c} FROM w)" for c in ("a", "b")}, "(SELECT 1) z"))
def g37_slowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=("rewards", "vals")).select("row_id", A.array_sum("rewards").alias("a"), A.array_sum("vals").alias("b"))
    return shown(M.slowest(df, ("a", "b")))
