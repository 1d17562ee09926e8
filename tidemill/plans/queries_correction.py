"""Off-policy correction over orders as trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.operators import correction as C
from tidemill.operators import losses as L
from tidemill.plans.catalog import query
from tidemill.plans.fixtures import TOKENS, per_token, rounded, trajectories

COLUMNS = ("response_mask", "old_log_probs", "rollout_log_probs")
X = "greatest(-2e1, least(2e1, old_log_probs - rollout_log_probs))"
KINDS = {"k1": f"-({X})", "k2": f"5e-1 * pow({X}, 2)", "k3": f"exp({X}) - 1 - ({X})"}
#: thresholds in the parser's words, and as bounds in SQL
SPECS = {"k1": ("0.97_1.04", "ln(97e-2)", "ln(104e-2)"), "k2": ("0.0007", None, "7e-4"), "k3": ("0.0006", None, "6e-4")}
LONG = TOKENS + ", lr AS (SELECT row_id, pos, response_mask AS m, old_log_probs - rollout_log_probs AS lr, " + ", ".join(f"{sql} AS {k}" for k, sql in KINDS.items()) + " FROM tok)"


def verdict_sql(option: str) -> str:
    """1 where a token of ``lr`` is kept, with windows over its row."""
    level, kind = option.rsplit("_", 1)
    _, low, high = SPECS[kind]
    over = "OVER (PARTITION BY row_id)"
    stat = {
        "token": kind,
        "seq_sum": f"(sum({kind} * m) {over})",
        "seq_mean": f"(sum({kind} * m) {over} / (sum(m) {over} + 1e-8))",
        "seq_max": f"coalesce(max(CASE WHEN m = 1 THEN {kind} END) {over}, 0)",
    }[level]
    return f"CASE WHEN {stat} <= {high}{f' AND {stat} >= {low}' if low else ''} THEN 1 ELSE 0 END"


def _reject(option: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = C.reject(trajectories(spark, sf_dir, columns=COLUMNS), option, SPECS[option.rsplit("_", 1)[1]][0])
        return per_token(df, mask="response_mask")

    return run


for _k, _option in enumerate(C.OPTIONS):
    query(f"r{_k + 4:02d}_{_option}", LONG + f" SELECT row_id, pos, CAST(m * {verdict_sql(_option)} AS INT) AS mask FROM lr")(_reject(_option))


@query("r15_combined_rejection", LONG + f" SELECT row_id, pos, CAST(m * {verdict_sql('token_k2')} * {verdict_sql('seq_mean_k1')} AS INT) AS mask FROM lr")
def r15_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = C.reject(trajectories(spark, sf_dir, columns=COLUMNS), "token_k2,seq_mean_k1,token_k2", "0.0007,0.97_1.04")
    return per_token(df, mask="response_mask")


def metrics_sql(option: str) -> str:
    level, kind = option.rsplit("_", 1)
    _, low, high = SPECS[kind]
    seq = level != "token"
    p = f"rollout_rs_{option}"
    floor = low or "0e0"
    over = "OVER (PARTITION BY row_id)"
    stat = {"token": kind, "seq_sum": f"sum({kind} * m) {over}", "seq_mean": f"sum({kind} * m) {over} / (sum(m) {over} + 1e-8)", "seq_max": f"coalesce(max(CASE WHEN m = 1 THEN {kind} END) {over}, 0)"}[level]
    below = lambda x: f"CASE WHEN {x} < {low} THEN 1e0 ELSE 0 END" if low else "0e0"
    above = lambda x: f"CASE WHEN {x} > {high} THEN 1e0 ELSE 0 END"
    n = "(sum(n) + 1e-8)"
    sq = f"sum(tot) / {n}"
    rows = {
        "mean": sq,
        "max": "max(sv)" if seq else "max(tmax)",
        "min": "min(sv)" if seq else "min(tmin)",
        "fraction_high": f"avg(CASE WHEN n > 0 THEN {above('sv')} END)" if seq else f"sum(hi) / {n}",
        "fraction_low": f"avg(CASE WHEN n > 0 THEN {below('sv')} END)" if seq else f"sum(lo) / {n}",
        "std": f"sqrt(greatest(sum(hsq) / {n} - pow(sum(held) / {n}, 2), 0))",
        "seq_mean": "avg(sv)",
        "seq_std": "coalesce(stddev_samp(sv), 0)",
        "seq_max": "max(sv)",
        "seq_min": "min(sv)",
        "seq_max_deviation": "max(abs(sv))",
        "seq_fraction_high": f"avg(CASE WHEN n > 0 THEN {above('sv')} END)",
        **({"seq_fraction_low": f"avg(CASE WHEN n > 0 THEN {below('sv')} END)"} if low else {}),
        "masked_fraction": f"sum(dropped) / {n}",
        "seq_masked_fraction": "avg(CASE WHEN n > 0 THEN CASE WHEN dropped > 0 THEN 1e0 ELSE 0 END END)",
    }
    values = [(f"{p}_{k}", v) for k, v in rows.items()] + [("rollout_rs_masked_fraction", f"sum(dropped) / {n}"), ("rollout_rs_seq_masked_fraction", "avg(CASE WHEN dropped > 0 THEN 1e0 ELSE 0 END)")]
    return (
        LONG
        + f""", st AS (SELECT row_id, m, {stat} AS v, {verdict_sql(option)} AS keep FROM lr),
        sq AS (SELECT row_id, sum(m) AS n, sum(v * m) AS tot, {'max(CASE WHEN m = 1 THEN v END)' if seq else 'CASE WHEN sum(m) > 0 THEN sum(v * m) / (sum(m) + 1e-8) END'} AS sv, max(CASE WHEN m = 1 THEN v END) AS tmax, min(CASE WHEN m = 1 THEN v END) AS tmin,
        sum({above('v')} * m) AS hi, sum({below('v')} * m) AS lo, sum(greatest({floor}, least({high}, v)) * m) AS held, sum(pow(greatest({floor}, least({high}, v)), 2) * m) AS hsq, sum(m * (1 - keep)) AS dropped FROM st GROUP BY row_id) """
        + " UNION ALL ".join(f"SELECT '{k}' AS metric, round({v}, 6) + 0.0 AS value FROM sq" for k, v in values)
    )


def _metrics(option: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = C.rejection_metrics(trajectories(spark, sf_dir, columns=COLUMNS), option, SPECS[option.rsplit("_", 1)[1]][0])
        return out.select("metric", rounded("value").alias("value"))

    return run


for _option in ("token_k1", "seq_mean_k1", "seq_max_k3"):
    query(f"r16_metrics_{_option}", metrics_sql(_option))(_metrics(_option))

RAW = {"token": f"exp({X}) * m", "sequence": "exp(greatest(-2e1, least(2e1, sum(lr * m) OVER (PARTITION BY row_id)))) * m"}


def weights_sql(level: str, held: str, then: str = "w") -> str:
    raw = RAW[level].replace("old_log_probs - rollout_log_probs", "lr")
    return LONG + f", rw AS (SELECT row_id, pos, m, {raw} AS r FROM lr), wt AS (SELECT row_id, pos, m, {held} AS w FROM rw) SELECT row_id, pos, round({then}, 6) + 0.0 AS w FROM wt"


WEIGHTS = {
    "r17_token_weights": ({"level": "token", "threshold": 1000.0}, weights_sql("token", "r")),
    "r18_sequence_weights": ({"level": "sequence", "threshold": 1000.0}, weights_sql("sequence", "r")),
    "r19_truncated_weights": ({"level": "token", "threshold": 1.01}, weights_sql("token", "least(r, 101e-2)")),
    "r20_icepop": ({"level": "token", "threshold": "0.98_1.01"}, weights_sql("token", "CASE WHEN r >= 98e-2 AND r <= 101e-2 THEN r ELSE 0 END")),
    "r21_normalized_token": ({"level": "token", "threshold": 1.01, "normalize": True}, weights_sql("token", "least(r, 101e-2)", "w / (SELECT sum(w * m) / (sum(m) + 1e-8) FROM wt)")),
    "r21_normalized_sequence": ({"level": "sequence", "threshold": 1.01, "normalize": True}, weights_sql("sequence", "least(r, 101e-2)", "w / (SELECT sum(CASE WHEN n > 0 THEN s / (n + 1e-8) ELSE 0 END) / sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) FROM (SELECT sum(w * m) AS s, sum(m) AS n FROM wt GROUP BY row_id))")),
}


def _weights(config: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return per_token(C.importance_weights(trajectories(spark, sf_dir, columns=COLUMNS), **config), w="is_weights")

    return run


for _name, (_config, _sql) in WEIGHTS.items():
    query(_name, _sql)(_weights(_config))


def weight_metrics_sql(level: str, upper: str, lower: str, held: str, icepop: bool) -> str:
    raw = RAW[level].replace("old_log_probs - rollout_log_probs", "lr")
    n = "(sum(n) + 1e-8)"
    if level == "sequence":
        top = {"max": "exp(least(max(lsum), 2e1))", "min": "exp(min(lsum))", "ratio_fraction_high": f"avg(CASE WHEN lsum > ln({upper}) THEN 1e0 ELSE 0 END)", "ratio_fraction_low": f"avg(CASE WHEN lsum < ln({lower}) THEN 1e0 ELSE 0 END)"}
    else:
        top = {"max": "max(mx)", "min": "min(mn)", "ratio_fraction_high": f"sum(hi) / {n}", "ratio_fraction_low": f"sum(lo) / {n}"}
    rows = {
        "mean": f"sum(ws) / {n}", **top, "std": f"sqrt(greatest(sum(sq) / {n} - pow(sum(hd) / {n}, 2), 0))", "eff_sample_size": f"1 / (sum(sq) / {n} / pow(sum(hd) / {n} + 1e-8, 2))",
        "seq_mean": "avg(sm)", "seq_std": "stddev_samp(sm)", "seq_max": "max(sm)", "seq_min": "min(sm)", "seq_max_deviation": "max(abs(sm - 1))", "seq_fraction_high": f"avg(CASE WHEN rs > {upper} THEN 1e0 ELSE 0 END)", "seq_fraction_low": f"avg(CASE WHEN rs < {lower} THEN 1e0 ELSE 0 END)",
        **({"oob_ratio": f"(sum(hi) + sum(lo)) / {n}"} if icepop else {}),
    }
    return (
        LONG
        + f""", rw AS (SELECT row_id, m, lr, {raw} AS r FROM lr), wt AS (SELECT *, {held} AS w FROM rw), sq AS (SELECT row_id, sum(m) AS n, sum(lr * m) AS lsum, sum(w * m) AS ws, sum(w * m) / (sum(m) + 1e-8) AS sm, sum(r * m) / (sum(m) + 1e-8) AS rs,
        sum(CASE WHEN r > {upper} THEN m ELSE 0 END) AS hi, sum(CASE WHEN r < {lower} THEN m ELSE 0 END) AS lo, max(CASE WHEN m = 1 THEN w END) AS mx, min(CASE WHEN m = 1 THEN w END) AS mn, sum(least(greatest(w, 0), {upper}) * m) AS hd, sum(pow(least(greatest(w, 0), {upper}), 2) * m) AS sq FROM wt GROUP BY row_id) """
        + " UNION ALL ".join(f"SELECT 'rollout_is_{k}' AS metric, round({v}, 6) + 0.0 AS value FROM sq" for k, v in rows.items())
    )


def _weight_metrics(config: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.weight_metrics(trajectories(spark, sf_dir, columns=COLUMNS), **config).select("metric", rounded("value").alias("value"))

    return run


query("r22_is_metrics_token", weight_metrics_sql("token", "101e-2", "(1 / 101e-2)", "least(r, 101e-2)", False))(_weight_metrics({"level": "token", "threshold": 1.01}))
query("r22_is_metrics_sequence", weight_metrics_sql("sequence", "103e-2", "(1 / 103e-2)", "least(r, 103e-2)", False))(_weight_metrics({"level": "sequence", "threshold": 1.03}))
query("r22_is_metrics_icepop", weight_metrics_sql("token", "101e-2", "98e-2", "CASE WHEN r >= 98e-2 AND r <= 101e-2 THEN r ELSE 0 END", True))(_weight_metrics({"level": "token", "threshold": "0.98_1.01"}))

OFF = {
    "training_ppl": "avg(exp(-tr))", "training_log_ppl": "avg(-tr)", "kl": "sum(kl) / (sum(n) + 1e-8)", "k3_kl": "sum(k3) / (sum(n) + 1e-8)", "rollout_ppl": "avg(exp(-ro))", "rollout_log_ppl": "avg(-ro)", "log_ppl_diff": "avg(ro - tr)",
    "log_ppl_abs_diff": "avg(abs(ro - tr))", "log_ppl_diff_max": "max(ro - tr)", "log_ppl_diff_min": "min(ro - tr)", "ppl_ratio": "avg(exp(ro - tr))", "chi2_token": "sum(rho) / (sum(n) + 1e-8) - 1", "chi2_seq": "avg(exp(2 * ls)) - 1",
}
OFF_SQL = TOKENS + """, sq AS (SELECT row_id, sum(response_mask) AS n, sum(old_log_probs * response_mask) / (sum(response_mask) + 1e-8) AS tr, sum(rollout_log_probs * response_mask) / (sum(response_mask) + 1e-8) AS ro,
    sum((rollout_log_probs - old_log_probs) * response_mask) AS kl, sum((exp(old_log_probs - rollout_log_probs) - (old_log_probs - rollout_log_probs) - 1) * response_mask) AS k3,
    sum(exp(2 * (old_log_probs - rollout_log_probs)) * response_mask) AS rho, greatest(-2e1, least(2e1, sum((old_log_probs - rollout_log_probs) * response_mask))) AS ls FROM tok GROUP BY row_id) """


@query("g19_offpolicy_metrics", OFF_SQL + " UNION ALL ".join(f"SELECT '{k}' AS metric, round({v}, 6) + 0.0 AS value FROM sq" for k, v in OFF.items()))
def g19_offpolicy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.offpolicy_metrics(trajectories(spark, sf_dir, columns=COLUMNS)).select("metric", rounded("value").alias("value"))


@query("r25_metrics_prefixed", OFF_SQL + " UNION ALL ".join(f"SELECT 'rollout_corr/{k}' AS metric, round({v}, 6) + 0.0 AS value FROM sq" for k, v in OFF.items()))
def r25_prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.correction_metrics(trajectories(spark, sf_dir, columns=COLUMNS)).select("metric", rounded("value").alias("value"))


@query(
    "r23_correct",
    LONG + f", rw AS (SELECT row_id, pos, m, least(exp({X.replace('old_log_probs - rollout_log_probs', 'lr')}) * m, 101e-2) AS w, {verdict_sql('seq_mean_k2')} AS keep FROM lr) SELECT row_id, pos, round(w, 6) + 0.0 AS w, CAST(m * keep AS INT) AS mask FROM rw",
)
def r23_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = C.correct(trajectories(spark, sf_dir, columns=COLUMNS), level="token", threshold=1.01, options="seq_mean_k2", rs_thresholds=0.0007)
    return per_token(df, w="is_weights", mask="response_mask")


@query("r24_weights_applied_to_loss", LONG.replace(" FROM tok)", ", advantages AS a, log_probs AS lp FROM tok)") + f" SELECT round(sum(-a * lp * least(exp({X.replace('old_log_probs - rollout_log_probs', 'lr')}) * m, 101e-2) * m) / sum(m), 6) + 0.0 AS loss FROM lr")
def r24_weights_in_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = C.correct(trajectories(spark, sf_dir, columns=(*COLUMNS, "advantages", "log_probs")), level="token", threshold=1.01)
    return L.reinforce(df, L.LossConfig(), "token-mean", weights="is_weights").select(rounded("loss").alias("loss"))


@query("r26_bypass", TOKENS + " SELECT row_id, pos, round(rollout_log_probs, 6) + 0.0 AS old FROM tok")
def r26_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_token(C.bypass(trajectories(spark, sf_dir, columns=COLUMNS)), old="old_log_probs")


@query(
    "r27_preset_seq_is_rs",
    LONG + """, s AS (SELECT *, sum(lr * m) OVER (PARTITION BY row_id) AS t FROM lr) SELECT row_id, pos, round(least(exp(t) * m, 2), 6) + 0.0 AS w, CAST(m * CASE WHEN -t >= ln(5e-1) AND -t <= ln(2) THEN 1 ELSE 0 END AS INT) AS mask FROM s""",
)
def r27_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = C.PRESETS["decoupled_seq_is_rs"].apply(trajectories(spark, sf_dir, columns=COLUMNS))
    return per_token(df, w="is_weights", mask="response_mask")


@query(
    "l14_bypass_mode",
    TOKENS + """, x AS (SELECT row_id, response_mask AS m, advantages AS a, log_probs AS lp, least(exp(greatest(-2e1, least(2e1, sum((log_probs - rollout_log_probs) * response_mask) OVER (PARTITION BY row_id)))) * response_mask, 2) AS w FROM tok),
    r AS (SELECT row_id, sum(-a * lp * w * m) AS t, sum(m) AS n FROM x GROUP BY row_id) SELECT round(sum(CASE WHEN n > 0 THEN t END) / count(CASE WHEN n > 0 THEN 1 END), 6) + 0.0 AS loss FROM r""",
)
def l14_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=(*COLUMNS, "advantages", "log_probs"))
    return L.bypass_loss(df, loss="reinforce", mode="seq-mean-token-sum", level="sequence", threshold=2.0).select(rounded("loss").alias("loss"))


@query("f11_rejected_rows", LONG + f", k AS (SELECT row_id, m * {verdict_sql('seq_mean_k1')} AS x FROM lr) SELECT count(*) AS rejected FROM (SELECT row_id FROM k GROUP BY row_id HAVING sum(x) = 0)")
def f11_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = C.reject(trajectories(spark, sf_dir, columns=COLUMNS), "seq_mean_k1", "0.97_1.04")
    return df.agg(F.count_if(F.aggregate("response_mask", F.lit(0), lambda a, m: a + m) == 0).alias("rejected"))


@query("r01_threshold_bounds", TOKENS + " SELECT row_id, pos, CASE WHEN exp(old_log_probs - rollout_log_probs) > 102e-2 THEN 'above' WHEN exp(old_log_probs - rollout_log_probs) < 98e-2 THEN 'below' ELSE 'inside' END AS found FROM tok")
def r01_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens' importance ratios by a threshold's two bounds."""
    upper, lower = C.parse_is_threshold("0.98_1.02")
    df = trajectories(spark, sf_dir, columns=("old_log_probs", "rollout_log_probs"))
    side = lambda r: F.when(r > upper, "above").when(r < lower, "below").otherwise("inside")
    return per_token(df.withColumn("f", F.zip_with("old_log_probs", "rollout_log_probs", lambda o, r: side(F.exp(o - r)))), found="f")


@query("r02_option_bounds", TOKENS + ", s AS (SELECT row_id, avg(rollout_log_probs - old_log_probs) AS m FROM tok GROUP BY row_id) SELECT 'token_k1' AS option, count(*) FILTER (rollout_log_probs - old_log_probs BETWEEN -153e-4 AND 153e-4) AS kept FROM tok UNION ALL SELECT 'seq_mean_k1', count(*) FILTER (m BETWEEN 1 / 10153e-4 - 1 AND 153e-4) FROM s")
def r02_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and sequences within the bounds of two options, whose ratios' bounds are given as text."""
    bounds = C.parse_rs("token_k1, seq_mean_k1", "0.9847_1.0153, 1.0153")
    df = trajectories(spark, sf_dir, columns=("old_log_probs", "rollout_log_probs")).withColumn("k1", F.zip_with("old_log_probs", "rollout_log_probs", lambda o, r: r - o))
    inside = lambda x, option: x.between(bounds[option][0] - 1, bounds[option][1] - 1)
    tokens = df.select(F.explode("k1").alias("x")).agg(F.lit("token_k1").alias("option"), F.count_if(inside(F.col("x"), "token_k1")).alias("kept"))
    means = df.select((A.array_sum("k1") / F.size("k1")).alias("x")).agg(F.lit("seq_mean_k1").alias("option"), F.count_if(inside(F.col("x"), "seq_mean_k1")).alias("kept"))
    return tokens.unionByName(means)
