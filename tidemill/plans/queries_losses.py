"""Losses and penalties over orders as trajectories; one row a loss and mode, checked in the long layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.operators import losses as L
from tidemill.plans.catalog import query
from tidemill.plans.fixtures import TOKENS, per_token, rounded, trajectories

COLUMNS = ("response_mask", "advantages", "log_probs", "old_log_probs")
MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-sum-norm", "seq-mean-token-mean")
D = "greatest(-2e1, least(2e1, log_probs - old_log_probs))"
R = f"exp({D})"
CFG = L.LossConfig(clip=0.02, dual_clip=1.01, cov_ratio=0.01, cov_low=0.0, cov_high=5.0)


def clip_sql(x: str, low: str, high: str) -> str:
    return f"greatest({low}, least({high}, {x}))"


#: token losses: (loss, clip flag, kl, lower clip flag) in SQL over tok joined with seq
HELD = clip_sql(R, "98e-2", "102e-2")
BIG = f"greatest(-advantages * {R}, -advantages * {HELD})"
KL2 = "(exp(old_log_probs) * (old_log_probs - log_probs) + (1 - exp(old_log_probs)) * ln((1 - exp(old_log_probs) + 1e-8) / (1 - exp(log_probs) + 1e-8)))"
SEQ_R = "exp(least(1e1, q.dsum / greatest(q.n, 1)))"
SEQ_HELD = clip_sql(SEQ_R, "98e-2", "102e-2")


def keep_sql(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


TV = keep_sql("CASE WHEN advantages > 0 THEN exp(log_probs) - exp(old_log_probs) <= 2e-2 ELSE exp(log_probs) - exp(old_log_probs) >= -2e-2 END")
BKL = keep_sql(f"CASE WHEN advantages > 0 THEN {KL2} <= 2e-2 OR exp(log_probs) <= exp(old_log_probs) ELSE {KL2} <= 2e-2 OR exp(log_probs) >= exp(old_log_probs) END")
TAU = "CASE WHEN advantages > 0 THEN 1e0 ELSE 105e-2 END"
LOSSES = {
    "l02_vanilla": ("vanilla", (f"CASE WHEN advantages < 0 THEN least(-advantages * 101e-2, {BIG}) ELSE {BIG} END", f"-advantages * {HELD} > -advantages * {R}", f"-({D})", f"{BIG} > -advantages * 101e-2 AND advantages < 0")),
    "l03_legacy": ("legacy", (f"CASE WHEN advantages < 0 THEN least(-advantages * 101e-2, {BIG}) ELSE {BIG} END", f"-advantages * {HELD} > -advantages * {R}", f"-({D})", f"{BIG} > -advantages * 101e-2 AND advantages < 0")),
    "l04_dppo_tv": ("dppo_tv", (f"-advantages * least({R}, 2e1) * log_probs * {TV}", f"{TV} = 0", f"-({D})", f"{R} > 2e1")),
    "l05_dppo_kl": ("dppo_kl", (f"-advantages * least({R}, 2e1) * log_probs * {BKL}", f"{BKL} = 0", f"-({D})", f"{R} > 2e1")),
    "l06_gspo": ("gspo", (f"greatest(-advantages * {SEQ_R}, -advantages * {SEQ_HELD})", f"-advantages * {SEQ_HELD} > -advantages * {SEQ_R}", "old_log_probs - log_probs", "false")),
    "l07_sapo": ("sapo", (f"-advantages * (1 / (1 + exp(-({TAU}) * ({R} - 1)))) * (4 / ({TAU}))", "false", f"-({D})", "false")),
    "l08_gpg": ("gpg", ("-log_probs * advantages", "false", "0e0", "false")),
    "l12_cispo": ("cispo", (f"-({HELD}) * advantages * log_probs", f"{R} <> {HELD}", f"-({D})", "false")),
    "l13_reinforce": ("reinforce", ("-advantages * log_probs", "false", "old_log_probs - log_probs", "false")),
}
FORCED = {"gspo": "seq-mean-token-mean", "sapo": "seq-mean-token-mean"}
MODE_SQL = {
    "token-mean": "sum(total) / sum(n)",
    "seq-mean-token-sum": "sum(CASE WHEN n > 0 THEN total END) / count(CASE WHEN n > 0 THEN 1 END)",
    "seq-mean-token-sum-norm": "sum(CASE WHEN n > 0 THEN total END) / count(CASE WHEN n > 0 THEN 1 END) / max(t)",
    "seq-mean-token-mean": "sum(CASE WHEN n > 0 THEN total / (n + 1e-8) END) / count(CASE WHEN n > 0 THEN 1 END)",
}


def loss_sql(name: str, parts: tuple[str, str, str, str]) -> str:
    loss, clip, kl, low = parts
    flag = lambda c: f"sum(CASE WHEN {c} THEN response_mask ELSE 0 END)"
    rows = f"""{TOKENS}, q AS (SELECT row_id, sum(response_mask) AS n, sum((log_probs - old_log_probs) * response_mask) AS dsum FROM tok GROUP BY row_id),
    x AS (SELECT tok.row_id, sum(({loss}) * response_mask) AS total, sum(response_mask) AS n, count(*) AS t, {flag(clip)} AS c, sum(({kl}) * response_mask) AS k, {flag(low)} AS l FROM tok JOIN q ON q.row_id = tok.row_id GROUP BY tok.row_id)"""
    modes = [FORCED[name]] if name in FORCED else MODES
    one = lambda m: f"SELECT '{m}' AS mode, round({MODE_SQL[m]}, 6) + 0.0 AS loss, round(sum(c) / (sum(n) + 1e-8), 6) + 0.0 AS clipfrac, round(sum(k) / (sum(n) + 1e-8), 6) + 0.0 AS kl, round(sum(l) / (sum(n) + 1e-8), 6) + 0.0 AS clipfrac_lower FROM x"
    return rows + " " + " UNION ALL ".join(map(one, modes))


def show(df: DataFrame, **extra: str) -> DataFrame:
    return df.select(*[F.lit(v).alias(k) for k, v in extra.items()], *[rounded(c).alias(c) for c in df.columns])


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _loss(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = trajectories(spark, sf_dir, columns=COLUMNS)
        return union([show(L.policy_loss(df, name, CFG, mode=m), mode=m) for m in ([FORCED[name]] if name in FORCED else MODES)])

    return run


for _key, (_name, _parts) in LOSSES.items():
    query(_key, loss_sql(_name, _parts))(_loss(_name))

COV = """, cm AS (SELECT avg(advantages) AS am, avg(log_probs) AS lm FROM tok WHERE response_mask = 1), cv AS (SELECT tok.*, (advantages - am) * (log_probs - lm) AS cov, log_probs - old_log_probs AS d FROM tok, cm)"""


@query(
    "l10_kl_cov",
    TOKENS + COV + """, rk AS (SELECT *, row_number() OVER (PARTITION BY response_mask ORDER BY cov DESC, row_id, pos) AS k FROM cv),
    x AS (SELECT response_mask AS m, d, -advantages * exp(d) + CASE WHEN m = 1 AND k <= greatest(floor((SELECT sum(response_mask) FROM tok) * 1e-2), 1) THEN abs(d) ELSE 0 END AS loss FROM rk)
    SELECT round(sum(loss * m) / sum(m), 6) + 0.0 AS loss, 0.0::DOUBLE AS clipfrac, round(sum(abs(d) * m) / (sum(m) + 1e-8), 6) + 0.0 AS kl, 0.0::DOUBLE AS clipfrac_lower FROM x""",
)
def l10_kl_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(L.kl_cov(trajectories(spark, sf_dir, columns=COLUMNS), CFG))


@query(
    "l09_clip_cov",
    TOKENS + COV + """, z AS (SELECT row_id, pos, response_mask AS m, d, cov, -advantages * exp(d) AS plain, -advantages * greatest(98e-2, least(102e-2, exp(d))) AS held, ('0x' || substr(md5('0:' || row_id || ':' || pos), 1, 15))::BIGINT::DOUBLE AS draw FROM cv),
    rk AS (SELECT row_id, pos, row_number() OVER (ORDER BY draw, row_id, pos) AS k FROM z WHERE m <> 0 AND NOT held > plain AND cov < 5 AND cov > 0),
    x AS (SELECT z.*, CASE WHEN k <= greatest(floor((SELECT sum(response_mask) FROM tok) * 1e-2), 1) THEN 1 ELSE 0 END AS gone FROM z LEFT JOIN rk ON z.row_id = rk.row_id AND z.pos = rk.pos)
    SELECT round(sum(greatest(plain, held) * (1 - gone) * m) / sum(m), 6) + 0.0 AS loss, round(sum(gone * m) / (sum(m) + 1e-8), 6) + 0.0 AS clipfrac, round(sum(-d * m) / (sum(m) + 1e-8), 6) + 0.0 AS kl, 0.0::DOUBLE AS clipfrac_lower FROM x""",
)
def l09_clip_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(L.clip_cov(trajectories(spark, sf_dir, columns=COLUMNS), CFG))


@query(
    "l11_geo_mean",
    TOKENS + """, g AS (SELECT row_id, advantages AS a, response_mask AS m, log_probs - old_log_probs AS d, greatest(-2e-2, least(2e-2, log_probs - old_log_probs)) AS h, sign(advantages) AS s FROM tok),
    r AS (SELECT row_id, sum(a * m) / (sum(m) + 1e-8) AS am, sum(s * least(s * d, s * h) * m) / (sum(m) + 1e-8) AS dm FROM g GROUP BY row_id)
    SELECT round((SELECT avg(-am * exp(dm)) FROM r), 6) + 0.0 AS loss, round(sum(CASE WHEN d <> h AND a > 0 THEN m ELSE 0 END) / (sum(m) + 1e-8), 6) + 0.0 AS clipfrac, round(sum(-d * m) / (sum(m) + 1e-8), 6) + 0.0 AS kl,
    round(sum(CASE WHEN d <> h AND a < 0 THEN m ELSE 0 END) / (sum(m) + 1e-8), 6) + 0.0 AS clipfrac_lower FROM g""",
)
def l11_geo_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(L.geo_mean(trajectories(spark, sf_dir, columns=COLUMNS), CFG))


@query(
    "l01_aggregations",
    TOKENS + ", x AS (SELECT row_id, sum(advantages * response_mask) AS total, sum(response_mask) AS n, count(*) AS t FROM tok GROUP BY row_id) " + " UNION ALL ".join(f"SELECT '{m}' AS mode, round({MODE_SQL[m]}, 6) + 0.0 AS loss FROM x" for m in MODES),
)
def l01_aggregations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=("advantages", "response_mask"))
    return union([show(L.aggregate_loss(df, "advantages", mode=m), mode=m) for m in MODES])


@query("l01_global_counts", TOKENS + ", x AS (SELECT row_id, sum(advantages * response_mask) AS total, sum(response_mask) AS n FROM tok GROUP BY row_id) SELECT round(sum(total) / 1e5 * 4, 6) + 0.0 AS loss FROM x")
def l01_global_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(L.aggregate_loss(trajectories(spark, sf_dir, columns=("advantages", "response_mask")), "advantages", parts=4, global_tokens=100_000))


@query(
    "l15_value_loss",
    TOKENS + """, v AS (SELECT response_mask AS m, vals + advantages * 3e-1 AS p, rewards AS r, vals AS v FROM tok), c AS (SELECT m, pow(p - r, 2) AS a, pow(greatest(v - 5e-2, least(v + 5e-2, p)) - r, 2) AS b FROM v)
    SELECT round(5e-1 * sum(greatest(a, b) * m) / sum(m), 6) + 0.0 AS loss, round(sum(CASE WHEN b > a THEN m ELSE 0 END) / (sum(m) + 1e-8), 6) + 0.0 AS clipfrac FROM c""",
)
def l15_value_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=("response_mask", "advantages", "rewards", "vals")).withColumn("vpreds", F.zip_with("vals", "advantages", lambda v, a: v + a * 0.3))
    return show(L.value_loss(df, clip=0.05, returns="rewards"))


LOGITS = "array(x[0], x[1], x[2])"


def with_logits(df: DataFrame) -> DataFrame:
    return df.withColumn("logits", F.transform(F.arrays_zip("rewards", "vals", "advantages"), lambda t: F.array(t["rewards"], t["vals"], t["advantages"])))


LSE = "ln(exp(rewards) + exp(vals) + exp(advantages))"
ENT = f"({LSE} - (exp(rewards) * rewards + exp(vals) * vals + exp(advantages) * advantages) / (exp(rewards) + exp(vals) + exp(advantages)))"


@query("l16_entropy_loss", TOKENS + f" SELECT round(sum({ENT} * response_mask) / sum(response_mask), 6) + 0.0 AS loss FROM tok")
def l16_entropy_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(L.entropy_loss(with_logits(trajectories(spark, sf_dir, columns=("response_mask", "rewards", "vals", "advantages")))))


@query("l25_softmax_functions", TOKENS + f" SELECT row_id, pos, round({ENT}, 6) + 0.0 AS entropy, round(vals - {LSE}, 6) + 0.0 AS label_lp, round((exp(2 * rewards) + exp(2 * vals) + exp(2 * advantages)) / pow(exp(rewards) + exp(vals) + exp(advantages), 2), 6) + 0.0 AS sum_pi2 FROM tok")
def l25_softmax_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_logits(trajectories(spark, sf_dir, columns=("rewards", "vals", "advantages")))
    df = df.withColumns({"e": F.transform("logits", A.entropy), "l": F.transform("logits", lambda x: A.label_log_prob(x, F.lit(1))), "s": F.transform("logits", A.sum_squared_probs)})
    return per_token(df, entropy="e", label_lp="l", sum_pi2="s")


KD = "greatest(-2e1, least(2e1, ref_log_prob - old_log_probs))"
PENALTY_SQL = {"k1": "old_log_probs - ref_log_prob", "abs": "abs(old_log_probs - ref_log_prob)", "k2": "5e-1 * pow(old_log_probs - ref_log_prob, 2)", "k3": f"greatest(-1e1, least(1e1, exp({KD}) - {KD} - 1))"}


@query("l17_kl_penalties", TOKENS + " SELECT row_id, pos, " + ", ".join(f"round({sql}, 6) + 0.0 AS {n}" for n, sql in PENALTY_SQL.items()) + " FROM tok")
def l17_kl_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=("old_log_probs", "ref_log_prob"))
    names = {"k1": "kl+", "abs": "abs", "k2": "mse", "k3": "low_var_kl+"}
    penalty = lambda n: F.zip_with("old_log_probs", "ref_log_prob", lambda x, y: L.kl_penalty(x, y, n))
    df = df.withColumns({f"_{k}": penalty(n) for k, n in names.items()})
    return per_token(df, **{k: f"_{k}" for k in names})


@query("l18_kl_in_reward", TOKENS + f" SELECT row_id, pos, round(rewards - 1e-1 * ({PENALTY_SQL['k3']}) * response_mask, 6) + 0.0 AS reward, round(sum(({PENALTY_SQL['k3']}) * response_mask) OVER (PARTITION BY row_id) / (sum(response_mask) OVER (PARTITION BY row_id) + 1e-8), 6) + 0.0 AS row_kl FROM tok")
def l18_kl_in_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = L.penalize_rewards(trajectories(spark, sf_dir, columns=("rewards", "response_mask", "old_log_probs", "ref_log_prob")), beta=0.1, penalty="k3")
    return per_token(df.withColumn("row_kl", rounded("row_kl")), keep=("row_id", "row_kl"), reward="rewards")


@query("l19_plain_rewards", TOKENS + " SELECT row_id, pos, round(rewards - 1e-1 * (old_log_probs - ref_log_prob), 6) + 0.0 AS reward FROM tok")
def l19_plain_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_token(L.plain_rewards(trajectories(spark, sf_dir, columns=("rewards", "old_log_probs", "ref_log_prob")), beta=0.1), reward="rewards")


@query(
    "l20_adaptive_kl",
    """WITH RECURSIVE st AS (SELECT row_number() OVER (ORDER BY d) AS k, kl FROM (SELECT CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) / 1e6 AS kl FROM orders GROUP BY 1)),
    f AS (SELECT 0::BIGINT AS k, 2e-1 AS c UNION ALL SELECT st.k, f.c * (1 + greatest(-2e-1, least(2e-1, st.kl / 15e-2 - 1)) * 64 / 1e4) FROM f JOIN st ON st.k = f.k + 1) SELECT k AS step, round(c, 6) + 0.0 AS kl_coef FROM f WHERE k > 0""",
)
def l20_adaptive_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    days = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("d")).agg((F.avg("o_totalprice") / 1e6).alias("kl"))
    steps = days.withColumn("step", F.row_number().over(Window.orderBy("d")).cast("long")).withColumn("n_steps", F.lit(64))
    return L.adaptive_controller(steps, start=0.2, target=0.15, horizon=10_000).select("step", rounded("kl_coef").alias("kl_coef"))


@query("l22_reverse_kl_distillation", TOKENS + " SELECT round(sum(greatest(-5e-2, least(5e-2, log_probs - ref_log_prob)) * response_mask) / sum(response_mask), 6) + 0.0 AS loss FROM tok")
def l22_reverse_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = L.reverse_kl(trajectories(spark, sf_dir, columns=("response_mask", "log_probs", "ref_log_prob")))
    return show(L.distillation_loss(df, bound=0.05))


@query(
    "l23_forward_kl_topk",
    TOKENS + """, p AS (SELECT row_id, pos, ref_log_prob - 1 AS t0, ref_log_prob - 2 AS t1, log_probs - 1 AS s0, log_probs - 3 AS s2 FROM tok)
    SELECT row_id, pos, round(greatest(0, exp(t0) * (t0 - s0) + exp(t1) * (t1 - s2)), 6) + 0.0 AS loss, round(exp(t0) + exp(t1), 6) + 0.0 AS teacher_mass, round(exp(s0) + exp(s2), 6) + 0.0 AS student_mass, 5e-1 AS overlap FROM p""",
)
def l23_forward_kl_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = lambda i, lp: F.struct(F.lit(i).alias("id"), lp.alias("lp"))
    df = trajectories(spark, sf_dir, columns=("log_probs", "ref_log_prob"))
    df = df.withColumns({"teacher_top": F.transform("ref_log_prob", lambda x: F.array(entry(0, x - 1), entry(1, x - 2))), "student_top": F.transform("log_probs", lambda x: F.array(entry(0, x - 1), entry(2, x - 3)))})
    return per_token(L.forward_kl_topk(df), loss="distill", teacher_mass="teacher_mass", student_mass="student_mass", overlap="overlap")


@query("l24_distillation_aggregate", TOKENS + " SELECT round(sum(greatest(-1e-2, least(1e-2, 5e-1 * pow(log_probs - ref_log_prob, 2))) * response_mask) / sum(response_mask), 6) + 0.0 AS loss FROM tok")
def l24_distillation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = L.DISTILLATION_LOSSES["k2"](trajectories(spark, sf_dir, columns=("response_mask", "log_probs", "ref_log_prob")), name="k2")
    return show(L.distillation_loss(df, bound=0.01))


KINDS = {"reverse_kl": "log_probs - ref_log_prob", "abs": "abs(log_probs - ref_log_prob)", "mse": "5e-1 * pow(log_probs - ref_log_prob, 2)", "k3": "greatest(-1e1, least(1e1, exp(ref_log_prob - log_probs) - (ref_log_prob - log_probs) - 1))"}


@query("h03_distillation_by_name", TOKENS + " " + " UNION ALL ".join(f"SELECT '{k}' AS name, row_id, pos, round({v}, 6) + 0.0 AS x FROM tok" for k, v in KINDS.items()))
def h03_distillation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered distillation losses by their names, and one registered on the spot."""
    df = trajectories(spark, sf_dir, columns=("log_probs", "ref_log_prob"))
    if "twice_abs" not in L.DISTILLATION_LOSSES:
        L.register_distillation_loss(L.DistillationSettings(("twice_abs",)))(lambda df, name: L.distill(df, "abs").withColumn("distill", F.transform("distill", lambda x: 2 * x)))
    own = per_token(L.distill(df, "twice_abs").withColumn("x", F.transform("distill", lambda x: x / 2)), x="x").select(F.lit("abs").alias("name"), "*")
    named = [per_token(L.distill(df, k), x="distill").select(F.lit(k).alias("name"), "*") for k in KINDS if k != "abs"]
    return union([own, *named])
