"""Group-relative estimators over orders as trajectories: one row for each token, checked in the long layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.operators import estimators as E
from tidemill.plans.catalog import query
from tidemill.plans.fixtures import TOKENS, per_token, rounded, trajectories

#: Group statistics per customer, in the oracles.
GRP = ", grp AS (SELECT uid, count(*) AS gn, avg(s) AS gmean, stddev_samp(s) AS gstd, sum(s) AS gsum, sum(n) AS gl, sum(n * s) AS gw FROM seq GROUP BY uid)"
#: Whitening of the column ``a`` of ``raw`` (row_id, pos, m, a).
WHITE = ", mv AS (SELECT sum(a * m) / (sum(m) + 1e-8) AS mu, var_samp(CASE WHEN m = 1 THEN a END) AS va FROM raw)"
COLUMNS = ("rewards", "response_mask")


def scalar_sql(expression: str, extra: str = "") -> str:
    return TOKENS + GRP + extra + f" SELECT t.row_id, t.pos, round(({expression}) * t.response_mask, 6) + 0.0 AS adv FROM tok t JOIN seq q USING (row_id) JOIN grp g ON g.uid = q.uid"


def white_sql(raw: str, remask: bool = True) -> str:
    return TOKENS + GRP + f", raw AS ({raw})" + WHITE + f" SELECT row_id, pos, round((a - mu) / sqrt(va + 1e-8){' * m' if remask else ''}, 6) + 0.0 AS adv FROM raw, mv"


def advantage(df: DataFrame) -> DataFrame:
    return per_token(df, adv="advantages")


CENTRED = "CASE WHEN gn = 1 THEN s ELSE s - gmean END"

SCALARS = {
    "w02_grpo": ("grpo", {}, "CASE WHEN gn = 1 THEN s / (1 + 1e-6) ELSE (s - gmean) / (gstd + 1e-6) END"),
    "w02_dr_grpo": ("grpo", {"by_std": False}, CENTRED),
    "w03_grpo_vectorized": ("grpo_vectorized", {}, "CASE WHEN gn = 1 THEN s / (1 + 1e-6) ELSE (s - gmean) / (gstd + 1e-6) END"),
    "w07_rloo": ("rloo", {}, "CASE WHEN gn = 1 THEN s ELSE (s - gmean) * gn / (gn - 1) END"),
    "w08_rloo_vectorized": ("rloo_vectorized", {}, "CASE WHEN gn = 1 THEN 0 ELSE (gn * s - gsum) / (gn - 1) END"),
    "w09_opo": ("opo", {}, "s - CASE WHEN gn = 1 OR gl = 0 THEN CASE WHEN gn = 1 THEN 0 END ELSE gw / gl END"),
    "w12_gpg": ("gpg", {}, f"(SELECT count(*) / greatest(count(CASE WHEN s <> 0 THEN 1 END), 1) FROM seq) * ({CENTRED})"),
}


def _scalar(estimator: str, config: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return advantage(E.compute_advantage(trajectories(spark, sf_dir, columns=COLUMNS), estimator, **config))

    return run


for _name, (_estimator, _config, _sql) in SCALARS.items():
    query(_name, scalar_sql(_sql))(_scalar(_estimator, _config))


@query(
    "w05_grpo_passk",
    TOKENS + GRP + """, r AS (SELECT q.*, row_number() OVER (PARTITION BY uid ORDER BY s DESC, row_id) AS k, lead(s) OVER (PARTITION BY uid ORDER BY s DESC, row_id) AS s2 FROM seq q)
    SELECT t.row_id, t.pos, round(CASE WHEN r.k = 1 THEN (r.s - r.s2) / (gstd + 1e-6) ELSE 0 END * t.response_mask, 6) + 0.0 AS adv FROM tok t JOIN r USING (row_id) JOIN grp g ON g.uid = r.uid WHERE gn >= 2""",
)
def w05_grpo_passk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=COLUMNS)
    several = E.with_group(df, _rows=F.count("*")).filter("_rows >= 2").drop("_rows")
    return advantage(E.grpo_passk(several))


@query(
    "w04_gdpo",
    white_sql(
        """SELECT t.row_id, t.pos, t.response_mask AS m, (1e0 * CASE WHEN gn = 1 THEN s / (1 + 1e-6) ELSE (s - gmean) / (gstd + 1e-6) END
        + 5e-1 * CASE WHEN gn = 1 THEN q.t / (1 + 1e-6) ELSE (q.t - c.tm) / (c.ts + 1e-6) END) * t.response_mask AS a
        FROM tok t JOIN seq q USING (row_id) JOIN grp g ON g.uid = q.uid JOIN (SELECT uid, avg(t) AS tm, stddev_samp(t) AS ts FROM seq GROUP BY uid) c ON c.uid = q.uid"""
    ),
)
def w04_gdpo(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=COLUMNS).withColumns({"score": A.array_sum("rewards"), "len": F.size("rewards").cast("double")})
    return advantage(E.gdpo(df, components={"score": 1.0, "len": 0.5}))


@query("w06_reinforce_pp_baseline", white_sql(f"SELECT t.row_id, t.pos, t.response_mask AS m, ({CENTRED}) * t.response_mask AS a FROM tok t JOIN seq q USING (row_id) JOIN grp g ON g.uid = q.uid"))
def w06_reinforce_pp_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advantage(E.reinforce_pp_baseline(trajectories(spark, sf_dir, columns=COLUMNS)))


SEGMENTS = """SELECT a.row_id, a.pos, a.response_mask AS m, sum(b.rewards * pow(9e-1, b.pos - a.pos)) AS a FROM tok a JOIN tok b ON a.row_id = b.row_id AND b.pos >= a.pos
    AND NOT EXISTS (SELECT 1 FROM tok c WHERE c.row_id = a.row_id AND c.pos > a.pos AND c.pos <= b.pos AND c.response_mask = 0) GROUP BY ALL"""


@query("w10_reinforce_pp", white_sql(SEGMENTS))
def w10_reinforce_pp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advantage(E.reinforce_pp(trajectories(spark, sf_dir, columns=COLUMNS), gamma=0.9))


@query(
    "w11_remax",
    TOKENS + """ SELECT row_id, pos, round(sum(rewards * response_mask) OVER (PARTITION BY row_id ORDER BY pos DESC) - 2.5e-1 * response_mask, 6) + 0.0 AS adv,
    round(sum(rewards * response_mask) OVER (PARTITION BY row_id ORDER BY pos DESC), 6) + 0.0 AS ret FROM tok""",
)
def w11_remax(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=COLUMNS).withColumn("reward_baseline", F.lit(0.25))
    return per_token(E.remax(df), adv="advantages", ret="returns")


@query("w17_reward_to_go", TOKENS + " SELECT row_id, pos, round(sum(rewards * response_mask) OVER (PARTITION BY row_id ORDER BY pos DESC), 6) + 0.0 AS ret FROM tok")
def w17_reward_to_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_token(E.reward_to_go(trajectories(spark, sf_dir, columns=COLUMNS)), ret="returns")


GAE_RAW = """, cmp AS (SELECT row_id, pos, rewards AS r, vals AS v, row_number() OVER (PARTITION BY row_id ORDER BY pos) AS k, coalesce(lead(vals) OVER (PARTITION BY row_id ORDER BY pos), 0) AS nv FROM tok WHERE response_mask = 1),
    act AS (SELECT a.row_id, a.pos, sum(pow(855e-3, b.k - a.k) * (b.r + 9e-1 * b.nv - b.v)) AS adv FROM cmp a JOIN cmp b ON a.row_id = b.row_id AND b.k >= a.k GROUP BY ALL),
    raw AS (SELECT t.row_id, t.pos, t.response_mask AS m, t.vals, coalesce(min_by(x.adv, x.pos), 0) AS a FROM tok t LEFT JOIN act x ON x.row_id = t.row_id AND x.pos >= t.pos GROUP BY ALL)"""


@query("w01_gae", TOKENS + GAE_RAW + WHITE + " SELECT row_id, pos, round((a - mu) / sqrt(va + 1e-8), 6) + 0.0 AS adv, round(a + vals, 6) + 0.0 AS ret FROM raw, mv")
def w01_gae(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=(*COLUMNS, "vals"))
    return per_token(E.gae(df, gamma=0.9, lam=0.95), adv="advantages", ret="returns")


def token_baseline_sql(compact: bool) -> str:
    place, seen = ("k - 1", "WHERE n > 0") if compact else ("pos", "")
    return (
        TOKENS
        + f""", sc AS (SELECT row_id, uid, pos, response_mask AS m, sum((1 - 2 * exp(old_log_probs) + sum_pi_squared) * response_mask) OVER (PARTITION BY row_id ORDER BY pos) AS w,
        sum(rewards * response_mask) OVER (PARTITION BY row_id ORDER BY pos DESC) AS g, sum(response_mask) OVER (PARTITION BY row_id ORDER BY pos) AS k FROM tok),
        pl AS (SELECT *, {place} AS p FROM sc), b AS (SELECT uid, p, sum(g * w) / (sum(w) + 1e-8) AS b FROM pl WHERE m = 1 GROUP BY uid, p),
        mem AS (SELECT uid, row_id, n, row_number() OVER (PARTITION BY uid ORDER BY n DESC) AS k, count(*) OVER (PARTITION BY uid) AS rows FROM seq {seen}),
        tops AS (SELECT uid, max(CASE WHEN k = 1 THEN n END) AS n1, max(CASE WHEN k = 2 THEN n END) AS n2, max(rows) AS rows FROM mem GROUP BY uid)
        SELECT pl.row_id, pl.pos, round((g - CASE WHEN coalesce(rows, 0) <= 1 OR (q.n = n1 AND n1 > n2 AND pl.p >= n2) THEN 0 ELSE coalesce(b.b, 0) END) * m, 6) + 0.0 AS adv
        FROM pl JOIN seq q USING (row_id) LEFT JOIN b ON b.uid = pl.uid AND b.p = pl.p LEFT JOIN tops ON tops.uid = pl.uid"""
    )


BASELINE_COLUMNS = (*COLUMNS, "old_log_probs", "sum_pi_squared")


@query("w13_optimal_token_baseline", token_baseline_sql(False))
def w13_optimal_token_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advantage(E.optimal_token_baseline(trajectories(spark, sf_dir, columns=BASELINE_COLUMNS)))


@query("w14_multi_turn_token_baseline", token_baseline_sql(True))
def w14_multi_turn_token_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advantage(E.multi_turn_token_baseline(trajectories(spark, sf_dir, columns=BASELINE_COLUMNS)))


@query(
    "w15_multi_trajectory_grpo",
    TOKENS + """, sx AS (SELECT *, row_id // 4 AS session FROM tok), fs AS (SELECT row_id, uid, session, coalesce(min_by(rewards, pos) FILTER (WHERE response_mask = 1), 0) AS s FROM sx GROUP BY row_id, uid, session),
    ls AS (SELECT uid, session, max_by(s, row_id) AS s FROM fs GROUP BY uid, session), st AS (SELECT uid, count(*) AS gn, avg(s) AS gmean, stddev_samp(s) AS gstd FROM ls GROUP BY uid)
    SELECT x.row_id, x.pos, round(CASE WHEN gn = 1 THEN ls.s / (1 + 1e-6) ELSE (ls.s - gmean) / (gstd + 1e-6) END * x.response_mask, 6) + 0.0 AS adv
    FROM sx x JOIN ls ON ls.uid = x.uid AND ls.session = x.session JOIN st ON st.uid = x.uid""",
)
def w15_multi_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=COLUMNS).withColumns({"session_id": F.expr("row_id div 4"), "traj_index": F.col("row_id")})
    return advantage(E.multi_trajectory(df))


@query("w16_dispatch_by_name", scalar_sql(SCALARS["w07_rloo"][2]))
def w16_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advantage(E.compute_advantage(trajectories(spark, sf_dir, columns=COLUMNS), "rloo"))


W19 = TOKENS + """, w AS (SELECT row_id, greatest(pow(abs(s), 2) + 1e-8, 1e-8) AS w FROM seq), c AS (SELECT row_id, w / sum(w) OVER () AS w, sum(w) OVER (ORDER BY row_id % 1024, row_id) / sum(w) OVER () AS high FROM w),
    d AS (SELECT ('0x' || substr(md5('7:' || CAST(row_id AS VARCHAR)), 1, 15))::BIGINT / pow(2e0, 60) AS u FROM seq) SELECT row_id, count(*) AS draws FROM c JOIN d ON u >= high - w AND u < high GROUP BY row_id"""


@query("w19_pf_resample", W19)
def w19_pf_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = E.pf_resample(trajectories(spark, sf_dir, columns=COLUMNS), seed=7)
    return drawn.groupBy("row_id").agg(F.count("*").alias("draws"))


@query("w19_pf_weights", TOKENS + " SELECT row_id, round(greatest(pow(abs(s), 2) + 1e-8, 1e-8), 6) + 0.0 AS pow, round(CASE WHEN s = (SELECT max(s) FROM seq) OR s = (SELECT min(s) FROM seq) THEN 1 ELSE 0 END + 1e-8, 6) + 0.0 AS max_min, round(CASE WHEN s = (SELECT max(s) FROM seq) THEN 4e-1 ELSE 1e-1 END + 1e-8, 6) + 0.0 AS max_random FROM seq")
def w19_pf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trajectories(spark, sf_dir, columns=COLUMNS)
    for method in ("pow", "max_min", "max_random"):
        out = E.pf_weights(method)(out).withColumnRenamed("weight", method)
    return out.select("row_id", *[rounded(m).alias(m) for m in ("pow", "max_min", "max_random")])


@query("g05_group_mean_std", TOKENS + GRP + " SELECT row_id, round(CASE WHEN gn <= 1 THEN 0 ELSE gmean END, 6) + 0.0 AS mean, round(CASE WHEN gn <= 1 THEN 1 ELSE sqrt(greatest(gstd * gstd, 1e-6)) END, 6) + 0.0 AS std, gn AS n FROM seq q JOIN grp g ON g.uid = q.uid")
def g05_group_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.operators.stats import group_mean_std

    scored = E.with_score(trajectories(spark, sf_dir, columns=COLUMNS))
    out = group_mean_std(scored, "_s", eps=1e-6)
    return out.select("row_id", rounded("mean").alias("mean"), rounded("std").alias("std"), "n")
