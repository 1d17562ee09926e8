"""Policy, value, entropy and distillation losses: an expression per token, reduced per row, then over the batch.

Rows are reduced with higher-order functions (no shuffle); a batch then needs one aggregate of a few sums. Every policy
loss gives one row: loss, clipfrac, kl and clipfrac_lower. Importance weights, an array column, multiply token losses.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.functions.registry import Registry
from tidemill.operators.sampling import hash_order
from tidemill.sources.storage import stored

AGGREGATIONS: Registry[Callable] = Registry("loss aggregation")
POLICY_LOSSES: Registry[Callable] = Registry("policy loss", overwrite=True)
PENALTIES: Registry[Callable[[Column, Column], Column]] = Registry("KL penalty")
DISTILLATION_LOSSES: Registry[Callable] = Registry("distillation loss")


@dataclass(frozen=True)
class LossConfig:
    clip: float = 0.2
    clip_low: float | None = None
    clip_high: float | None = None
    dual_clip: float = 3.0
    ratio_cap: float = 20.0
    tau_pos: float = 1.0
    tau_neg: float = 1.05
    cov_ratio: float = 0.0002
    cov_low: float = 1.0
    cov_high: float = 5.0
    kl_coef: float = 1.0
    seed: int = 0

    @property
    def low(self) -> float:
        return self.clip if self.clip_low is None else self.clip_low

    @property
    def high(self) -> float:
        return self.clip if self.clip_high is None else self.clip_high


# Aggregation: each mode reduces a row to (_num, _den); the batch's loss is sum(_num) / sum(_den).
@AGGREGATIONS.register("token-mean")
def _token_mean(total: Column, n: Column) -> tuple[Column, Column]:
    return total, n


@AGGREGATIONS.register("seq-mean-token-sum", "seq-mean-token-sum-norm")
def _seq_sum(total: Column, n: Column) -> tuple[Column, Column]:
    return F.when(n > 0, total).otherwise(0.0), F.when(n > 0, 1.0).otherwise(0.0)


@AGGREGATIONS.register("seq-mean-token-mean")
def _seq_mean(total: Column, n: Column) -> tuple[Column, Column]:
    return F.when(n > 0, total / (n + A.EPS)).otherwise(0.0), F.when(n > 0, 1.0).otherwise(0.0)


def aggregate_loss(df: DataFrame, values: str, mask: str = "response_mask", *, mode: str = "token-mean", parts: int = 1, global_tokens: int | None = None, global_rows: int | None = None, scale: float | None = None, width: int | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row: ``loss`` of token losses under a mode, times ``parts`` (data-parallel ranks), and ``extra`` aggregates.

    Explicit global counts replace local ones and must be given for more than one part. ``seq-mean-token-sum-norm`` divides
    by ``scale``, by default the padded ``width``, by default the longest array. No tokens give NaN.
    """
    reduce = AGGREGATIONS[mode]
    given = global_tokens if mode == "token-mean" else global_rows
    if parts > 1 and given is None:
        raise ValueError(f"{mode} over {parts} parts needs the {'token' if mode == 'token-mean' else 'row'} count of all of them")
    total, n = A.masked_sum(values, mask), A.mask_count(mask)
    num, den = reduce(total, n)
    rows = df.withColumns({"_num": num, "_den": den, "_width": F.size(mask)})
    bottom = F.lit(float(given)) if given is not None else F.sum("_den")
    loss = F.when(bottom == 0, F.lit(float("nan"))).otherwise(F.sum("_num") / F.when(bottom != 0, bottom)) * parts
    if mode == "seq-mean-token-sum-norm":
        loss = loss / (F.lit(float(scale)) if scale is not None else F.lit(float(width)) if width is not None else F.max("_width"))
    return rows.agg(loss.alias("loss"), *[c.alias(k) for k, c in (extra or {}).items()])


def _over_batch(values: str) -> Column:
    """The masked mean of a token array over the batch, as an aggregate over ``_m_<values>`` and ``_n``."""
    return F.sum(f"_m{values}") / (F.sum("_n") + A.EPS)


def _finish(df: DataFrame, mode: str, weights: str | None, **batch) -> DataFrame:
    """Aggregates the token arrays _loss, _clip, _kl and _low."""
    if weights:
        df = df.withColumn("_loss", F.zip_with("_loss", weights, lambda x, w: x * w))
    sums = {f"_m{c}": A.masked_sum(c, "response_mask") for c in ("_clip", "_kl", "_low")}
    df = df.withColumns({**sums, "_n": A.mask_count("response_mask")})
    return aggregate_loss(df, "_loss", mode=mode, extra={"clipfrac": _over_batch("_clip"), "kl": _over_batch("_kl"), "clipfrac_lower": _over_batch("_low")}, **batch)


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _tokens(df: DataFrame, fn: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """Adds the arrays _loss, _clip, _kl and _low from a function of the tokens' struct (lp, old, a, m)."""
    zipped = F.arrays_zip(F.col("log_probs").alias("lp"), F.col("old_log_probs").alias("old"), F.col("advantages").alias("a"), F.col("response_mask").alias("m"))
    made = df.withColumn("_t", F.transform(zipped, lambda t: F.struct(*[c.cast("double").alias(k) for k, c in fn(t).items()])))
    return made.withColumns({c: F.col(f"_t.{c}") for c in ("_loss", "_clip", "_kl", "_low")}).drop("_t")


def from_tokens(df: DataFrame, fn: Callable[[Column], dict[str, Column]], mode: str = "token-mean", weights: str | None = None, **batch) -> DataFrame:
    """A loss made of ``fn``, which gives _loss, _clip, _kl and _low of a token's struct (lp, old, a, m)."""
    return _finish(_tokens(df, fn), mode, weights, **batch)


def _log_ratio(t: Column, bound: bool = True) -> Column:
    d = t["lp"] - t["old"]
    return A.clip(d, -A.LOG_BOUND, A.LOG_BOUND) if bound else d


@POLICY_LOSSES.register("vanilla", "legacy")
def vanilla(df: DataFrame, cfg: LossConfig, mode: str = "token-mean", weights: str | None = None, **batch) -> DataFrame:
    """PPO with two clips: the larger of the plain and clipped loss, held below ``dual_clip`` for negative advantages."""
    if cfg.dual_clip <= 1:
        raise ValueError("dual_clip must be above 1")

    def token(t: Column) -> dict[str, Column]:
        d, a = _log_ratio(t), t["a"]
        plain, clipped = -a * F.exp(d), -a * A.clip(F.exp(d), 1 - cfg.low, 1 + cfg.high)
        larger, cap = F.greatest(plain, clipped), -a * cfg.dual_clip
        return {"_loss": F.when(a < 0, F.least(cap, larger)).otherwise(larger), "_clip": _flag(clipped > plain), "_kl": -d, "_low": _flag((larger > cap) & (a < 0))}

    return _finish(_tokens(df, token), mode, weights, **batch)


def _masked_divergence(df: DataFrame, cfg: LossConfig, mode: str, weights: str | None, keep: Callable[[Column], Column], **batch) -> DataFrame:
    def token(t: Column) -> dict[str, Column]:
        d = _log_ratio(t)
        valid, ratio = _flag(keep(t)), F.exp(d)
        return {"_loss": -t["a"] * A.clip(ratio, None, cfg.ratio_cap) * t["lp"] * valid, "_clip": 1.0 - valid, "_kl": -d, "_low": _flag(ratio > cfg.ratio_cap) * valid}

    return _finish(_tokens(df, token), mode, weights, **batch)


@POLICY_LOSSES.register("dppo_tv")
def dppo_tv(df: DataFrame, cfg: LossConfig, mode: str = "token-mean", weights: str | None = None, **batch) -> DataFrame:
    """Tokens whose probability has moved too far in the advantage's direction are left out."""

    def keep(t: Column) -> Column:
        moved = F.exp(t["lp"]) - F.exp(t["old"])
        return F.when(t["a"] > 0, moved <= cfg.high).otherwise(moved >= -cfg.low)

    return _masked_divergence(df, cfg, mode, weights, keep, **batch)


@POLICY_LOSSES.register("dppo_kl")
def dppo_kl(df: DataFrame, cfg: LossConfig, mode: str = "token-mean", weights: str | None = None, **batch) -> DataFrame:
    """As ``dppo_tv`` by the divergence of the two-outcome distributions (token or not)."""

    def keep(t: Column) -> Column:
        p, q = F.exp(t["lp"]), F.exp(t["old"])
        kl = q * (t["old"] - t["lp"]) + (1 - q) * F.log((1.0 - q + 1e-8) / (1.0 - p + 1e-8))
        return F.when(t["a"] > 0, (kl <= cfg.high) | (p <= q)).otherwise((kl <= cfg.low) | (p >= q))

    return _masked_divergence(df, cfg, mode, weights, keep, **batch)


@POLICY_LOSSES.register("gspo")
def gspo(df: DataFrame, cfg: LossConfig, mode: str = "seq-mean-token-mean", weights: str | None = None, **batch) -> DataFrame:
    """One ratio a sequence, the exponential of its mean log-ratio (at most e**10); always seq-mean-token-mean."""
    diff = F.zip_with("log_probs", "old_log_probs", lambda x, y: x - y)
    mean = A.masked_sum(diff, "response_mask") / F.greatest(A.mask_count("response_mask"), F.lit(1.0))
    df = df.withColumn("_ratio", F.exp(A.clip(mean, None, 10.0)))

    def token(t: Column) -> dict[str, Column]:
        plain, clipped = -t["a"] * F.col("_ratio"), -t["a"] * A.clip(F.col("_ratio"), 1 - cfg.low, 1 + cfg.high)
        return {"_loss": F.greatest(plain, clipped), "_clip": _flag(clipped > plain), "_kl": t["old"] - t["lp"], "_low": F.lit(0.0)}

    return _finish(_tokens(df, token), "seq-mean-token-mean", weights, **batch)


@POLICY_LOSSES.register("sapo")
def sapo(df: DataFrame, cfg: LossConfig, mode: str = "seq-mean-token-mean", weights: str | None = None, **batch) -> DataFrame:
    """A sigmoid gate of the ratio, its steepness by the advantage's sign; always seq-mean-token-mean."""

    def token(t: Column) -> dict[str, Column]:
        d = _log_ratio(t)
        tau = F.when(t["a"] > 0, cfg.tau_pos).otherwise(cfg.tau_neg)
        gate = 1 / (1 + F.exp(-tau * (F.exp(d) - 1.0))) * (4.0 / tau)
        return {"_loss": -gate * t["a"], "_clip": F.lit(0.0), "_kl": -d, "_low": F.lit(0.0)}

    return _finish(_tokens(df, token), "seq-mean-token-mean", weights, **batch)


@POLICY_LOSSES.register("gpg")
def gpg(df: DataFrame, cfg: LossConfig, mode: str = "token-mean", weights: str | None = None, **batch) -> DataFrame:
    return _finish(_tokens(df, lambda t: {"_loss": -t["lp"] * t["a"], "_clip": F.lit(0.0), "_kl": F.lit(0.0), "_low": F.lit(0.0)}), mode, weights, **batch)


@POLICY_LOSSES.register("reinforce")
def reinforce(df: DataFrame, cfg: LossConfig, mode: str = "seq-mean-token-sum", weights: str | None = None, **batch) -> DataFrame:
    return _finish(_tokens(df, lambda t: {"_loss": -t["a"] * t["lp"], "_clip": F.lit(0.0), "_kl": t["old"] - t["lp"], "_low": F.lit(0.0)}), mode, weights, **batch)


@POLICY_LOSSES.register("cispo")
def cispo(df: DataFrame, cfg: LossConfig, mode: str = "token-mean", weights: str | None = None, **batch) -> DataFrame:
    """The clipped ratio as a weight of the log-probability."""

    def token(t: Column) -> dict[str, Column]:
        d = _log_ratio(t)
        held = A.clip(F.exp(d), 1 - cfg.low, 1 + cfg.high)
        return {"_loss": -held * t["a"] * t["lp"], "_clip": _flag(F.exp(d) != held), "_kl": -d, "_low": F.lit(0.0)}

    return _finish(_tokens(df, token), mode, weights, **batch)


@POLICY_LOSSES.register("geo_mean")
def geo_mean(df: DataFrame, cfg: LossConfig, mode: str | None = None, weights: str | None = None, **batch) -> DataFrame:
    """A geometric-mean ratio a row, clipped in log space on the advantage's side; a plain mean over rows, whatever the mode."""

    def token(t: Column) -> dict[str, Column]:
        d, sign = _log_ratio(t, bound=False), F.signum(t["a"])
        held = A.clip(d, -cfg.low, cfg.high)
        clipped = d != held
        return {"_loss": sign * F.least(sign * d, sign * held), "_clip": _flag(clipped & (t["a"] > 0)), "_kl": -d, "_low": _flag(clipped & (t["a"] < 0))}

    df = _tokens(df, token)
    n = A.mask_count("response_mask")
    mean = lambda c: A.masked_sum(c, "response_mask") / (n + A.EPS)
    loss = -mean("advantages") * F.exp(mean("_loss"))
    if weights:
        loss = loss * F.exp(mean(F.transform(weights, lambda w: F.log(w + 1e-10))))
    df = df.withColumns({"_row": loss, **{f"_m{c}": A.masked_sum(c, "response_mask") for c in ("_clip", "_kl", "_low")}, "_n": n})
    return df.agg(F.avg("_row").alias("loss"), _over_batch("_clip").alias("clipfrac"), _over_batch("_kl").alias("kl"), _over_batch("_low").alias("clipfrac_lower"))


def _covariances(df: DataFrame) -> DataFrame:
    """Tokens (row_id, pos, m, a, lp, old, cov): advantage and log-probability less their masked batch means, multiplied.

    The tokens are stored, as means, quantiles, counts and ranks each read them and a batch's plan may be long.
    """
    names = {"m": "response_mask", "a": "advantages", "lp": "log_probs", "old": "old_log_probs"}
    tokens = df.select("row_id", F.posexplode(F.arrays_zip(*[F.col(c).alias(n) for n, c in names.items()])).alias("pos", "t")).select("row_id", "pos", "t.*")
    tokens = stored(tokens, "tokens")
    means = tokens.filter("m <> 0").agg(F.avg("a").alias("a"), F.avg("lp").alias("lp"))
    shifted = tokens.withColumns({"_a": means.select("a").scalar(), "_lp": means.select("lp").scalar()})
    return shifted.withColumn("cov", (F.col("a") - F.col("_a")) * (F.col("lp") - F.col("_lp"))).drop("_a", "_lp")


def _from_tokens(tokens: DataFrame, mode: str) -> DataFrame:
    """The losses of tokens (row_id, m, _loss, _clip, _kl) under a mode."""
    rows = tokens.groupBy("row_id").agg(F.sum(F.col("_loss") * F.col("m")).alias("total"), F.sum("m").cast("double").alias("n"), F.sum(F.col("_clip") * F.col("m")).alias("_m_clip"), F.sum(F.col("_kl") * F.col("m")).alias("_m_kl"))
    num, den = AGGREGATIONS[mode](F.col("total"), F.col("n"))
    rows = rows.withColumns({"_num": num, "_den": den, "_n": F.col("n")})
    return rows.agg((F.sum("_num") / F.sum("_den")).alias("loss"), _over_batch("_clip").alias("clipfrac"), _over_batch("_kl").alias("kl"), F.lit(0.0).alias("clipfrac_lower"))


def _top_rows(tokens: DataFrame, order: list[Column], k: Column) -> DataFrame:
    """The first ``k`` tokens by a total order, by counting over chunks: no task ranks all tokens.

    Tokens are bucketed by quantile of the first key and buckets counted; those wholly among the first ``k`` are taken as they
    are, and only the bucket where ``k`` falls is ranked.
    """
    keyed = tokens.withColumn("_key", order[0])
    cuts = [float(c) for c in keyed.stat.approxQuantile("_key", [j / 64 for j in range(1, 64)], 0.001)]
    bucket = F.lit(0)
    for c in sorted(set(cuts)):
        bucket = bucket + F.when(F.col("_key") > c, 1).otherwise(0)
    bucketed = keyed.withColumn("_b", bucket)
    counts = bucketed.groupBy("_b").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = bucketed.join(F.broadcast(before), "_b").withColumn("_k", k).filter("_before < _k")  # broadcast: at most 64 rows
    whole = F.col("_before") + F.col("_c") <= F.col("_k")
    ranked = placed.filter(~whole).withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_key", *order[1:])))
    return placed.filter(whole).select("row_id", "pos").unionByName(ranked.filter("_r <= _k").select("row_id", "pos"))


@POLICY_LOSSES.register("clip_cov")
def clip_cov(df: DataFrame, cfg: LossConfig, mode: str = "token-mean", weights: str | None = None) -> DataFrame:
    """PPO in which a random share of the tokens of high covariance is left out; the draw is a hash of place and seed."""
    tokens = _covariances(df)
    d = F.col("lp") - F.col("old")
    plain, clipped = -F.col("a") * F.exp(d), -F.col("a") * A.clip(F.exp(d), 1 - cfg.low, 1 + cfg.high)
    tokens = tokens.withColumns({"_plain": plain, "_clipped": clipped, "_kl": -d})
    wanted = tokens.filter((F.col("m") != 0) & ~(F.col("_clipped") > F.col("_plain")) & (F.col("cov") < cfg.cov_high) & (F.col("cov") > cfg.cov_low))
    k = tokens.agg(F.greatest(F.floor(F.sum("m") * F.lit(cfg.cov_ratio)), F.lit(1)).alias("k")).scalar()
    draw = hash_order(cfg.seed, F.concat_ws(":", F.col("row_id").cast("string"), F.col("pos").cast("string"))).cast("double")
    out = _top_rows(wanted, [draw, F.col("row_id"), F.col("pos")], k).withColumn("_out", F.lit(1.0))
    marked = tokens.join(out, ["row_id", "pos"], "left").withColumn("_clip", F.coalesce("_out", F.lit(0.0)))
    return _from_tokens(marked.withColumn("_loss", F.greatest("_plain", "_clipped") * (1 - F.col("_clip"))), mode)


@POLICY_LOSSES.register("kl_cov")
def kl_cov(df: DataFrame, cfg: LossConfig, mode: str = "token-mean", weights: str | None = None) -> DataFrame:
    """The plain loss, with a penalty on the absolute log-ratio of the tokens of highest covariance (at least one)."""
    tokens = _covariances(df)
    d = F.col("lp") - F.col("old")
    tokens = tokens.withColumns({"_kl": F.abs(d), "_plain": -F.col("a") * F.exp(d)})
    k = tokens.agg(F.greatest(F.floor(F.sum("m") * F.lit(cfg.cov_ratio)), F.lit(1)).alias("k")).scalar()
    top = _top_rows(tokens.filter("m <> 0"), [-F.col("cov"), F.col("row_id"), F.col("pos")], k).withColumn("_in", F.lit(1.0))
    marked = tokens.join(top, ["row_id", "pos"], "left").withColumn("_loss", F.col("_plain") + F.coalesce("_in", F.lit(0.0)) * cfg.kl_coef * F.col("_kl"))
    return _from_tokens(marked.withColumn("_clip", F.lit(0.0)), mode)


def policy_loss(df: DataFrame, name: str, cfg: LossConfig | None = None, **how) -> DataFrame:
    return POLICY_LOSSES[name](df, cfg or LossConfig(), **how)


def bypass_loss(df: DataFrame, *, cfg: LossConfig | None = None, loss: str = "ppo", mode: str = "token-mean", **correction) -> DataFrame:
    """Rollout log-probabilities stand for the old ones; corrections are worked out on the spot. PPO uses no importance
    weights then (its ratio is one already), the plain policy gradient does."""
    from tidemill.operators.correction import correct

    corrected = correct(df.withColumn("old_log_probs", F.col("log_probs")), **correction)
    corrected = corrected.withColumn("old_log_probs", F.col("rollout_log_probs"))
    if loss == "ppo":
        return vanilla(corrected, cfg or LossConfig(), mode)
    if loss == "reinforce":
        return reinforce(corrected, cfg or LossConfig(), mode, weights="is_weights" if "is_weights" in corrected.columns else None)
    raise ValueError(f"unknown bypass loss {loss!r}")


def value_loss(df: DataFrame, *, clip: float, predictions: str = "vpreds", returns: str = "returns", values: str = "vals", mode: str = "token-mean") -> DataFrame:
    """Half the larger of the plain and clipped squared errors, and the share of clipped tokens."""
    zipped = F.arrays_zip(F.col(predictions).alias("p"), F.col(returns).alias("r"), F.col(values).alias("v"))

    def token(t: Column) -> Column:
        plain = F.pow(t["p"] - t["r"], 2.0)
        held = F.pow(A.clip(t["p"], t["v"] - clip, t["v"] + clip) - t["r"], 2.0)
        return F.struct(F.greatest(plain, held).alias("l"), _flag(held > plain).alias("c"))

    df = df.withColumn("_t", F.transform(zipped, token)).withColumns({"_loss": F.col("_t.l"), "_m_clip": A.masked_sum(F.col("_t.c"), "response_mask"), "_n": A.mask_count("response_mask")})
    out = aggregate_loss(df, "_loss", mode=mode, extra={"clipfrac": _over_batch("_clip")})
    return out.withColumn("loss", 0.5 * F.col("loss"))


def entropy_loss(df: DataFrame, logits: str = "logits", mode: str = "token-mean") -> DataFrame:
    """The entropy of each token's logits (an array of arrays), aggregated."""
    return aggregate_loss(df.withColumn("_loss", F.transform(logits, A.entropy)), "_loss", mode=mode)


@PENALTIES.register("kl", "k1")
def _k1(lp: Column, ref: Column) -> Column:
    return lp - ref


@PENALTIES.register("abs")
def _abs(lp: Column, ref: Column) -> Column:
    return F.abs(lp - ref)


@PENALTIES.register("mse", "k2")
def _k2(lp: Column, ref: Column) -> Column:
    return 0.5 * (lp - ref) * (lp - ref)


@PENALTIES.register("low_var_kl", "k3")
def _k3(lp: Column, ref: Column) -> Column:
    d = A.clip(ref - lp, -A.LOG_BOUND, A.LOG_BOUND)
    return A.clip(F.exp(d) - d - 1, -10.0, 10.0)


def kl_penalty(lp: Column, ref: Column, name: str) -> Column:
    """The named estimate of a token's divergence; a trailing "+" has the same value. "full" and unknown names raise."""
    return PENALTIES[name.removesuffix("+")](lp, ref)


def penalize_rewards(df: DataFrame, *, beta: float, penalty: str = "kl", scores: str = "rewards", out: str = "rewards") -> DataFrame:
    """Rewards less beta times the masked penalty against the reference; ``row_kl`` is the row's masked mean penalty."""
    kl = F.zip_with("old_log_probs", "ref_log_prob", lambda x, y: kl_penalty(x, y, penalty))
    df = df.withColumn("_kl", F.zip_with(kl, "response_mask", lambda k, m: k * m))
    return df.withColumns({"row_kl": A.masked_mean("_kl", "response_mask"), out: F.zip_with(scores, "_kl", lambda s, k: s - beta * k)}).drop("_kl")


def plain_rewards(df: DataFrame, *, beta: float, scores: str = "rewards", out: str = "rewards") -> DataFrame:
    """Scores less beta (old - reference)."""
    diff = F.zip_with("old_log_probs", "ref_log_prob", lambda x, y: x - y)
    return df.withColumn(out, F.zip_with(scores, diff, lambda s, d: s - beta * d))


def fixed_controller(kl_coef: float) -> Callable[[float, int], float]:
    """A KL coefficient that never changes."""
    return lambda current, n: kl_coef


def fixed(df: DataFrame, *, start: float) -> DataFrame:
    """The KL coefficient after each step, which stays as it is; ``adaptive_controller``'s counterpart."""
    return df.withColumn("kl_coef", F.lit(float(start)))


def adaptive_controller(df: DataFrame, *, start: float, target: float, horizon: float, order: str = "step", kl: str = "kl", n: str = "n_steps") -> DataFrame:
    """The KL coefficient after each step: times 1 + clip(kl / target - 1, ±0.2) n / horizon. Steps are few (one a training step);
    the fold is a running product."""
    factor = 1 + A.clip(F.col(kl) / target - 1, -0.2, 0.2) * F.col(n) / horizon
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sign = F.pow(F.lit(-1.0), F.sum(_flag(factor < 0)).over(upto))
    return df.withColumn("kl_coef", start * sign * F.exp(F.sum(F.log(F.abs(factor))).over(upto)))


@dataclass(frozen=True)
class DistillationSettings:
    """What a distillation loss is called and needs: the teacher's top entries, or log-probabilities of the sampled tokens."""

    names: tuple[str, ...]
    top_entries: bool = False


DISTILLATION_SETTINGS: Registry[DistillationSettings] = Registry("distillation settings")


def register_distillation_loss(settings: DistillationSettings) -> Callable[[Callable], Callable]:
    """Register a loss under all its names, and its settings; a name that is taken raises."""

    def add(fn: Callable) -> Callable:
        DISTILLATION_LOSSES.register(*settings.names)(fn)
        DISTILLATION_SETTINGS.register(*settings.names)(settings)
        return fn

    return add


def distill(df: DataFrame, name: str, **columns) -> DataFrame:
    """The named distillation loss of every token; an estimator of a divergence is told its name."""
    needs = DISTILLATION_SETTINGS[name]
    return DISTILLATION_LOSSES[name](df, **columns) if needs.top_entries else DISTILLATION_LOSSES[name](df, name=name, **columns)


@register_distillation_loss(DistillationSettings(("reverse_kl", "kl", "k1", "abs", "mse", "k2", "low_var_kl", "k3")))
def reverse_kl(df: DataFrame, *, name: str = "k1", student: str = "log_probs", teacher: str = "ref_log_prob", out: str = "distill") -> DataFrame:
    """The penalty of the student's tokens against the teacher's."""
    return df.withColumn(out, F.zip_with(student, teacher, lambda s, t: kl_penalty(s, t, "k1" if name == "reverse_kl" else name)))


@register_distillation_loss(DistillationSettings(("forward_kl_topk",), top_entries=True))
def forward_kl_topk(df: DataFrame, *, student: str = "student_top", teacher: str = "teacher_top", out: str = "distill") -> DataFrame:
    """Over the teacher's top entries (arrays per token of structs id, lp): sum of p (log p - log q), held at 0 or more.

    A token the student lacks counts with the student's smallest log-probability. Adds the masses and the overlap share.
    """

    def one(pair: Column) -> Column:
        mine = F.map_from_entries(F.transform(pair["s"], lambda x: F.struct(x["id"], x["lp"])))
        least = F.array_min(F.transform(pair["s"], lambda x: x["lp"]))
        terms = F.transform(pair["t"], lambda x: F.exp(x["lp"]) * (x["lp"] - F.coalesce(F.try_element_at(mine, x["id"]), least)))
        shared = F.size(F.array_intersect(F.transform(pair["s"], lambda x: x["id"]), F.transform(pair["t"], lambda x: x["id"])))
        mass = lambda c: A.array_sum(F.transform(pair[c], lambda x: F.exp(x["lp"])))
        return F.struct(F.greatest(A.array_sum(terms), F.lit(0.0)).alias("loss"), mass("t").alias("teacher_mass"), mass("s").alias("student_mass"), (shared / F.size(pair["t"])).alias("overlap"))

    made = df.withColumn("_d", F.transform(F.arrays_zip(F.col(student).alias("s"), F.col(teacher).alias("t")), one))
    return made.withColumns({out: F.col("_d.loss"), "teacher_mass": F.col("_d.teacher_mass"), "student_mass": F.col("_d.student_mass"), "overlap": F.col("_d.overlap")}).drop("_d")


def distillation_loss(df: DataFrame, *, values: str = "distill", bound: float | None = None, policy_gradient: bool = False, mode: str = "token-mean", cfg: LossConfig | None = None) -> DataFrame:
    """Token losses held within ±``bound`` and aggregated; as a policy gradient they are, negated, the advantages of PPO."""
    held = F.transform(values, lambda x: A.clip(x, -bound, bound)) if bound is not None else F.col(values)
    df = df.withColumn("_d", held)
    if policy_gradient:
        return vanilla(df.withColumn("advantages", F.transform("_d", lambda x: -x)), cfg or LossConfig(), mode)
    return aggregate_loss(df, "_d", mode=mode)
