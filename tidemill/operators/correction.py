"""Off-policy correction: importance weights, rejection masks and their metrics, between old and rollout log-probabilities.

Row statistics are higher-order functions; a batch's metrics are one aggregate over row sums. Metrics come as rows
(metric, value). ``SAFETY`` bounds log-ratios before they are exponentiated.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import arrays as A

SAFETY = A.LOG_BOUND
#: Rejection options: the level (a token, or a sequence's sum, mean or max) and the divergence estimate.
OPTIONS = ("token_k1", "token_k2", "token_k3", "seq_sum_k1", "seq_sum_k2", "seq_sum_k3", "seq_mean_k1", "seq_mean_k2", "seq_mean_k3", "seq_max_k2", "seq_max_k3")


def parse_is_threshold(threshold: float | str) -> tuple[float, float | None]:
    """(upper, lower): a positive number is an upper bound alone; "low_high" is both."""
    if isinstance(threshold, bool) or threshold is None:
        raise TypeError("a threshold is a number or text")
    parts = [float(p) for p in str(threshold).split("_")] if isinstance(threshold, str) else [float(threshold)]
    if len(parts) > 2 or any(p <= 0 for p in parts) or len(parts) == 2 and parts[0] > parts[1]:
        raise ValueError(f"not a threshold: {threshold!r}")
    return (parts[1], parts[0]) if len(parts) == 2 else (parts[0], None)


def parse_rs(options: str, thresholds: float | str) -> dict[str, tuple[float | None, float]]:
    """(lower, upper) for each distinct option. One threshold serves all, else there is one for each; for k1 a single number u
    stands for (1/u, u), for the others it is the upper bound."""
    names = list(dict.fromkeys(o.strip() for o in options.split(",") if o.strip())) if isinstance(options, str) else []
    unknown = [n for n in names if n not in OPTIONS]
    if not names or unknown:
        raise ValueError(f"unknown rejection options {unknown or options!r}; known: {', '.join(OPTIONS)}")
    if thresholds is None:
        raise ValueError("rejection needs a threshold")
    given = [t.strip() for t in thresholds.split(",") if t.strip()] if isinstance(thresholds, str) else [thresholds]
    if len(given) not in (1, len(names)):
        raise ValueError(f"{len(given)} thresholds for {len(names)} options")
    out = {}
    for name, t in zip(names, given * len(names) if len(given) == 1 else given, strict=True):
        upper, lower = parse_is_threshold(t if isinstance(t, str) else float(t))
        if name.endswith("k1"):
            out[name] = (1 / upper if lower is None else lower, upper)
        elif lower is not None:
            raise ValueError(f"{name} has an upper bound alone")
        else:
            out[name] = (None, upper)
    return out


def estimate(x: Column, kind: str) -> Column:
    """k1, k2 or k3 of a log-ratio, held within the safety bound."""
    x = A.clip(x, -SAFETY, SAFETY)
    return {"k1": -x, "k2": 0.5 * x * x, "k3": F.exp(x) - 1.0 - x}[kind]


def with_log_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("_lr", F.zip_with("old_log_probs", "rollout_log_probs", lambda o, r: o - r))


def _statistic(option: str, mask: str = "response_mask") -> tuple[Column, Column | None]:
    """The per-token values (an array) and, for sequence options, the row's statistic under a mask."""
    level, kind = option.rsplit("_", 1)
    values = F.transform("_lr", lambda x: estimate(x, kind))
    if level == "token":
        return values, None
    fn = {"seq_sum": A.masked_sum, "seq_mean": A.masked_mean, "seq_max": A.masked_max}[level]
    return values, fn(values, mask)


def _bounds(option: str, spec: tuple[float | None, float]) -> tuple[float | None, float]:
    """Bounds on the statistic; those of k1 are logarithms."""
    low, high = spec
    return (math.log(low), math.log(high)) if option.endswith("k1") else (None, high)


def _inside(x: Column, low: float | None, high: float) -> Column:
    return (x <= high) & (x >= low) if low is not None else x <= high


def reject(df: DataFrame, options: str, thresholds: float | str) -> DataFrame:
    """``response_mask`` times the product of all options' verdicts; adds ``_keep`` (the product) and ``_keep_<option>``."""
    df = with_log_ratio(df)
    keeps = []
    for option, spec in parse_rs(options, thresholds).items():
        low, high = _bounds(option, spec)
        values, row = _statistic(option)
        verdict = F.transform(values, lambda x: F.when(_inside(x, low, high), 1).otherwise(0)) if row is None else F.transform("_lr", lambda _: F.when(_inside(row, low, high), 1).otherwise(0))
        df = df.withColumn(f"_keep_{option}", verdict)
        keeps.append(f"_keep_{option}")
    product = F.col(keeps[0])
    for k in keeps[1:]:
        product = F.zip_with(product, F.col(k), lambda a, b: a * b)
    df = df.withColumns({"_keep": product, "_mask": F.col("response_mask")})
    return df.withColumn("response_mask", F.zip_with("_mask", "_keep", lambda m, k: m * k))


def _mapped(values: Column, fn) -> Column:
    return F.transform(values, lambda x: fn(x))


def _spread(row: Column) -> Column:
    """A row's statistic on every token."""
    return F.transform("_lr", lambda _: row)


def _dropped(df: DataFrame, keep: str, mask: str) -> dict[str, Column]:
    out = F.zip_with(keep, mask, lambda k, m: F.when((k == 0) & (m != 0), 1.0).otherwise(0.0))
    return {f"_drop{keep}": A.array_sum(out)}


def rejection_metrics(df: DataFrame, options: str, thresholds: float | str) -> DataFrame:
    """(metric, value): statistics of each option, the shares that it masks, and those of all together.

    The final share of sequences counts all rows, an option's only those with tokens.
    """
    specs = parse_rs(options, thresholds)
    done = reject(df, options, thresholds)
    done = done.withColumns({"_n": A.mask_count("_mask"), **_dropped(done, "_keep", "_mask"), **{k: v for o in specs for k, v in _dropped(done, f"_keep_{o}", "_mask").items()}})
    valid = F.col("_n") > 0
    n = F.sum("_n")
    aggregates: dict[str, Column] = {}
    for option, spec in specs.items():
        low, high = _bounds(option, spec)
        values, row = _statistic(option, "_mask")
        values = values if row is None else _spread(row)
        seq = A.masked_mean(values, "_mask") if row is None else row
        row_cols = {f"_{option}_sum": A.masked_sum(values, "_mask"), f"_{option}_seq": F.when(valid, seq)}
        kept = F.filter(F.zip_with(values, "_mask", lambda v, m: F.when(m != 0, v)), lambda x: x.isNotNull())
        held = _mapped(values, lambda x: A.clip(x, low if low is not None else 0.0, high))  # noqa: B023
        row_cols |= {f"_{option}_max": F.array_max(kept), f"_{option}_min": F.array_min(kept), f"_{option}_held": A.masked_sum(held, "_mask"), f"_{option}_square": A.masked_sum(F.transform(held, lambda x: x * x), "_mask")}
        row_cols |= {f"_{option}_high": A.masked_sum(_mapped(values, lambda x: F.when(x > high, 1.0).otherwise(0.0)), "_mask"), f"_{option}_low": A.masked_sum(_mapped(values, lambda x: F.when(x < low, 1.0).otherwise(0.0) if low is not None else F.lit(0.0)), "_mask")}
        done = done.withColumns(row_cols)
        c, s = (lambda name, option=option: F.col(f"_{option}_{name}")), F.col(f"_{option}_seq")
        mean = lambda x: F.sum(x) / (n + A.EPS)
        above, below = F.when(s > high, 1.0).when(s.isNotNull(), 0.0), F.when(s < low, 1.0).when(s.isNotNull(), 0.0) if low is not None else F.when(s.isNotNull(), 0.0)
        p = f"rollout_rs_{option}"
        sequence = row is not None
        aggregates |= {
            f"{p}_mean": mean(c("sum")),
            f"{p}_max": F.max(s) if sequence else F.max(c("max")),
            f"{p}_min": F.min(s) if sequence else F.min(c("min")),
            f"{p}_fraction_high": F.avg(above) if sequence else mean(c("high")),
            f"{p}_fraction_low": F.avg(below) if sequence else mean(c("low")),
            f"{p}_std": F.sqrt(F.greatest(mean(c("square")) - F.pow(mean(c("held")), 2.0), F.lit(0.0))),
            f"{p}_seq_mean": F.avg(s),
            f"{p}_seq_std": F.coalesce(F.stddev_samp(s), F.lit(0.0)),
            f"{p}_seq_max": F.max(s),
            f"{p}_seq_min": F.min(s),
            f"{p}_seq_max_deviation": F.max(F.abs(s)),
            f"{p}_seq_fraction_high": F.avg(above),
            **({f"{p}_seq_fraction_low": F.avg(below)} if low is not None else {}),
            f"{p}_masked_fraction": mean(F.col(f"_drop_keep_{option}")),
            f"{p}_seq_masked_fraction": F.coalesce(F.avg(F.when(valid, F.when(F.col(f"_drop_keep_{option}") > 0, 1.0).otherwise(0.0))), F.lit(0.0)),
        }
    aggregates |= {"rollout_rs_masked_fraction": F.sum("_drop_keep") / (n + A.EPS), "rollout_rs_seq_masked_fraction": F.avg(F.when(F.col("_drop_keep") > 0, 1.0).otherwise(0.0))}
    return as_metrics(done.agg(*[v.alias(k) for k, v in aggregates.items()]))


def as_metrics(one_row: DataFrame, prefix: str = "") -> DataFrame:
    """A row of aggregates as rows (metric, value)."""
    pairs = F.array(*[F.struct(F.lit(prefix + c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in one_row.columns])
    return one_row.select(F.inline(pairs))


def importance_weights(df: DataFrame, *, level: str = "token", threshold: float | str = 2.0, normalize: bool = False) -> DataFrame:
    """Adds ``is_weights`` and ``raw_weights``: exponentials of the log-ratio of tokens or of the whole sequence, masked.

    One bound truncates; two bounds zero what is outside (the mask stays). ``normalize`` divides by the batch's mean weight,
    over tokens or over sequences with tokens, where that is above 1e-8.
    """
    upper, lower = parse_is_threshold(threshold)
    df = with_log_ratio(df)
    if level == "token":
        raw = F.zip_with("_lr", "response_mask", lambda x, m: F.exp(A.clip(x, -SAFETY, SAFETY)) * m)
    elif level == "sequence":
        row = F.exp(A.clip(A.masked_sum("_lr", "response_mask"), -SAFETY, SAFETY))
        raw = F.transform("response_mask", lambda m: row * m)
    else:
        raise ValueError(f"unknown level {level!r}")
    df = df.withColumn("raw_weights", raw)
    held = (lambda w: F.least(w, F.lit(upper))) if lower is None else (lambda w: F.when((w >= lower) & (w <= upper), w).otherwise(0.0))
    df = df.withColumn("is_weights", F.transform("raw_weights", held))
    if normalize:
        total, n = A.masked_sum("is_weights", "response_mask"), A.mask_count("response_mask")
        if level == "token":
            mean = df.agg((F.sum(total) / (F.sum(n) + A.EPS)).alias("x")).scalar()
        else:
            mean = df.agg((F.sum(F.when(n > 0, total / (n + A.EPS)).otherwise(0.0)) / F.greatest(F.sum(F.when(n > 0, 1.0).otherwise(0.0)), F.lit(A.EPS))).alias("x")).scalar()
        df = df.withColumn("_norm", mean).withColumn("is_weights", F.transform("is_weights", lambda w: F.when(F.col("_norm") > 1e-8, w / F.col("_norm")).otherwise(w))).drop("_norm")
    return df


def weight_metrics(df: DataFrame, *, level: str = "token", threshold: float | str = 2.0) -> DataFrame:
    """(metric, value) of the weights before normalization; high and low shares are of the raw weights."""
    upper, lower = parse_is_threshold(threshold)
    icepop, low = lower is not None, lower if lower is not None else 1 / upper
    df = importance_weights(df, level=level, threshold=threshold)
    mask = "response_mask"
    held = F.transform("is_weights", lambda w: A.clip(w, 0.0, upper))
    flag = lambda cond: A.masked_sum(F.transform("raw_weights", lambda w: F.when(cond(w), 1.0).otherwise(0.0)), mask)
    kept = F.filter(F.zip_with("is_weights", mask, lambda w, m: F.when(m != 0, w)), lambda x: x.isNotNull())
    df = df.withColumns({
        "_n": A.mask_count(mask), "_sum": A.masked_sum("is_weights", mask), "_held": A.masked_sum(held, mask), "_square": A.masked_sum(F.transform(held, lambda w: w * w), mask), "_high": flag(lambda w: w > upper), "_low": flag(lambda w: w < low),
        "_max": F.array_max(kept), "_min": F.array_min(kept), "_seq": A.masked_mean("is_weights", mask), "_rawseq": A.masked_mean("raw_weights", mask), "_total": A.masked_sum("_lr", mask),
    })
    mean = lambda c: F.sum(c) / (F.sum("_n") + A.EPS)
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    m, sq = mean("_held"), mean("_square")
    if level == "sequence":
        top = {"max": F.exp(F.least(F.max("_total"), F.lit(SAFETY))), "min": F.exp(F.min("_total")), "ratio_fraction_high": share(F.col("_total") > math.log(upper)), "ratio_fraction_low": share(F.col("_total") < math.log(low))}
    else:
        top = {"max": F.max("_max"), "min": F.min("_min"), "ratio_fraction_high": mean("_high"), "ratio_fraction_low": mean("_low")}
    out = {
        "mean": mean("_sum"), **top, "std": F.sqrt(F.greatest(sq - F.pow(m, 2.0), F.lit(0.0))), "eff_sample_size": 1.0 / (sq / F.pow(m + 1e-8, 2.0)),
        "seq_mean": F.avg("_seq"), "seq_std": F.coalesce(F.stddev_samp("_seq"), F.lit(0.0)), "seq_max": F.max("_seq"), "seq_min": F.min("_seq"), "seq_max_deviation": F.max(F.abs(F.col("_seq") - 1.0)),
        "seq_fraction_high": share(F.col("_rawseq") > upper), "seq_fraction_low": share(F.col("_rawseq") < low),
        **({"oob_ratio": (F.sum("_high") + F.sum("_low")) / (F.sum("_n") + A.EPS)} if icepop else {}),
    }
    return as_metrics(df.agg(*[v.alias(f"rollout_is_{k}") for k, v in out.items()]))


def offpolicy_metrics(df: DataFrame) -> DataFrame:
    """(metric, value): perplexities of both policies, their divergences and chi-squares by token and by sequence."""
    mask = "response_mask"
    df = with_log_ratio(df)
    safe = F.transform("_lr", lambda x: A.clip(x, -SAFETY, SAFETY))
    df = df.withColumns({
        "_n": A.mask_count(mask), "_train": A.masked_mean("old_log_probs", mask), "_roll": A.masked_mean("rollout_log_probs", mask), "_kl": A.masked_sum(F.transform("_lr", lambda x: -x), mask),
        "_k3": A.masked_sum(F.transform("_lr", lambda x: F.exp(x) - x - 1), mask), "_rho2": A.masked_sum(F.transform(safe, lambda x: F.exp(x) * F.exp(x)), mask), "_total": A.clip(A.masked_sum("_lr", mask), -SAFETY, SAFETY),
    })
    mean = lambda c: F.sum(c) / (F.sum("_n") + A.EPS)
    diff = F.col("_roll") - F.col("_train")
    out = {
        "training_ppl": F.avg(F.exp(-F.col("_train"))), "training_log_ppl": F.avg(-F.col("_train")), "kl": mean("_kl"), "k3_kl": mean("_k3"), "rollout_ppl": F.avg(F.exp(-F.col("_roll"))), "rollout_log_ppl": F.avg(-F.col("_roll")),
        "log_ppl_diff": F.avg(diff), "log_ppl_abs_diff": F.avg(F.abs(diff)), "log_ppl_diff_max": F.max(diff), "log_ppl_diff_min": F.min(diff), "ppl_ratio": F.avg(F.exp(diff)), "chi2_token": mean("_rho2") - 1.0, "chi2_seq": F.avg(F.exp(2.0 * F.col("_total"))) - 1.0,
    }
    return as_metrics(df.agg(*[v.alias(k) for k, v in out.items()]))


def correct(df: DataFrame, *, level: str | None = None, threshold: float | str | None = 2.0, normalize: bool = False, options: str | None = None, rs_thresholds: float | str | None = None) -> DataFrame:
    """``is_weights`` where a level is given, and ``response_mask`` replaced where options are."""
    if level is not None and threshold is not None:
        df = importance_weights(df, level=level, threshold=threshold, normalize=normalize)
    if options is not None:
        df = reject(df, options, rs_thresholds)
    return df.drop(*[c for c in df.columns if c.startswith("_") and c != "_mask"])


def correction_metrics(df: DataFrame, *, level: str | None = None, threshold: float | str | None = 2.0, options: str | None = None, rs_thresholds: float | str | None = None) -> DataFrame:
    """All metrics under the prefix ``rollout_corr/``."""
    parts = []
    if level is not None and threshold is not None:
        parts.append(weight_metrics(df, level=level, threshold=threshold))
    if options is not None:
        parts.append(rejection_metrics(df, options, rs_thresholds))
    parts.append(offpolicy_metrics(df))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("metric", F.concat(F.lit("rollout_corr/"), "metric"))


def bypass(df: DataFrame) -> DataFrame:
    """Old log-probabilities replaced by the rollout's."""
    return df.withColumn("old_log_probs", F.col("rollout_log_probs"))


@dataclass(frozen=True)
class Correction:
    """A named bundle of correction parameters."""

    level: str | None = None
    threshold: float | str | None = None
    normalize: bool = False
    options: str | None = None
    rs_thresholds: float | str | None = None
    bypass: bool = False
    loss: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        df = bypass(df) if self.bypass else df
        return correct(df, level=self.level, threshold=self.threshold, normalize=self.normalize, options=self.options, rs_thresholds=self.rs_thresholds)


PRESETS = {
    "disabled": Correction(),
    "decoupled_token_is": Correction("token", 2.0),
    "decoupled_seq_is": Correction("sequence", 2.0),
    "decoupled_seq_is_rs": Correction("sequence", 2.0, options="seq_sum_k1", rs_thresholds="0.5_2.0"),
    "decoupled_geo_rs": Correction(options="seq_mean_k1", rs_thresholds="0.999_1.001"),
    "decoupled_k3_rs": Correction(options="seq_mean_k3", rs_thresholds=0.01),
    "bypass_ppo_clip": Correction(bypass=True, loss="ppo"),
    "bypass_pg_is": Correction("sequence", 2.0, bypass=True, loss="reinforce"),
    "bypass_pg_geo_rs": Correction(options="seq_mean_k1", rs_thresholds="0.999_1.001", bypass=True, loss="reinforce"),
}
