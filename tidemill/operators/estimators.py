"""Advantage estimators: statistics of a prompt's group of trajectories, broadcast back to its tokens.

An estimator takes trajectories (row_id, uid and the arrays rewards, response_mask, ...) and adds ``advantages`` and
``returns``. Group statistics are aggregated per ``uid`` (partial aggregation first, so a hot prompt doesn't meet in one
task) and joined back; batch statistics are scalar subqueries. Scores sum the unmasked rewards unless stated.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.functions.registry import Registry
from tidemill.operators.sampling import hash_order
from tidemill.sources.storage import stored

Estimator = Callable[..., DataFrame]
ESTIMATORS: Registry[Estimator] = Registry("estimator", allow_same=True)
EPS = 1e-6


def with_group(df: DataFrame, *, by: str = "uid", **aggregates: Column) -> DataFrame:
    """``df`` with aggregates of each row's group (null groups are a group)."""
    stats = df.groupBy(F.col(by).alias("_g")).agg(*[c.alias(n) for n, c in aggregates.items()])
    return df.join(stats, df[by].eqNullSafe(stats["_g"])).drop("_g")


def with_score(df: DataFrame) -> DataFrame:
    return df.withColumn("_s", A.array_sum("rewards"))


def spread(df: DataFrame, scalar: Column) -> DataFrame:
    """The scalar on every unmasked token, as advantages and returns."""
    out = df.withColumn("advantages", A.scaled_mask(scalar, "response_mask"))
    return out.withColumn("returns", F.col("advantages"))


def batch_moments(df: DataFrame, values: str, mask: str = "response_mask") -> tuple[Column, Column]:
    """Mean and variance (with Bessel's correction) of all unmasked values, as scalar subqueries.

    The mean's divisor has the epsilon of ``masked_mean``; one unmasked value or none has no variance (null).
    """
    tokens = df.select(F.explode(F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m"))).alias("t")).select(F.when(F.col("t.m") != 0, F.col("t.v")).alias("v"))
    moments = tokens.agg(F.coalesce(F.sum("v") / (F.count("v") + A.EPS), F.lit(0.0)).alias("mean"), F.var_samp("v").alias("var"))
    return moments.select("mean").scalar(), moments.select("var").scalar()


def whiten(df: DataFrame, values: str, out: str, *, mask: str = "response_mask", shift_mean: bool = True, remask: bool = False) -> DataFrame:
    """Values less the batch mean, over the batch deviation; masked places are moved too, unless ``remask``."""
    mean, var = batch_moments(df, values, mask)
    scaled = df.withColumns({"_mean": mean, "_inv": 1 / F.sqrt(var + A.EPS)})
    done = F.zip_with(values, mask, lambda v, m: ((v - F.col("_mean")) * F.col("_inv") + (F.lit(0.0) if shift_mean else F.col("_mean"))) * (m if remask else F.lit(1.0)))
    return scaled.withColumn(out, done).drop("_mean", "_inv")


def _standardized(df: DataFrame, score: str, by_std: bool = True, eps: float = EPS) -> Column:
    """(score - mean) / (sample deviation + eps) in the group; a group of one has mean 0 and deviation 1."""
    n, mean, std = F.col("_n"), F.col("_mean"), F.col("_std")
    mean = F.when(n == 1, 0.0).otherwise(mean)
    std = F.when(n == 1, 1.0).otherwise(std)
    return (F.col(score) - mean) / (std + eps) if by_std else F.col(score) - mean


_STATS = {"_n": F.count, "_mean": F.avg, "_std": F.stddev_samp}


def _group_stats(df: DataFrame, score: str) -> DataFrame:
    return with_group(df, **{name: fn(score) for name, fn in _STATS.items()})


@ESTIMATORS.register("grpo")
def grpo(df: DataFrame, *, by_std: bool = True, eps: float = EPS) -> DataFrame:
    """Scores standardized in their group; without ``by_std`` only centred."""
    with_stats = _group_stats(with_score(df), "_s")
    return spread(with_stats, _standardized(with_stats, "_s", by_std, eps)).drop("_s", *_STATS)


@ESTIMATORS.register("grpo_vectorized")
def grpo_vectorized(df: DataFrame, *, by_std: bool = True, eps: float = EPS) -> DataFrame:
    return grpo(df, by_std=by_std, eps=eps)


@ESTIMATORS.register("gdpo")
def gdpo(df: DataFrame, *, components: dict[str, float], by_std: bool = True, eps: float = EPS) -> DataFrame:
    """Each component (a column of scores) standardized in its group, weighted and summed, whitened and masked."""
    names = list(components)
    aggregates = {f"_{k}{stat}": fn(c) for k, c in enumerate(names) for stat, fn in _STATS.items()}
    grouped = with_group(df, **aggregates)
    total = F.lit(0.0)
    for k, (c, weight) in enumerate(components.items()):
        n, mean, std = (F.col(f"_{k}{stat}") for stat in _STATS)
        centred = F.col(c) - F.when(n == 1, 0.0).otherwise(mean)
        total = total + weight * (centred / (F.when(n == 1, 1.0).otherwise(std) + eps) if by_std else centred)
    raw = grouped.withColumn("_raw", A.scaled_mask(total, "response_mask"))
    out = whiten(raw, "_raw", "advantages", remask=True)
    return out.withColumn("returns", F.col("advantages")).drop("_raw", *aggregates)


@ESTIMATORS.register("grpo_passk")
def grpo_passk(df: DataFrame, *, by_std: bool = True, eps: float = EPS) -> DataFrame:
    """The group's best row gets its lead over the second (over the deviation); all others 0. Ties: the smallest row_id.

    Groups of one have no second and raise.
    """
    scored = with_score(df)
    best = F.max(F.struct(F.col("_s").alias("s"), (-F.col("row_id")).alias("r")))
    grouped = with_group(scored, _n=F.count("_s"), _std=F.stddev_samp("_s"), _best=best)
    rest = with_group(grouped.withColumn("_first", -F.col("row_id") == F.col("_best.r")), _second=F.max(F.when(-F.col("row_id") != F.col("_best.r"), F.col("_s"))))
    lead = F.col("_best.s") - F.col("_second")
    lead = lead / (F.col("_std") + eps) if by_std else lead
    checked = F.when(F.col("_n") < 2, F.raise_error(F.lit("pass@k needs at least 2 samples in a group")).cast("double")).otherwise(F.when(F.col("_first"), lead).otherwise(0.0))
    return spread(rest, checked).drop("_s", "_n", "_std", "_best", "_first", "_second")


@ESTIMATORS.register("reinforce_plus_plus_baseline")
def reinforce_pp_baseline(df: DataFrame) -> DataFrame:
    """Scores less the group's mean (0 in a group of one), whitened over tokens and masked."""
    grouped = _group_stats(with_score(df), "_s")
    raw = spread(grouped, F.col("_s") - F.when(F.col("_n") == 1, 0.0).otherwise(F.col("_mean")))
    out = whiten(raw.withColumn("_raw", F.col("advantages")), "_raw", "advantages", remask=True)
    return out.withColumn("returns", F.col("advantages")).drop("_raw", "_s", *_STATS)


@ESTIMATORS.register("rloo")
def rloo(df: DataFrame) -> DataFrame:
    """Score less the mean of the others; a group of one keeps its raw score."""
    grouped = _group_stats(with_score(df), "_s")
    n = F.col("_n")
    return spread(grouped, F.when(n > 1, (F.col("_s") - F.col("_mean")) * n / F.when(n > 1, n - 1)).otherwise(F.col("_s"))).drop("_s", *_STATS)


@ESTIMATORS.register("rloo_vectorized")
def rloo_vectorized(df: DataFrame) -> DataFrame:
    """As ``rloo``, but a group of one gets 0."""
    grouped = with_group(with_score(df), _n=F.count("_s"), _sum=F.sum("_s"))
    n = F.col("_n")
    return spread(grouped, F.when(n > 1, (n * F.col("_s") - F.col("_sum")) / F.greatest(n - 1, F.lit(1))).otherwise(0.0)).drop("_s", "_n", "_sum")


@ESTIMATORS.register("opo")
def opo(df: DataFrame) -> DataFrame:
    """Score less the length-weighted mean of the group; 0 is the baseline of a group of one."""
    scored = with_score(df).withColumn("_len", A.mask_count("response_mask"))
    grouped = with_group(scored, _n=F.count("_s"), _w=F.sum(F.col("_len") * F.col("_s")), _l=F.sum("_len"))
    baseline = F.when(F.col("_n") == 1, 0.0).otherwise(F.col("_w") / F.when(F.col("_l") != 0, F.col("_l")))
    return spread(grouped, F.col("_s") - baseline).drop("_s", "_len", "_n", "_w", "_l")


@ESTIMATORS.register("gpg")
def gpg(df: DataFrame, *, f_norm: float = 1.0) -> DataFrame:
    """alpha (score - mean) / f_norm with alpha = rows / rows of non-zero score; a group of one has mean 0."""
    grouped = _group_stats(with_score(df), "_s")
    alpha = with_score(df).agg((F.count("*") / F.greatest(F.count_if(F.col("_s") != 0), F.lit(1))).alias("a")).scalar()
    centred = F.col("_s") - F.when(F.col("_n") == 1, 0.0).otherwise(F.col("_mean"))
    return spread(grouped.withColumn("_alpha", alpha), F.col("_alpha") * centred / f_norm).drop("_s", "_alpha", *_STATS)


def affine_scan(a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """s[t] = b[t] + a[t] s[t + 1] within rows, laid end to end, whose ends (exclusive) are given; nothing follows a row.

    Affine maps compose to affine maps: after the k-th pass an entry holds the composition of the 2**k maps from it on, so
    rows of n tokens take log n passes over the whole batch and no loop over tokens.
    """
    a, b = a.copy(), b.copy()
    starts = np.concatenate([[0], ends[:-1]])
    a[ends[ends > starts] - 1] = 0.0
    longest, shift = int((ends - starts).max(initial=0)), 1
    while shift < longest:
        moves = a[:-shift] != 0  # what is not finite in a later row stays there
        b[:-shift] = np.where(moves, b[:-shift] + a[:-shift] * np.where(moves, b[shift:], 0.0), b[:-shift])
        a[:-shift] = np.where(moves, a[:-shift] * a[shift:], 0.0)
        shift *= 2
    return b


def _reverse_scan(step: Callable[..., np.ndarray], *columns: str) -> Column:
    """A column of arrays that ``step`` makes of the flat values of such columns and the rows' ends, a batch at a time.

    In higher-order functions the same scan took 2 (8 tokens) to 11 times (4096) as long as this.
    """

    @F.arrow_udf("array<double>")
    def scan(*arrays: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(arrays[0]), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths).astype(np.int32)
        flat = [pc.cast(x.flatten(), pa.float64()).to_numpy(zero_copy_only=False) for x in arrays]
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(step(*flat, ends)), mask=arrays[0].is_null() if arrays[0].null_count else None)

    whole = F.lit(True)
    for c in columns[1:]:
        whole = whole & F.col(c).isNotNull()
    # A row that lacks a column has no result; rows' arrays are of one length.
    return scan(*[F.when(whole, F.col(c)) if len(columns) > 1 else F.col(c) for c in columns])


def reward_to_go(df: DataFrame, values: str = "rewards", mask: str = "response_mask", out: str = "returns") -> DataFrame:
    """Reverse running sums of the masked values."""
    return df.withColumn(out, _reverse_scan(lambda r, m, ends: affine_scan(np.ones(len(r)), r * m, ends), values, mask))


@ESTIMATORS.register("reinforce_plus_plus")
def reinforce_pp(df: DataFrame, *, gamma: float = 1.0) -> DataFrame:
    """Discounted reverse returns whose carry ends where the mask is 0 (after that token's return), whitened and masked."""

    def scan(rewards: np.ndarray, mask: np.ndarray, ends: np.ndarray) -> np.ndarray:
        # A token passes on what the mask of the token after it leaves.
        after = np.concatenate([mask[1:], [0.0]]) if len(mask) else mask
        return affine_scan(gamma * after, rewards, ends)

    raw = df.withColumn("returns", _reverse_scan(scan, "rewards", "response_mask"))
    return whiten(raw, "returns", "advantages", remask=True)


@ESTIMATORS.register("remax")
def remax(df: DataFrame, *, baseline: str = "reward_baseline") -> DataFrame:
    """Masked reward-to-go less a baseline of the row, on unmasked tokens."""
    with_returns = reward_to_go(df)
    return with_returns.withColumn("advantages", F.zip_with("returns", "response_mask", lambda g, m: g - F.col(baseline) * m))


@ESTIMATORS.register("gae")
def gae(df: DataFrame, *, gamma: float = 1.0, lam: float = 1.0, values: str = "vals") -> DataFrame:
    """Generalized advantages: masked tokens leave the state untouched and show it; returns = advantages + values; whitened."""

    def scan(rewards: np.ndarray, value: np.ndarray, mask: np.ndarray, ends: np.ndarray) -> np.ndarray:
        seen = mask != 0
        held = affine_scan(np.where(seen, 0.0, 1.0), np.where(seen, value, 0.0), ends)  # the value at or after a token
        following = np.zeros(len(held))
        following[:-1] = held[1:]
        following[ends[ends > np.concatenate([[0], ends[:-1]])] - 1] = 0.0
        delta = np.where(seen, rewards + gamma * following - value, 0.0)
        return affine_scan(np.where(seen, gamma * lam, 1.0), delta, ends)

    raw = df.withColumn("_raw", _reverse_scan(scan, "rewards", values, "response_mask")).withColumn("returns", F.zip_with("_raw", values, lambda a, v: a + v))
    return whiten(raw, "_raw", "advantages").drop("_raw")


def _token_baseline(df: DataFrame, compact: bool, zero_tail: bool, weights: str | None, eps: float) -> DataFrame:
    """Per group and position, the mean return weighted by the trajectories' cumulative variance proxies.

    Positions are those of the arrays or, with ``compact``, those among a trajectory's unmasked tokens. Long layout: running
    sums per row, aggregates per (uid, position), joined back; a hot group is spread over its positions.
    """
    w = lambda t: (1 - 2 * F.exp(t["old_log_probs"]) + t["sum_pi_squared"]) * (t[weights] ** 2 if weights else F.lit(1.0))
    names = ["rewards", "response_mask", "old_log_probs", "sum_pi_squared", *([weights] if weights else [])]
    tokens = df.select("row_id", "uid", A.mask_count("response_mask").cast("int").alias("n_tokens"), F.posexplode(F.arrays_zip(*[F.col(n) for n in names])).alias("pos", "t"))
    forward = Window.partitionBy("row_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy("row_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    m = F.col("t.response_mask")
    scanned = tokens.select("row_id", "uid", "n_tokens", "pos", m.alias("m"), F.sum(w(F.col("t")) * m).over(forward).alias("w"), F.sum(F.col("t.rewards") * m).over(backward).alias("g"), F.sum(m).over(forward).alias("k"))
    scanned = scanned.withColumn("place", F.col("k") - 1 if compact else F.col("pos"))
    used = scanned.filter("m <> 0")
    per_place = used.groupBy("uid", "place").agg((F.sum(F.col("g") * F.col("w")) / (F.sum("w") + eps)).alias("b"))
    members = df.select("uid", A.mask_count("response_mask").cast("int").alias("n_tokens"))
    members = members.filter("n_tokens > 0") if compact else members
    top = members.groupBy("uid").agg(F.count("*").alias("rows"), F.max("n_tokens").alias("longest"))
    tied = members.join(top, "uid").groupBy("uid").agg(F.count_if(F.col("n_tokens") == F.col("longest")).alias("at_top"), F.max(F.when(F.col("n_tokens") < F.col("longest"), F.col("n_tokens"))).alias("second"))
    joined = scanned.join(per_place, ["uid", "place"], "left").join(top, "uid", "left").join(tied, "uid", "left")
    alone = F.coalesce(F.col("rows"), F.lit(0)) <= 1
    tail = (F.col("at_top") == 1) & (F.col("n_tokens") == F.col("longest")) & (F.col("place") >= F.col("second")) if zero_tail else F.lit(False)
    baseline = F.when(alone | F.coalesce(tail, F.lit(False)), 0.0).otherwise(F.coalesce("b", F.lit(0.0)))
    done = joined.select("row_id", F.struct("pos", ((F.col("g") - baseline) * F.col("m")).alias("a"), F.col("g")).alias("x")).groupBy("row_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return df.join(done.select("row_id", F.col("x.a").alias("advantages"), F.col("x.g").alias("returns")), "row_id")


@ESTIMATORS.register("optimal_token_baseline")
def optimal_token_baseline(df: DataFrame, *, zero_tail: bool = True, weights: str | None = None, eps: float = 1e-8) -> DataFrame:
    return _token_baseline(df, False, zero_tail, weights, eps)


@ESTIMATORS.register("tir_optimal_token_baseline")
def multi_turn_token_baseline(df: DataFrame, *, zero_tail: bool = True, weights: str | None = None, eps: float = 1e-8) -> DataFrame:
    return _token_baseline(df, True, zero_tail, weights, eps)


def multi_trajectory(df: DataFrame, *, by_std: bool = True, eps: float = EPS) -> DataFrame:
    """GRPO over sessions: the last output (by traj_index) of each (uid, session_id) enters, scored at its first unmasked
    token; every output of the session gets the session's advantage on its own mask."""
    unmasked = F.filter(F.zip_with("rewards", "response_mask", lambda r, m: F.when(m != 0, r)), lambda x: x.isNotNull())
    score = F.coalesce(F.try_element_at(unmasked, F.lit(1)), F.lit(0.0))
    last = df.withColumn("_s", score).groupBy("uid", "session_id").agg(F.max_by("_s", "traj_index").alias("_s"))
    stats = _group_stats(last, "_s")
    adv = stats.select("uid", "session_id", _standardized(stats, "_s", by_std, eps).alias("_a"))
    return spread(df.join(adv, ["uid", "session_id"]), F.col("_a")).drop("_a")


def pf_weights(method: str, power: float = 2.0) -> Callable[[DataFrame], DataFrame]:
    """Adds ``weight`` of a row by its score: ``pow``, ``max_min`` or ``max_random``."""

    def add(df: DataFrame) -> DataFrame:
        scored = with_score(df)
        top, bottom = scored.agg(F.max("_s")).scalar(), scored.agg(F.min("_s")).scalar()
        w = {
            "pow": lambda s: F.pow(F.abs(s), F.lit(power)),
            "max_min": lambda s: F.when((s == top) | (s == bottom), 1.0).otherwise(0.0),
            "max_random": lambda s: F.when(s == top, 0.4).otherwise(0.1),
        }
        if method not in w:
            raise ValueError(f"unsupported reweighting {method!r}")
        return scored.withColumn("weight", F.greatest(w[method](F.col("_s")) + 1e-8, F.lit(1e-8))).drop("_s")

    return add


def pf_resample(df: DataFrame, *, method: str = "pow", power: float = 2.0, seed: int = 0, chunks: int = 1024) -> DataFrame:
    """As many rows as ``df`` has, drawn with replacement in proportion to weight; adds ``draw``, the draw's number (there is
    one for each row id).

    Inverse distribution by an equi-join: draws and cumulative weights meet in cells of the unit interval, so neither side
    is sent everywhere. There is a cell for every four rows, so what meets grows with the rows and not with their square.
    Draws are hashes of their number: the same seed draws the same. The weighted rows are stored, as sums, cells and draws
    each read them.
    """
    weighted = stored(pf_weights(method, power)(df), "weighted")
    n_cells = F.lit(max(chunks, weighted.count() // 4))
    chunked = weighted.withColumn("_chunk", F.pmod("row_id", F.lit(chunks)))
    sums = chunked.groupBy("_chunk").agg(F.sum("weight").alias("_sum"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0.0))).drop("_sum")
    total = sums.agg(F.sum("_sum")).scalar()
    inside = Window.partitionBy("_chunk").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = chunked.join(base, "_chunk").withColumn("_high", (F.col("_base") + F.sum("weight").over(inside)) / total)
    placed = placed.withColumn("_low", F.col("_high") - F.col("weight") / total)
    cells = placed.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_low") * n_cells), F.floor(F.col("_high") * n_cells))))
    draws = weighted.select(F.col("row_id").alias("draw"), (hash_order(seed, "row_id") / F.lit(float(1 << 60))).alias("_u")).withColumn("_cell", F.floor(F.col("_u") * n_cells))
    return cells.join(draws, "_cell").filter("_u >= _low and _u < _high").drop("_chunk", "_base", "_high", "_low", "_cell", "_u", "weight")


def compute_advantage(df: DataFrame, name: str, **config) -> DataFrame:
    """The named estimator."""
    return ESTIMATORS[name](df, **config)
