"""Batch, timing and validation metrics, and reductions of long metric tables (step, rank, key, value).

Metrics come as rows (metric, value) from one aggregate over rows or tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.functions.names import fresh
from tidemill.operators import selection
from tidemill.operators.batch import with_dense_id
from tidemill.operators.correction import as_metrics
from tidemill.sources.storage import stored

#: Draws of all sizes of groups that a bootstrap broadcasts at most, of 8 bytes each.
BROADCAST_PICKS = 1 << 21


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


# Reductions of metric tables
def reduction_of(key: Column) -> Column:
    """"max" if the key contains it, else "min" if it contains that (also inside words), else "mean"."""
    return F.when(key.contains("max"), "max").when(key.contains("min"), "min").otherwise("mean")


def reduce_by_name(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(metric, value): every key's values reduced as its name says."""
    rule = reduction_of(F.col(key))
    out = df.groupBy(key).agg(F.max(value).alias("max"), F.min(value).alias("min"), F.avg(value).alias("mean"))
    return out.select(F.col(key).alias("metric"), F.when(rule == "max", F.col("max")).when(rule == "min", F.col("min")).otherwise(F.col("mean")).alias("value"))


def accumulate(df: DataFrame, how: str, *, by: str = "key", value: str = "value") -> DataFrame:
    """One kind of reduction for all keys: mean, sum, min or max."""
    fns = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
    if how not in fns:
        raise ValueError(f"unknown aggregation {how!r}")
    return df.groupBy(by).agg(fns[how](value).alias("value"))


def reduce_ranks(df: DataFrame, how: str, *, by: str = "key", slot: str = "slot", rank: str = "rank", value: str = "value") -> DataFrame:
    """Across ranks and then slots: means per slot for sum and mean, all values for min and max. Ranks with unequal numbers
    of slots raise when the query runs."""
    if how in ("min", "max"):
        return accumulate(df, how, by=by, value=value)
    counts = df.groupBy(by, rank).agg(F.count("*").alias("_n")).groupBy(by).agg(F.min("_n").alias("_low"), F.max("_n").alias("_high"))
    slots = df.groupBy(by, slot).agg(F.avg(value).alias("_v")).groupBy(by).agg((F.sum("_v") if how == "sum" else F.avg("_v")).alias("value"))
    checked = F.when(F.col("_low") != F.col("_high"), F.raise_error(F.lit("ranks have unequal numbers of values")).cast("double")).otherwise(F.col("value"))
    return slots.join(counts, by).select(by, checked.alias("value"))


#: Keys whose reduction over steps is the last value.
LAST = ("fully_async/count/total_generated_samples", "fully_async/count/stale_samples_processed", "fully_async/count/current_param_version", "training/global_step", "training/epoch")


def reduce_steps(df: DataFrame, *, last: tuple[str, ...] = LAST, step: str = "step", key: str = "key", value: str = "value") -> DataFrame:
    """(metric, value) over steps: last value for ``last``; times (``timing_s/``) add up; else by the first word found in
    the key: mean or avg, max, min, sum or total; else the mean."""
    k = F.col(key)
    has = lambda *words: F.lit(False) if not words else F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(k), w))
    rule = F.when(k.isin(*last), "last").when(k.startswith("timing_s/"), "sum").when(has("mean", "avg"), "mean").when(has("max"), "max").when(has("min"), "min").when(has("sum", "total"), "sum").otherwise("mean")
    out = df.groupBy(key).agg(F.max_by(value, step).alias("last"), F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"))
    picked = F.coalesce(*[F.when(rule == r, F.col(r)) for r in ("last", "sum", "mean", "max", "min")])
    return out.select(k.alias("metric"), picked.alias("value"))


def section(variable: Column, metric: Column, most: Column) -> Column:
    """"val-core" for accuracy (or the reward where there is none, as the caller decides) with mean, maj or best at the largest
    n; "val-aux" for the rest. ``variable`` is 'core' or anything else."""
    top = metric.rlike("^(mean|maj|best)") & metric.contains(F.concat(F.lit("@"), most))
    return F.when((variable == "core") & top, "val-core").otherwise("val-aux")


# Batch metrics
def data_metrics(df: DataFrame, *, use_critic: bool = True, max_response: int, max_prompt: int | None = None) -> DataFrame:
    """(metric, value) of trajectories with scores, rewards, advantages, returns, response_mask, response_length and, with
    a critic, vals. Rows without a response are aborted and left out of score statistics. Token statistics take unmasked
    tokens. Without any, values are NaN."""
    nan = F.lit(float("nan"))
    ok = F.col("response_length") != 0
    rows = df.withColumns({"_score": A.array_sum("scores"), "_reward": A.array_sum("rewards")})
    three = lambda name, c, cond=None: {f"{name}/{s}": F.coalesce(fn(F.when(cond, c) if cond is not None else c), nan) for s, fn in (("mean", F.avg), ("max", F.max), ("min", F.min))}
    length = F.col("response_length").cast("double")
    out = three("critic/score", F.col("_score"), ok) | three("critic/rewards", F.col("_reward"), ok) | three("response_length", length) | three("response_length_non_aborted", length, ok)
    full = F.when(length == max_response, 1.0).otherwise(0.0)
    out |= {"response_length/clip_ratio": F.avg(full), "response_length_non_aborted/clip_ratio": F.coalesce(F.avg(F.when(ok, full)), nan), "response/aborted_ratio": share(~ok)}
    if max_prompt is not None:
        prompt = F.col("prompt_length").cast("double")
        out |= three("prompt_length", prompt) | {"prompt_length/clip_ratio": share(prompt == max_prompt)}
    for extra in ("num_turns", "tool_call_counts"):
        if extra in df.columns:
            out |= three(extra, F.col(extra).cast("double"))
    by_row = as_metrics(rows.agg(*[c.alias(k) for k, c in out.items()]))
    names = ["advantages", "returns", *(["vals"] if use_critic else [])]
    tokens = df.select(F.explode(F.arrays_zip("response_mask", *names)).alias("t")).filter("t.response_mask <> 0").select(*[F.col(f"t.{n}").alias(n) for n in names])
    token = three("critic/advantages", F.col("advantages")) | three("critic/returns", F.col("returns"))
    if use_critic:
        explained = 1.0 - F.var_samp(F.col("returns") - F.col("vals")) / (F.var_samp("returns") + 1e-5)
        token |= three("critic/values", F.col("vals")) | {"critic/vf_explained_var": F.coalesce(explained, nan)}
    return by_row.unionByName(as_metrics(tokens.agg(*[c.alias(k) for k, c in token.items()])))


def timing_metrics(df: DataFrame, timings: dict[str, float]) -> DataFrame:
    """Seconds, and milliseconds a token: response tokens for ``gen``, all tokens for ref, values, adv and updates; 0 without tokens."""
    response, everything = F.sum("response_length"), F.sum(F.col("response_length") + F.col("prompt_length"))
    tokens = {"gen": response} | dict.fromkeys(("ref", "values", "adv", "update_critic", "update_actor"), everything)
    out = {f"timing_s/{k}": F.lit(float(v)) for k, v in timings.items()}
    out |= {f"timing_per_token_ms/{k}": F.when(tokens[k] > 0, F.lit(v * 1000.0) / F.when(tokens[k] > 0, tokens[k])).otherwise(0.0) for k, v in timings.items() if k in tokens}
    return as_metrics(df.agg(*[c.alias(k) for k, c in out.items()]))


def throughput_metrics(df: DataFrame, *, seconds: float, workers: int) -> DataFrame:
    total = F.sum(F.col("response_length") + F.col("prompt_length")).cast("double")
    return as_metrics(df.agg(total.alias("perf/total_num_tokens"), F.lit(float(seconds)).alias("perf/time_per_step"), (total / (seconds * workers)).alias("perf/throughput")))


def variance_proxies(df: DataFrame, gradient_norm: float | None = None, *, weights: str | None = None) -> DataFrame:
    """Signal, total power and noise of the gradient by its proxies."""
    w = A.token_map(lambda lp, s: 1 - 2 * F.exp(lp) + s, "old_log_probs", "sum_pi_squared")
    a, mask = A.masked_mean("advantages", "response_mask"), "response_mask"
    original = A.masked_sum(w, mask)
    if weights:
        total = A.masked_sum(F.zip_with(w, weights, lambda x, r: x * r * r), mask)
        power = F.pow(A.masked_mean(weights, mask), 2.0) * a * a * F.greatest(original, F.lit(0.0))
    else:
        total, power = original, a * a * F.greatest(original, F.lit(0.0))
    rows = df.select(a.alias("a"), total.alias("w"), power.alias("p"))
    signal = F.lit(gradient_norm**2 if gradient_norm is not None else 0.0)
    noise = F.when(F.count("*") > 1, F.greatest(F.lit(0.0), (F.avg("p") - signal) / (F.count("*") - 1))).otherwise(0.0) if gradient_norm is not None else F.lit(0.0)
    out = {"proxy1_signal_strength": signal, "proxy2_total_power": F.avg("p"), "proxy3_pure_noise": noise, "expected_a_squared": F.avg(F.col("a") * F.col("a")), "expected_w": F.avg("w")}
    return as_metrics(rows.agg(*[c.alias(f"variance_proxy/{k}") for k, c in out.items()]))


def expert_counts(df: DataFrame, *, experts: int, layer: str = "layer", expert: str = "expert") -> DataFrame:
    """(layer, expert, n) of routed experts (token arrays) under the mask; ids outside [0, experts) give no rows at all."""
    tokens = df.select(F.explode(F.arrays_zip("response_mask", layer, expert)).alias("t")).filter("t.response_mask <> 0").select(F.col(f"t.{layer}").alias("layer"), F.col(f"t.{expert}").alias("expert"))
    counts = tokens.groupBy("layer", "expert").agg(F.count("*").alias("n"))
    bad = counts.agg(F.coalesce(F.count_if((F.col("expert") < 0) | (F.col("expert") >= experts)), F.lit(0)).alias("bad")).scalar()
    return counts.withColumn("_bad", bad).filter("_bad = 0").drop("_bad")


def expert_imbalance(counts: DataFrame, *, experts: int, prefix: str = "rollout/moe") -> DataFrame:
    """(metric, value): a layer's largest, smallest and mean absolute deviation of an expert's share from even, and their
    maximum and mean over layers. Experts without tokens deviate by -1."""
    per_layer = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("layer")) * experts - 1.0).groupBy("layer").agg(F.max("share").alias("top"), F.min("share").alias("low"), F.sum(F.abs("share")).alias("abs"), F.count("*").alias("seen"))
    missing = F.lit(experts) - F.col("seen")
    per_layer = per_layer.select("layer", F.col("top").alias("max_vio"), F.when(missing > 0, F.least("low", F.lit(-1.0))).otherwise(F.col("low")).alias("min_vio"), ((F.col("abs") + missing) / experts).alias("avg_vio"))
    kinds = ("max_vio", "min_vio", "avg_vio")
    rows = per_layer.select(F.inline(F.array(*[F.struct(F.concat(F.lit(f"{prefix}/{k}/layer_"), F.col("layer").cast("string")).alias("metric"), F.col(k).alias("value")) for k in kinds])))
    return rows.unionByName(as_metrics(per_layer.agg(*[fn(k).alias(f"{prefix}/{k}/{s}") for k in kinds for s, fn in (("max", F.max), ("avg", F.avg))])))


def accumulated_counts(counts: DataFrame, *, every: int, step: str = "step") -> DataFrame:
    """Expert counts added up over each ``every`` steps: (window, layer, expert, n)."""
    return counts.groupBy(F.expr(f"{step} div {every}").alias("window"), "layer", "expert").agg(F.sum("n").alias("n"))


def speculative_rates(df: DataFrame) -> DataFrame:
    """Acceptance rate and length of speculative decoding: ratios per row, then their means; no draft counts as 0."""
    rate = F.when(F.col("drafted") > 0, F.col("accepted") / F.col("drafted")).otherwise(0.0)
    length = F.when(F.col("verified") > 0, 1.0 + F.col("accepted") / F.col("verified")).otherwise(0.0)
    return as_metrics(df.agg(F.avg(rate).alias("spec_decode/accept_rate"), F.avg(length).alias("spec_decode/accept_length")))


def drift_metrics(df: DataFrame) -> DataFrame:
    """How far rollout and training probabilities are apart on unmasked tokens, and their correlation."""
    tokens = df.select(F.explode(F.arrays_zip("response_mask", "old_log_probs", "rollout_log_probs")).alias("t")).filter("t.response_mask <> 0").select(F.exp("t.old_log_probs").alias("a"), F.exp("t.rollout_log_probs").alias("b"))
    diff = F.abs(F.col("a") - F.col("b"))
    return as_metrics(tokens.agg(F.max(diff).alias("rollout_probs_diff_max"), F.avg(diff).alias("rollout_probs_diff_mean"), F.stddev_samp(diff).alias("rollout_probs_diff_std"), F.corr("a", "b").alias("rollout_actor_probs_pearson_corr")))


def token_differences(a: str, b: str, mask: str) -> Column:
    """How many unmasked tokens differ."""
    return F.size(F.filter(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"), F.col(mask).alias("m")), lambda t: (t["m"] != 0) & (t["a"] != t["b"])))


def percentiles(df: DataFrame, value: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles with linear interpolation, of tables of any size (see ``selection``)."""
    return as_metrics(selection.percentiles(df, value, at).select(*[F.col(f"p{k}").alias(f"tp{round(p * 100)}") for k, p in enumerate(at)]))


def partial_stats(df: DataFrame) -> DataFrame:
    """Trajectories made under several versions: their number, share and the largest span."""
    span = F.col("max_global_steps") - F.col("min_global_steps")
    return as_metrics(df.agg(F.count_if(span != 0).alias("partial/total_partial_num"), share(span != 0).alias("partial/partial_ratio"), F.max(span).alias("partial/max_partial_span"), F.count_distinct("max_global_steps").alias("partial/versions")))


def staleness_stats(df: DataFrame, *, now: Column, sync: int = 1) -> DataFrame:
    """Span, staleness and worst staleness of trajectories in units of ``sync`` versions: mean, max, min."""
    kinds = {"span": (F.col("max_global_steps") - F.col("min_global_steps") + 1) / sync, "staleness": (now - 1 - F.col("max_global_steps")) / sync, "worst_staleness": (now - 1 - F.col("min_global_steps")) / sync}
    return as_metrics(df.agg(*[fn(c).alias(f"trajectory/{k}/{s}") for k, c in kinds.items() for s, fn in (("mean", F.avg), ("max", F.max), ("min", F.min))]))


def mean_by_source(df: DataFrame, *, scores: str = "scores", source: str = "data_source") -> DataFrame:
    """Mean over a row's scores, then over a source's rows."""
    row = A.array_sum(scores) / F.when(F.size(scores) > 0, F.size(scores))
    return df.groupBy(source).agg(F.avg(row).alias("test_score"), F.count("*").alias("n"))


def sizes_of(n: Column) -> Column:
    """2, 4, 8, ... below n, and n itself; nothing for n of 1 or less."""
    powers = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.when(n > 1, F.concat(F.filter(powers, lambda p: p < n), F.array(n.cast("int")))).otherwise(F.array().cast("array<int>"))


def validation_metrics(df: DataFrame, *, source: str = "data_source", uid: str = "uid", value: str = "value", order: str = "row_id") -> DataFrame:
    """(data_source, metric, value): per prompt mean@N, population std@N and the exact expectations of the best and worst of n
    draws with replacement for n = 2, 4, ... N; then means over prompts.

    The expectation is what a bootstrap estimates, in closed form: with sorted values v_1..v_N, the sum of
    v_i ((i/N)**n - ((i-1)/N)**n).
    """
    grouped = df.groupBy(source, uid).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.array_sort(F.collect_list(value)).alias("v"))
    named = lambda name, k: F.concat(F.lit(name + "@"), k.cast("string"))
    basic = grouped.select(source, uid, F.inline(F.array(F.struct(named("mean", F.col("n")).alias("metric"), F.col("mean").alias("value")), F.struct(F.when(F.col("n") > 1, named("std", F.col("n"))).alias("metric"), F.col("std").alias("value")))))
    many = grouped.withColumn("k", F.explode(sizes_of(F.col("n"))))
    size = F.col("n").cast("double")
    term = lambda rank: F.pow(rank / size, F.col("k")) - F.pow((rank - 1) / size, F.col("k"))
    best = A.array_sum(F.transform("v", lambda x, i: x * term(i.cast("double") + 1)))
    worst = A.array_sum(F.transform("v", lambda x, i: x * term(size - i)))
    both = many.select(source, uid, F.inline(F.array(F.struct(F.concat(named("best", F.col("k")), F.lit("/mean")).alias("metric"), best.alias("value")), F.struct(F.concat(named("worst", F.col("k")), F.lit("/mean")).alias("metric"), worst.alias("value")))))
    return basic.filter("metric is not null").unionByName(both).groupBy(source, "metric").agg(F.avg("value").alias("value"))


def bootstrap(df: DataFrame, *, size: int, fns: dict[str, Callable[[Column], Column]], draws: int = 1000, seed: int = 42, by: str = "uid", value: str = "value", order: str = "row_id") -> DataFrame:
    """(by, fn, mean, std): seeded bootstrap per group, the mean and population deviation of aggregates (``F.max`` and the like)
    over samples with replacement.

    What is drawn depends on a group's size alone. Groups of fewer rows than there are draws of one are an array each, and
    meet the draws of their size where they lie, so no draw is shuffled. The draws of larger groups are a relation that
    meets the rows by their place in their group, fewer than there are rows: a group of any size is never in one task.
    """
    at, n, place, draw = fresh(df, "at", "n", "place", "draw")
    few = max(1, min(draws * size, BROADCAST_PICKS // (draws * size)))
    placed = with_dense_id(df.select(by, order, value), [by, order], at)
    # A group's rows lie together. Of a group of few rows or more all slices but the first and the last are full, and full ones aren't kept.
    slices = placed.groupBy(by, F.floor(F.col(at) / few).alias("slice")).agg(F.min(at).alias("first"), F.count("*").alias("rows"), F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("v"))).alias("part"))
    groups = slices.groupBy(by).agg(F.min("first").alias("first"), F.sum("rows").alias(n), F.flatten(F.collect_list(F.when(F.col("rows") < few, F.col("part")))).alias("part"))
    groups = stored(groups.withColumnRenamed(by, "of"), "bootstrap-groups")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for many in batch.column(0).to_pylist():
                picks = np.random.RandomState(seed).choice(many, size=(draws, size), replace=True).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(picks), many)), pa.array(np.repeat(np.arange(draws), size)), pa.array(picks.astype(np.int64))], ["n", "draw", "place"])

    def summed(picked: DataFrame) -> DataFrame:
        found = picked.groupBy("base", draw).agg(F.first("of").alias("of"), *[fn(F.col(value)).cast("double").alias(f"f{k}") for k, fn in enumerate(fns.values())])
        long = found.select("base", "of", F.inline(F.array(*[F.struct(F.lit(name).alias("fn"), F.col(f"f{k}").alias("v")) for k, name in enumerate(fns)])))
        return long.groupBy("base", "fn").agg(F.first("of").alias(by), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).select(by, "fn", "mean", "std")

    def relation(of: DataFrame) -> DataFrame:
        return of.select(n).distinct().mapInArrow(pick, "n long, draw long, place long").select(F.col("n").alias(n), F.col("draw").alias(draw), "place")

    small, large = groups.filter(F.col(n) < few), groups.filter(F.col(n) >= few)
    # Fewer than ``few`` sizes, of draws * size places each.
    of_size = F.broadcast(relation(small).groupBy(n).agg(F.collect_list(F.struct(F.col(draw).cast("int").alias("draw"), F.col("place").cast("int").alias("place"))).alias("picks")))
    # Parted by group, in which state the aggregates by draw find them.
    arrays = small.select(F.col("first").alias("base"), "of", n, F.sort_array("part")["v"].alias("vs")).repartition("base").join(of_size, n)
    picked = arrays.select("base", "of", "vs", F.inline("picks")).select("base", "of", F.col("draw").alias(draw), F.get("vs", F.col("place")).alias(value))
    # A size's draws meet each group of that size; groups of a common size are spread over copies of its draws.
    copies = relation(large).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(15))))
    wanted = large.withColumn("copy", F.pmod(F.xxhash64("first"), F.lit(16)).cast("int")).join(copies, [n, "copy"]).select(F.col("first").alias("base"), "of", draw, (F.col("first") + F.col("place")).alias(at))
    return summed(picked).unionByName(summed(wanted.join(placed.select(at, value), at)))


def majority_value(df: DataFrame, *, by: str = "uid", vote: str = "pred", value: str = "value", order: str = "row_id") -> DataFrame:
    """The first value of each group's most frequent vote; ties go to the vote seen first."""
    votes = df.groupBy(by, vote).agg(F.count("*").alias("_n"), F.min(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("_first"))
    return votes.groupBy(by).agg(F.max_by(F.struct(F.col(vote).alias("vote"), F.col("_first.v").alias("value")), F.struct("_n", -F.col("_first.o"))).alias("_w")).select(by, F.col("_w.vote").alias("vote"), F.col("_w.value").alias("value"))


def imbalance(df: DataFrame, *, length: str, part: str, chunk: str) -> DataFrame:
    """Smallest and largest sums of contiguous chunks and of balanced parts."""
    before = df.groupBy(chunk).agg(F.sum(length).alias("s")).agg(F.min("s").alias("min"), F.max("s").alias("max"), (F.max("s") - F.min("s")).alias("minmax_diff"))
    after = df.groupBy(part).agg(F.sum(length).alias("s")).agg(F.min("s").alias("balanced_min"), F.max("s").alias("balanced_max"), F.avg("s").alias("mean"))
    return as_metrics(before, "global_seqlen/").unionByName(as_metrics(after, "global_seqlen/"))


def timing_spread(df: DataFrame, value: str = "value", k: float = 20.0) -> DataFrame:
    """Mean, the share of values above the (1 - k/100) quantile's value, min and max."""
    edge = selection.percentiles(df, value, (1 - k / 100,)).scalar()
    return as_metrics(df.withColumn("_q", edge).agg(F.avg(value).alias("mean"), share(F.col(value) > F.col("_q")).alias("topk_ratio"), F.min(value).alias("min"), F.max(value).alias("max")))


def distillation_metrics(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Mean, min and max of token arrays on unmasked tokens."""
    tokens = df.select(F.explode(F.arrays_zip("response_mask", *columns)).alias("t")).filter("t.response_mask <> 0")
    return as_metrics(tokens.agg(*[fn(F.col(f"t.{c}")).alias(f"distillation/{c}/{s}") for c in columns for s, fn in (("mean", F.avg), ("min", F.min), ("max", F.max))]))


def transformer_flops(tokens: Column, squared: Column, *, layers: int, hidden: int, ffn: int, vocab: int, heads: int, kv_heads: int, head_dim: int) -> Column:
    """Training FLOPs of a dense decoder: 6 per weight and token, and 6 per attention score and dimension (causal halves of 12)."""
    attention = hidden * (heads + 2 * kv_heads) * head_dim + heads * head_dim * hidden
    weights = layers * (attention + 3 * hidden * ffn) + 2 * vocab * hidden
    return 6.0 * weights * tokens + 6.0 * squared * head_dim * heads * layers


def support_profile(df: DataFrame) -> DataFrame:
    """One row on a set of memory records: count, distinct modalities, authors and sources, time range, any raw media."""
    distinct = lambda c: F.array_sort(F.collect_set(c))
    return df.agg(F.count("*").alias("count"), distinct("modality").alias("modalities"), distinct("author").alias("authors"), distinct("source_type").alias("sources"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.bool_or(F.col("raw_pointer").isNotNull()).alias("has_raw"))


def slowest(df: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """Min, max and mean of each part's time, and the parts of the row whose sum is largest."""
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    spread = [fn(p).alias(f"{p}/{s}") for p in parts for s, fn in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    worst = F.max_by(F.struct(*parts), F.struct(total, -F.col("row_id")))
    return as_metrics(df.agg(*spread, worst.alias("w")).select("*", *[F.col(f"w.{p}").alias(f"slowest/{p}") for p in parts]).drop("w"))
