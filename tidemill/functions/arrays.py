"""Column functions over token arrays: masked sums and means, padding, masks, norms.

A trajectory's token columns are arrays of its true length; ``mask`` arrays hold 0 and 1 (interior zeros count).
Everything here is a built-in expression, linear in the array's length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8
#: Log-ratios are held within this bound before they are exponentiated.
LOG_BOUND = 20.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def array_sum(values: str | Column) -> Column:
    """Sum of an array of doubles, 0.0 if it is empty."""
    return F.aggregate(col(values), F.lit(0.0), lambda a, x: a + x)


def token_map(fn: Callable[..., Column], *names: str) -> Column:
    """An array of ``fn`` of the tokens' values in the named array columns."""
    return F.transform(F.arrays_zip(*[F.col(n) for n in names]), lambda t: fn(*[t[n] for n in names]))


def masked_sum(values: str | Column, mask: str | Column) -> Column:
    """Sum of value times mask; values where the mask is 0 don't count, even NaN."""
    return array_sum(F.zip_with(col(values), col(mask), lambda v, m: F.when(m != 0, v * m).otherwise(F.lit(0.0))))


def mask_count(mask: str | Column) -> Column:
    return F.aggregate(col(mask), F.lit(0.0), lambda a, m: a + m)


def masked_mean(values: str | Column, mask: str | Column) -> Column:
    """``masked_sum`` over the mask's sum plus 1e-8; the epsilon is part of the result."""
    return masked_sum(values, mask) / (mask_count(mask) + EPS)


def masked_max(values: str | Column, mask: str | Column) -> Column:
    """Largest unmasked value, 0.0 where nothing is unmasked."""
    kept = F.filter(F.zip_with(col(values), col(mask), lambda v, m: F.when(m != 0, v)), lambda x: x.isNotNull())
    return F.coalesce(F.array_max(kept), F.lit(0.0))


def clip(x: Column, low: Column | float | None, high: Column | float | None) -> Column:
    """``x`` held within bounds; bounds may be columns."""
    lit = lambda b: b if isinstance(b, Column) else F.lit(float(b))
    if high is not None:
        x = F.least(x, lit(high))
    return F.greatest(x, lit(low)) if low is not None else x


def scaled_mask(scalar: Column, mask: str | Column) -> Column:
    """A scalar spread over a mask."""
    return F.transform(col(mask), lambda m: scalar * m)


def eos_mask(ids: str | Column, eos: int) -> Column:
    """1 up to and including the first end token, 0 after it."""
    at = F.array_position(col(ids), eos)
    return F.transform(col(ids), lambda x, k: F.when((at == 0) | (k < at), 1).otherwise(0))


def tail(values: str | Column, n: Column | int) -> Column:
    """The last ``n`` entries."""
    n = n if isinstance(n, Column) else F.lit(n)
    size = F.size(col(values))
    return F.slice(col(values), size - F.least(size, n) + 1, F.least(size, n))


def pad(values: str | Column, length: int, fill: Column, left: bool = False) -> Column:
    """Padded to at least ``length``; longer arrays stay as they are."""
    more = F.array_repeat(fill, F.greatest(F.lit(length) - F.size(col(values)), F.lit(0)))
    return F.concat(more, col(values)) if left else F.concat(col(values), more)


def fit_length(values: str | Column, length: int, fill: Column, truncation: str = "error", left_pad: bool = True) -> Column:
    """Exactly ``length`` entries: padded, or cut on the ``left``, on the ``right``, in the ``middle``, or an ``error``."""
    v, size = col(values), F.size(col(values))
    head = length // 2
    cut = {
        "left": F.slice(v, size - length + 1, length),
        "right": F.slice(v, 1, length),
        "middle": F.concat(F.slice(v, 1, head), F.slice(v, size - (length - head) + 1, length - head)),
    }
    if truncation == "error":
        too_long = F.raise_error(F.concat(F.lit(f"a sequence is longer than {length}: "), size.cast("string")))
        return F.when(size <= length, pad(v, length, fill, left_pad)).otherwise(too_long)
    if truncation not in cut:
        raise ValueError(f"unknown truncation {truncation!r}")
    return F.when(size > length, cut[truncation]).otherwise(pad(v, length, fill, left_pad))


def strip_padding(ids: str | Column, mask: str | Column) -> Column:
    """The last ``sum(mask)`` ids."""
    return tail(ids, mask_count(mask).cast("int"))


def lengths_to_mask(length: Column, width: int) -> Column:
    """Right-padded mask: ones for ``length`` places of ``width``."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.when(k < length, 1).otherwise(0))


def l2_normalize(values: str | Column, floor: float | None = None) -> Column:
    """Divided by the Euclidean norm; zero vectors stay, or the norm is held above ``floor``."""
    norm = F.sqrt(array_sum(F.transform(col(values), lambda x: x * x)))
    norm = F.greatest(norm, F.lit(floor)) if floor is not None else F.when(norm == 0, 1.0).otherwise(norm)
    return F.transform(col(values), lambda x: x / norm)


def dot(a: str | Column, b: str | Column) -> Column:
    return array_sum(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def log_sum_exp(values: str | Column) -> Column:
    top = F.array_max(col(values))
    return top + F.log(array_sum(F.transform(col(values), lambda x: F.exp(x - top))))


def entropy(logits: str | Column) -> Column:
    """logsumexp minus the mean logit under the softmax."""
    lse = log_sum_exp(logits)
    return lse - array_sum(F.transform(col(logits), lambda x: F.exp(x - lse) * x))


def label_log_prob(logits: str | Column, label: Column) -> Column:
    """Log-softmax at a 0-based label."""
    return F.element_at(col(logits), label + 1) - log_sum_exp(logits)


def sum_squared_probs(logits: str | Column) -> Column:
    """Sum of squared softmax probabilities."""
    return F.exp(log_sum_exp(F.transform(col(logits), lambda x: 2.0 * x)) - 2.0 * log_sum_exp(logits))


def temperature(logits: str | Column, t: float) -> Column:
    return F.transform(col(logits), lambda x: x / t)


def place_reward(reward: Column, length: Column) -> Column:
    """The reward on the last of ``length`` tokens, zeros before it; no token, no place."""
    every = F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(every, lambda k: F.when(k == length - 1, reward).otherwise(F.lit(0.0)))


def multiset_jaccard(a: str | Column, b: str | Column) -> Column:
    """Shared items over all items, with multiplicities; equal lists give 1, one empty list 0."""
    a, b = col(a), col(b)
    times = lambda xs, k: F.size(F.filter(xs, lambda x: x == k))
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, k: n + F.least(times(a, k), times(b, k)))
    return F.when(F.array_sort(a) == F.array_sort(b), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def first_seen(values: str | Column, most: int | None = None) -> Column:
    """Distinct values in order of first appearance, at most ``most``."""
    out = F.array_distinct(col(values))
    return F.slice(out, 1, most) if most is not None else out
