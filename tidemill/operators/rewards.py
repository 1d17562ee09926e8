"""Reward managers: scores placed on trajectories' last tokens, with the extras that scorers return."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.functions.registry import Registry, load_object
from tidemill.functions.text import score_memory

MANAGERS: Registry[Callable[..., DataFrame]] = Registry("reward manager", allow_same=True)


def place(df: DataFrame, score: Column, *, length: str = "response_length", out: str = "rewards") -> DataFrame:
    """The score on the last response token; a row without tokens has an empty array."""
    return df.withColumn("reward_score", score.cast("double")).withColumn(out, A.place_reward(F.col("reward_score"), F.col(length).cast("int")))


@MANAGERS.register("naive", "batch", "prime", "remote")
def naive(df: DataFrame, score: Column, *, given: str = "rm_scores", length: str = "response_length") -> DataFrame:
    """Scores by a column expression; token scores that are there already (``rm_scores``) are used as they are.

    Spark's tasks are the workers here, so scoring in batches, in pools and on other machines is this operator, too;
    scorers of one's own are held to 0 on failure by ``custom_scorer``.
    """
    scored = place(df, F.coalesce(score.cast("double"), F.lit(0.0)), length=length)
    return scored.withColumn("rewards", F.coalesce(F.col(given), F.col("rewards"))) if given in df.columns else scored


@MANAGERS.register("dapo")
def dapo(df: DataFrame, score: Column, *, longest: int, buffer: int = 0, factor: float = 1.0, length: str = "response_length") -> DataFrame:
    """The score and, within the last ``buffer`` tokens before ``longest``, a penalty that grows with the length."""
    extra = F.lit(0.0)
    if buffer:
        over = F.col(length) - (longest - buffer)
        extra = F.least(-over / F.lit(float(buffer)) * factor, F.lit(0.0))
    return place(df.withColumn("overlong", extra), score + extra, length=length)


@MANAGERS.register("gdpo")
def gdpo(df: DataFrame, components: dict[str, Column], *, length: str = "response_length") -> DataFrame:
    """Each component as a column, their sum as the score."""
    total = sum(components.values(), F.lit(0.0))
    return place(df.withColumns(components), total, length=length)


@MANAGERS.register("opd_mm")
def memory(df: DataFrame, *, length: str = "response_length") -> DataFrame:
    return place(df, score_memory(F.col("correct"), F.col("recall"), F.col("evidence"), F.col("answer"), F.col("gold")), length=length)


def passthrough(df: DataFrame, extras: tuple[str, ...] = (), given: str = "rm_scores") -> DataFrame:
    """Existing token scores and the listed extras."""
    return df.select("row_id", F.col(given).alias("rewards"), *extras)


class TokenBucket:
    """Tokens that come at a rate up to a capacity. ``reserve`` takes some, now or ahead of time, and says how long to wait."""

    def __init__(self, rate: float, capacity: float | None = None, now: Callable[[], float] = time.monotonic):
        self.rate, self.capacity, self.now = rate, capacity or rate, now
        self.level, self.at = self.capacity, now()

    def reserve(self, tokens: float = 1.0) -> float:
        now = self.now()
        self.level = min(self.capacity, self.level + (now - self.at) * self.rate)
        self.at = now
        self.level -= tokens
        return max(0.0, -self.level / self.rate)


class _Call(threading.Thread):
    """A call of the scorer on a row, in a thread of its own that nothing waits for once it is overdue."""

    def __init__(self, fn: Callable[[dict], float], place: int, row: dict):
        super().__init__(daemon=True)
        self.fn, self.place, self.row = fn, place, row
        self.began, self.score, self.error = time.monotonic(), 0.0, None

    def run(self) -> None:
        try:
            self.score = float(self.fn(self.row))
        except Exception as e:  # noqa: BLE001  any failure of the service is a score of 0
            self.error = type(e).__name__

    def outcome(self, timeout: float | None) -> tuple[float, str | None] | None:
        """Score and error once it has ended or is overdue, else None."""
        if not self.is_alive():
            return self.score, self.error
        return (0.0, "timeout") if timeout is not None and time.monotonic() - self.began > timeout else None


def rate_limited(
    df: DataFrame, fn: Callable[[dict], float], *, per_second: float | None = None, requests_per_minute: float | None = None, tokens_per_minute: float | None = None, tokens: Callable[[dict], float] | float = 2000.0,
    max_concurrent: int = 1, workers: int = 1, timeout: float | None = None,
) -> DataFrame:
    """Scores by calls that an outer service limits, in three layers: requests a minute (or second), tokens a minute (``tokens``
    a request, or a function of the row), and calls at once.

    Rows are dealt over ``workers`` tasks, each with its share of every limit, of calls at once at least one. A call that fails
    scores 0 and names the reason in ``error``; one that takes longer than ``timeout`` is left behind, its row scores 0.
    """
    requests = per_second if requests_per_minute is None else requests_per_minute / 60
    limits = [(rate / workers, cost) for rate, cost in ((requests, 1.0), (None if tokens_per_minute is None else tokens_per_minute / 60, tokens)) if rate is not None]
    at_once = max(1, max_concurrent // workers)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = [(TokenBucket(rate), cost) for rate, cost in limits]
        for pdf in frames:
            outcomes: dict[int, tuple[float, str | None]] = {}
            active: list[_Call] = []

            def settle(most: int, outcomes=outcomes, active=active) -> None:
                """Wait until no more than ``most`` calls go on."""
                while True:
                    for call in list(active):
                        found = call.outcome(timeout)
                        if found is not None:
                            outcomes[call.place] = found
                            active.remove(call)
                    if len(active) <= most:
                        return
                    active[0].join(0.001)

            for place, row in enumerate(pdf.to_dict("records")):
                time.sleep(max([0.0, *(bucket.reserve(cost(row) if callable(cost) else cost) for bucket, cost in buckets)]))
                settle(at_once - 1)
                active.append(_Call(fn, place, row))
                active[-1].start()
            settle(0)
            yield pdf.assign(reward_score=[outcomes[k][0] for k in range(len(pdf))], error=[outcomes[k][1] for k in range(len(pdf))])

    schema = ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + ", reward_score double, error string"
    return df.repartition(workers).mapInPandas(run, schema)


def reward_manager(name: str, *, source: str = "register", path: str | None = None) -> Callable[..., DataFrame]:
    """A reward manager by its registered name or, with source "importlib", of that name in a module or file at ``path``."""
    if source == "register":
        return MANAGERS[name]
    if source != "importlib":
        raise ValueError(f"unknown source of reward managers {source!r}")
    if path is None:
        raise ValueError("a reward manager from a module needs the module's path")
    return load_object(path, name)


def assemble(df: DataFrame, *, score: str = "score", length: str = "response_length") -> DataFrame:
    """Token scores for a batch only if every row has a score; otherwise a null column."""
    whole = df.agg(F.bool_and(F.col(score).isNotNull())).scalar()
    placed = A.place_reward(F.col(score).cast("double"), F.col(length).cast("int"))
    return df.withColumn("_whole", whole).withColumn("rm_scores", F.when(F.col("_whole"), placed)).drop("_whole")
