"""A versioned replay buffer: prompts by status, late data by version, batches of the oldest prompts.

Tags are rows (uid, key, is_prompt, status, global_steps, version); trajectories are rows of their own by uid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE, DONE = ("pending", "running"), ("finished", "failure")


def latest(tags: DataFrame) -> DataFrame:
    """The newest tag of each prompt."""
    return tags.filter("is_prompt").groupBy("uid").agg(F.max_by("status", F.struct("version", "status")).alias("status"), F.max_by("global_steps", F.struct("version", "status")).alias("global_steps"))


def by_status(tags: DataFrame) -> DataFrame:
    return latest(tags).groupBy("status").agg(F.count("*").alias("n"))


def staleness(steps: Column, now: int, sync: int = 1) -> Column:
    """How many versions old a prompt is, the current one included."""
    return (F.lit(now) - steps + 1) / sync


def drop_stale(prompts: DataFrame, *, now: int, threshold: float, sync: int = 1) -> tuple[DataFrame, DataFrame]:
    """(kept, one row of dropped and kept counts): finished prompts staler than the threshold (strictly) go."""
    stale = F.col("status").isin(*DONE) & (staleness(F.col("global_steps"), now, sync) > threshold)
    return prompts.filter(~stale), prompts.agg(F.count_if(stale).alias("dropped"), F.count_if(~stale).alias("kept"))


def ready(prompts: DataFrame, *, batch: int, now: int, threshold: float | None = None, sync: int = 1) -> DataFrame:
    """One row (ready, done, waiting_for): enough prompts are done and, with a threshold, none in flight is as stale as it."""
    in_flight = F.col("status").isin(*ACTIVE)
    blocking = F.count_if(in_flight & (staleness(F.col("global_steps"), now, sync) >= threshold)) if threshold is not None else F.lit(0)
    done = F.count_if(F.col("status").isin(*DONE))
    return prompts.agg(((done >= batch) & (blocking == 0)).alias("ready"), done.alias("done"), blocking.cast("long").alias("waiting_for"))


def sample(prompts: DataFrame, trajectories: DataFrame, *, batch: int) -> DataFrame:
    """All trajectories of the ``batch`` oldest finished prompts."""
    oldest = prompts.filter("status = 'finished'").orderBy("global_steps", "uid").limit(batch).select("uid")
    return trajectories.join(oldest, "uid", "left_semi")


def version_span(trajectories: DataFrame) -> DataFrame:
    """(uid, first, last) versions that a prompt's trajectories were made under."""
    return trajectories.groupBy("uid").agg(F.min("min_global_steps").alias("first"), F.max("max_global_steps").alias("last"))
