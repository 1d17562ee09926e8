"""Shared helpers: the cluster's shared folder, spooled tables, joins with hot keys, and file access from executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.storage import drop_stored as drop_spool
from tidemill.sources.storage import drop_stored_since as drop_spooled_since
from tidemill.sources.storage import shared_dir, work_path
from tidemill.sources.storage import stored as spool
from tidemill.sources.storage import stored_tables as spooled

__all__ = ["drop_spool", "drop_spooled_since", "shared_dir", "spool", "spooled", "work_path"]

#: Below this character, letters are Latin and every Unicode version agrees on them.
LATIN_END = "\u0250"
#: A key with more than this part of all rows is hot, so there are fewer hot keys than ``HOT_PART``, whatever the data.
HOT_PART = 1024
#: Nor is a key hot with fewer rows than this, which are no task's burden; so small tables have none.
HOT_ROWS = 1000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores before them until none is a column of ``df`` (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def join_unique(rows: DataFrame, one: DataFrame, keys: list[str], *, weight: str, total: int, outer: bool = False, merge: bool = False) -> DataFrame:
    """``rows`` with the columns of ``one``, which has a row for each key; without rows that find none, unless ``outer``.

    ``one`` says in ``weight`` how many rows have the key, of ``total`` (``weight`` isn't in the result). Keys with more
    than a ``HOT_PART``-th of them and ``HOT_ROWS``, fewer than ``HOT_PART`` by their definition, are broadcast and their rows stay where
    they are; the others are shuffled, none of which fills a task (with ``merge`` also where Spark would broadcast a small ``one``,
    so that plans are alike at every size). Rows with a null in the keys find nothing and aren't
    shuffled either. ``rows`` is read once for each of these parts, so it should be a table. Where no key is hot,
    which is tested at once, there is one part.
    """
    is_hot = F.col(weight) > hot_from(total)
    extra = [c for c in one.columns if c not in keys and c != weight]
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    cold, others, with_hot = rows.filter(whole), one.select(*keys, *extra), None
    if has_hot(one, weight, total):
        hot = F.broadcast(one.filter(is_hot).select(*keys, *extra))  # fewer than HOT_PART rows
        with_hot = cold.join(hot, keys)
        cold = cold.join(F.broadcast(one.filter(is_hot).select(*keys)), keys, "left_anti")  # fewer than HOT_PART rows
        others = one.filter(~is_hot).select(*keys, *extra)
    found = cold.join(others.hint("merge") if merge else others, keys, "left" if outer else "inner")
    found = found if with_hot is None else with_hot.unionByName(found)
    if outer:
        found = found.unionByName(rows.filter(~whole).select("*", *[F.lit(None).cast(one.schema[c].dataType).alias(c) for c in extra]))
    return found.select(*rows.columns, *extra)


def hot_from(total: int) -> int:
    """A key with more rows than this, of ``total``, is hot."""
    return max(total // HOT_PART, HOT_ROWS)


def has_hot(one: DataFrame, weight: str, total: int) -> bool:
    """Whether a key of ``one`` is hot. Without hot keys plans need no broadcasts and fewer stages, each of which costs the driver memory."""
    return (one.agg(F.max(weight)).first()[0] or 0) > hot_from(total)


def keep_keys(rows: DataFrame, keys: DataFrame, key: str, *, weight: str, total: int, having: bool) -> DataFrame:
    """``rows`` whose non-null key is, or (``having`` false) isn't, in ``keys``; hot keys as in ``join_unique``."""
    is_hot = F.col(weight) > hot_from(total)
    if not has_hot(keys, weight, total):
        return rows.join(keys.select(key), key, "left_semi" if having else "left_anti")
    hot, cold = F.broadcast(keys.filter(is_hot).select(key)), keys.filter(~is_hot).select(key)  # fewer than HOT_PART rows
    others = rows.join(hot, key, "left_anti")
    if not having:
        return others.join(cold, key, "left_anti")
    return rows.join(hot, key, "left_semi").unionByName(others.join(cold, key, "left_semi"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it; works on the driver and on executors."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def prefix_sums(counts: DataFrame, group: list[str], order: str, value: str, out: str) -> DataFrame:
    """Exclusive running sums of ``value`` by ``order`` within ``group``, over a table of counts (a row per chunk)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the consecutive rows that share ``keys``, from batches already sorted by them.

    Only one run is held at a time, so callers bound memory by bounding the size of a run.
    """
    import numpy as np

    held: list[pa.RecordBatch] = []
    held_key: tuple | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        for c in columns:
            same = np.asarray(pc.equal(c.slice(1), c.slice(0, batch.num_rows - 1)).fill_null(False)) if batch.num_rows > 1 else np.zeros(0, bool)
            change[1:] |= ~same.astype(bool)
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(c[a].as_py() for c in columns)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Kept:
    """A store of at most twice ``half`` entries in two generations: what was used lately stays, the rest goes."""

    def __init__(self, half: int):
        self.half = half
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = value


def on_all_cores(df: DataFrame) -> DataFrame:
    """``df``, its rows dealt over the cluster's cores where its scan has fewer splits than that; else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sql_type(df: DataFrame, column: str) -> str:
    """The type of a column, for a schema."""
    return df.schema[column].dataType.simpleString()


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for the 256 bytes in a byte-level vocabulary: printable ones for themselves, then from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
