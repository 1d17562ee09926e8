"""Filters, samples, splits and orders of datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.batch import ID, count, with_dense_id


def hash_order(seed: int | str, column: str | Column) -> Column:
    """A pseudo-random number of 60 bits that depends on the seed and the column's text alone, the same in every engine."""
    text = F.concat(F.lit(f"{seed}:"), (F.col(column) if isinstance(column, str) else column).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def portable_draw(seed: int, value: Column, modulus: int = 2147483647) -> Column:
    """A pseudo-random integer below ``modulus`` by integer arithmetic that every SQL engine shares."""
    once = (value % modulus * 48271 + F.lit(seed % modulus)) % modulus
    return (once * 69621 + 11) % modulus


def drop_long(df: DataFrame, length: Column, most: int) -> DataFrame:
    """Rows of at most ``most`` tokens; an unknown length counts as too long."""
    return df.filter(F.coalesce(length, F.lit(most + 1)) <= most)


def labelled(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.length(F.coalesce(F.col(label).cast("string"), F.lit(""))) > 0)


def present_fields(fields: Column) -> Column:
    """A map without null and empty values."""
    return F.map_filter(fields, lambda _, v: v.isNotNull() & (v != ""))


def varied_groups(df: DataFrame, metric: str, by: str = "uid") -> DataFrame:
    """Groups whose metric varies (this library's reading of the group filter that the configuration names)."""
    from tidemill.operators.estimators import with_group

    return with_group(df, by=by, _low=F.min(metric), _high=F.max(metric)).filter("_low <> _high").drop("_low", "_high")


def head(df: DataFrame, n: int) -> DataFrame:
    """The first rows by position."""
    return df.filter(F.col(ID) < n)


def sample(df: DataFrame, n: int, seed: int, by: str = ID) -> DataFrame:
    """``n`` rows without replacement: the smallest hashes."""
    return df.orderBy(hash_order(seed, by), by).limit(n)


def oldest_groups(df: DataFrame, n: int, *, by: str = "uid", age: str = "global_steps") -> DataFrame:
    """All rows of the ``n`` oldest groups (smallest ``age``, then smallest key)."""
    oldest = df.groupBy(by).agg(F.min(age).alias("_age")).orderBy("_age", by).limit(n).select(by)
    return df.join(oldest, by, "left_semi")


def epoch_order(df: DataFrame, *, seed: int | None, epoch: int = 0, out: str = "place") -> DataFrame:
    """``out``: the position in the epoch, sequential or shuffled by a hash of seed and epoch."""
    if seed is None:
        return df.withColumn(out, F.col(ID))
    return with_dense_id(df, [hash_order(f"{seed}:{epoch}", ID), ID], out)


def equal_split(df: DataFrame, parts: int) -> DataFrame:
    """``part``: contiguous parts of equal size; the remainder is dropped."""
    n = df.agg(F.count("*")).first()[0]
    size = n // parts
    return df.filter(F.col(ID) < size * parts).withColumn("part", F.expr(f"CAST({ID} div {max(size, 1)} AS INT)"))


def train_test(df: DataFrame, share: float, seed: int, key: Column) -> DataFrame:
    """``is_test`` for about ``share`` of the rows, by a portable draw on a key; the same key always falls alike."""
    return df.withColumn("is_test", portable_draw(seed, key) < int(share * 2147483647))


def positional_slice(df: DataFrame, start: float = 0.0, stop: float = 1.0) -> DataFrame:
    """Rows between two shares of the positions, rounded to whole rows."""
    n = count(df)
    return df.filter((F.col(ID) >= F.round(n * F.lit(start))) & (F.col(ID) < F.round(n * F.lit(stop))))


def top_two(df: DataFrame, score: str, by: str = "uid", tie: str = ID) -> DataFrame:
    """Each group's two best rows, ``rank`` 1 and 2."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter("rank <= 2")


def first_appearance_rank(df: DataFrame, key: str, order: Sequence[str], out: str = "rank") -> DataFrame:
    """1, 2, ... for keys by where they first appear; all rows of a key share its rank."""
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    ranked = with_dense_id(first, ["_first", key], "_at").select(F.col(key).alias("_key"), (F.col("_at") + 1).alias(out))
    return df.join(ranked, df[key].eqNullSafe(ranked["_key"])).drop("_key")


def evenly(lengths: Column, parts: int) -> Column:
    """The ceiling of a division."""
    return F.ceil(lengths / parts)
