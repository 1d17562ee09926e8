"""Row and column algebra of batches: selection, gathering, repetition, chunks, padding, zip-joins and unions.

A batch is a DataFrame with a dense ``row_id`` (0, 1, ...) that stands for position. Operators that reorder give new
dense ids. Ids are made from a total order that the caller names, never from partition layout, and in two levels
(counts per range, then places within) so that no task sees the whole batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.names import fresh
from tidemill.sources.storage import stored

ID = "row_id"
#: Fixed value: the bits that ``monotonically_increasing_id`` has for a row within its partition.
PLACE_BITS = 33


def _scanned_bytes(df: DataFrame) -> int:
    """How many bytes the tables that a plan reads have; sources that don't say count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 50)


def with_dense_id(df: DataFrame, order: Sequence[str | Column], out: str = ID, *, range_bytes: int = 64 << 20) -> DataFrame:
    """``out`` = 0, 1, ... by a total order: rows are ranged and sorted in one shuffle and stored with their place in their
    range; a range's first id is a prefix sum of counts. There is a range for every ``range_bytes`` that the plan reads, and as
    many as shuffles have parts at least.

    The rows are stored, as the bounds of the ranges come from a sample and must be the same for counts and places. This writes
    a table when it is called.
    """
    sort = [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order]
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), _scanned_bytes(df) // range_bytes)
    at, part, n, base = fresh(df, "dense_at", "dense_part", "dense_count", "dense_base")
    # The id of a row in its partition: the partition's number above PLACE_BITS, the place below.
    ranged = stored(df.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumn(at, F.monotonically_increasing_id()), "ranged")
    counts = ranged.groupBy(F.shiftright(at, PLACE_BITS).alias(part)).agg(F.count("*").alias(n))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    placed = ranged.withColumn(part, F.shiftright(at, PLACE_BITS)).join(F.broadcast(bases), part)  # broadcast: a row for each partition
    return placed.withColumn(out, F.col(base) + F.col(at) % (1 << PLACE_BITS)).drop(part, at, base)


def count(df: DataFrame) -> Column:
    return df.agg(F.count("*").alias("n")).scalar()


def select(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A subset of columns, the id always; None is all."""
    return df if columns is None else df.select(ID, *[c for c in columns if c != ID])


def pop(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(the columns, the rest); a column that isn't there raises."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"no columns {missing}")
    return df.select(ID, *[c for c in columns if c != ID]), df.drop(*[c for c in columns if c != ID])


def rename(df: DataFrame, old: str | Sequence[str], new: str | Sequence[str]) -> DataFrame:
    old, new = [[x] if isinstance(x, str) else list(x) for x in (old, new)]
    if len(old) != len(new):
        raise ValueError(f"{len(old)} names for {len(new)}")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def prefix_columns(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c != ID})


def gather(df: DataFrame, places: DataFrame, *, place: str = "place", order: str = "ord") -> DataFrame:
    """Rows by a table of (ord, place): repeats allowed, new ids by ``ord``. Negative places count from the end."""
    wanted = places.select(F.col(order).alias("_ord"), F.when(F.col(place) < 0, F.col(place) + count(df)).otherwise(F.col(place)).alias(ID))
    return wanted.join(df, ID).drop(ID).withColumnRenamed("_ord", ID)


def gather_list(df: DataFrame, places: Sequence[int]) -> DataFrame:
    """``gather`` by a short list of places."""
    if not places:
        return df.limit(0)
    spark = df.sparkSession
    return gather(df, spark.createDataFrame(list(enumerate(places)), "ord long, place long"))


def mask_rows(df: DataFrame, keep: Column) -> DataFrame:
    """Rows where the mask holds, with new dense ids."""
    return with_dense_id(df.filter(keep), [ID], "_new").drop(ID).withColumnRenamed("_new", ID)


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, step: int | None = None) -> DataFrame:
    """A Python slice by position, negatives included; ids are counted anew."""
    n = df.agg(F.count("*")).first()[0]
    at = range(*slice(start, stop, step).indices(n))
    if not len(at):
        return df.limit(0)
    low, high = (at[0], at[-1]) if at.step > 0 else (at[-1], at[0])
    inside = df.filter(F.col(ID).between(low, high) & ((F.col(ID) - at.start) % abs(at.step) == 0))
    return inside.withColumn(ID, ((F.col(ID) - at.start) / at.step).cast("long"))


def item(df: DataFrame, at: int | slice | Sequence[int]) -> DataFrame:
    """``df[at]``: one row, a slice or a list of places."""
    if isinstance(at, int):
        return gather_list(df, [at])
    return slice_rows(df, at.start, at.stop, at.step) if isinstance(at, slice) else gather_list(df, list(at))


def reorder(df: DataFrame, permutation: DataFrame) -> DataFrame:
    """Rows by a permutation table (ord, place)."""
    return gather(df, permutation)


def inverse(permutation: DataFrame) -> DataFrame:
    """The permutation that undoes one."""
    return permutation.select(F.col("place").alias("ord"), F.col("ord").alias("place"))


def repeat(df: DataFrame, times: int, *, interleave: bool = True) -> DataFrame:
    """Every row ``times`` times: r0 r0 r1 r1, or, without ``interleave``, r0 r1 r0 r1."""
    made = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else df.limit(0).withColumn("_k", F.lit(0))
    new = F.col(ID) * times + F.col("_k") if interleave else F.col("_k") * count(df) + F.col(ID)
    return made.withColumn(ID, new).drop("_k")


def repeat_each(df: DataFrame, times: str) -> DataFrame:
    """Every row as often as its column says; 0 removes it. Ids are counted anew, copies together."""
    made = df.filter(F.col(times) > 0).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
    return with_dense_id(made, [ID, "_k"], "_new").drop(ID, "_k").withColumnRenamed("_new", ID)


def unfold(df: DataFrame, parts: int, columns: Sequence[str]) -> DataFrame:
    """Array columns cut into ``parts`` equal pieces, a row a piece; other columns repeat."""
    made = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    cut = {c: F.slice(c, F.col("_k") * (F.size(c) / parts).cast("int") + 1, F.greatest((F.size(c) / parts).cast("int"), F.lit(0))) for c in columns}
    return made.withColumns(cut).withColumn(ID, F.col(ID) * parts + F.col("_k")).drop("_k")


def fold(df: DataFrame, k: int, columns: Sequence[str]) -> DataFrame:
    """Every ``k`` consecutive rows become one with arrays of their values; the count must be divisible."""
    checked = F.when(count(df) % k != 0, F.raise_error(F.lit(f"the batch is not divisible by {k}")).cast("long")).otherwise(F.expr(f"{ID} div {k}"))
    grouped = df.withColumn("_new", checked).groupBy("_new").agg(F.array_sort(F.collect_list(F.struct(ID, *columns))).alias("_r"))
    return grouped.select(F.col("_new").alias(ID), *[F.col(f"_r.{c}").alias(c) for c in columns])


def unfold_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Undoes ``fold``."""
    made = df.select(F.col(ID).alias("_row"), F.posexplode(F.arrays_zip(*columns)).alias("_k", "_t"), F.size(columns[0]).alias("_n"))
    return made.select((F.col("_row") * F.col("_n") + F.col("_k")).alias(ID), *[F.col(f"_t.{c}").alias(c) for c in columns])


def chunk(df: DataFrame, parts: int, *, padded: bool = False) -> DataFrame:
    """Adds ``chunk``: equal contiguous parts. A count that isn't divisible raises, or with ``padded`` makes parts of the
    ceiling's size, the last one short."""
    n = df.agg(F.count("*")).first()[0]
    if n % parts and not padded:
        raise ValueError(f"{n} rows can't be cut into {parts} equal parts")
    return df.withColumn("chunk", F.expr(f"CAST({ID} div {max(1, -(-n // parts))} AS INT)"))


def split(df: DataFrame, size: int) -> DataFrame:
    """Adds ``chunk``: parts of ``size`` rows, the last one short."""
    return df.withColumn("chunk", F.expr(f"CAST({ID} div {size} AS INT)"))


def mini_batches(df: DataFrame, size: int, epochs: int = 1, seed: int | None = None) -> DataFrame:
    """Rows of all epochs with ``epoch``, ``batch`` and ``place``; with a seed each epoch is shuffled by a hash."""
    n = df.agg(F.count("*")).first()[0]
    if n % size:
        raise ValueError(f"{n} rows can't be cut into batches of {size}")
    made = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if seed is None:
        made = made.withColumn("_p", F.col(ID) + F.col("epoch") * n)
    else:
        made = with_dense_id(made, ["epoch", F.xxhash64(F.lit(seed), "epoch", ID), ID], "_p")
    return made.withColumns({"batch": F.expr(f"CAST((_p % {n}) div {size} AS INT)"), "place": F.expr(f"CAST(_p % {size} AS INT)")}).drop("_p")


def pad_to_divisor(df: DataFrame, divisor: int) -> tuple[DataFrame, int]:
    """Rows added cyclically from the head until the count is divisible, and how many were."""
    n = df.agg(F.count("*")).first()[0]
    more = -n % divisor
    if not more or not n:
        return df, 0
    copies = df.filter(F.col(ID) < more).withColumn("_r", F.explode(F.expr(f"sequence(0, CAST(({more} - 1 - {ID}) div {n} AS INT))")))
    return df.unionByName(copies.withColumn(ID, F.lit(n) + F.col("_r") * n + F.col(ID)).drop("_r")), more


def unpad(df: DataFrame, more: int) -> DataFrame:
    """Without the last ``more`` rows."""
    return df.filter(F.col(ID) < count(df) - more)


def pad_with(df: DataFrame, size: int, which: str = "first") -> DataFrame:
    """``size`` copies of the first row, or of the last for anything but "first", at the end."""
    n = df.agg(F.count("*")).first()[0]
    one = df.filter(F.col(ID) == (0 if which == "first" else n - 1))
    return df.unionByName(one.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn(ID, F.lit(n) + F.col("_k")).drop("_k")) if size > 0 and n else df


def pad_with_empty(df: DataFrame, multiple: int, *, uid: str = "uid", arrays: dict[str, Column] | None = None) -> DataFrame:
    """No-op rows up to a multiple, each with a fresh uid and ``is_padding``; array columns get the one-token ``arrays``."""
    n = df.agg(F.count("*")).first()[0]
    marked = df.withColumn("is_padding", F.lit(False))
    if not -n % multiple:
        return marked
    fill = df.sparkSession.range(-n % multiple).select((F.col("id") + n).alias(ID), *[(F.concat(F.lit("padding-"), F.col("id")) if c == uid else (arrays or {}).get(c, F.lit(None))).cast(k).alias(c) for c, k in df.dtypes if c != ID], F.lit(True).alias("is_padding"))
    return marked.unionByName(fill)


def without_padding(df: DataFrame) -> DataFrame:
    """Rows that aren't padding; all of them where there is nothing else."""
    others = df.agg(F.count_if(~F.col("is_padding"))).scalar()
    return df.withColumn("_others", others).filter((F.col("_others") == 0) | ~F.col("is_padding")).drop("_others")


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows one batch after the other, ids counted on."""
    out, base = None, F.lit(0)
    for f in frames:
        moved = f.withColumn(ID, F.col(ID) + base)
        out = moved if out is None else out.unionByName(moved)
        base = base + count(f)
    return out


def concat_common(frames: Sequence[DataFrame], optional: Sequence[str]) -> DataFrame:
    """``concat`` without the optional columns that some batch lacks."""
    gone = [c for c in optional if not all(c in f.columns for f in frames)]
    return concat([f.drop(*gone) for f in frames])


def concat_filled(frames: Sequence[DataFrame], lists: Sequence[str] = ()) -> DataFrame:
    """``concat`` where columns that a batch lacks are null there, or empty arrays for ``lists``."""
    out, base = None, F.lit(0)
    for f in frames:
        moved = f.withColumn(ID, F.col(ID) + base)
        out = moved if out is None else out.unionByName(moved, allowMissingColumns=True)
        base = base + count(f)
    kinds = dict(out.dtypes)
    return out.withColumns({c: F.coalesce(F.col(c), F.array().cast(kinds[c])) for c in lists if c in kinds})


def zip_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of two batches of equal ids side by side. A shared column must be equal (NaN equals NaN, null null) and rows
    must match one to one, else the query raises when it runs."""
    shared = [c for c in right.columns if c in left.columns and c != ID]
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in shared}).withColumn("_right", F.lit(True))
    joined = left.withColumn("_left", F.lit(True)).join(renamed, ID, "full")
    conflict = ~(F.col("_left").isNotNull() & F.col("_right").isNotNull())
    for c in shared:
        conflict = conflict | ~F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    checked = F.when(conflict, F.raise_error(F.concat(F.lit("batches don't agree at row "), F.col(ID).cast("string"))).cast("long")).otherwise(F.col(ID))
    return joined.withColumn(ID, checked).drop("_left", "_right", *[f"_r_{c}" for c in shared])


def merge_dicts(a: dict, b: dict) -> dict:
    """Both; a key in both must have equal values."""
    clash = [k for k in a.keys() & b.keys() if a[k] != b[k]]
    if clash:
        raise ValueError(f"values differ for {sorted(map(str, clash))}")
    return {**a, **b}


def merge_maps(a: str | Column, b: str | Column) -> Column:
    """``merge_dicts`` of two map columns; a key in both with unlike values raises when the row is read."""
    a, b = (F.col(m) if isinstance(m, str) else m for m in (a, b))
    unlike = F.exists(F.map_keys(b), lambda k: F.map_contains_key(a, k) & ~a[k].eqNullSafe(b[k]))
    added = F.map_filter(b, lambda k, _: ~F.map_contains_key(a, k))
    return F.when(unlike, F.raise_error(F.lit("values differ"))).otherwise(F.map_concat(a, added))


def to_columns(df: DataFrame, by: str, columns: Sequence[str], order: str = ID) -> DataFrame:
    """Rows to columns: of each group of rows one with the columns' values as arrays, in the rows' order."""
    grouped = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)]))).alias("r"))
    return grouped.select(by, *[F.col(f"r.c{k}").alias(c) for k, c in enumerate(columns)])


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two batches have the same rows as often (NaN equals NaN) and the same columns."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def assert_equal(a: DataFrame, b: DataFrame, shown: int = 5) -> None:
    """Raises, and shows some of the rows that differ, unless two batches are equal in schema and rows (NaN equals NaN)."""
    if describe(a) != describe(b):
        raise AssertionError(f"schemas differ: {describe(a)} and {describe(b)}")
    b = b.select(*a.columns)
    only = {side: x.exceptAll(y).limit(shown).collect() for side, x, y in (("left", a, b), ("right", b, a))}
    if any(only.values()):
        raise AssertionError(f"rows differ: {only}")


def collate_stacked(df: DataFrame, columns: Sequence[str], *, batch: str, order: str = ID) -> DataFrame:
    """A row for each batch: every column's values in order. Arrays of different lengths in a batch raise when the query runs."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), *columns)))
    out = df.groupBy(batch).agg(rows.alias("_rows")).select(batch, *[F.col(f"_rows.{c}").alias(c) for c in columns])
    kinds = dict(df.dtypes)
    same = lambda c: F.size(F.array_distinct(F.transform(c, lambda x: F.size(x)))) <= 1
    checked = lambda c: F.when(same(c), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} has arrays of different lengths")))
    return out.withColumns({c: checked(c) for c in columns if kinds[c].startswith("array")})


def collate_padded(df: DataFrame, fills: dict[str, Column], *, batch: str, left: bool = False, multiple: int = 1) -> DataFrame:
    """Arrays padded to the longest of their batch, rounded up to a multiple, on the right or left."""
    longest = df.groupBy(batch).agg(*[F.max(F.size(c)).alias(f"_{c}") for c in fills])

    def padded(c: str) -> Column:
        to = F.ceil(F.col(f"_{c}") / multiple) * multiple
        pad = F.array_repeat(fills[c], (to - F.size(c)).cast("int"))
        return F.concat(pad, F.col(c)) if left else F.concat(F.col(c), pad)

    kinds = dict(df.dtypes)
    return df.join(longest, batch).withColumns({c: padded(c).cast(kinds[c]) for c in fills}).drop(*[f"_{c}" for c in fills])


def collate_jagged(df: DataFrame, columns: Sequence[str], *, batch: str, order: str = ID) -> DataFrame:
    """A row for each batch: every array column's values end to end, and ``<column>_offsets`` with one more entry than rows."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), *columns)))
    out = df.groupBy(batch).agg(rows.alias("_rows"))
    lengths = lambda c: F.transform(f"_rows.{c}", lambda x: F.size(x))
    upto = lambda c: F.transform(F.sequence(F.lit(0), F.size("_rows")), lambda k: F.aggregate(F.slice(lengths(c), 1, k), F.lit(0), lambda a, x: a + x))
    return out.select(batch, *[x for c in columns for x in (F.flatten(f"_rows.{c}").alias(c), upto(c).alias(f"{c}_offsets"))])


def describe(df: DataFrame) -> dict[str, str]:
    """Column names and types, nested ones included."""
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def size_report(df: DataFrame) -> DataFrame:
    """(column, bytes): how large the columns are as text, strings by their UTF-8 bytes."""
    sums = df.agg(*[F.coalesce(F.sum(F.octet_length(F.col(c) if k == "string" else F.to_json(F.struct(c)))), F.lit(0)).alias(c) for c, k in df.dtypes])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("bytes")) for c in sums.columns])))


def consistent(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """The ids of rows whose arrays differ in length."""
    first = F.size(arrays[0])
    return df.filter(F.array_contains(F.array(*[F.size(c) != first for c in arrays]), True)).select(ID)


def to_ragged(padded: str | Column, mask: str | Column) -> Column:
    """The entries of a padded array where the mask is 1."""
    from tidemill.functions.arrays import col

    return F.transform(F.filter(F.arrays_zip(col(padded).alias("v"), col(mask).alias("m")), lambda t: t["m"] != 0), lambda t: t["v"])


def to_padded(ragged: Column, width: int, fill: Column, left: bool = False) -> Column:
    from tidemill.functions.arrays import pad

    return pad(ragged, width, fill, left)


def response_of(values: Column, prompt: Column, response: Column, *, shifted: bool = True) -> Column:
    """The response's part of an array over prompt and response; model outputs are shifted left by one."""
    return F.slice(values, prompt + (0 if shifted else 1), response)


def stack_columns(df: DataFrame, columns: Sequence[str], out: str, kind: str = "source") -> DataFrame:
    """One row becomes one for each of the columns, in their order: (kind, out)."""
    pairs = F.array(*[F.struct(F.lit(c).alias(kind), F.col(c).alias(out)) for c in columns])
    return df.select(*[c for c in df.columns if c not in columns], F.posexplode(pairs).alias("_k", "_p")).select("*", f"_p.{kind}", f"_p.{out}").drop("_p").withColumnRenamed("_k", "part")


def flatten_structs(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested struct fields as columns with joined names."""
    from pyspark.sql.types import StructType

    def walk(schema: StructType, path: list[str]) -> list[Column]:
        out = []
        for f in schema.fields:
            here = [*path, f.name]
            out += walk(f.dataType, here) if isinstance(f.dataType, StructType) else [F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here))]
        return out

    return df.select(*walk(df.schema, []))
