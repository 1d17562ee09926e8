"""Exact percentiles of a whole table, by refining histograms.

Doubles are mapped to longs of the same order. A first histogram counts the longs by their leading 16 bits and tells in
which bucket a rank lies; each further one counts only the buckets that a rank lies in, by 16 bits more, until the value is
told. A pass is one scan with map-side counts; no task holds more than the histogram of a pass, at most 65,536 rows a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 16
#: Fixed values of doubles: bits of the fraction, the least exponent of normal numbers and the bias of exponents.
FRACTION_BITS, LEAST_EXPONENT, BIAS = 52, -1022, 1023


def order_key(x: Column) -> Column:
    """A long for a double, greater for greater ones: its sign, exponent and fraction; zeros are one, NaN is the greatest."""
    a = F.abs(x)
    near = F.greatest(F.floor(F.log2(a)).cast("int"), F.lit(LEAST_EXPONENT))
    # The logarithm may be off by one at powers of two.
    e = F.when(F.pow(F.lit(2.0), near) > a, near - 1).when(F.pow(F.lit(2.0), near + 1) <= a, near + 1).otherwise(near)
    e = F.greatest(F.least(e, F.lit(BIAS)), F.lit(LEAST_EXPONENT))
    scaled = a / F.pow(F.lit(2.0), e)  # exact
    normal = a >= F.lit(2.0**LEAST_EXPONENT)
    field = F.when(normal, e + BIAS).otherwise(0).cast("long")
    fraction = ((scaled - F.when(normal, 1.0).otherwise(0.0)) * F.lit(float(1 << FRACTION_BITS))).cast("long")
    size = F.when(a == float("inf"), F.lit((2 * BIAS + 1) << FRACTION_BITS)).otherwise(F.shiftleft(field, FRACTION_BITS) + fraction)
    return F.when(F.isnan(x), F.lit(((2 * BIAS + 1) << FRACTION_BITS) + 1)).when(a == 0, F.lit(0).cast("long")).when(x < 0, -size).otherwise(size)


def _chosen(histogram: DataFrame, within: list[str], ranks: Column) -> DataFrame:
    """(prefix, wanted): the buckets of (within, prefix, n, value) that a rank of ``ranks`` lies in, ranks counted inside them."""
    order = Window.partitionBy(*within).orderBy("prefix")
    through = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    told = histogram.withColumn("through", through).withColumn("before", F.col("through") - F.col("n"))
    inside = F.filter(ranks, lambda r: (r["rank"] >= F.col("before")) & (r["rank"] < F.col("through")))
    inside = F.transform(inside, lambda r: F.struct(r["name"].alias("name"), (r["rank"] - F.col("before")).alias("rank")))
    return told.select("prefix", inside.alias("wanted"), "value").filter(F.size("wanted") > 0)


def percentiles(df: DataFrame, value: str | Column, at: tuple[float, ...]) -> DataFrame:
    """One row, ``p0``, ``p1``, ...: the percentiles of non-null values with linear interpolation; nulls if there are none.

    The table is read four times, so it should be a table and not a long plan.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(x.alias("x")).filter("x is not null").select("x", order_key(F.col("x")).alias("key"))
    shift = 64 - BITS
    histogram = rows.groupBy(F.shiftright("key", shift).alias("prefix")).agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("value"))
    histogram = histogram.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))  # of at most 65,536 buckets
    place = [(F.col("total") - 1) * float(p) for p in at]
    ranks = F.array(*[F.struct(F.lit(f"{end}{k}").alias("name"), fn(q).cast("long").alias("rank")) for k, q in enumerate(place) for end, fn in (("low", F.floor), ("high", F.ceil))])
    chosen, totals = _chosen(histogram, ["total"], ranks), histogram.agg(F.max("total").alias("total"))
    while shift:
        known, shift = chosen.select(F.col("prefix").alias("known"), "wanted"), shift - BITS
        inside = rows.join(F.broadcast(known), F.shiftright("key", shift + BITS) == F.col("known"))  # two rows a percentile at most
        last = F.max("x") if not shift else F.lit(None).cast("double")
        histogram = inside.groupBy("known", F.shiftright("key", shift).alias("prefix")).agg(F.count("*").alias("n"), last.alias("value"), F.first("wanted").alias("ranks"))
        chosen = _chosen(histogram, ["known"], F.col("ranks"))
    found = chosen.select(F.explode("wanted").alias("w"), "value").select("w.name", "value")
    ends = found.groupBy().agg(*[F.max(F.when(F.col("name") == f"{end}{k}", F.col("value"))).alias(f"{end}{k}") for k in range(len(at)) for end in ("low", "high")])
    total = totals.select("total").scalar()
    between = lambda k, p: F.when(F.col(f"low{k}") == F.col(f"high{k}"), F.col(f"low{k}")).otherwise(F.col(f"low{k}") + (F.col(f"high{k}") - F.col(f"low{k}")) * ((total - 1) * p - F.floor((total - 1) * p)))
    return ends.select(*[between(k, float(p)).alias(f"p{k}") for k, p in enumerate(at)])
