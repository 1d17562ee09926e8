"""Mixing sources to target weights with a low-discrepancy schedule (DataFrame functions only).

Every source's documents are shuffled by a hash and laid end to end as a stream of words. There is a slot of the
schedule for every ``block`` words. Slot ``i`` takes the golden-ratio point ``frac(i / phi)``, which falls into one
source's part of the cumulative targets; a source without a point gets a slot of its own. A source's n slots take
equal stretches of its stream, repeated as often as its target needs: the r-th from word r target / n on. So any prefix
of the schedule is close to the target mixture, and all of it meets each source's target to the word, whatever its size.

Defined results: null texts and texts without words have size 0 and ``taken`` 0; a null source is a source of
its own and is last; repeated rows are rows of their own; an empty table gives an empty plan. Only the id, text
and source columns are read, so other columns may have any name.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import fresh, join_unique, prefix_sums, spool

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: floor(2**31 / golden ratio), made odd: multiples of it modulo 2**31 are the golden-ratio points, exactly.
GOLDEN_STEP, GOLDEN_MOD = 1327217885, 1 << 31
HASH_BITS, LEAST_BUCKET_BITS, BUCKET_ROWS = 60, 10, 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, text: Column, seed: int) -> Column:
    """60 bits of MD5: the same in every engine, so the shuffle can be checked elsewhere. Only equal rows share a key."""
    whole = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Targets of the table (source, source_size): shares by weight of all words, stopped at ``max_epochs`` times
    the source's size; what is over goes to the others by weight until none is above (water filling).

    Adds ``s`` (the source's rank by code point, null last), ``weight`` and ``target``.
    """
    scale = lcm(*weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("s", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("s") % len(weights) + 1).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs)
    # Sources stop in the order of cap / weight; one stops if its cap is within the share that is left to it.
    by_fill = Window.orderBy(F.col("cap") * F.lit(scale) / F.col("weight"), "s")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("decimal(38,0)")
    filled = ranked.withColumns({"all_words": F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything)})
    stops = F.col("cap").cast("decimal(38,0)") * (F.col("all_weight") - total("weight", before)) <= F.col("weight") * (F.col("all_words") - total("cap", before))
    filled = filled.withColumn("stops", stops)
    stopped = lambda c: F.sum(F.when(F.col("stops"), F.col(c)).otherwise(0)).over(everything)
    filled = filled.withColumns({"words_left": F.col("all_words") - stopped("cap"), "weight_left": F.col("all_weight") - stopped("weight")})
    shared = (F.col("weight") * F.col("words_left")).cast("double") / F.col("weight_left").cast("double")
    return filled.withColumn("target", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(shared)).select("s", "source", "source_size", "weight", "target", "all_words")


def _ranked_in_chunks(df: DataFrame, group: list[str], chunk: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` over each group, in two levels so that no task gets a whole group."""
    sums = prefix_sums(df.groupBy(*group, chunk).agg(F.sum(value).alias("_sum")), group, chunk, "_sum", "_base").drop("_sum")
    inside = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)).cast("long"))
    return local.join(sums, [*group, chunk]).withColumn(out, F.col("_base") + F.col("_local")).drop("_base", "_local")


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, block: int = 1024, seed: int = 17) -> DataFrame:
    """How many words the mix takes of each document: doc_id, text_hash, source, size, source_size, target, taken.

    ``block`` is the number of words that a slot stands for. ``taken`` is at most ``max_epochs`` times ``size``.
    """
    id_, text = F.col(id_col), F.col(text_col)
    sized = spool(docs.select(id_.alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_hash"), shuffle_key(id_, text, seed).alias("h")), "mix-sizes")
    return mix_sizes(sized, weights=weights, max_epochs=max_epochs, block=block)


def schedule(targets: DataFrame, *, block: int) -> DataFrame:
    """(slot, s, r, n): which source each slot takes, as the r-th of its n slots. A source without a point comes last."""
    spark, cells = targets.sparkSession, 4096
    words = targets.agg(F.max("all_words").alias("n")).first()["n"] or 0
    upto = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    parts = targets.withColumn("high", F.sum("width").over(upto)).filter("width > 0")
    parts = parts.withColumn("all_width", F.max("high").over(Window.partitionBy(F.lit(0))))
    edge = lambda c: F.floor(F.col(c).cast("decimal(38,0)") * GOLDEN_MOD / F.col("all_width")).cast("long")
    parts = parts.withColumn("low", F.col("high") - F.col("width")).withColumns({"low": edge("low"), "high": edge("high")})
    # Points meet sources by an equi-join on cells of the unit interval.
    cell_size = GOLDEN_MOD // cells
    parts = parts.filter("high > low").withColumn("cell", F.explode(F.sequence(F.expr(f"low div {cell_size}"), F.expr(f"(high - 1) div {cell_size}")))).select("s", "low", "high", "cell")
    points = spark.range(-(-words // block)).select(F.col("id").alias("slot"), ((F.col("id") % GOLDEN_MOD) * GOLDEN_STEP % GOLDEN_MOD).alias("point"))
    points = points.withColumn("cell", F.expr(f"point div {cell_size}"))
    dealt = points.join(parts, "cell").filter("point >= low and point < high").select("slot", "s", F.shiftright("slot", 16).alias("chunk"))
    dealt = spool(dealt, "mix-points")  # read three times
    ranked = _ranked_in_chunks(dealt, ["s"], "chunk", [F.col("slot")], F.lit(1), "r")
    counts = dealt.groupBy("s").agg(F.count("*").alias("n"))
    alone = targets.filter("width > 0").select("s").join(counts, "s", "left_anti")
    without = alone.select(F.lit(None).cast("long").alias("slot"), "s", F.lit(0).cast("long").alias("r"), F.lit(1).cast("long").alias("n"))
    return ranked.join(counts, "s").select("slot", "s", F.col("r").cast("long").alias("r"), "n").unionByName(without)


def _stretches(slots: DataFrame, targets: DataFrame, cell: int) -> DataFrame:
    """(s, cell, taken): the stretches [low, high) of a source's stream that its slots take, cut at cells and at the stream's end."""
    sized = slots.join(targets.select("s", "width", "source_size"), "s")
    edge = lambda r: F.floor(r.cast("decimal(38,0)") * F.col("width") / F.col("n")).cast("long")
    sized = sized.select("s", "source_size", edge(F.col("r")).alias("from"), edge(F.col("r") + 1).alias("to")).filter("to > from")
    turns = sized.withColumn("turn", F.explode(F.sequence(F.expr("from div source_size"), F.expr("(to - 1) div source_size"))))
    first = F.col("turn") * F.col("source_size")
    pieces = turns.select("s", (F.greatest(F.col("from"), first) - first).alias("low"), (F.least(F.col("to"), first + F.col("source_size")) - first).alias("high"))
    pieces = pieces.withColumn("cell", F.explode(F.sequence(F.expr(f"low div {cell}"), F.expr(f"(high - 1) div {cell}"))))
    # A cell meets a few stretches of each turn.
    return pieces.groupBy("s", "cell").agg(F.collect_list(F.struct("low", "high")).alias("stretches"))


def mix_sizes(sized: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, block: int = 1024) -> DataFrame:
    """``mix_plan`` over sizes that are known: a stored table of doc_id, source, size, text_hash and ``h`` (the shuffle key)."""
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    targets = spool(targets.withColumn("width", F.round("target").cast("long")), "mix-targets")
    # Equal rows of a part of the table are one row with their number until the stream is laid.
    equal = sized.withColumn("part", F.spark_partition_id()).groupBy("doc_id", "source", "size", "text_hash", "h", "part").agg(F.count("*").alias("copies"))
    bits = max(LEAST_BUCKET_BITS, (sized.count() // BUCKET_ROWS).bit_length())
    keyed = equal.join(targets.select(F.col("source").alias("of"), "s"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("bucket", F.shiftright("h", HASH_BITS - bits))
    keyed = spool(keyed, "mix-keyed")  # read three times
    order = [F.col(c) for c in ("h", "doc_id", "size", "text_hash", "part")]
    laid = _ranked_in_chunks(keyed.filter("size > 0"), ["s"], "bucket", order, F.col("size") * F.col("copies"), "start")
    laid = laid.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("start", F.col("start") + F.col("k") * F.col("size"))
    pieces = laid.select("doc_id", "text_hash", "s", "size", "start", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("cell"))
    low, high = F.greatest(F.col("start"), F.col("cell") * block), F.least(F.col("start") + F.col("size"), (F.col("cell") + 1) * block)
    stretches = spool(_stretches(schedule(targets, block=block), targets, block), "mix-stretches")
    met = pieces.withColumns({"low": low, "high": high}).join(stretches, ["s", "cell"], "left")
    over = F.aggregate(F.coalesce("stretches", F.array().cast("array<struct<low:bigint,high:bigint>>")), F.lit(0).cast("long"), lambda n, x: n + F.greatest(F.least(x["high"], F.col("high")) - F.greatest(x["low"], F.col("low")), F.lit(0)))
    taken = met.groupBy("doc_id", "text_hash", "s", "size", "start").agg(F.sum(over).alias("taken")).drop("start")
    nothing = keyed.filter("size = 0").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    taken = taken.unionByName(nothing.select("doc_id", "text_hash", "s", "size", F.lit(0).cast("long").alias("taken")))
    return taken.join(targets.select("s", "source", "source_size", "target"), "s").select("doc_id", "text_hash", "source", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents of the mix, whole: each as often as the nearest number to ``taken / size``, none included.

    A document without words has nothing to weigh and stays once. All columns of ``docs``, a table, are kept. Rows that
    agree in id and text get the mean of what the plan takes of them.
    """
    plan = mix_plan(docs, id_col=id_col, text_col=text_col, **how)
    key, times, copy = fresh(docs, "key", "times", "copy")
    taken = F.floor(F.avg(F.col("taken") / F.greatest("size", F.lit(1))) + 0.5)
    chosen = plan.groupBy("doc_id", "text_hash").agg(F.when(F.max("size") > 0, taken).otherwise(1).cast("int").alias("n"), F.count("*").alias("rows"))
    chosen = spool(chosen.select(F.struct("doc_id", "text_hash").alias(key), F.col("n").alias(times), "rows"), "mix-times")
    total = chosen.agg(F.sum("rows")).first()[0] or 0
    keyed = docs.withColumn(key, F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash")))
    found = join_unique(keyed, chosen.filter(F.col(times) > 0), [key], weight="rows", total=total)
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
