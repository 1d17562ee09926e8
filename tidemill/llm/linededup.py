"""Deletes later repeats of runs of lines, by winnowing over line hashes (DataFrame functions only).

Lines are compared after trimming; lines without words count for nothing and are left where they are. A *run* is
any lines in a row that have ``min_words`` words together. A run that occurred before, in an earlier document (by
id) or earlier in its own, without overlapping itself there, is deleted.

1. Windows are the fewest lines from each line on, and the fewest lines up to each line, that make a run: any run is
   a union of windows that lie in it. The hashes of the fewest lines with ``seed_words`` words from a line on are
   candidates for fingerprints, and each window selects the least of those inside it, so equal windows select equal
   ones at equal places, however they are embedded (the guarantee of winnowing), and neighbouring windows mostly the same.
2. The selected positions meet by fingerprint; only windows around a fingerprint with two positions go on.
3. From its fingerprint a window is extended both ways to its ends: windows match where the fingerprints, the lines
   before and the lines after them are equal. The first occurrence of each match is found, and joined to the
   windows that match it; those that come later are deleted. Their union is the whole repeat.

Minima and counts are aggregated before they are shuffled and hot fingerprints are joined by broadcast, so a line,
passage or document that a third of all rows share meets in no task. All work on a document is linear in its lines.
Lines are compared by 64-bit hashes: with N different lines, one is taken for some other with probability N / 2**64.

Defined results: a null text stays null and has no lines; empty and blank texts stay; rows that agree in id and text
are one document and keep the same; null ids come first in order. Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import fresh, join_unique, let, spool


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def _reach(words: Column, start: Column, least: int, first: int = 6) -> Column:
    """How many lines from ``start`` (from 0) on have ``least`` words together, or null; every line has a word.

    Words and lines are counted in one number (words above the low 20 bits). Few lines are tried first.
    """
    unit = 1 << 20
    step = lambda a, x: F.when(a >= least * unit, a).otherwise(a + x.cast("long") * unit + 1)
    among = lambda n: F.aggregate(F.slice(words, start + 1, F.lit(n)), F.lit(0).cast("long"), step)
    lines = lambda a: F.when(a >= least * unit, (a % unit).cast("int"))
    few = lines(among(min(first, least)))
    return F.coalesce(few, F.when(F.size(words) > start + first, lines(among(least)))) if least > first else few


def _windows(lines: DataFrame, min_words: int, seed_words: int) -> DataFrame:
    """(doc_id, text_hash, start, length, seed, at, sides): every window with its fingerprint, the fingerprint's first line
    and a hash of the lines before and after it.

    All is made inside the row and exploded once, so that no row carries a document's arrays along.
    """
    every = F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1))
    reach = lambda words, least: F.transform(every, lambda q: _reach(F.col(words), q, least))
    seed = lambda n, q: F.when(n.isNotNull(), F.struct(F.xxhash64(F.slice("h", q + 1, n)).alias("hash"), q.alias("at"), (q + n).alias("end")))
    onward = lambda ahead: F.transform(ahead, lambda n, q: F.struct(q.alias("start"), n.alias("length")))
    upto = F.transform(reach("back_w", min_words), lambda n, q: F.struct((F.size("h") - q - n).alias("start"), n.alias("length")))
    spans = lambda ahead: F.concat(F.filter(onward(ahead), lambda s: s["length"].isNotNull()), F.filter(upto, lambda s: F.get(ahead, s["start"]) < s["length"]))

    def window(span: Column, seeds: Column) -> Column:
        end = span["start"] + span["length"]
        chosen = F.array_min(F.filter(F.slice(seeds, span["start"] + 1, span["length"]), lambda s: s["end"] <= end))
        before = F.slice("h", span["start"] + 1, chosen["at"] - span["start"])
        after = F.slice("h", chosen["end"] + 1, end - chosen["end"])
        sides = F.struct(F.xxhash64(before, F.size(before), after, span["length"]).alias("a"), F.xxhash64(F.lit(7), after, span["length"], F.size(before), before).alias("b"))
        return F.struct(span["start"].alias("start"), span["length"].alias("length"), chosen["hash"].alias("seed"), chosen["at"].alias("at"), sides.alias("sides"))

    found = let(reach("w", min_words), lambda ahead: let(F.transform(reach("w", seed_words), seed), lambda seeds: F.transform(spans(ahead), lambda span: window(span, seeds))))
    return lines.select("doc_id", "text_hash", F.explode(found).alias("x")).select("doc_id", "text_hash", "x.*")


def repeated_lines(docs: DataFrame, *, min_words: int = 50, seed_words: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, removed): stretches (from, upto) of deleted lines among the lines with words, in order, for
    documents that lose any."""
    text = F.col(text_col)
    kept = F.filter(F.transform(_lines(text), lambda x: F.struct(F.xxhash64(_trimmed(x)).alias("h"), F.regexp_count(x, F.lit(r"\S+")).alias("w"))), lambda s: s["w"] > 0)
    lines = docs.filter(text.isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), kept.alias("l"))
    lines = spool(lines.select("doc_id", "text_hash", F.transform("l", lambda s: s["h"]).alias("h"), F.transform("l", lambda s: s["w"]).alias("w"), F.reverse(F.transform("l", lambda s: s["w"])).alias("back_w")), "lines")
    windows = spool(_windows(lines, min_words, seed_words), "line-windows")
    total = windows.count()
    # Repeated rows of a document are at one place, so that only true repeats have two.
    place = lambda at: F.struct("doc_id", "text_hash", at)
    met = windows.groupBy("seed").agg(F.min(place("at")).alias("first"), F.max(place("at")).alias("last"), F.count("*").alias("n"))
    met = spool(met.filter(~F.col("first").eqNullSafe(F.col("last"))).select("seed", "n"), "line-seeds")
    around = spool(join_unique(windows, met, ["seed"], weight="n", total=total), "line-around")
    matched = around.groupBy("seed", "sides").agg(F.min(F.struct("doc_id", "text_hash", "start", "length")).alias("first"), F.max(place("start")).alias("last"), F.count("*").alias("n"))
    matched = spool(matched.filter(~F.struct("first.doc_id", "first.text_hash", "first.start").eqNullSafe(F.col("last"))).select("seed", "sides", "n", "first"), "line-matches")
    found = join_unique(around, matched, ["seed", "sides"], weight="n", total=total)
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    later = found.filter(~own | (F.col("start") >= F.col("first.start") + F.col("first.length")))
    # Of overlapping windows each adds the lines beyond those before it.
    in_document = Window.partitionBy("doc_id", "text_hash").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    ends = later.select("doc_id", "text_hash", "start", "length", (F.col("start") + F.col("length")).alias("upto")).withColumn("reached", F.coalesce(F.max("upto").over(in_document), F.lit(0)))
    stretches = ends.filter("upto > reached").select("doc_id", "text_hash", F.struct(F.greatest("start", "reached").alias("from"), "upto").alias("stretch"))
    return stretches.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("stretch")).alias("removed"))


def dedup_lines(docs: DataFrame, *, min_words: int = 50, seed_words: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the repeated lines deleted from the text, and n_lines, n_removed as the last columns.

    A document that loses all its lines with words has an empty text. Clashing columns of those names are replaced.
    """
    key, removed, result = fresh(docs, "key", "removed", "result")
    found = repeated_lines(docs, min_words=min_words, seed_words=seed_words, id_col=id_col, text_col=text_col)
    found = found.select(F.struct("doc_id", "text_hash").alias(f"{key}_of"), F.col("removed").alias(removed))
    keyed = docs.withColumn(key, F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash")))
    joined = keyed.join(found, F.col(key).eqNullSafe(F.col(f"{key}_of")), "left")
    gone = F.aggregate(removed, F.lit(0), lambda n, s: n + s["upto"] - s["from"])

    def rest(lines: Column) -> Column:
        places = F.filter(F.transform(lines, lambda x, i: F.when(F.regexp_like(x, F.lit(r"\S")), i)), lambda i: i.isNotNull())
        deleted = lambda at: F.flatten(F.transform(removed, lambda s: F.slice(at, s["from"] + 1, s["upto"] - s["from"])))
        stay = lambda at: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), deleted(at))
        return let(places, lambda at: F.when(F.size(at) == gone, F.lit("")).otherwise(F.array_join(F.transform(stay(at), lambda k: F.get(lines, k)), "\n")))

    shortened = F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(let(_lines(F.col(text_col)), rest))
    n_lines = F.coalesce(F.size(_lines(F.col(text_col))), F.lit(0))
    out = joined.withColumn(result, F.struct(shortened.alias("text"), F.when(F.col(text_col).isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed")))
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*[F.col(f"{result}.text").alias(c) if c == text_col else F.col(c) for c in others], f"{result}.n_lines", f"{result}.n_removed")
