"""Working columns must not clash with the caller's: inputs have every working name as a column of their own."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import odd_documents
from tidemill.llm import decontam, embednear, linededup, mixing, ngramjoin, quality, sharding, tokencounts, warc
from tidemill.llm.common import fresh

NAMES = ["key", "_key", "key_of", "times", "copy", "at", "score", "hits", "removed", "result", "stays", "text_hash", "size", "taken", "row", "_tm_key", "_tm_hits", "_tm_score", "_mix_key", "_hits", "gkey", "H"]


def crowded(spark):
    docs = odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    return docs.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.substring("text", 1, 9), F.lit("none"))).alias(n) for n in NAMES])


def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(13))), (2, "one")], "item_id long, text string")


def good(spark):
    return spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")


OPERATORS = {
    "mix": lambda spark, d: mixing.mix(d),
    "keep_one": lambda spark, d: ngramjoin.keep_one(d),
    "dedup_lines": lambda spark, d: linededup.dedup_lines(d).drop("n_lines", "n_removed"),
    "decontaminate": lambda spark, d: decontam.decontaminate(d, bench(spark)),
    "keep_good": lambda spark, d: quality.keep_good(d, good(spark), least=0.0),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_of_the_caller_stay(spark, name):
    docs = crowded(spark)
    found = OPERATORS[name](spark, docs)
    assert found.columns == docs.columns
    rest = [c for c in docs.columns if name != "dedup_lines" or c != "text"]
    source = Counter(tuple(r[c] for c in rest) for r in docs.collect())
    rows = [tuple(r[c] for c in rest) for r in found.collect()]
    assert rows and set(rows) <= set(source)


def test_reports_with_clashing_columns(spark):
    docs = crowded(spark)
    n = docs.count()
    assert decontam.contamination(docs, bench(spark), keep=("doc_id", "hits", "_hits")).count() == n
    for found in (mixing.mix_plan(docs), ngramjoin.near_duplicates(docs), sharding.shard(docs), quality.score_documents(docs, good(spark))):
        assert found.count() == n


def test_ids_and_labels_keep_their_type(spark):
    docs = odd_documents(spark).select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 3, "0")).alias("doc_id"), "text")
    numbers = {None if r["doc_id"] is None else f"d{r['doc_id']:03d}": r["component_id"] for r in ngramjoin.near_duplicates(odd_documents(spark)).collect()}
    for r in ngramjoin.near_duplicates(docs).collect():
        assert r["component_id"] == (None if numbers[r["doc_id"]] is None else f"d{numbers[r['doc_id']]:03d}")
    v = [1.0, 2.0, 3.0]
    table = spark.createDataFrame([("a", v, "x"), ("b", v, "x"), ("c", v, "y"), ("d", [2.0, 4.0, 6.1], "y"), ("e", v, None)], "vec_id string, embedding array<double>, label string")
    assert {tuple(r) for r in embednear.near_vectors(table).collect()} == {("a", 1, "a", True), ("b", 1, "a", False), ("c", 1, "c", True), ("d", 1, "c", False), ("e", 0, "e", True)}
    import public_tokenizers

    assert {r["doc_id"] for r in tokencounts.prefix_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()} == set(numbers)


def test_fresh_names():
    class Columns:
        columns = ["Key", "_key", "x"]

    assert fresh(Columns, "key", "y", "y") == ["__key", "y", "_y"]


def test_a_payload_that_most_pages_share(spark):
    pages = spark.createDataFrame([(k, "u", "x" * 200 if k % 3 else ("" if k % 2 else f"{k} " * 90)) for k in range(3000)], "page_id long, url string, html string").repartition(6)
    index = warc.write_archives(pages)
    rows = warc.read_records(index)
    found = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in rows.collect()}
    assert len(found) == 3000
    assert all(found[k] == (("response", None) if k == 1 or k % 3 == 0 else ("revisit", 1)) for k in found)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
