import re
from collections import Counter, defaultdict

import pytest

from tests.llm.fixtures import no_documents, odd_documents
from tidemill.llm import mixing


def filled(sizes, weights, cap):
    """Targets by repeated resharing, as the contract tells it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, target, stopped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(cap * sizes[s] for s in stopped)
        share = sum(w[s] for s in names if s not in stopped)
        target = {s: cap * sizes[s] if s in stopped else left * w[s] / share for s in names}
        over = {s for s in names if s not in stopped and target[s] > cap * sizes[s]}
        if not over:
            return target
        stopped |= over


@pytest.mark.parametrize("weights", [(5, 2, 1), (1,), (100, 1)])
def test_targets_and_taken(spark, sf_dir, weights):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix_plan(docs, weights=weights).collect()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == size
    by_source = defaultdict(int)
    for r in rows:
        by_source[r["source"]] += r["size"]
        assert r["taken"] <= 3 * r["size"]
    want = filled(by_source, weights, 3)
    taken = Counter()
    for r in rows:
        assert r["source_size"] == by_source[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert taken[s] == round(t)


def test_reruns_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(map(tuple, mixing.mix_plan(docs).collect())) == sorted(map(tuple, mixing.mix_plan(docs.repartition(7)).collect()))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = mixing.mix_plan(docs).collect()
    assert len(rows) == docs.count()
    assert sorted((r["doc_id"], r["taken"]) for r in rows if r["doc_id"] in (0, 1, 2)) == [(0, 0), (1, 0), (2, 0)]
    assert mixing.mix_plan(no_documents(spark)).count() == 0
    kept = mixing.mix(docs)
    assert kept.columns == docs.columns
    assert {0, 1, 2} <= {r["doc_id"] for r in kept.collect()}
    assert mixing.mix(no_documents(spark)).count() == 0


def test_schedule_prefixes_follow_the_targets():
    """Any prefix of the golden-ratio points is close to the cumulative shares."""
    points = [(k * mixing.GOLDEN_STEP) % mixing.GOLDEN_MOD / mixing.GOLDEN_MOD for k in range(5000)]
    for n in (50, 500, 5000):
        assert abs(sum(p < 0.3 for p in points[:n]) / n - 0.3) < 4 / n


def test_small_sources_beside_a_large_one(spark):
    """200 million words by a size column: every source gets its target to the word, those of 50 to 3000 words, too."""
    small = {"s050": 50, "s100": 100, "s300": 300, "s700": 700, "s1500": 1500, "s3000": 3000}
    rows = [("large", k, 1_000_000) for k in range(200)]
    for s, words in small.items():
        parts = [words // 7] * 6 + [words - 6 * (words // 7)]
        rows += [(s, len(rows) + k, n) for k, n in enumerate(parts)]
    sized = spark.createDataFrame(rows, "source string, doc_id long, size long").withColumn("text_hash", mixing.F.xxhash64("doc_id")).withColumn("h", mixing.shuffle_key(mixing.F.col("doc_id"), mixing.F.lit("x"), 17))
    found = mixing.mix_sizes(sized).collect()
    assert len(found) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in found)
    sizes, taken = Counter(), Counter()
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = filled(sizes, (5, 2, 1), 3)
    assert dict(taken) == {s: round(t) for s, t in want.items()}


def test_prefixes_of_the_schedule(spark):
    """Any prefix of the slots is close to the targets, and a source without a point has a slot."""
    rows = [(0, 700_000, 600_000), (1, 250_000, 300_000), (2, 49_999, 99_999), (3, 1, 1)]
    targets = spark.createDataFrame(rows, "s int, source_size long, width long").withColumn("all_words", mixing.F.lit(1_000_000).cast("long"))
    slots = mixing.schedule(targets, block=1000).collect()
    assert [(r["slot"], r["r"], r["n"]) for r in slots if r["s"] == 3] == [(None, 0, 1)]
    order = [r["s"] for r in sorted((r for r in slots if r["slot"] is not None), key=lambda r: r["slot"])]
    for n in (10, 100, 333, 1000):
        for s, _, width in rows[:3]:
            assert abs(order[:n].count(s) - n * width / 1_000_000) < 4
    for s in range(3):
        assert sorted(r["r"] for r in slots if r["s"] == s) == list(range(order.count(s)))


def test_a_third_of_all_rows_equal(spark):
    """Equal rows are laid one after the other; no task gets them all."""
    docs = spark.range(30_000).select(mixing.F.when(mixing.F.col("id") % 3 == 0, 7).otherwise(mixing.F.col("id")).alias("doc_id"), mixing.F.when(mixing.F.col("id") % 3 == 0, "a b c").otherwise(mixing.F.concat(mixing.F.lit("w "), mixing.F.col("id"))).alias("text"), mixing.F.lit("s").alias("source")).repartition(8)
    rows = mixing.mix_plan(docs, weights=(1,))
    taken = Counter()
    for r in rows.collect():
        assert r["taken"] == r["size"]
        taken[r["doc_id"]] += 1
    assert taken[7] == 10_001 and len(taken) == 20_000
    kept = mixing.mix(docs, weights=(1,))
    assert kept.count() == 30_000
