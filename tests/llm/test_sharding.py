import hashlib
import zlib
from collections import defaultdict

from tests.llm.fixtures import no_documents, odd_documents
from tidemill.llm import sharding


def check(docs, rows, shards):
    text = defaultdict(list)
    for r in docs.collect():
        text[r["doc_id"]].append(r["text"])
    assert len(rows) == sum(map(len, text.values()))
    home = {}
    slots = defaultdict(list)
    for r in rows:
        candidates = [t for t in text[r["doc_id"]] if len((t or "").encode()) + 1 == r["size"] and zlib.crc32((t or "").encode()) == r["text_crc32"]]
        assert candidates and r["law"] == "bytes" and r["grown_shard"] is None
        assert home.setdefault(candidates[0], r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
    for s, found in slots.items():
        assert 0 <= s < shards and sorted(found) == list(range(len(found)))


def test_shards_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for leaf, fan in ((20_000, 1024), (20, 3)):
        rows = sharding.shard(docs, leaf_groups=leaf, fan_in=fan).collect()
        check(docs, rows, 16)
        size = defaultdict(int)
        for r in rows:
            size[r["shard"]] += r["size"]
        largest = max(r["size"] for r in rows)
        assert len(size) == 16 and max(size.values()) - min(size.values()) <= max(0.05 * sum(size.values()) / 16, largest)


def test_odd_rows(spark):
    check(odd_documents(spark), sharding.shard(odd_documents(spark), shards=3).collect(), 3)
    assert sharding.shard(no_documents(spark)).count() == 0


def test_differencing_by_hand():
    # The textbook case: 8 7 6 5 4 differences to sets of 16 and 14.
    last = sharding.difference([[(s, s), (0, None)] for s in (8, 7, 6, 5, 4)])
    assert sorted(s for s, _ in last) == [14, 16]
    for s, tree in last:
        assert sum(sharding.marks(tree)) == s


def brute(sizes, shards):
    """Loads by differencing as the textbook tells it, on sums alone: sort all partial partitions anew at every step."""
    partial = [(k, sorted([s] + [0] * (shards - 1), reverse=True)) for k, s in enumerate(sizes)]
    arrived = len(partial)
    while len(partial) > 1:
        partial.sort(key=lambda x: (x[1][-1] - x[1][0], x[0]))
        (_, a), (_, b) = partial[:2]
        partial = [*partial[2:], (arrived, sorted((x + y for x, y in zip(a, b[::-1], strict=True)), reverse=True))]
        arrived += 1
    return sorted(partial[0][1])


def test_loads_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    groups = defaultdict(int)
    for r in docs.collect():
        groups[r["text"]] += len((r["text"] or "").encode()) + 1
    key = lambda t: b"null" if t is None else hashlib.sha256(t.encode()).digest()
    want = brute([groups[t] for t in sorted(groups, key=key)], 16)
    loads = defaultdict(int)
    for r in sharding.shard(docs).collect():
        loads[r["shard"]] += r["size"]
    assert sorted(loads.values()) == want


def test_a_text_that_a_third_of_all_rows_share(spark):
    docs = spark.createDataFrame([(k, "the same text" if k % 3 == 0 else f"text {k}") for k in range(6000)], "doc_id long, text string").repartition(5)
    rows = sharding.shard(docs, shards=4, leaf_groups=500, fan_in=3).collect()
    check(docs, rows, 4)
    loads = defaultdict(int)
    for r in rows:
        loads[r["shard"]] += r["size"]
    rest = sorted(loads.values())[:3]
    assert rest[-1] - rest[0] <= 12 and max(loads.values()) >= 2000 * 14


def test_repeated_rows_share_no_task(spark):
    """A third of the rows agree in id and text; they get slots one after the other from tables without them all."""
    docs = spark.createDataFrame([(7, "same") if k % 3 == 0 else (k, f"text {k}") for k in range(3000)], "doc_id long, text string").repartition(6)
    rows = sharding.shard(docs, shards=4).collect()
    check(docs, rows, 4)
    assert sum(r["doc_id"] == 7 and r["size"] == 5 for r in rows) >= 1000
