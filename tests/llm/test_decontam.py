import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tests.llm.fixtures import no_documents, odd_documents
from tidemill.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + window]), set()).add("" if item is None else str(item))
    lengths = {len(p) for p in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                p = tuple(w[k : k + n])
                if p in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[p]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block_words", [2_000_000, 500])
def test_against_brute_force(spark, sf_dir, block_words):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.contamination(docs, bench, block_words=block_words).collect()
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [tuple(r) for r in bench.collect()])
    assert Counter(map(tuple, found)) == Counter(want)
    assert any(r[5] for r in want)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    items = [(1, None), (2, ""), (3, "one"), (4, " ".join(f"w{k}" for k in range(13))), (5, "One!"), (None, "no id AT all"), (6, "É" * 500), (7, "... --")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, _hits string")
    found = decontam.contamination(docs, bench).collect()
    assert Counter(map(tuple, found)) == Counter(brute([(r["doc_id"], r["text"]) for r in docs.collect()], items))
    assert decontam.contamination(no_documents(spark), bench).count() == 0
    assert not any(r["contaminated"] for r in decontam.contamination(docs, bench.limit(0)).collect())
    assert decontam.decontaminate(docs, bench).columns == docs.columns


def test_search_on_random_words():
    rng = random.Random(9)
    for _ in range(300):
        text = [rng.choice("abc").encode() for _ in range(rng.randint(0, 40))]
        patterns = {tuple(rng.choice("abc").encode() for _ in range(rng.choice([1, 2, 3, 5, 5, 5]))): [str(k)] for k in range(4)}
        spans, items = decontam.PatternSet(patterns, 5).search(text)
        want = {(k, k + len(p)): p for p in patterns for k in range(len(text) - len(p) + 1) if tuple(text[k : k + len(p)]) == p}
        assert set(spans) == set(want)
        assert items == {patterns[p][0] for p in patterns if any(tuple(text[k : k + len(p)]) == p for k in range(len(text)))}


def test_more_blocks_than_a_task_keeps(spark, sf_dir):
    """Blocks are small pickles by their words; batches are searched together, so that each block is loaded once for them."""
    paths = decontam.write_pattern_blocks(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), block_words=500)
    assert len(paths) > decontam.KEPT and len(set(paths)) == len(paths)
    assert sum(len(decontam._load(p).groups) > 0 for p in paths) == len(paths) and len(decontam._BLOCKS) <= decontam.KEPT
    batches = [pa.array(["a" * 1000] * 10)] * 50
    assert [len(p) for p in decontam._parts(iter(batches), True)] == [50]
    assert [len(p) for p in decontam._parts(iter(batches), False)] == [1] * 50
    large = [pa.array(["a" * (decontam.PART_BYTES // 2)])] * 5
    assert [len(p) for p in decontam._parts(iter(large), True)] == [2, 2, 1]
