import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from tests.llm.fixtures import no_documents, odd_documents
from tidemill.llm import ngramjoin


def brute(rows):
    """(doc_id, text) rows -> sorted (doc_id, class, links, component) from all pairs of word-tuple sets."""
    sets = []
    for _, text in rows:
        w = re.findall(r"\w+", (text or "").lower())
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None)
    near = defaultdict(set)
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            near[i].add(j)
            near[j].add(i)
    big = lambda x: (x is None, x or 0)
    out = []
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        same = [rows[k][0] for k in seen if sets[k] == sets[i]] if sets[i] else [doc]
        out.append((doc, min(same, key=big), len(near[i]), min((rows[k][0] for k in seen), key=big)))
    return Counter(out)


@pytest.mark.parametrize("block", [192, 3])
def test_against_all_pairs(spark, sf_dir, block):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = ngramjoin.near_duplicates(docs, block=block, sign_block=2 * block).collect()
    want = brute([tuple(r) for r in docs.collect()])
    assert Counter((r["doc_id"], r["class_id"], r["n_links"], r["component_id"]) for r in found) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    assert sum(n for (_, _, links, _), n in want.items() if links) > 10


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = ngramjoin.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"], r["component_id"]) for r in found) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert ngramjoin.near_duplicates(no_documents(spark)).count() == 0
    kept = ngramjoin.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {0, 1, 2, 4, None} <= ids and not ids & {5, 6, 11}


def test_one_row_of_each_group_stays(spark):
    say = lambda p, n=40: " ".join(f"{p}{k}" for k in range(n))
    rows = [(1, say("a")), (1, say("a")), (None, say("a")), (None, say("clean")), (None, say("b")), (None, say("b")), (2, say("c")), (3, say("c")), (3, say("other")), (4, say("d")), (4, say("d") + " more"), (5, say("e")), (6, None), (6, None)]
    docs = spark.createDataFrame([(k, t, str(n)) for n, (k, t) in enumerate(rows)], "doc_id long, text string, source string")
    found = ngramjoin.keep_one(docs.repartition(3)).collect()
    kept = Counter((r["doc_id"], r["text"]) for r in found)
    four = [k for k in kept if k[0] == 4]
    assert len(four) == 1 and kept.pop(four[0]) == 1
    assert kept == Counter([(1, say("a")), (None, say("clean")), (None, say("b")), (2, say("c")), (3, say("other")), (5, say("e")), (6, None), (6, None)])
    assert {r["source"] for r in found} >= {"0", "4"}


def test_large_family(spark):
    """A family of near copies larger than a block, with copies, chains and all pairs linked."""
    import random

    rng = random.Random(1)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(90):
        w = list(base)
        w[rng.randrange(120)] = f"x{rng.randrange(40)}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, rows[k][1]) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngramjoin.near_duplicates(docs, block=16, sign_block=32).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"], r["component_id"]) for r in found) == brute(rows)


def test_recall_of_the_banding():
    assert ngramjoin.missed(0.8, 32, 5) < 1e-5


def test_recall_on_planted_pairs(spark):
    """Pairs of similarity 0.8 to 0.85, one word in the middle changed: 50 words have 46 shingles, 41 of which stay of 51."""
    import random

    rng = random.Random(7)
    rows = []
    for k in range(400):
        words = [f"p{rng.randrange(10**9)}" for _ in range(rng.choice([50, 55, 60]))]
        other = list(words)
        other[25] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in ngramjoin.near_duplicates(docs).collect()}
    assert [found[2 * k + 1] for k in range(400)] == [(1, 2 * k) for k in range(400)]


def test_many_copies_are_one_key(spark):
    """A third of all rows are copies of one text, under working names of the operator as columns."""
    rows = [(k, " ".join(f"c{j}" for j in range(30)) if k % 3 == 0 else " ".join(f"w{k}_{j}" for j in range(30)), k) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, skey int").repartition(5)
    found = {r["doc_id"]: r for r in ngramjoin.near_duplicates(docs).collect()}
    assert len(found) == 3000 and all((found[k]["n_links"], found[k]["component_id"]) == ((999, 0) if k % 3 == 0 else (0, k)) for k in found)
    assert sorted(r["doc_id"] for r in ngramjoin.keep_one(docs).collect()) == [0, *(k for k in range(3000) if k % 3)]


def test_keep_one_of_many_repeated_rows(spark):
    """A third of all rows are one id and text; one of them stays, and a near copy of it of a larger id goes."""
    words = [f"w{k}" for k in range(60)]
    base, near = " ".join(words), " ".join([*words[:59], "changed"])
    rows = [(5, base, k % 2) for k in range(400)] + [(6, near, 0)] * 300 + [(k, f"alone {k} " * 12, 1) for k in range(100, 600)] + [(None, base, 9)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(6)
    kept = ngramjoin.keep_one(docs).collect()
    assert [(r["doc_id"], r["extra"]) for r in kept if r["doc_id"] is None or r["doc_id"] < 100] == [(5, 0)]
    assert len(kept) == 501
