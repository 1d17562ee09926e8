import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.fixtures import no_documents, odd_documents
from tidemill.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """The root, and for each leaf its siblings by level as (before, after)."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for k, p in enumerate(at):
            start = p - p % 3
            paths[k].append((nodes[start:p], nodes[p + 1 : start + 3]))
        nodes = [H(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        at = [p // 3 for p in at]
    return nodes[0], paths


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in groups[s]])
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (_, _, own, r), path in zip(groups[s], trees[s][1], strict=True):
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            fold = leaf(r, text)
            for before, after in path + top:
                fold = H(*before, fold, *after)
            siblings = [d for before, after in path + top for d in (*before, *after)]
            out.append((r["doc_id"], own, trees[s][0], root, H(*siblings), fold, fold == root))
    return Counter(out)


def found(df):
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("sizes", [{}, {"part_rows": 7, "fan_in": 2}, {"part_rows": 40, "fan_in": 3}])
def test_against_brute_force(spark, sf_dir, sizes):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(merkle.verified_manifest(docs, **sizes)) == brute(docs.collect())


def test_odd_rows(spark):
    for docs in (odd_documents(spark), odd_documents(spark).union(odd_documents(spark))):
        assert found(merkle.verified_manifest(docs, part_rows=3, fan_in=2)) == brute(docs.collect())
    assert merkle.verified_manifest(no_documents(spark)).count() == 0


def test_groups_of_every_size_over_parts(spark):
    """Groups of 1 to 30 rows and one that holds a third of all, over parts that begin at any place of a run."""
    rows = [(k, "x\ny" if k % 2 else "plain", "en", f"g{size:02d}", k) for size in range(1, 31) for k in range(size)] + [(k % 40, "t\n", "en", "hot", 1) for k in range(233)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = brute(docs.collect())
    for part_rows in (5, 11, 64):
        assert found(merkle.verified_manifest(docs, part_rows=part_rows, fan_in=4)) == want


def test_many_groups_of_one_row(spark):
    docs = spark.createDataFrame([(k, f"t{k}\n", None, f"s{k}", k) for k in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    assert found(merkle.verified_manifest(docs, part_rows=6, fan_in=2)) == brute(docs.collect())


def test_proofs_fold_to_the_root_and_parts_share_rows(spark):
    docs = spark.createDataFrame([(None, "same", "en", "s", 4)] * 900 + [(k, "other", "en", "t", 5) for k in range(100)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = merkle.manifest(docs, part_rows=100)
    assert rows.filter(merkle.folded(rows["leaf"], rows["proof"]) != rows["root"]).isEmpty()
    assert rows.count() == 1000 and rows.select("root").distinct().count() == 1
    trees = merkle.Forest(docs.select("source", merkle.leaf_digest(docs["doc_id"], docs["text"]).alias("digest")).withColumnRenamed("source", "grp"), [], [], parts=10)
    assert max(r["n"] for r in trees.pieces.groupBy("part").sum("n").withColumnRenamed("sum(n)", "n").collect()) < 300


def test_climbing_by_hand():
    a = [H(str(k)) for k in range(4)]
    assert merkle.climb(0, a, 4) == [(0, a, 4), (0, [H(*a[:3]), H(a[3])], 2), (0, [H(H(*a[:3]), H(a[3]))], 1)]
    assert merkle.climb(1, a[1:3], 4) == [(1, a[1:3], 4)]
