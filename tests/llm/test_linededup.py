import random

import pytest

from tests.llm.fixtures import no_documents, odd_documents
from tidemill.llm import linededup


def brute(rows, least):
    """(doc_id, text) -> text left, by looking at the shortest runs from every line on and up to every line, in order."""
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    runs, seen, out = {}, {}, {}
    for d in order:
        lines = [(k, x.strip(), len(x.split())) for k, x in enumerate(d[1].split("\n")) if x.split()]
        found = set()
        for p in range(len(lines)):
            for way in (range(p, len(lines)), range(p, -1, -1)):
                words = 0
                for e in way:
                    words += lines[e][2]
                    if words >= least:
                        found.add((min(p, e), max(p, e) + 1))
                        break
        runs[d] = [(p, e, tuple(x for _, x, _ in lines[p:e])) for p, e in sorted(found)]
    for d in order:
        lines = [k for k, x in enumerate(d[1].split("\n")) if x.split()]
        gone = set()
        for p, e, content in runs.get(d, []):
            first = seen.setdefault(content, (d, p, e))
            if first[0] != d or p >= first[2]:
                gone |= {lines[k] for k in range(p, e)} if first[:2] != (d, p) else set()
        kept = [x for k, x in enumerate(d[1].split("\n")) if k not in gone]
        out[d] = ("" if gone and len(gone) == len(lines) else "\n".join(kept), len(gone))
    return out


@pytest.mark.parametrize(("least", "seed"), [(50, 25), (12, 5), (20, 20)])
def test_against_brute_force(spark, sf_dir, least, seed):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()], least)
    found = linededup.dedup_lines(docs, min_words=least, seed_words=seed).collect()
    source = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {(r["doc_id"], source[r["doc_id"]]): (r["text"], r["n_removed"]) for r in found} == want
    assert sum(n > 0 for _, n in want.values()) > 5


def test_planted_passages_and_periods(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    lines = [say(9) for _ in range(7)]  # 63 words in seven lines
    rows = [(1, "\n".join([say(5), *lines, say(5)])), (2, "\n".join([say(30), "", *lines[:3], " ", *lines[3:], say(8)])), (3, say(60)), (4, "\n".join(["again and again"] * 60)), (5, "\n".join(lines[:5])), (6, "\n".join([say(70)] * 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    want = brute(rows, 50)
    assert {(k, dict(rows)[k]): (r["text"], r["n_removed"]) for k, r in found.items()} == want
    assert [found[k]["n_removed"] for k in (1, 2, 3, 4, 5, 6)] == [0, 7, 0, 43, 0, 2]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = linededup.dedup_lines(docs)
    assert found.columns == [*docs.columns, "n_lines", "n_removed"] and found.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in found.collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    changed = {k for k in before if before[k] != texts[k]}
    assert changed == {5, 8} and texts[5] == "" and texts[0] is None and texts[2] == before[2]
    assert linededup.dedup_lines(no_documents(spark)).count() == 0


def whole(rows, least):
    """doc_id -> numbers of the lines deleted, by looking at all runs of any length with ``least`` words."""
    first, gone = {}, {}
    for d, text in sorted(rows):
        lines = text.split("\n")
        gone[d] = set()
        for p in range(len(lines)):
            for e in range(p + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[p:e]) >= least:
                    where = first.setdefault(tuple(lines[p:e]), (d, p))
                    if where[0] != d or p >= where[1] + e - p:
                        gone[d] |= set(range(p, e))
    return gone


def test_whole_repeats(spark):
    rng = random.Random(8)
    made = {}
    line = lambda name, n: made.setdefault(name, " ".join(f"{name}{rng.randrange(10**6)}" for _ in range(n)))
    texts = []
    for name, sizes in (("a", [60, 5]), ("b", [25, 25, 3]), ("c", [60, 20, 20])):
        passage = [line(f"{name}{k}", n) for k, n in enumerate(sizes)]
        texts += [[*passage, line(f"{name}x", 9)], [line(f"{name}y", 9), *passage, line(f"{name}z", 9)]]
    # The first copy of a line goes on otherwise than the second, which the third repeats.
    texts += [[line("e", 60), line("f", 5)], [line("e", 60), line("g", 5)], [line("h", 7), line("e", 60), line("g", 5)]]
    few = [line(f"k{k}", n) for k, n in enumerate([55, 30, 20, 8, 5])]
    texts += [[rng.choice(few) for _ in range(rng.randrange(1, 12))] for _ in range(60)]
    rows = [(k, "\n".join(x)) for k, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = whole(rows, 50)
    assert [len(want[k]) for k in range(9)] == [0, 2, 0, 3, 0, 3, 0, 1, 2]
    for r in linededup.dedup_lines(docs).collect():
        kept = [x for k, x in enumerate(texts[r["doc_id"]]) if k not in want[r["doc_id"]]]
        assert (r["text"], r["n_removed"]) == ("\n".join(kept), len(want[r["doc_id"]]))


def test_many_short_lines(spark):
    """A document of 200,000 short lines, half of them repeats, beside a copy of its first half."""
    rng = random.Random(2)
    half = [f"{rng.randrange(10**9)} {k}" for k in range(100_000)]
    text = "\n".join([*half, *half])
    docs = spark.createDataFrame([(1, text), (2, "\n".join(half)), (3, "\n".join(half[:24])), (4, "\n".join(half[50:75]))], "doc_id long, text string")
    found = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    assert [(found[k]["n_lines"], found[k]["n_removed"]) for k in (1, 2, 3, 4)] == [(200_000, 100_000), (100_000, 100_000), (24, 0), (25, 25)]
    assert found[1]["text"] == "\n".join(half) and found[2]["text"] == "" and found[3]["text"] == "\n".join(half[:24])


def test_a_hot_passage_and_line(spark):
    """A passage and a line that most documents share, under names of columns that the operator uses itself."""
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, line = [say(30), say(30)], say(60)
    rows = [(k, "\n".join([say(9), *(passage if k % 3 else []), say(5), *([line] if k % 2 else [])]), k, "t", k) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, removed string, result int").repartition(5)
    found = linededup.dedup_lines(docs)
    assert found.columns == [*docs.columns, "n_lines", "n_removed"]
    want = brute([r[:2] for r in rows], 50)
    got = {(r["doc_id"], dict(r2[:2] for r2 in rows)[r["doc_id"]]): (r["text"], r["n_removed"]) for r in found.collect()}
    assert got == want and {(r["key"], r["removed"], r["result"]) for r in found.collect()} == {(k, "t", k) for k in range(300)}
