import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import no_documents, odd_documents
from tidemill.llm import fingerprints as fp
from tidemill.llm import queries

LIMIT = 1 << 61  # an eighth of 64 bits
WRAP = (1 << 64) - 1


def shingle_hash(words):
    h = 0
    for w in words:
        h = (h * 0x9E3779B97F4A7C15 + xxhash.xxh64_intdigest(w)) & WRAP
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = ((h ^ (h >> shift)) * factor) & WRAP
    return h ^ (h >> 31)


def shingles(text):
    words = re.findall(r"\w+", text.lower())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def sketch(text):
    every = sorted(shingle_hash(s) for s in shingles(text))
    return [h for h in every if h < LIMIT] or every[:1]


def jaccard(a, b):
    a, b = set(a), set(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def brute(rows):
    """``rows`` of (doc_id, text) in order."""
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        a, b, c = sketch(text), sketch(edited), sketch(following)
        print_of = lambda s: "".join(f"{h:016x}" for h in s)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), print_of(a), print_of(b), jaccard(a, b), jaccard(a, c)))
    return Counter(out)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def found(df):
    return Counter(tuple(r) for r in df.select(COLUMNS).collect())


def test_query_against_brute_force(spark, sf_dir):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert found(queries.op12_fingerprints(spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize("part_bytes", [300, 5000, 1 << 20])
def test_odd_rows_over_parts(spark, part_bytes):
    docs = odd_documents(spark)
    key = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    rows = sorted(key, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    assert found(fp.edited_pairs(docs, part_bytes=part_bytes, at_once=2)) == brute([(r["doc_id"], r["text"]) for r in rows])


def test_none_and_one(spark):
    assert fp.edited_pairs(no_documents(spark)).count() == 0
    assert found(fp.edited_pairs(spark.createDataFrame([(7, "only one text is here now and again")], "doc_id long, text string"))) == brute([(7, "only one text is here now and again")])


def test_rows_of_one_id_share_parts(spark):
    docs = spark.createDataFrame([(None, f"text {k % 3} " * 20) for k in range(900)] + [(k, f"other {k}") for k in range(100)], "doc_id long, text string")
    rows = fp.edited_pairs(docs, part_bytes=20_000)
    assert rows.count() == 1000 and rows.filter("doc_id is null").count() == 900
    assert rows.filter("doc_id is null and near_next = 1").count() >= 897


def test_estimates(spark):
    """Against the true similarity: unbiased over documents, and close for long ones; containment of a small text in a large one."""
    rng, sketcher = random.Random(1), fp.Sketcher()
    off = []
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(1500)]
        cut = rng.randrange(100, 1400)
        a, b = " ".join(words), " ".join([*words[:cut], *(f"v{rng.randrange(5000)}" for _ in range(300))])
        true = jaccard(shingles(a), shingles(b))
        off.append(fp.likeness(sketcher.sketch(a), sketcher.sketch(b)) - true)
        part = " ".join(words[cut : cut + 90])
        assert fp.contained(sketcher.sketch(part), sketcher.sketch(a)) == 1.0
    assert abs(sum(off) / len(off)) < 0.02 and max(map(abs, off)) < 0.15


def test_merged_sketches(spark):
    docs = odd_documents(spark)
    prints = fp.fingerprints(docs.select("doc_id", "source", "text", F.lit(1).alias("fingerprint")))
    rows = prints.collect()
    assert all(r["fingerprint"] == "".join(f"{h:016x}" for h in sketch(r["text"] or "")) for r in rows)
    groups = fp.merged(prints, ["source"])
    have = {}
    for r in groups.collect():
        have.setdefault(r["source"], []).append(int(r["hash"], 16))
    for source in {r["source"] for r in rows}:
        every = sorted({shingle_hash(s) for r in rows if r["source"] == source for s in shingles(r["text"] or "")})
        assert sorted(have.get(source, [])) == ([h for h in every if h < LIMIT] or every[:1])
    one = prints.filter("doc_id = 4").limit(1)
    assert {(r["source"], r["shared"]) for r in fp.contained_in_groups(one, groups, ["source"]).collect()} >= {(one.first()["source"], 1.0)}
