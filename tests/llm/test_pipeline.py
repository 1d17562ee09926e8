from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.test_decontam import brute as brute_contamination
from tests.llm.test_ngramjoin import brute as brute_near
from tidemill.llm.common import spool, table


def test_every_stage_on_what_the_one_before_kept(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = spool(stage(spark, docs, sf_dir), "test-stage")
        kept[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == columns
            source = {tuple(r) for r in before.collect()}
            assert {tuple(r) for r in docs.collect()} <= source
    before, after = kept["quality"]
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    stay = {r["doc_id"] for r in after.collect()}
    right = [(d in stay) == bool(labels[d]) for d in (r["doc_id"] for r in before.collect()) if d in labels]
    assert sum(right) / len(right) > 0.9
    before, after = kept["near_duplicates"]
    near = brute_near([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(d for d, _, _, c in near if d == c)
    before, after = kept["decontamination"]
    bench = [tuple(r) for r in table(spark, sf_dir, "benchmark").collect()]
    dirty = {r[0] for r in brute_contamination([(r["doc_id"], r["text"]) for r in before.collect()], bench) if r[5]}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - dirty
    before, after = kept["mixing"]
    times = Counter(r["doc_id"] for r in after.collect())
    assert max(times.values()) <= 3 and after.count() > 0
    before, after = kept["sharding"]
    assert Counter(r["doc_id"] for r in after.collect()) == Counter(r["doc_id"] for r in before.collect())
    slots = defaultdict(list)
    for r in after.collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_names_and_run(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
