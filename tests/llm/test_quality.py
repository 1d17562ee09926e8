import zlib

import numpy as np

from tests.llm.fixtures import no_documents, odd_documents
from tidemill.llm import quality


def test_held_out_accuracy_and_calibration(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.score_documents(docs, labels).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    out = [(truth[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    y, s = np.array([a for a, _ in out]), np.array([b for _, b in out])
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in s[y == 1] for n in s[y == 0]])
    assert auc > 0.95 and ((s >= 0.7) == y).mean() > 0.93
    assert abs(s.mean() - y.mean()) < 0.08
    again = quality.score_documents(docs.repartition(5), labels.repartition(3)).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {r["doc_id"]: r["score"] for r in rows}


def test_labels_of_held_out_rows_are_not_learned(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    scores = lambda lab: {r["doc_id"]: r["score"] for r in quality.score_documents(docs, lab).collect()}
    assert scores(labels) == scores(flipped)


def test_odd_rows(spark, sf_dir):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(k, k % 2, 0, "x") for k in range(12)] + [(None, 1, 0, "x"), (3, None, 0, "x"), (3, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    scores = {r["doc_id"]: r["score"] for r in rows}
    assert scores[0] == scores[1] == scores[2] and not next(r for r in rows if r["doc_id"] is None)["held_out"]
    assert quality.score_documents(no_documents(spark), labels).count() == 0
    assert {r["score"] for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.score_documents(docs, labels.filter("quality = 1")).collect()} == {1.0}
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_shapes_and_vectors():
    assert quality.shape("Word,") == "Aa," and quality.shape("the%%%") == "a%" and quality.shape("Éa12") == "éa0"
    v = quality.index_vector("a")
    assert np.count_nonzero(v) == quality.NONZERO and (v == quality.index_vector("a")).all()


def test_long_runs_count_whole(spark, sf_dir):
    """Texts without white space that agree in their first 64 characters and differ after them."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    head = "文書7" * 21 + "文"
    texts = [head, head + "本文" * 500, head + "x9{}" * 500, head + "x9{}" * 499 + "x9{A"]
    assert len(head) == 64 and len(set(model.scores(texts))) == 4
    assert quality.words_of(f"a {head}bc\n{'d' * 130}") == ["a", head, "bc", "d" * 64, "d" * 64, "dd"]
    assert quality.words_of("") == quality.words_of(" \n") == []


def test_pooling_and_network_against_plain_loops(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    for text in [r["text"] for r in docs.limit(20).collect()] + ["one", "a a a", "\u0000\u0000 §§ §§", None, ""]:
        rows = []
        for w in quality.words_of(text):
            filled = [k for k in (quality.word_row(quality.code(w)), quality.class_row(quality.code(quality.shape(w)))) if model.vectors.table[k].any()]
            v = model.vectors.table[filled[0]] if filled else quality.index_vector(quality.shape(w))
            rows.append([float(x) / (1 if filled else quality.NONZERO**0.5) for x in v])
        n = max(len(rows), 1)
        mean = [sum(r[d] for r in rows) / n for d in range(quality.DIM)]
        spread = [max(sum(r[d] ** 2 for r in rows) / n - mean[d] ** 2, 0) ** 0.5 for d in range(quality.DIM)]
        step = [(sum((b[d] - a[d]) ** 2 for a, b in zip(rows, rows[1:])) / max(n - 1, 1)) ** 0.5 for d in range(quality.DIM)]
        found = model.vectors.pooled(text)
        assert np.allclose(found, mean + spread + step, atol=1e-3)
        net, z = model.network, 0.0
        for h in range(net.w1.shape[1]):
            z += net.w2[h] * np.tanh(sum((found[d] - net.mean[d]) / net.scale[d] * net.w1[d, h] for d in range(len(found))) + net.b1[h])
        assert abs(model.scores([text])[0] - 1 / (1 + np.exp(-(z + net.b2) / net.temperature))) < 1e-6


def test_words_get_the_index_vectors_of_their_neighbours(spark):
    vectors = quality.learn_vectors(spark.createDataFrame([("x y z",), ("x y",), (None,), ("",)], "text string"))
    code = quality.index_vector
    want = {"x": np.log(3) * code("y") + np.log(2) * code("z"), "y": np.log(3) * code("x") + np.log(2) * code("z"), "z": np.log(2) * (code("x") + code("y"))}
    for word, v in want.items():
        assert np.allclose(vectors.vectors([word])[0], v / np.linalg.norm(v), atol=1e-6)
    assert vectors.table.any(axis=1).sum() == 4 and vectors.row("unknown") == quality.class_row(quality.code("a")) and vectors.row("%") < 0


def test_neighbours_are_counted_across_stretches(monkeypatch):
    """However a text is cut, its counts are those of plain loops over all of its words; no word is left out."""
    texts = ["a b c a b d e f a b", "a", None, "b a", "q " * 25]
    want = {}
    for text in texts:
        words = quality.words_of(text)
        for i, w in enumerate(words):
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                if i != j:
                    for row in (quality.word_row(quality.code(w)), quality.class_row(quality.code(quality.shape(w)))):
                        key = (row, quality.code(words[j]))
                        want[key] = want.get(key, 0) + 1
    for stretch in (2, 3, 4, 7, 200):
        monkeypatch.setattr(quality, "STRETCH", stretch)
        found = {}
        for batch in quality.neighbour_counts(texts):
            for r in batch.to_pylist():
                found[r["row"], r["beside"]] = found.get((r["row"], r["beside"]), 0) + r["n"]
        assert found == want


def test_null_and_long_labelled_texts_are_learned_from(spark):
    ids = [k for k in range(40) if zlib.crc32(str(k).encode()) % 4 != 2]
    docs = spark.createDataFrame([(k, None if k == ids[0] else "word " * 30_000 if k == ids[1] else f"t{k}") for k in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, quality int")
    sample = quality.labelled_sample(docs, labels, sample_rows=100, id_col="doc_id", text_col="text", label_col="quality").collect()
    assert {r["id"] for r in sample} == set(ids)
    assert {r["id"]: len(r["text"]) for r in sample if r["text"] and len(r["text"]) > 9} == {ids[1]: 150_000}
    assert len(quality.labelled_sample(docs, labels, sample_rows=7, id_col="doc_id", text_col="text", label_col="quality").collect()) == 7


def test_held_out_calibration(spark):
    """Of held-out rows in tenths of the score, the mean score is near the share of label 1."""
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score_documents(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).filter("held_out").join(labels, "doc_id").select("score", "quality").collect()
    s, y = np.array([r["score"] for r in scored]), np.array([r["quality"] for r in scored])
    tenth = np.minimum((s * 10).astype(int), 9)
    error = sum((tenth == b).mean() * abs(s[tenth == b].mean() - y[tenth == b].mean()) for b in set(tenth.tolist()))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in s[y == 1] for n in s[y == 0]])
    assert error < 0.05 and auc > 0.95
