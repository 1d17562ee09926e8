import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.fixtures import no_documents, odd_documents
from tidemill.llm import tokenbin, tokencounts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [*"ab'sredlvtm  \n\n\t 12.,!é ñß中文한ा́\x85 　\x1cΣİA", "'re", "'ll", " '", "<|endoftext|>", "<|startoftext|>", "<|EndofText|>", "  ", "\n\n", "the ", "ing", "\xa0", "ﬁ", "😀", "x.", "y,"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_counts_at_every_prefix_are_the_librarys():
    counter, library = tokencounts.counter(BYTES), Tokenizer.from_file(BYTES)
    for t in [*texts(800, 1), "x" * 3000, "=" * 700 + " " * 300, "\n" * 40, "é" * 200]:
        found = np.cumsum(np.frombuffer(counter.prefix_deltas(t), "<i2"), dtype=np.int64).tolist()
        step = 1 if len(t) < 100 else 37
        want = library.encode_batch([t[: k + 1] for k in range(0, len(t), step)], add_special_tokens=False)
        assert found[::step] == [len(e.ids) for e in want], repr(t[:80])


def test_small_stores_give_the_same():
    counter, library = tokencounts.PrefixCounter(BYTES, max_entries=50), Tokenizer.from_file(BYTES)
    encoder, words = tokenbin.SpacedEncoder(WORDS, "<u2", max_entries=20), Tokenizer.from_file(WORDS)
    for t in texts(600, 2):
        assert int(np.frombuffer(counter.prefix_deltas(t), "<i2").sum()) == len(library.encode(t, add_special_tokens=False).ids)
        assert np.frombuffer(encoder.encode(t), "<u2").tolist() == words.encode(t, add_special_tokens=False).ids


def test_budget_and_prefix_questions(spark):
    docs = odd_documents(spark)
    library = Tokenizer.from_file(BYTES)
    counted = tokencounts.prefix_token_counts(docs, BYTES)
    asked = counted.join(docs.select("doc_id", "text").filter("doc_id > 4"), "doc_id").select("text", "n_bytes", "n_tokens", tokencounts.tokens_at("prefix_deltas", F.lit(20)).alias("at"), tokencounts.longest_prefix("prefix_deltas", F.lit(7)).alias("most"))
    for r in asked.collect():
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["at"]) == (len(r["text"].encode()), count(r["text"]), count(r["text"][:20]))
        assert r["most"] == max(k for k in range(min(len(r["text"]), 120) + 1) if count(r["text"][:k]) <= 7)
    found = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in counted.collect()}
    assert found[0] == found[1] == (0, 0) and counted.count() == docs.count()
    assert tokencounts.prefix_token_counts(no_documents(spark), BYTES).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_token_files_round_trip(spark, sf_dir, parts):
    library = Tokenizer.from_file(WORDS)
    for docs in (odd_documents(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        manifest = tokenbin.write_token_files(docs, WORDS, end_id=1, parts=parts)
        rows = sorted(tokenbin.read_token_files(manifest).collect(), key=lambda r: r["start"])
        want = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        assert len(rows) == len(want)
        start = 0
        for r, (doc, text) in zip(rows, want, strict=True):
            ids = [*library.encode(text, add_special_tokens=False).ids, 1]
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
        doc_ids, offsets, tokens = tokenbin.open_part(*[manifest.first()[k] for k in ("path", "dtype")])
        assert isinstance(tokens, np.memmap) and len(tokens) == offsets[-1] and len(doc_ids) + 1 == len(offsets)
    empty = tokenbin.write_token_files(no_documents(spark), WORDS, end_id=1)
    assert empty.count() == 0 and tokenbin.read_token_files(empty).count() == 0
