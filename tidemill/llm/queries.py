"""The queries of this subpackage, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import conversations, decontam, embednear, fingerprints, linededup, merkle, mixing, ngramjoin, oracles, quality, sharding, tokenbin, tokencounts, warc
from tidemill.llm.common import Query, on_all_cores, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = tokenbin.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenbin.read_token_files(manifest)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(on_all_cores(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(on_all_cores(table(spark, sf_dir, "documents")))


def op8_embedding_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embednear.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = tokencounts.prefix_token_counts(on_all_cores(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"), keep_prefixes=False)
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(on_all_cores(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(table(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(conversations.damaged(table(spark, sf_dir, "conversations")), times="times")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_mix_sources, op2_warc, op3_shard, op4_token_files, op5_line_dedup, op6_decontaminate, op7_ngram_jaccard, op8_embedding_near, op9_token_counts, op10_quality, op11_merkle_manifest, op12_fingerprints, op13_conversations)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
