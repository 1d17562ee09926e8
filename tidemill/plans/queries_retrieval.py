"""The retrieval language over conversations as a memory store and embeddings as vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.operators import metrics as M
from tidemill.operators import retrieval as R
from tidemill.operators.vectorindex import VectorIndex
from tidemill.plans.catalog import query
from tidemill.sources.storage import work_path
from tidemill.plans.fixtures import rounded, table

MEM = """WITH mem AS (SELECT 'm' || conv_id || '_' || turn AS memory_id, 'D' || conv_id || ':' || turn AS turn_id, '2026/' || (1 + conv_id % 12) || '/' || (1 + turn % 28) || ' 10:' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') AS timestamp,
    role AS author, text AS content, 'c' || conv_id AS session_key, CAST(turn AS INT) AS turn_index, row_number() OVER (ORDER BY conv_id, turn) - 1 AS ord FROM conversations)"""


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.operators.batch import with_dense_id

    s = lambda c: F.col(c).cast("string")
    stamp = F.concat(F.lit("2026/"), (1 + F.col("conv_id") % 12).cast("string"), F.lit("/"), (1 + F.col("turn") % 28).cast("string"), F.lit(" 10:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"))
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("m"), s("conv_id"), F.lit("_"), s("turn")).alias("memory_id"), F.concat(F.lit("D"), s("conv_id"), F.lit(":"), s("turn")).alias("turn_id"), stamp.alias("timestamp"), F.col("role").alias("author"), F.lit("text").alias("modality"), F.lit("chat").alias("source_type"),
        F.lit(None).cast("string").alias("summary"), F.col("text").alias("content"), F.lit(None).cast("string").alias("raw_pointer"), F.concat(F.lit("c"), s("conv_id")).alias("session_key"), F.col("turn").cast("int").alias("turn_index"),
    )
    return with_dense_id(rows, ["conv_id", "turn"], "ord").drop("conv_id", "turn")


def over_store(name: str, sql: str):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(store(spark, sf_dir))

        return query(name, MEM + " " + sql)(run)

    return register


over_store("f03_filter_contains", "SELECT memory_id FROM mem WHERE contains(lower(content), 'the of')")(lambda s: R.filter_pool(R.initial_pool(s), "content", "contains", "THE of").select("memory_id"))
over_store("f03_filter_neq_missing", "SELECT memory_id FROM mem")(lambda s: R.filter_pool(R.initial_pool(s), "summary", "neq", "x").select("memory_id"))
over_store("f04_filter_before", "SELECT memory_id FROM mem WHERE lower(author) < 'system'")(lambda s: R.filter_pool(R.initial_pool(s), "author", "before", "System").select("memory_id"))
over_store("f05_filter_day", "SELECT memory_id FROM mem WHERE starts_with(timestamp, '2026/6/7 ')")(lambda s: R.filter_pool(R.initial_pool(s), "timestamp", "eq", "2026-06-07").select("memory_id"))
over_store("f05_filter_before_day", "SELECT memory_id FROM mem WHERE CAST(string_split(timestamp, '/')[2] AS INT) < 6")(lambda s: R.filter_pool(R.initial_pool(s), "timestamp", "before", "2026-06-01").select("memory_id"))
over_store("f06_filter_scope", "SELECT memory_id FROM mem WHERE author = 'user'")(lambda s: R.run_trace([{"tool": "FILTER", "field": "author", "op": "eq", "value": "assistant"}, {"tool": "filter", "field": "author", "op": "eq", "value": "USER", "scope": "full_memory"}], "q", s).pool.select("memory_id"))
over_store("o01_sort_stable", "SELECT memory_id, row_number() OVER (ORDER BY lower(author) DESC, ord) - 1 AS ord FROM mem")(lambda s: R.sort_pool(R.initial_pool(s), "author", "desc").select("memory_id", "ord"))
over_store("o02_sort_natural", "SELECT memory_id, row_number() OVER (ORDER BY CAST(substr(session_key, 2) AS INT), turn_index) - 1 AS ord FROM mem")(lambda s: R.sort_pool(R.initial_pool(s), "turn_id").select("memory_id", "ord"))
over_store("o03_topk_turns", "SELECT memory_id FROM mem ORDER BY ord LIMIT 7")(lambda s: R.top_turns(R.initial_pool(s), 7).select("memory_id"))

TERMS = """, tk AS (SELECT memory_id, unnest(regexp_extract_all(lower(author || ' ' || content), '[a-z0-9]+')) AS term FROM mem), ln AS (SELECT memory_id, len(regexp_extract_all(lower(author || ' ' || content), '[a-z0-9]+')) AS len FROM mem),
    q(term, qn) AS (VALUES ('the', 2), ('thing', 1), ('user', 1)), tf AS (SELECT memory_id, term, count(*) AS tf FROM tk WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), st AS (SELECT count(*) AS n, avg(len) AS al FROM ln),
    bm AS (SELECT memory_id, sum(qn * ln(1 + (n - df + 5e-1) / (df + 5e-1)) * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * len / greatest(al, 1)))) AS s FROM tf JOIN df USING (term) JOIN q USING (term) JOIN ln USING (memory_id), st GROUP BY memory_id),
    sc AS (SELECT mem.*, coalesce(s, 0) AS score FROM mem LEFT JOIN bm USING (memory_id))"""
QUERY = "The thing, the user"
TRACE = '[{"tool": "RETRIEVE", "method": "bm25", "top_k": 8}, {"tool": "EXPAND_NEIGHBORS", "window": 1}, {"tool": "FILTER", "field": "author", "op": "eq", "value": "User"}, {"tool": "STOP"}]'

over_store("q02_bm25", TERMS + " SELECT memory_id, round(score, 6) + 0.0 AS score FROM sc")(lambda s: R.bm25(R.initial_pool(s), QUERY).select("memory_id", rounded("score").alias("score")))
over_store("q07_retrieve_bm25", TERMS + " SELECT * FROM (SELECT memory_id, round(score, 6) + 0.0 AS score, row_number() OVER (ORDER BY score DESC, timestamp, turn_id, memory_id) - 1 AS ord FROM sc) z WHERE ord < 20")(lambda s: R.retrieve(s, QUERY, method="bm25", top_k=20).select("memory_id", rounded("score").alias("score"), "ord"))
over_store("o04_ranked_topk", TERMS + " SELECT memory_id FROM sc ORDER BY score DESC, timestamp, turn_id, memory_id LIMIT 9")(lambda s: R.retrieve(s, QUERY, method="bm25", top_k=9).select("memory_id"))
over_store(
    "q08_retrieve_turns",
    TERMS + """, pr AS (SELECT a.memory_id, a.turn_id, a.timestamp, greatest(a.score, coalesce(max(b.score * 9e-1), 0)) AS score FROM sc a LEFT JOIN sc b ON a.session_key = b.session_key AND abs(a.turn_index - b.turn_index) = 1 GROUP BY a.memory_id, a.turn_id, a.timestamp, a.score)
    SELECT memory_id, round(score, 6) + 0.0 AS score, row_number() OVER (ORDER BY score DESC, timestamp, turn_id) - 1 AS ord FROM pr QUALIFY ord < 10""",
)(lambda s: R.retrieve_turns(s, QUERY, method="bm25", top_k=10).select("memory_id", rounded("score").alias("score"), "ord"))
over_store("o05_grouped_topk", TERMS + " SELECT turn_id FROM sc ORDER BY score DESC, timestamp, turn_id LIMIT 6")(lambda s: R.retrieve_turns(s, QUERY, method="bm25", top_k=6, window=0).select("turn_id"))
over_store(
    "j08_neighbour_decay",
    TERMS + " SELECT a.turn_id, round(greatest(a.score, coalesce(max(b.score * pow(9e-1, abs(a.turn_index - b.turn_index))), 0)), 6) + 0.0 AS score FROM sc a LEFT JOIN sc b ON a.session_key = b.session_key AND abs(a.turn_index - b.turn_index) BETWEEN 1 AND 2 GROUP BY a.turn_id, a.score",
)(lambda s: R.propagate(s.join(R.bm25(R.initial_pool(s), QUERY), "memory_id"), window=2).select("turn_id", rounded("score").alias("score")))
over_store(
    "j07_expand_neighbors",
    ", p AS (SELECT * FROM mem WHERE contains(lower(content), 'the of')) SELECT memory_id, row_number() OVER (ORDER BY session_key, turn_index, timestamp, memory_id) - 1 AS ord FROM mem m WHERE EXISTS (SELECT 1 FROM p WHERE p.session_key = m.session_key AND abs(p.turn_index - m.turn_index) <= 2)",
)(lambda s: R.expand_neighbors(R.filter_pool(R.initial_pool(s), "content", "contains", "the of"), s, 2).select("memory_id", "ord"))
def ranked_store(s: DataFrame) -> DataFrame:
    """The whole store by its score, ``ord`` from 0."""
    from tidemill.operators.batch import with_dense_id

    scored = s.drop("ord").join(R.bm25(R.initial_pool(s), QUERY).select("memory_id", "score"), "memory_id")
    return with_dense_id(scored, [F.desc("score"), F.asc("timestamp"), F.asc("turn_id"), F.asc("memory_id")], "ord")


#: Two pools that overlap and hold the whole store together.
early = lambda s: R.initial_pool(s).filter("turn_index <= 4")
late = lambda s: R.initial_pool(s).filter("turn_index >= 3")
over_store(
    "j09_merge_pools",
    ", a AS (SELECT memory_id, ord, 2e0 AS score FROM mem WHERE turn_index <= 4), b AS (SELECT memory_id, ord, CASE WHEN ord % 2 = 0 THEN 0e0 ELSE 5e0 END AS score FROM mem WHERE turn_index >= 3) SELECT coalesce(a.memory_id, b.memory_id) AS memory_id, coalesce(CASE WHEN a.memory_id IS NOT NULL AND b.score = 0 THEN a.score ELSE b.score END, a.score) AS score, row_number() OVER (ORDER BY coalesce(a.ord, 1000000000 + b.ord)) - 1 AS ord FROM a FULL JOIN b ON a.memory_id = b.memory_id",
)(lambda s: R.merge_pools(early(s).withColumn("score", F.lit(2.0)), late(s).withColumn("score", F.when(F.col("ord") % 2 == 0, 0.0).otherwise(5.0))).select("memory_id", "score", "ord"))
over_store("j10_append_unseen", "SELECT memory_id FROM mem")(lambda s: R.append_unseen(early(s), late(s)).select("memory_id"))
over_store("j11_refresh_evidence", "SELECT memory_id, CASE WHEN k = 0 THEN 'INSPECT_RAW' ELSE 'POOL' END AS source FROM mem, range(2) r(k) WHERE turn_index >= 3 AND (k = 1 OR turn_index <= 4)")(lambda s: R.refresh_evidence(early(s).withColumn("source", F.lit("INSPECT_RAW")), late(s)).select("memory_id", "source"))
over_store(
    "j15_gold_support",
    TERMS + """, r AS (SELECT turn_id, row_number() OVER (ORDER BY score DESC, timestamp, turn_id, memory_id) AS rank FROM sc), g AS (SELECT r.rank FROM mem LEFT JOIN r USING (turn_id) WHERE contains(lower(content), 'the of'))
    SELECT min(rank) AS best_rank, max(rank) AS all_turns_rank, max(rank) AS all_records_rank, count(*) AS turns_found, count(*) AS turns, count(*) AS records_found, min(rank) <= 1 AS found_at_1, min(rank) <= 3 AS found_at_3, min(rank) <= 5 AS found_at_5, min(rank) <= 10 AS found_at_10, min(rank) <= 20 AS found_at_20 FROM g""",
)(lambda s: R.support_profile(ranked_store(s), R.filter_pool(R.initial_pool(s), "content", "contains", "the of")))
over_store("j14_text_context", "SELECT turn_id, substr(content, 1, 30) AS context FROM mem")(lambda s: R.text_context(s, 30))
over_store("j19_existence", "SELECT true AS shared")(lambda s: s.sparkSession.createDataFrame([(R.any_shared(s, s.filter("ord = 3")),)], "shared boolean"))
over_store("e28_evidence_projection", "SELECT memory_id, content FROM mem")(lambda s: R.project_evidence(R.initial_pool(s)).select("memory_id", "content"))
over_store(
    "q01_trace",
    TERMS + """, t AS (SELECT * FROM sc ORDER BY score DESC, timestamp, turn_id, memory_id LIMIT 8), x AS (SELECT m.* FROM mem m WHERE EXISTS (SELECT 1 FROM t WHERE t.session_key = m.session_key AND abs(t.turn_index - m.turn_index) <= 1)) SELECT memory_id FROM x WHERE lower(author) = 'user'""",
)(lambda s: R.run_trace(R.parse_trace(TRACE), QUERY, s).pool.select("memory_id"))
over_store("q09_oracle_profile", TERMS + ", t AS (SELECT turn_id, row_number() OVER (ORDER BY score DESC, timestamp, turn_id, memory_id) AS k FROM sc QUALIFY k <= 50), g AS (SELECT turn_id FROM mem WHERE ord % 40 = 1), j AS (SELECT k FROM g LEFT JOIN t USING (turn_id)) SELECT 'bm25' AS method, min(k) AS first_rank, round(avg(CASE WHEN k <= 10 THEN 1 ELSE 0 END), 6) + 0.0 AS recall_at_10 FROM j")(
    lambda s: R.oracle_profile(s, QUERY, s.filter("ord % 40 = 1"), methods=("bm25",), top_k=50).select("method", F.col("first_rank").cast("long").alias("first_rank"), rounded("recall_at_10").alias("recall_at_10"))
)
over_store("q10_advice", TERMS + ", t AS (SELECT turn_id, row_number() OVER (ORDER BY score DESC, timestamp, turn_id, memory_id) AS k FROM sc QUALIFY k <= 50), j AS (SELECT t.k FROM (SELECT turn_id FROM mem WHERE ord % 40 = 1) g LEFT JOIN t USING (turn_id)) SELECT CAST(c AS INT) AS k, round(avg(CASE WHEN j.k <= c THEN 1 ELSE 0 END), 6) + 0.0 AS recall FROM j, (VALUES (1), (3), (5), (10)) v(c) GROUP BY c")(
    lambda s: R.advice(R.oracle_profile(s, QUERY, s.filter("ord % 40 = 1"), methods=("bm25",), top_k=50)).select("k", rounded("recall").alias("recall"))
)
over_store("q12_session", "SELECT count(*) AS size FROM mem WHERE lower(author) = 'user'")(lambda s: s.sparkSession.createDataFrame([(R.Session("q", s).execute({"tool": "FILTER", "field": "author", "op": "eq", "value": "user"})["size"],)], "size long"))
over_store("g36_support_profile", "SELECT count(*) AS count, min(timestamp) AS first, max(timestamp) AS last, false AS has_raw FROM mem")(lambda s: M.support_profile(s).select("count", "first", "last", "has_raw"))

VEC = "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE vec_id = 3), d AS (SELECT vec_id, list_dot_product(e, qe) / sqrt(list_dot_product(qe, qe)) AS s FROM v, q)"


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return v, v.filter("memory_id = 3").first()["embedding"]


@query("q03_dense_scores", VEC + " SELECT vec_id AS memory_id, round(s, 6) + 0.0 AS score FROM d")
def q03_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = vectors(spark, sf_dir)
    return R.dense(v, v, [q]).select("memory_id", rounded("score").alias("score"))


@query("j12_missing_vectors", VEC + " SELECT vec_id AS memory_id, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE round(s, 6) END + 0.0 AS score FROM d")
def j12_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = vectors(spark, sf_dir)
    return R.dense(v, v.filter("memory_id % 5 <> 0"), [q]).select("memory_id", rounded("score").alias("score"))


@query("q04_vision_scores", VEC + " SELECT vec_id AS memory_id, round(s, 6) + 0.0 AS score FROM d")
def q04_vision(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = vectors(spark, sf_dir)
    return R.scores_by("vision", v, "", R.Encoders(image_vectors=v, image=q)).select("memory_id", rounded("score").alias("score"))


@query("q05_hybrid_joint", VEC + " SELECT vec_id AS memory_id, round(s, 6) + 0.0 AS score FROM d")
def q05_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = vectors(spark, sf_dir)
    return R.scores_by("hybrid", v, "any", R.Encoders(joint_vectors=v, encode=lambda text: q)).select("memory_id", rounded("score").alias("score"))


@query("q06_weighted_hybrid", VEC + ", m AS (SELECT min(s) AS lo, max(s) AS hi FROM d) SELECT vec_id AS memory_id, round(5e-1 * (5e-1 * (vec_id - (SELECT min(vec_id) FROM d)) / (SELECT max(vec_id) - min(vec_id) FROM d) + 5e-1 * (s - lo) / (hi - lo)) + 5e-1 * (s - lo) / (hi - lo), 6) + 0.0 AS score FROM d, m")
def q06_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = vectors(spark, sf_dir)
    d = R.dense(v, v, [q])
    lexical = v.select("memory_id", F.col("memory_id").cast("double").alias("score"))
    return R.weighted_hybrid(v, lexical, d, d, has_image=True).select("memory_id", rounded("score").alias("score"))


@query("x11_min_max", VEC + ", m AS (SELECT min(s) AS lo, max(s) AS hi FROM d) SELECT vec_id AS memory_id, round((s - lo) / (hi - lo), 6) + 0.0 AS score FROM d, m")
def x11_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = vectors(spark, sf_dir)
    return R.min_max(R.dense(v, v, [q])).select("memory_id", rounded("score").alias("score"))


@query("o06_vector_topk", VEC + " SELECT vec_id AS memory_id, round(s, 6) + 0.0 AS score FROM d ORDER BY s DESC, vec_id LIMIT 10")
def o06_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = vectors(spark, sf_dir)
    return R.vector_search(v, q, 10).select("memory_id", rounded("score").alias("score"))


@query("j13_search_among", VEC + " SELECT vec_id AS memory_id FROM d WHERE vec_id % 7 = 1 ORDER BY s DESC, vec_id LIMIT 10")
def j13_among(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = vectors(spark, sf_dir)
    return R.vector_search(v, q, 10, among=v.filter("memory_id % 7 = 1")).select("memory_id")


ASKED = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))::DOUBLE) AS e FROM embeddings), p AS (SELECT q.vec_id AS query, v.vec_id AS memory_id, list_inner_product(q.e::DOUBLE[], v.e::DOUBLE[]) AS s FROM v q JOIN v ON q.vec_id % 50 = 0{})"


def indexed(spark: SparkSession, sf_dir: str, **how):
    """The nearest ten of the vectors whose id is divisible by 50, by an index over all vectors."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), "embedding")
    index = VectorIndex.build(v, work_path(spark, "vector-index"))
    return index.search(v.filter("memory_id % 50 = 0"), 10, id_col="memory_id", vector="embedding", **how)


@query("o06_index_topk", ASKED.format("") + " SELECT query, memory_id, round(s, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, memory_id) AS k FROM p) WHERE k <= 10")
def o06_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = indexed(spark, sf_dir)
    return found.select("query", F.col("id").alias("memory_id"), rounded("score").alias("score"))


@query("j13_index_among", ASKED.format(" AND v.vec_id % 7 = 1") + " SELECT query, memory_id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, memory_id) AS k FROM p) WHERE k <= 10")
def j13_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = indexed(spark, sf_dir, among=table(spark, sf_dir, "embeddings").select("vec_id").filter("vec_id % 7 = 1"))
    return found.select("query", F.col("id").alias("memory_id"))


@query("q13_index_build", "SELECT count(*) AS n, round(sum(length(content) * 1e0), 6) + 0.0 AS x FROM (SELECT role || ' ' || text AS content FROM conversations)")
def q13_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import numpy as np

    from tidemill.sources.storage import shared_dir

    s = store(spark, sf_dir)
    index = R.build_index(s, lambda texts: np.array([[len(t), 0.0] for t in texts]), f"{shared_dir(spark)}/tidemill/index-{uuid.uuid4().hex}", dim=2)
    sized = s.select("memory_id", F.length(R.searchable(s.columns)).alias("n"))
    joined = index.join(sized, "memory_id")
    return joined.agg(F.count("*").alias("n"), rounded(F.sum(F.round(A.l2_normalize(F.col("embedding").cast("array<double>"))[0]) * F.col("n"))).alias("x"))
