"""Further forms of the operators: ragged batches, pivots, registries, managers by name, files and indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.functions import text as T
from tidemill.functions.registry import Registry, load_object
from tidemill.operators import balance as P
from tidemill.operators import batch as B
from tidemill.operators import estimators as E
from tidemill.operators import losses as L
from tidemill.operators import retrieval as R
from tidemill.operators import rewards as M
from tidemill.operators import sampling as S
from tidemill.operators.traces import checked
from tidemill.plans import cases as C
from tidemill.plans.catalog import query
from tidemill.plans.fixtures import TOKENS, per_token, rounded, table, trajectories
from tidemill.plans.queries_batch import ROWS, rows
from tidemill.plans.queries_retrieval import MEM, QUERY, TERMS, store
from tidemill.sources import datasets as D
from tidemill.sources.storage import shared_dir


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemill/{name}-{uuid.uuid4().hex}"


def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories of differing lengths with dense ids."""
    df = trajectories(spark, sf_dir, columns=("token_id",)).select(F.col("row_id").alias("k"), "token_id")
    return B.with_dense_id(df, ["k"])


RAG = TOKENS + ", rg AS (SELECT row_id AS k, dense_rank() OVER (ORDER BY row_id) - 1 AS row_id, pos, token_id FROM tok), rc AS (SELECT count(DISTINCT row_id) AS n FROM tok)"


@query("a20_ragged_concat", RAG + " SELECT row_id, pos, token_id FROM rg UNION ALL SELECT row_id + n, pos, token_id FROM rg, rc")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ragged(spark, sf_dir)
    return per_token(B.concat([df, df]), token_id="token_id")


@query("a21_ragged_chunk", RAG + " SELECT DISTINCT row_id, CAST(row_id // CAST(ceil(n / 4.0) AS BIGINT) AS INT) AS chunk FROM rg, rc")
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.chunk(ragged(spark, sf_dir), 4, padded=True).select("row_id", "chunk")


@query("a22_ragged_gather", RAG + " SELECT CAST(o AS BIGINT) AS row_id, pos, token_id FROM (VALUES (0, 3), (1, 1), (2, 3)) v(o, p) JOIN rg ON rg.row_id = p")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_token(B.gather_list(ragged(spark, sf_dir), [3, 1, 3]), token_id="token_id")


@query("a23_keys_and_pop", ROWS + " SELECT row_id, price FROM b")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.pop(rows(spark, sf_dir), ["price"])[0]


@query("a24_ragged_padding", RAG + " SELECT row_id, pos, token_id FROM rg UNION ALL SELECT n + i, pos, token_id FROM rc, range(4096) r(i) JOIN rg ON rg.row_id = i % (SELECT n FROM rc) WHERE i < (4096 - n % 4096) % 4096")
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_token(B.pad_to_divisor(ragged(spark, sf_dir), 4096)[0], token_id="token_id")


@query("a25_rows_to_columns", "SELECT n_regionkey AS region, string_agg(n_name, ',' ORDER BY n_nationkey) AS names, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS keys FROM nation GROUP BY 1")
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row_id"), F.col("n_regionkey").alias("region"), "n_name", "n_nationkey")
    return B.to_columns(n, "region", ["n_name", "n_nationkey"]).select("region", F.array_join("n_name", ",").alias("names"), F.array_join("n_nationkey", ",").alias("keys"))


@query("a28_dict_of_lists", "SELECT string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation")
def a28(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row_id"), "n_name")
    return B.fold(n, n.count(), ["n_name"]).select(F.array_join("n_name", ",").alias("names"))


@query("a30_flatten_keys", "SELECT n_nationkey AS \"a.b.key\", n_name AS \"a.name\" FROM nation")
def a30(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "nation").select(F.struct(F.struct(F.col("n_nationkey").alias("key")).alias("b"), F.col("n_name").alias("name")).alias("a"))
    return B.flatten_structs(nested)


@query("a31_schema_report", "SELECT column_name AS name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END AS type FROM (SELECT 'vec_id' AS column_name, (SELECT any_value(typeof(vec_id)) FROM embeddings) AS data_type UNION ALL SELECT 'embedding', (SELECT any_value(typeof(embedding)) FROM embeddings) UNION ALL SELECT 'label', (SELECT any_value(typeof(label)) FROM embeddings))")
def a31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(sorted(B.describe(table(spark, sf_dir, "embeddings")).items()), "name string, type string")


@query("b09_ceiling_division", ROWS + " SELECT row_id, CAST(ceil(row_id / 7.0) AS BIGINT) AS x FROM b")
def b09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("row_id", S.evenly(F.col("row_id"), 7).alias("x"))


@query("b12_rank_zero", ROWS + " SELECT row_id, 0 AS worker FROM b")
def b12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.DISPATCH["rank_zero"](rows(spark, sf_dir), 4).select("row_id", "worker")


@query("e22_query_variants", r"""WITH f AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS q FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, q, unnest(string_split_regex(regexp_replace(q, '([.!?。！？])\s+', '\1' || chr(10), 'g'), '[\n\r]+')) AS raw, generate_subscripts(string_split_regex(regexp_replace(q, '([.!?。！？])\s+', '\1' || chr(10), 'g'), '[\n\r]+'), 1) AS i FROM f),
s AS (SELECT doc_id, q, regexp_replace(raw, '^[ \t:-]+|[ \t:-]+$', '', 'g') AS part, i FROM p),
k AS (SELECT doc_id, part, min(i) AS i FROM s WHERE part <> q AND len(regexp_extract_all(lower(part), '[a-z0-9]+|[一-鿿]')) + greatest(len(regexp_extract_all(part, '[一-鿿]')) - 1, 0) >= 3 GROUP BY doc_id, part),
r AS (SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM k)
SELECT doc_id, 0 AS k, sha256(q) AS variant FROM f WHERE q <> '' UNION ALL SELECT doc_id, CAST(k AS INT), sha256(part) FROM r WHERE k < 6""")
def e22(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.query_variants_of(F.col("text"))).alias("k", "q")).select("doc_id", "k", F.sha2("q", 256).alias("variant"))


@query("f12_trace_validation", C.case_sql(C.TRACES, {"valid": (1, "$v <> ''"), "trace": (1, "nullif($v, '')")}))
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.case_table(spark, sf_dir, C.TRACES, ("t",)).select("doc_id", checked(F.col("t")).alias("c")).select("doc_id", "c.valid", "c.trace")


@query("h01_registered_estimator", TOKENS + " SELECT row_id, pos, round(s * response_mask, 6) + 0.0 AS adv FROM tok JOIN seq USING (row_id)")
def h01(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine: Registry = Registry("estimator")
    mine.register("score")(lambda df: E.spread(E.with_score(df), F.col("_s")))
    return per_token(mine["score"](trajectories(spark, sf_dir, columns=("rewards", "response_mask"))), adv="advantages")


@query("h02_registered_loss", TOKENS + " SELECT round(sum(-5e-1 * advantages * log_probs * response_mask) / sum(response_mask), 6) + 0.0 AS loss, round(sum((old_log_probs - log_probs) * response_mask) / sum(response_mask), 6) + 0.0 AS kl FROM tok")
def h02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loss of one's own by its name."""

    @L.POLICY_LOSSES.register("halved")
    def halved(df: DataFrame, cfg: L.LossConfig, mode: str = "token-mean", **batch) -> DataFrame:
        token = lambda t: {"_loss": -0.5 * t["a"] * t["lp"], "_clip": F.lit(0.0), "_kl": t["old"] - t["lp"], "_low": F.lit(0.0)}
        return L.from_tokens(df, token, mode, **batch)

    df = trajectories(spark, sf_dir, columns=("response_mask", "advantages", "log_probs", "old_log_probs"))
    return L.policy_loss(df, "halved").select(rounded("loss").alias("loss"), rounded("kl").alias("kl"))


@query("h04_registered_manager", "SELECT doc_id AS row_id, round(ln(1 + n_chars), 6) + 0.0 AS reward_score, 2 AS tokens FROM documents")
def h04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reward manager of one's own by its name: longer answers are worth more, by their logarithm."""

    if "by_length" not in M.MANAGERS:
        M.MANAGERS.register("by_length")(lambda df, score: M.place(df, F.log1p(score)))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "n_chars", F.lit(2).alias("response_length"))
    scored = M.reward_manager("by_length")(docs, F.col("n_chars"))
    return scored.select("row_id", rounded("reward_score").alias("reward_score"), F.size("rewards").alias("tokens"))


@query("h09_registered_dispatch", ROWS + " SELECT row_id, CAST(row_id % 5 AS INT) AS worker FROM b")
def h09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dispatch mode of one's own: workers take turns."""
    if "in_turns" not in P.DISPATCH:
        P.DISPATCH.register("in_turns")(lambda df, workers: df.withColumn("worker", (F.col("row_id") % workers).cast("int")))
    return P.DISPATCH["in_turns"](rows(spark, sf_dir), 5).select("row_id", "worker")


@query("h06_manager_by_path", "SELECT n_nationkey::BIGINT AS row_id, n_nationkey::DOUBLE AS registered, -n_nationkey::DOUBLE AS loaded FROM nation")
def h06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered reward manager, and one from a file."""
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".py") as f:  # the driver alone reads it
        f.write("from tidemill.operators.rewards import place\n\ndef negated(df, score):\n    return place(df, -score)\n")
        f.flush()
        loaded = M.reward_manager("negated", source="importlib", path=f.name)
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row_id"), F.lit(1).alias("response_length"))
    score = F.col("row_id").cast("double")
    both = M.reward_manager("naive")(df, score).select("row_id", F.col("reward_score").alias("registered"))
    return both.join(loaded(df, score).select("row_id", (F.col("reward_score") + 0.0).alias("loaded")), "row_id")


@query("h07_external_object", "SELECT r_regionkey AS k, r_name AS name FROM region WHERE r_regionkey >= 2")
def h07(spark: SparkSession, sf_dir: str) -> DataFrame:
    at_least = load_object("pkg://operator", "ge")
    return table(spark, sf_dir, "region").filter(at_least(F.col("r_regionkey"), 2)).select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))


@query("h08_custom_sampler", ROWS + " SELECT row_id FROM b WHERE row_id % 10 = 3")
def h08(spark: SparkSession, sf_dir: str) -> DataFrame:
    samplers: Registry = Registry("sampler")
    samplers.register("tenth")(lambda df: df.filter("row_id % 10 = 3"))
    return samplers["tenth"](rows(spark, sf_dir)).select("row_id")


@query("h13_partitioned_function", ROWS + " SELECT CAST(row_id // CAST(ceil(n / 7.0) AS BIGINT) AS INT) AS worker, count(*) AS n FROM b, c GROUP BY 1")
def h13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function that gets each worker's rows; what it gives for padding is dropped."""
    import pandas as pd

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"worker": [int(pdf["worker"].iloc[0])], "n": [int((~pdf["is_padding"]).sum())]})

    return P.DISPATCH["dp_compute"](rows(spark, sf_dir), 7).groupBy("worker").applyInPandas(work, "worker int, n long")


#: Accuracy alone: the score without the point for the format, which an answer gets that has the gold's parts once and in order.
MATCHED = [(t, g, str(round(float(r) - T.tool_shape(t, g), 6))) for t, g, r in C.TOOL_ANSWERS]


@query("j16_greedy_match", C.case_sql(MATCHED, {"score": (2, "$v::DOUBLE")}))
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = C.case_table(spark, sf_dir, MATCHED, ("t", "g"))
    return cases.select("doc_id", rounded(T.score_tools(F.col("t"), F.col("g"))["accuracy_reward"]).alias("score"))


@query("k06_training_rows_written", "SELECT item_id AS index, length(text)::BIGINT AS n FROM benchmark")
def k06(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").withColumn("row_id", F.col("item_id"))
    out = D.prompt_rows(b, source="b", question=F.col("text"), truth=F.lit("t"), answer=F.lit("a"), split="train")
    path = fresh(spark, "rows") + ".jsonl"
    out.write.json(path)
    return D.scan(spark, path, D.PROMPTS).select(F.col("extra_info.index").alias("index"), F.length(F.col("prompt")[0]["content"]).cast("long").alias("n"))


@query("k08_vector_store", "SELECT vec_id AS memory_id, len(embedding)::BIGINT AS dim FROM embeddings")
def k08(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "vectors")
    D.save(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), "embedding"), path, {"dim": 64})
    index, meta = D.load(spark, path)
    return index.filter(F.size("embedding") == meta["dim"]).select("memory_id", F.size("embedding").cast("long").alias("dim"))


@query("k09_metric_fan_out", "SELECT 'a' AS sink, count(*) AS n FROM region UNION ALL SELECT 'b', count(*) FROM region")
def k09(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen: list[tuple[str, int]] = []
    metrics = table(spark, sf_dir, "region").select(F.col("r_name").alias("metric"), F.lit(1.0).alias("value"))
    D.log_metrics(metrics, 3, sinks=[lambda df: seen.append(("a", df.count())), lambda df: seen.append(("b", df.count()))])
    return spark.createDataFrame(seen, "sink string, n long")


@query("l21_fixed_kl", "SELECT row_number() OVER (ORDER BY d) AS step, 2e-1 AS kl_coef FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)")
def l21(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return L.fixed(days.select(F.row_number().over(Window.orderBy("d")).cast("long").alias("step")), start=0.2)


@query("m03_batch_manager", "SELECT doc_id AS row_id, score FROM (" + C.case_sql(C.LATEX, {"score": (2, "$v::DOUBLE")}) + ")")
def m03(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.case_table(spark, sf_dir, C.LATEX, ("t", "g")).withColumnRenamed("doc_id", "row_id").withColumn("response_length", F.lit(2))
    return M.MANAGERS["batch"](docs, T.score_math(F.col("t"), F.col("g"))).select("row_id", F.col("reward_score").alias("score"))


@query("m04_failures_score_zero", "SELECT doc_id AS row_id, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN n_chars WHEN 2 THEN n_chars / 2e0 ELSE 0 END::DOUBLE AS score FROM documents")
def m04(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.lit(2).alias("response_length"), F.when(F.col("doc_id") % 4 < 3, F.col("n_chars").cast("string")).otherwise("no number").alias("n"))
    score = T.custom_scorer(lambda k, n: int(n) / (k % 4), F.col("row_id"), F.col("n"))
    return M.MANAGERS["prime"](docs, score).select("row_id", F.col("reward_score").alias("score"))


@query("m08_memory_manager", "SELECT doc_id AS row_id, coalesce(quality, CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END)::DOUBLE AS score FROM documents LEFT JOIN labels USING (doc_id)")
def m08(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    null = F.lit(None).cast("double")
    df = joined.select(F.col("doc_id").alias("row_id"), F.col("quality").alias("correct"), null.alias("recall"), null.alias("evidence"), F.col("text").alias("answer"), F.lit("the").alias("gold"), F.lit(1).alias("response_length"))
    return M.MANAGERS["opd_mm"](df).select("row_id", F.col("reward_score").alias("score"))


@query("m10_extract_reward", TOKENS + " SELECT row_id, pos, round(rewards, 6) + 0.0 AS r, uid AS extra FROM tok")
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=("rewards",)).withColumns({"rm_scores": F.col("rewards"), "extra": F.col("uid")})
    return per_token(M.passthrough(df, ("extra",)), keep=("row_id", "extra"), r="rewards")


@query("m11_scatter_and_gather", ROWS + " SELECT row_id, round(price * 2, 4) + 0.0 AS score FROM b")
def m11(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = P.DISPATCH["dp_compute_proto"](rows(spark, sf_dir), 6).repartition("worker")
    return P.gather(dealt.withColumn("score", F.col("price") * 2)).select("row_id", (F.round("score", 4) + 0.0).alias("score"))


@query("q11_inspect_raw", MEM + TERMS + ", t AS (SELECT memory_id FROM sc ORDER BY score DESC, timestamp, turn_id, memory_id LIMIT 3) SELECT memory_id, 'INSPECT_RAW' AS source FROM t UNION ALL SELECT memory_id, 'POOL' FROM t")
def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir).withColumn("raw_pointer", F.lit("p.png"))
    look = lambda pool, question: pool.select("memory_id", F.lit(question).alias("content"))
    found = R.run_trace([{"tool": "RETRIEVE", "method": "bm25", "top_k": 3}, {"tool": "INSPECT_RAW", "question": "what"}], QUERY, s, inspect=look)
    return found.evidence.select("memory_id", "source")


@query("s05_line_reader", "SELECT item_id, text FROM benchmark")
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "lines")
    table(spark, sf_dir, "benchmark").write.json(path)
    return D.read_lines(spark, path, "item_id long, text string")


@query("s10_vector_index", "SELECT vec_id AS memory_id FROM embeddings WHERE len(embedding) = 64")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "index")
    table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), "embedding").write.parquet(path)
    return spark.read.parquet(path).filter(F.size("embedding") == 64).select("memory_id")


@query("x04_pad_left", TOKENS + ", l AS (SELECT row_id, count(*) AS t FROM tok GROUP BY row_id), w AS (SELECT row_id, t, greatest(t, 6) AS n FROM l) SELECT w.row_id, CAST(i AS INT) AS pos, coalesce(token_id, -7) AS x FROM w CROSS JOIN range(100) r(i) LEFT JOIN tok ON tok.row_id = w.row_id AND tok.pos = i - (n - t) WHERE i < n")
def x04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_token(trajectories(spark, sf_dir, columns=("token_id",)).withColumn("x", A.pad("token_id", 6, F.lit(-7), left=True)), x="x")


@query("x06_strip_padding", TOKENS + ", l AS (SELECT row_id, count(*) AS t, sum(response_mask) AS n FROM tok GROUP BY row_id) SELECT tok.row_id, CAST(pos - (t - n) AS INT) AS pos, token_id AS x FROM tok JOIN l ON l.row_id = tok.row_id WHERE pos >= t - n")
def x06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_token(trajectories(spark, sf_dir, columns=("token_id", "response_mask")).withColumn("x", A.strip_padding("token_id", "response_mask")), x="x")


@query("x07_clip_by_value", TOKENS + " SELECT row_id, pos, round(greatest(rewards, least(vals, rewards + 1e-1)), 6) + 0.0 AS x FROM tok")
def x07(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=("vals", "rewards"))
    return per_token(df.withColumn("x", A.token_map(lambda v, r: A.clip(v, r, r + 0.1), "vals", "rewards")), x="x")


@query("x16_flat_ids", TOKENS + " SELECT row_id, pos, token_id::BIGINT AS id FROM tok")
def x16(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=("token_id",)).withColumn("out", F.struct(F.array("token_id").alias("input_ids")))
    return per_token(df.withColumn("ids", D.flat_ids_of(df, "out")), id="ids")