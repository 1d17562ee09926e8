"""Datasets, joins by key, assembly of training rows, and round trips through sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.operators import estimators as E
from tidemill.operators.batch import merge_maps
from tidemill.operators.sampling import present_fields
from tidemill.plans.catalog import query
from tidemill.plans.fixtures import TOKENS, per_token, rounded, table, trajectories
from tidemill.sources import datasets as D
from tidemill.sources import files
from tidemill.sources import keyvalue as KV
from tidemill.sources.storage import shared_dir


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemill/{name}-{uuid.uuid4().hex}"


@query("s01_parquet_scan", "SELECT doc_id, lang FROM documents WHERE n_chars > 500 UNION ALL SELECT doc_id, lang FROM documents WHERE n_chars > 500")
def s01_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    return D.scan(spark, [path, path]).filter("n_chars > 500").select("doc_id", "lang")


@query("s02_json_scan", "SELECT item_id, text FROM benchmark")
def s02_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "bench") + ".jsonl"
    table(spark, sf_dir, "benchmark").write.json(path)
    return D.scan(spark, path, "item_id long, text string")


@query("s03_message_scan", "SELECT count(*) AS n, sum(c)::BIGINT AS turns FROM (SELECT count(*) AS c FROM conversations GROUP BY conv_id)")
def s03_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "sft") + ".parquet"
    conversations = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    conversations.write.parquet(path)
    return D.scan_messages(spark, path).agg(F.count("*").alias("n"), F.sum(F.size("messages")).alias("turns"))


@query("s04_preference_scan", "SELECT text AS prompt, lang AS chosen, source AS rejected FROM documents")
def s04_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.scan_pairs(spark, f"{sf_dir}/documents.parquet", prompt="text", chosen="lang", rejected="source")


SCENARIOS = """WITH d AS (SELECT conv_id, turn, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)"""


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.struct(F.col("turn").alias("round"), F.col("text").alias("user"), F.col("role").alias("assistant"), F.when(F.col("turn") % 3 == 0, F.array(F.lit("p.png"))).otherwise(F.array().cast("array<string>")).alias("images"))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("d"))
    session = F.struct(F.lit("s").alias("session_id"), F.lit("2026-01-01").alias("date"), F.col("d").alias("dialogues"))
    qa = F.struct(F.lit("q?").alias("question"), F.lit("a").alias("answer"), F.array(F.lit("s:0"), F.lit("s:1")).alias("clues"))
    return grouped.select(F.concat(F.lit("c"), F.col("conv_id")).alias("scenario"), F.array(session).alias("sessions"), F.array(qa, qa).alias("qas"))


@query("s06_nested_scenarios", SCENARIOS + " SELECT 'txt:c' || conv_id || ':s:' || turn AS memory_id, '2026-01-01T' || lpad(CAST(k AS VARCHAR), 4, '0') AS timestamp, CAST(k AS INT) AS turn_index FROM d UNION ALL SELECT 'img:c' || conv_id || ':s:' || turn || ':0', '2026-01-01T' || lpad(CAST(k AS VARCHAR), 4, '0'), CAST(k AS INT) FROM d WHERE turn % 3 = 0")
def s06_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.scenario_records(scenarios(spark, sf_dir)).select("memory_id", "timestamp", "turn_index")


@query("s07_questions", "SELECT 'c' || conv_id AS scenario, CAST(i AS INT) AS qa_id, 'c' || conv_id || ':s:1' AS clue FROM (SELECT DISTINCT conv_id FROM conversations), range(2) r(i)")
def s07_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.questions(scenarios(spark, sf_dir)).select("scenario", "qa_id", F.element_at("turn_ids", 2).alias("clue"))


@query("s12_read_keys", "SELECT o_orderkey AS traj_key, o_totalprice AS price FROM orders WHERE o_custkey % 7 = 0")
def s12_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("traj_key"), F.col("o_totalprice").alias("price"), "o_orderstatus")
    keys = table(spark, sf_dir, "orders").filter("o_custkey % 7 = 0").select(F.col("o_orderkey").alias("traj_key"), F.col("o_orderkey").alias("ord"))
    return D.read_keys(values, keys, ["price"]).select("traj_key", "price")


@query("s12_keyvalue_source", "SELECT o_orderkey AS traj_key, CASE WHEN o_custkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END AS price, CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority END AS prio FROM orders WHERE o_custkey % 7 = 0")
def s12_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders put into the store, fields of a third of the customers put later, two of four fields read back."""
    orders, path = table(spark, sf_dir, "orders"), fresh(spark, "keyvalue")
    KV.put(orders.select(F.col("o_orderkey").alias("traj_key"), F.col("o_custkey").alias("uid"), F.col("o_totalprice").alias("price"), "o_orderstatus"), path, key="traj_key", buckets=8)
    KV.put(orders.filter("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("traj_key"), (-F.col("o_totalprice")).alias("price"), F.col("o_orderpriority").alias("prio")), path, key="traj_key")
    return KV.get(spark, path, "traj_key long, uid long, price double, prio string", key="traj_key").filter("uid % 7 = 0").drop("uid")


@query("s12_some_keys", "SELECT o_orderkey AS traj_key, o_totalprice AS price FROM orders WHERE o_orderkey IN (1, 2, 3, 32, 33, 34)")
def s12_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few keys: only their buckets are read."""
    path = fresh(spark, "keyvalue")
    KV.put(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("traj_key"), F.col("o_totalprice").alias("price")), path, key="traj_key", buckets=16)
    return KV.get(spark, path, "traj_key long, price double", key="traj_key").filter(F.col("traj_key").isin(1, 2, 3, 32, 33, 34))


@query("s13_list_keys", "SELECT o_orderpriority AS partition_id, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def s13_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.list_keys(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("partition_id"), F.col("o_orderstatus").alias("status")))


@query("s14_snapshot_choice", "SELECT max(o_orderkey % 50) AS step FROM orders WHERE o_orderkey % 50 % 4 = 0 AND o_orderkey % 50 <= 30")
def s14_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.snapshot_for(table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("step")).filter("step % 4 = 0"), 30)


@query("k01_save_and_load", "SELECT c_custkey, c_name, 'v1' AS tag FROM customer")
def k01_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "batch")
    D.save(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), path, {"tag": "v1"})
    df, meta = D.load(spark, path)
    return df.withColumn("tag", F.lit(meta["tag"]))


@query("k02_wire_round_trip", "SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem")
def k02_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    return D.from_messages(D.wire_messages(lines, 1000), lines.schema)


@query("k02_wire_of_a_small_batch", "SELECT n_nationkey, n_name FROM nation")
def k02_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.from_wire(spark, D.to_wire(table(spark, sf_dir, "nation").select("n_nationkey", "n_name")))


@query("k03_generations_dump", "SELECT CAST(s AS INT) AS step, count(*) AS n FROM benchmark, range(2) r(s) GROUP BY s")
def k03_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "generations")
    for step in (0, 1):
        D.dump_generations(table(spark, sf_dir, "benchmark"), path, step)
    return spark.read.schema("item_id long, text string, step int").json(path).groupBy("step").agg(F.count("*").alias("n"))


@query("k05_split_files", "SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY 1")
def k05_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "splits")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train").alias("split"))
    D.write_splits(docs, path)
    return spark.read.parquet(path).groupBy(F.col("split").cast("string").alias("split")).agg(F.count("*").alias("n"))


@query("k07_supervised_converter", "SELECT item_id, 'FILTER' AS tool FROM benchmark")
def k07_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = fresh(spark, "sft-in"), fresh(spark, "sft-out")
    table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"), F.lit('[{"tool": "filter", "field": "author"}]').alias("actions")).write.json(source)
    D.supervised_file(spark, source, target, "item_id long, question string, actions string")
    return spark.read.parquet(target).select("item_id", F.col("messages")[1]["tool_calls"][0]["name"].alias("tool"))


@query("k10_metric_log", "SELECT CAST(s AS INT) AS step, 'n' AS metric, (SELECT count(*) FROM region)::DOUBLE AS value FROM range(3) r(s)")
def k10_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "metrics")
    for step in range(3):
        D.log_metrics(table(spark, sf_dir, "region").agg(F.count("*").cast("double").alias("value")).select(F.lit("n").alias("metric"), "value"), step, path=path)
    return spark.read.schema("step int, metric string, value double").json(path)


@query("k11_put_and_clear", "SELECT o_orderkey AS traj_key, o_totalprice * 2 AS score FROM orders WHERE o_orderkey % 3 <> 0")
def k11_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("traj_key"), F.col("o_totalprice").alias("price"))
    put = D.put_columns(values, values.select("traj_key", (F.col("price") * 2).alias("score")))
    return D.clear_keys(put, values.filter("traj_key % 3 = 0")).select("traj_key", "score")


@query("k12_resume", "SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS epoch, CAST(month(o_orderdate) AS INT) AS batch FROM orders WHERE year(o_orderdate) > 1994 OR (year(o_orderdate) = 1994 AND month(o_orderdate) > 6)")
def k12_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year of orders is an epoch, a month a batch."""
    batches = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("epoch"), F.month("o_orderdate").alias("batch")).distinct()
    return D.resume_after(batches, 1994, 6)


@query("e24_prompt_rows", "SELECT item_id AS index, 'user' AS role, text || ' Think.' AS content, CAST(length(text) AS VARCHAR) AS truth, 'bench' AS source FROM benchmark")
def e24_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").withColumn("row_id", F.col("item_id"))
    rows = D.prompt_rows(b, source="bench", question=F.col("text"), truth=F.length("text").cast("string"), answer=F.lit("a"), split="train", instruction="Think.")
    return rows.select(F.col("extra_info.index").alias("index"), F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), F.col("reward_model.ground_truth").alias("truth"), F.col("data_source").alias("source"))


@query("e26_search_rows", "SELECT item_id AS index, 'searchR1_nq' AS source, CASE WHEN item_id % 2 = 0 THEN 'gold' ELSE 'other' END AS gold FROM benchmark")
def e26_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "struct<ground_truth: struct<target: array<string>>>"
    rm = F.when(F.col("item_id") % 2 == 0, F.struct(F.struct(F.array(F.lit("gold")).alias("target")).alias("ground_truth"))).cast(kind)
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), F.col("text").alias("question"), F.lit("nq").alias("data_source"), rm.alias("reward_model"), F.array(F.lit("other")).alias("golden_answers"))
    rows = D.search_rows(b, split="train", prefix="Q: ", system="s")
    return rows.select(F.col("extra_info.index").alias("index"), F.col("data_source").alias("source"), F.col("reward_model.ground_truth.target")[0].alias("gold"))


@query("e30_tool_rows", "SELECT item_id AS index, length(text)::BIGINT AS kw, 'system' AS role FROM benchmark")
def e30_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").withColumn("row_id", F.col("item_id"))
    tools = F.struct(F.length("text").cast("long").alias("n"))
    rows = D.prompt_rows(b, source="b", question=F.col("text"), truth=F.lit("t"), answer=F.lit("a"), split="train", system="sys", tools=tools)
    return rows.select(F.col("extra_info.index").alias("index"), F.col("extra_info.tools_kwargs.n").alias("kw"), F.col("prompt")[0]["role"].alias("role"))


@query("e31_memory_rows", "SELECT count(*) AS samples, sum(n)::BIGINT AS records FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)")
def e31_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    records = c.select(F.col("conv_id").alias("scenario"), F.col("turn").cast("string").alias("timestamp"), F.col("turn").alias("memory_id"), F.col("turn").alias("turn_id"), F.col("text").alias("content"))
    samples = c.select(F.col("conv_id").alias("scenario")).distinct().select("scenario", F.lit("q").alias("question"), F.lit("a").alias("answer"))
    rows = D.memory_rows(samples, records)
    return rows.agg(F.count("*").alias("samples"), F.sum(F.size("extra_info.tools_kwargs.memory.create_kwargs.records")).alias("records"))


@query("e32_actions_to_messages", "SELECT item_id, 'SORT' AS name, '{\"order\":\"desc\"}' AS arguments FROM benchmark")
def e32_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"), F.lit('[{"tool": "sort", "order": "desc"}]').alias("actions"))
    call = F.col("messages")[1]["tool_calls"][0]
    return D.actions_to_messages(b).select("item_id", call["name"].alias("name"), call["arguments"].alias("arguments"))


@query("x13_message_mask", "SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN greatest(len(string_split(text, ' ')) - 2, 0) ELSE 0 END)::BIGINT AS learned, sum(len(string_split(text, ' ')))::BIGINT AS n FROM conversations GROUP BY conv_id")
def x13_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("ids", F.transform(F.split("text", " "), lambda w: F.length(w)))
    rows = D.supervised_rows(turns, header=2)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("conv_id", total("loss_mask").alias("learned"), F.size("input_ids").cast("long").alias("n"))


@query("x14_supervised_rows", "SELECT conv_id, 64::BIGINT AS width, least(64, sum(len(string_split(text, ' '))))::BIGINT AS used FROM conversations GROUP BY conv_id")
def x14_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("ids", F.transform(F.split("text", " "), lambda w: F.length(w)))
    rows = D.supervised_rows(turns, width=64, pad_id=-1)
    return rows.select("conv_id", F.size("input_ids").cast("long").alias("width"), A.mask_count("attention_mask").cast("long").alias("used"))


@query("x15_preference_rows", TOKENS + ", l AS (SELECT row_id, count(*) AS t FROM tok GROUP BY row_id) SELECT l.row_id, CAST(i AS INT) AS pos, CASE WHEN i < t THEN a.token_id WHEN i < 2 * t THEN b.expert WHEN i = 2 * t THEN 99 ELSE 0 END AS x FROM l CROSS JOIN range(6) r(i) JOIN tok a ON a.row_id = l.row_id AND a.pos = CASE WHEN i < t THEN i ELSE 0 END JOIN tok b ON b.row_id = l.row_id AND b.pos = CASE WHEN i >= t AND i < 2 * t THEN i - t ELSE 0 END")
def x15_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=("token_id", "expert", "layer"))
    out = D.preference_rows(df, prompt="token_id", chosen="expert", rejected="layer", width=6, eos=99)
    return per_token(out, x="chosen_input")


@query("u04_distinct_versions", "SELECT count(DISTINCT o_orderkey % 12) AS versions FROM orders")
def u04_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.count_distinct(F.col("o_orderkey") % 12).alias("versions"))


@query("u06_dataset_concat", "SELECT count(*) AS n FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM documents)")
def u06_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    return D.scan(spark, [path, path]).agg(F.count("*").alias("n"))


@query("j02_dict_union", "SELECT o_orderkey, k, v FROM (SELECT o_orderkey, unnest(['status', 'cust', 'prio']) AS k, unnest([o_orderstatus, CAST(o_custkey AS VARCHAR), o_orderpriority]) AS v FROM orders)")
def j02_dicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = F.col("o_custkey").cast("string")
    a = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("cust"), customer)
    b = F.create_map(F.lit("cust"), customer, F.lit("prio"), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(merge_maps(a, b)).alias("k", "v"))


@query("j03_group_broadcast", "SELECT o_orderkey AS row_id, round(avg(o_totalprice / 97003e0) OVER (PARTITION BY o_custkey), 6) + 0.0 AS mean FROM orders")
def j03_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("uid"), "o_totalprice")
    return E.with_group(o, mean=F.avg(F.col("o_totalprice") / 97003.0)).select("row_id", rounded("mean").alias("mean"))


@query("j04_session_to_rows", "SELECT o_orderkey AS row_id, max_by(o_totalprice, o_orderkey) OVER (PARTITION BY o_custkey, o_orderkey // 4) AS last FROM orders")
def j04_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("uid"), F.expr("o_orderkey div 4").alias("session_id"), "o_totalprice")
    last = o.groupBy("uid", "session_id").agg(F.max_by("o_totalprice", "row_id").alias("last"))
    return o.join(last, ["uid", "session_id"]).select("row_id", "last")


@query("j05_key_lookup", "SELECT o_orderkey AS traj_key, o_orderstatus AS status FROM orders WHERE o_orderkey % 11 = 0")
def j05_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("traj_key"), F.col("o_orderstatus").alias("status"))
    keys = values.filter("traj_key % 11 = 0").select("traj_key", F.col("traj_key").alias("ord"))
    return D.read_keys(values, keys, ["status"]).drop("ord")


@query("f09_present_fields", "SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n FROM documents")
def f09_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.create_map(F.lit("a"), F.col("source"), F.lit("b"), F.lit(""), F.lit("c"), F.when(F.col("n_chars") % 2 == 0, F.lit("x")), F.lit("d"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(present_fields(fields)).cast("long").alias("n"))


@query("f08_non_aborted", TOKENS + " SELECT (SELECT count(*) FROM orders) - count(*) AS aborted, round(avg(s), 6) + 0.0 AS mean FROM seq WHERE n > 0")
def f08_aborted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=("rewards", "response_mask"), aborted=True).select(A.mask_count("response_mask").alias("n"), A.array_sum("rewards").alias("s"))
    return df.agg(F.count_if(F.col("n") == 0).alias("aborted"), rounded(F.avg(F.when(F.col("n") != 0, F.col("s")))).alias("mean"))


@query("h05_custom_scorer", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE length(source) * 2 END::DOUBLE AS score FROM documents")
def h05_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.functions.text import custom_scorer

    score = custom_scorer(lambda s, k, factor: len(s) * factor / (1 if k else 0), F.col("source"), F.col("doc_id") % 3 != 0, factor=2)
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score"))


@query("s08_local_copy", "SELECT n_nationkey AS k, n_name AS name, true AS again FROM nation")
def s08_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of the store copied to a local folder once, and read there by the driver."""
    import tempfile

    import pyarrow.parquet as pq

    source, cache = fresh(spark, "staged") + "/nation.parquet", tempfile.mkdtemp(prefix="tidemill-cache-")
    files.copy(spark, f"{sf_dir}/nation.parquet", source)
    first = files.local_copy(spark, source, cache)
    rows = pq.read_table(first, columns=["n_nationkey", "n_name"]).to_pylist()
    again = files.local_copy(spark, source, cache) == first
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"], again) for r in rows], "k long, name string, again boolean")


@query("s09_store_files", "SELECT r_regionkey, r_name, false AS before, true AS made, true AS copied, false AS other FROM region")
def s09_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a file that was copied within the store, and what was there before and after."""
    folder = fresh(spark, "files")
    before, made = files.exists(spark, folder), files.make_dirs(spark, folder)
    files.copy(spark, f"{sf_dir}/region.parquet", f"{folder}/r.parquet")
    found = {"before": before, "made": made, "copied": files.exists(spark, f"{folder}/r.parquet"), "other": files.exists(spark, f"{folder}/s.parquet")}
    return spark.read.parquet(f"{folder}/r.parquet").select("r_regionkey", "r_name", *[F.lit(v).alias(k) for k, v in found.items()])


@query("s11_custom_dataset", "SELECT n_nationkey AS k, n_name AS name FROM nation")
def s11_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.custom_dataset("pkg://tidemill.plans.fixtures", "table", spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))


@query("k04_write_in_background", "SELECT o_orderkey AS k, o_orderstatus AS status FROM orders")
def k04_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "background")
    writing = files.write_in_background(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status")), path)
    writing.result(timeout=600)
    return spark.read.parquet(path)
