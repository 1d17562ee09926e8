"""Scoring and parsing of answers that are made from documents' texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.functions import text as T
from tidemill.functions.tool_parsers import PARSERS, explode_calls, parse_calls, register_call_rows
from tidemill.operators import metrics as M
from tidemill.operators import rewards as R
from tidemill.plans import cases as C
from tidemill.plans.catalog import query
from tidemill.plans.fixtures import TOKENS, per_token, rounded, table, trajectories


def docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *columns)


#: Answers: every third document has a right number, every third a wrong one, the rest none.
ANSWER = "CASE doc_id % 3 WHEN 0 THEN text || ' #### ' || CAST(n_chars AS VARCHAR) WHEN 1 THEN text || ' #### 1,' || CAST(n_chars AS VARCHAR) ELSE text END"


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars").cast("string")
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" #### "), n)).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" #### 1,"), n)).otherwise(F.col("text"))
    return docs(spark, sf_dir, "text", "n_chars", "source").withColumn("answer", answer)


STRICT = f"regexp_replace(regexp_extract_all(right({ANSWER}, 300), '#### (\\-?[0-9\\.\\,]+)', 1)[-1], '[,$]', '', 'g')"


@query("e02_strict_number", f"SELECT doc_id, {STRICT} AS found FROM documents")
def e02_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered(spark, sf_dir).select("doc_id", T.final_number(F.col("answer")).alias("found"))


@query("e03_flexible_number", f"WITH f AS (SELECT doc_id, regexp_extract_all(right({ANSWER}, 300), '(\\-?[0-9\\.\\,]+)', 1) AS x FROM documents) SELECT doc_id, coalesce(list_filter(x, lambda v: v <> '.')[-1], x[1]) AS found FROM f")
def e03_flexible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered(spark, sf_dir).select("doc_id", T.final_number(F.col("answer"), "flexible").alias("found"))


@query("e04_number_score", f"SELECT doc_id, CASE WHEN {STRICT} IS NULL THEN 0 WHEN {STRICT} = CAST(n_chars AS VARCHAR) THEN 1 ELSE 1e-1 END::DOUBLE AS score FROM documents")
def e04_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered(spark, sf_dir).select("doc_id", T.score_number(F.col("answer"), F.col("n_chars").cast("string"), format_score=0.1).alias("score"))


def norm_sql(x: str) -> str:
    """Articles are taken out twice, since a match has the characters beside it and those of neighbours overlap."""
    punct = """[!"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]"""
    article = "(^|[^\\p{L}\\p{N}_])(a|an|the)($|[^\\p{L}\\p{N}_])"
    once = lambda y: f"regexp_replace({y}, '{article}', '\\1 \\3', 'g')"
    bare = f"regexp_replace(lower({x}), '{punct}', '', 'g')"
    return f"trim(regexp_replace({once(once(bare))}, '\\s+', ' ', 'g'))"


@query("e05_normalize_answer", f"SELECT doc_id, {norm_sql('text')} AS answer FROM documents")
def e05_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "text").select("doc_id", T.normalize_answer(F.col("text")).alias("answer"))


#: A document's last 200 characters, without the last of them.
PART = "left(right(text, 200), 199)"


@query("e06_exact_and_containing_match", f"SELECT doc_id, {norm_sql('text')} = {norm_sql("'?! ' || translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '...'")} AS em, {norm_sql('text')} = {norm_sql(PART)} AS part, contains({norm_sql('text')}, {norm_sql(PART)}) AS sub FROM documents")
def e06_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    part = F.left(F.right(t, F.lit(200)), F.lit(199))
    loud = F.concat(F.lit("?! "), F.translate(t, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("..."))
    return docs(spark, sf_dir, "text").select("doc_id", T.exact_match(t, F.array(F.lit("?!"), loud)).alias("em"), T.exact_match(t, F.array(part)).alias("part"), T.contains_match(t, F.array(part)).alias("sub"))


TAGGED = "CASE WHEN doc_id % 4 = 0 THEN 'x <answer> y </answer>' || text || '<answer> ' || source || ' </answer>' WHEN doc_id % 4 = 1 THEN '<answer>' || text || '</answer>' ELSE text END"


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.concat(F.lit("x <answer> y </answer>"), "text", F.lit("<answer> "), "source", F.lit(" </answer>"))
    whole = F.concat(F.lit("<answer>"), "text", F.lit("</answer>"))
    return docs(spark, sf_dir, "text", "source").withColumn("t", F.when(F.col("doc_id") % 4 == 0, last).when(F.col("doc_id") % 4 == 1, whole).otherwise(F.col("text")))


@query("e07_tagged_answer", f"SELECT doc_id, regexp_replace(regexp_extract_all({TAGGED}, '(?s)<answer>(.*?)</answer>', 1)[-1], '^\\s+|\\s+$', '', 'g') AS answer FROM documents")
def e07_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).select("doc_id", T.tagged_answer(F.col("t")).alias("answer"))


def scored(cases: list, score, name: str = "score"):
    """A query of (text, truth) cases with their scores."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.case_table(spark, sf_dir, cases, ("t", "g")).select("doc_id", rounded(score(F.col("t"), F.col("g"))).alias(name))

    return run


SCORE = {"score": (2, "$v::DOUBLE")}
ARRAY = "array<string>"
query("e08_qa_score", C.case_sql(C.ANSWERS, SCORE))(scored(C.ANSWERS, lambda t, g: T.score_qa(t, F.from_json(g, ARRAY), format_score=0.1)))


@query("e09_boxed_answer", C.case_sql(C.BOXED, {"answer": (2, "$v")}))
def e09_boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.case_table(spark, sf_dir, C.BOXED, ("t",)).select("doc_id", T.boxed_answer(F.col("t")).alias("answer"))


#: A box after a document's whole text.
@query("e09_box_after_a_text", "SELECT doc_id, '{' || source || '}' AS answer FROM documents")
def e09_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("text", F.lit(r" \boxed{{"), "source", F.lit("}} end"))
    return docs(spark, sf_dir, "text", "source").select("doc_id", T.boxed_answer(t).alias("answer"))


@query("e10_final_answer", C.case_sql(C.FINAL, {"answer": (2, "$v")}))
def e10_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.case_table(spark, sf_dir, C.FINAL, ("t",)).select("doc_id", T.plain_final(F.col("t")).alias("answer"))


@query("e11_competition_score", C.case_sql(C.COMPETITION, {"score": (2, "split_part($v, '|', 1)::DOUBLE"), "acc": (2, "split_part($v, '|', 1) = '1.0'"), "pred": (2, "split_part($v, '|', 2)")}))
def e11_dapo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.case_table(spark, sf_dir, C.COMPETITION, ("t", "g")).withColumn("s", T.score_dapo(F.col("t"), F.col("g"))).select("doc_id", "s.*")


query("e12_latex_score", C.case_sql(C.LATEX, SCORE))(scored(C.LATEX, T.score_math))
query("e13_stated_score", C.case_sql(C.STATED, SCORE))(scored(C.STATED, T.score_stated))
query("e13_identities", C.case_sql(C.IDENTITIES, SCORE))(scored(C.IDENTITIES, T.score_stated))
query("e14_verified_score", C.case_sql(C.VERIFIED, SCORE))(scored(C.VERIFIED, T.score_verified))
query("e15_geometry_score", C.case_sql(C.GEOMETRY, SCORE))(scored(C.GEOMETRY, T.score_geometry))
query("e16_tool_call_score", C.case_sql(C.TOOL_ANSWERS, SCORE))(scored(C.TOOL_ANSWERS, lambda t, g: T.score_tools(t, g)["score"]))


@query("e18_memory_score", "SELECT doc_id, CASE WHEN quality IS NOT NULL THEN quality WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END::DOUBLE AS score FROM documents LEFT JOIN labels USING (doc_id)")
def e18_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = docs(spark, sf_dir, "text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    null = F.lit(None)
    return joined.select("doc_id", T.score_memory(F.col("quality"), null, null, F.col("text"), F.lit(" THE ")).alias("score"))


#: Cases of every kind of source; a QA answer without a match scores 0 with the router's defaults.
ROUTED = [
    *[("numina_cn_k12", *c) for c in C.STATED],
    *[("HuggingFaceH4/MATH-500", *c) for c in C.LATEX], *[("aime_2024", t, g, r.split("|")[0]) for t, g, r in C.COMPETITION], *[("math_dapo", t, g, r.split("|")[0]) for t, g, r in C.COMPETITION], *[("hiyouga/geometry3k", *c) for c in C.GEOMETRY],
    *[("searchR1_nq", t, g, "0.0" if r == "0.1" else r) for t, g, r in C.ANSWERS], *[("openai/gsm8k", t, "{N}", r) for t, r in (("#### {N}", "1.0"), ("#### 1\n#### {N}", "1.0"), ("{N}", "0.0"), ("#### ${N}", "0.0"), ("#### {N},", "1.0"), ("", "0.0"))],
]


@query("e01_score_router", C.case_sql(ROUTED, {"score": (3, "$v::DOUBLE")}))
def e01_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = C.case_table(spark, sf_dir, ROUTED, ("source", "t", "g"))
    return cases.select("doc_id", rounded(T.score_by_source(F.col("source"), F.col("t"), F.col("g"))).alias("score"))


query("e19_batched_scorer", C.case_sql(C.LATEX, SCORE))(scored(C.LATEX, lambda t, g: T.custom_scorer(lambda a, b: float(bool(a) and T.same_latex(T.last_box(a), b)), t, g)))


def _parser(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parsed = C.case_table(spark, sf_dir, C.parser_cases(name), ("t",)).withColumn("p", parse_calls(F.col("t"), name, C.TOOLS.get(name)))
        return parsed.select("doc_id", "p.content", F.concat_ws(";", F.transform("p.calls", lambda c: F.concat(c["name"], c["arguments"]))).alias("calls"))

    return run


for _letter, _name in zip("abcdefgh", C.RENDER, strict=True):
    query(f"e20{_letter}_parse_{_name.replace('-', '_')}", C.case_sql(C.parser_cases(_name), {"content": (1, "$v"), "calls": (2, "$v")}))(_parser(_name))


def _call_rows(name: str):
    """The calls of every text as rows, by a parser's table function from SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        function = register_call_rows(spark, name, tools=C.TOOLS.get(name))
        cases = C.case_table(spark, sf_dir, C.call_cases(name), ("t",))
        return spark.sql(f"SELECT doc_id, place, name, arguments FROM {{cases}}, LATERAL {function}(t)", cases=cases)

    return run


for _letter, _name in zip("abcdefgh", C.RENDER, strict=True):
    query(f"h11{_letter}_rows_{_name.replace('-', '_')}", C.call_rows_sql(C.call_cases(_name)))(_call_rows(_name))


def _lines(text: str, tools: list[dict] | None = None) -> tuple[str, list[tuple[str, str]]]:
    """A parser of one's own: each line is a call of its first word, with its length."""
    return "", [(line.split(" ")[0], f'{{"length": {len(line)}}}') for line in text.split("\n")]


@query("h11_own_parser", """SELECT doc_id, CAST(k - 1 AS INT) AS place, split_part(l[k], ' ', 1) AS name, '{"length": ' || length(l[k]) || '}' AS arguments FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), range(1, 100000) r(k) WHERE k <= len(l)""")
def h11_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    if "lines" not in PARSERS:
        PARSERS.register("lines")(_lines)
    return explode_calls(docs(spark, sf_dir, "text"), "text", "lines").drop("text")


@query("e21_retrieval_tokens", "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n, regexp_extract_all(lower(text), '[a-z0-9]+')[1] AS first FROM documents")
def e21_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = T.retrieval_tokens(F.col("text"))
    return docs(spark, sf_dir, "text").select("doc_id", F.size(tokens).cast("long").alias("n"), F.try_element_at(tokens, F.lit(1)).alias("first"))


@query("e23_media_segments", C.case_sql(C.SEGMENTS, {"parts": (2, "$v")}))
def e23_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.transform(T.media_segments(F.col("t")), lambda s: F.concat(s["type"], F.lit(":"), F.coalesce(s["text"], F.lit(""))))
    return C.case_table(spark, sf_dir, C.SEGMENTS, ("t",)).select("doc_id", F.array_join(parts, ",").alias("parts"))


@query("e25_clean_choice", "SELECT doc_id, source || '. go on now' AS t FROM documents")
def e25_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "source").select("doc_id", T.clean_choice(F.concat(F.lit("  "), "source", F.lit(" [title]go [header] on now "))).alias("t"))


@query("e27_clip", "SELECT doc_id, substr(text, 1, 40) AS t FROM documents")
def e27_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "text").select("doc_id", T.clipped(F.col("text"), 40).alias("t"))


@query("e33_preview", "SELECT doc_id, CASE WHEN length(text) > 40 THEN rtrim(substr(text, 1, 40)) || '...(truncated)' ELSE text END AS t FROM documents")
def e33_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "text").select("doc_id", T.preview(F.col("text"), 40).alias("t"))


@query("u03_multiset_jaccard", "SELECT doc_id, round(CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 5e-1 ELSE 0 END, 6) + 0.0 AS j FROM documents")
def u03_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.array(*map(F.lit, "aab")), F.when(F.col("doc_id") % 3 == 0, F.array(*map(F.lit, "baa"))).when(F.col("doc_id") % 3 == 1, F.array(*map(F.lit, "abc"))).otherwise(F.array().cast("array<string>"))
    return docs(spark, sf_dir).select("doc_id", rounded(A.multiset_jaccard(a, b).cast("double")).alias("j"))


@query("u05_first_seen", "SELECT doc_id, source || ',b,' || lang AS d FROM documents")
def u05_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "source", "lang").select("doc_id", F.array_join(A.first_seen(F.array("source", F.lit("b"), "source", "lang", F.lit("x")), 3), ",").alias("d"))


# Token arrays
@query("x01_eos_mask", TOKENS + " SELECT row_id, pos, CASE WHEN pos <= coalesce((SELECT min(x.pos) FROM tok x WHERE x.row_id = tok.row_id AND x.expert = 3), 1000000) THEN 1 ELSE 0 END AS m FROM tok")
def x01_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_token(trajectories(spark, sf_dir, columns=("expert",)).withColumn("m", A.eos_mask("expert", 3)), m="m")


@query("x02_tail", TOKENS + ", l AS (SELECT row_id, max(pos) + 1 AS t FROM tok GROUP BY row_id) SELECT row_id, CAST(pos - greatest(t - 3, 0) AS INT) AS pos, token_id FROM tok JOIN l USING (row_id) WHERE pos >= t - 3")
def x02_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_token(trajectories(spark, sf_dir, columns=("token_id",)).withColumn("x", A.tail("token_id", 3)), token_id="x")


def fitted_sql(cut: str) -> str:
    """Arrays of exactly 4: left-padded with -1, longer ones cut; positions by place."""
    return TOKENS + f""", l AS (SELECT row_id, max(pos) + 1 AS t FROM tok GROUP BY row_id), g AS (SELECT row_id, t, CAST(i AS INT) AS i FROM l, range(4) r(i))
    SELECT g.row_id, g.i AS pos, coalesce(tok.token_id, -1) AS x FROM g LEFT JOIN tok ON tok.row_id = g.row_id AND tok.pos = CASE WHEN t <= 4 THEN g.i - (4 - t) ELSE {cut} END"""


for _how, _cut in (("left", "t - 4 + g.i"), ("right", "g.i"), ("middle", "CASE WHEN g.i < 2 THEN g.i ELSE t - 4 + g.i END")):

    def _fit(how: str):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return per_token(trajectories(spark, sf_dir, columns=("token_id",)).withColumn("x", A.fit_length("token_id", 4, F.lit(-1), how)), x="x")

        return run

    query(f"x05_fit_{_how}", fitted_sql(_cut))(_fit(_how))


@query("x03_pad", TOKENS + ", l AS (SELECT row_id, greatest(count(*), 5) AS t FROM tok GROUP BY row_id) SELECT l.row_id, CAST(i AS INT) AS pos, coalesce(token_id, 0) AS x FROM l, range(100) r(i) LEFT JOIN tok ON tok.row_id = l.row_id AND tok.pos = i WHERE i < t")
def x03_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_token(trajectories(spark, sf_dir, columns=("token_id",)).withColumn("x", A.pad("token_id", 5, F.lit(0))), x="x")


@query("x08_lengths", TOKENS + " SELECT row_id, n, t FROM seq")
def x08_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories(spark, sf_dir, columns=("response_mask",)).select("row_id", A.mask_count("response_mask").cast("long").alias("n"), F.size("response_mask").cast("long").alias("t"))


@query("x09_lengths_to_mask", TOKENS + " SELECT row_id, CAST(i AS INT) AS pos, CASE WHEN i < n THEN 1 ELSE 0 END AS m FROM seq, range(8) r(i)")
def x09_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_token(trajectories(spark, sf_dir, columns=("response_mask",)).withColumn("m", A.lengths_to_mask(A.mask_count("response_mask"), 8)), m="m")


@query("x10_l2_normalize", "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT vec_id, CAST(pos AS INT) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) + 0.0 AS x FROM e")
def x10_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).withColumn("x", A.l2_normalize("e"))
    return per_token(df, keep=("vec_id",), x="x")


@query("x12_temperature", TOKENS + " SELECT row_id, pos, round(vals / 7e-1, 6) + 0.0 AS x FROM tok")
def x12_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_token(trajectories(spark, sf_dir, columns=("vals",)).withColumn("x", A.temperature("vals", 0.7)), x="x")


@query("x17_reward_placement", TOKENS + " SELECT row_id, CAST(i AS INT) AS pos, round(CASE WHEN i = n - 1 THEN s ELSE 0 END, 6) + 0.0 AS r FROM seq, range(100) x(i) WHERE i < n")
def x17_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=("rewards", "response_mask"))
    return per_token(df.withColumn("r", A.place_reward(A.array_sum("rewards"), A.mask_count("response_mask").cast("int"))), r="r")


@query("x18_assembly", TOKENS + " SELECT row_id, CAST(i AS INT) AS pos, round(CASE WHEN i = t - 1 THEN s ELSE 0 END, 6) + 0.0 AS r FROM seq, range(100) x(i) WHERE i < t")
def x18_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=("rewards",)).withColumns({"score": A.array_sum("rewards"), "response_length": F.size("rewards")})
    return per_token(R.assemble(df), r="rm_scores")


# Reward managers
@query("m01_naive_manager", f"SELECT doc_id AS row_id, CASE WHEN {STRICT} = CAST(n_chars AS VARCHAR) THEN 1 ELSE 0 END::DOUBLE AS score, doc_id % 5 AS n FROM documents")
def m01_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = answered(spark, sf_dir).withColumns({"row_id": F.col("doc_id"), "response_length": F.col("doc_id") % 5})
    out = R.naive(df, T.score_number(F.col("answer"), F.col("n_chars").cast("string")))
    return out.select("row_id", F.col("reward_score").alias("score"), F.size("rewards").cast("long").alias("n"))


@query("m02_dapo_overlong", "SELECT o_orderkey AS row_id, round(1 + least(-((o_orderkey % 100) - 60) / 4e1 * 5e-1, 0), 6) + 0.0 AS score FROM orders")
def m02_dapo(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderkey") % 100).alias("response_length"))
    return R.dapo(df, F.lit(1.0), longest=100, buffer=40, factor=0.5).select("row_id", rounded("reward_score").alias("score"))


@query("m05_gdpo_components", "SELECT o_orderkey AS row_id, (o_orderkey % 2)::DOUBLE AS format, (o_custkey % 3)::DOUBLE AS accuracy, (o_orderkey % 2 + o_custkey % 3)::DOUBLE AS score FROM orders")
def m05_gdpo(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey", F.lit(2).alias("response_length"))
    out = R.gdpo(df, {"format": (F.col("row_id") % 2).cast("double"), "accuracy": (F.col("o_custkey") % 3).cast("double")})
    return out.select("row_id", "format", "accuracy", F.col("reward_score").alias("score"))


@query("m06_rate_limited", "SELECT CAST(r_regionkey AS BIGINT) AS row_id, CASE WHEN r_regionkey = 2 THEN 0 ELSE r_regionkey END::DOUBLE AS score, CASE WHEN r_regionkey = 2 THEN 'ZeroDivisionError' END AS error FROM region")
def m06_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("row_id"))
    return R.rate_limited(df, lambda row: row["row_id"] + 0 / (row["row_id"] - 2), per_second=1000.0).select("row_id", F.col("reward_score").alias("score"), "error")


@query("m06_three_limits", "SELECT n_nationkey::BIGINT AS row_id, CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE n_nationkey END::DOUBLE AS score, CASE WHEN n_nationkey % 5 = 0 THEN 'timeout' END AS error FROM nation")
def m06_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls at once, requests and tokens a minute, and calls that hang."""

    def judge(row: dict) -> float:
        import time

        if row["row_id"] % 5 == 0:
            time.sleep(60)
        return row["row_id"]

    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row_id"))
    out = R.rate_limited(df, judge, requests_per_minute=6000, tokens_per_minute=600_000, tokens=lambda row: 10 + row["row_id"], max_concurrent=4, timeout=0.5)
    return out.select("row_id", F.col("reward_score").alias("score"), "error")


@query("m09_passthrough", TOKENS + " SELECT row_id, pos, round(rewards, 6) + 0.0 AS r FROM tok")
def m09_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir, columns=("rewards",)).withColumn("rm_scores", F.col("rewards"))
    return per_token(R.passthrough(df), r="rewards")


@query("g25_mean_of_means", f"SELECT source, round(avg(CASE WHEN {STRICT} = CAST(n_chars AS VARCHAR) THEN 1 ELSE 0 END), 6) + 0.0 AS test_score, count(*) AS n FROM documents GROUP BY source")
def g25_mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = answered(spark, sf_dir).withColumn("scores", F.array(T.score_number(F.col("answer"), F.col("n_chars").cast("string"))))
    return M.mean_by_source(scored, source="source").select("source", rounded("test_score").alias("test_score"), "n")
