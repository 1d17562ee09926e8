"""Traces, variants, maps and other small operators on odd rows."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemill.functions import text as T
from tidemill.functions import tool_parsers as P
from tidemill.operators import balance as W
from tidemill.operators import batch as B
from tidemill.operators import traces
from tidemill.plans import cases as C
from tidemill.sources import datasets as D


@pytest.mark.parametrize("trace,want", C.TRACES)
def test_traces(trace, want):
    try:
        found = json.dumps(traces.check_trace(json.loads(trace.replace("{N}", "12"))))
    except (ValueError, RecursionError):
        found = ""
    assert found == want.replace("{N}", "12")


def test_traces_without_inspection_and_null(spark):
    with pytest.raises(traces.InvalidTraceError):
        traces.check_trace([{"tool": "INSPECT_RAW"}], inspect=False)
    df = spark.createDataFrame([(None,), ('[{"tool": "TOPK", "k": 9}]',)], "t string").select(traces.checked(F.col("t"), max_top_k=5).alias("c"))
    assert {tuple(r["c"]) for r in df.collect()} == {(False, "no JSON", None), (False, "TOPK can't have that k", None)}


def test_query_variants_of_a_column(spark):
    texts = [None, "", "  ", "one two", "a b c. d e f! no? x y z", "a b c. a b c.", "中文 字。另一句话。ok", "l1 a b\n\nl2 a b\r\n - l3 a b", "x. " * 20 + "a b c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.query_variants_of(F.col("t")).alias("v"))
    for r in df.collect():
        assert r["v"] == T.query_variants(r["t"]), r["t"]


def test_maps_columns_and_ids(spark):
    df = spark.createDataFrame([(1, {"a": 1, "b": None}, {"b": None, "c": 3}), (2, {}, {"x": 1})], "k int, a map<string,int>, b map<string,int>")
    assert [r["m"] for r in df.select(B.merge_maps("a", "b").alias("m")).collect()] == [{"a": 1, "b": None, "c": 3}, {"x": 1}]
    with pytest.raises(PySparkException):
        spark.createDataFrame([({"a": 1}, {"a": 2})], "a map<string,int>, b map<string,int>").select(B.merge_maps("a", "b")).collect()
    rows = spark.createDataFrame([(0, "g", 1, "x"), (1, "h", 2, "y"), (2, "g", 3, None)], "row_id long, by string, o int, r string")
    assert {r["by"]: (r["o"], r["r"]) for r in B.to_columns(rows, "by", ["o", "r"]).collect()} == {"g": ([1, 3], ["x", None]), "h": ([2], ["y"])}
    ids = spark.createDataFrame([([[1, 2]],), ([],)], "x array<array<int>>")
    assert [r["i"] for r in ids.select(D.flat_ids_of(ids, "x").alias("i")).collect()] == [[1, 2], []]
    with pytest.raises(PySparkException):
        many = spark.createDataFrame([([[1], [2]],)], "x array<array<int>>")
        many.select(D.flat_ids_of(many, "x")).collect()
    n = spark.range(1, 40).select("id", W.batch_multiple_of(F.col("id"), [F.lit(6), F.col("id") % 5 + 1]).alias("m"))
    assert all(r["m"] == W.batch_multiple(r["id"], [6, r["id"] % 5 + 1]) for r in n.collect())


DEEP = "[" * 200_000


@pytest.mark.parametrize("parser,text", [
    ("hermes", "<tool_call>" + DEEP + "</tool_call>"), ("glm", "<tool_call>f<arg_key>x</arg_key><arg_value>" + DEEP + "</arg_value></tool_call>"),
    ("kimi", C.K + "<|tool_call_begin|>f<|tool_call_argument_begin|>" + DEEP + "<|tool_call_end|>"), ("seed", "<seed:tool_call><function=f><parameter=s>" + DEEP + "</parameter></function></seed:tool_call>"),
    ("minimax", '<minimax:tool_call><invoke name="f"><parameter name="s">' + DEEP + "</parameter></invoke></minimax:tool_call>"), ("qwen3_coder", C.Q + "<parameter=o>" + DEEP + "</parameter></function></tool_call>"),
    ("gemma4", "<|tool_call>call:f{x:" + DEEP + "}<tool_call|>"), ("gpt-oss", "<|start|>assistant<|channel|>c to=functions.f <|constrain|>json<|message|>" + DEEP + "<|call|>"),
])
def test_deep_and_long_texts(parser, text):
    content, calls = P.PARSERS[parser](text, C.TOOLS.get(parser))
    for _, arguments in calls:
        if parser != "gpt-oss":  # which gives arguments as they stand
            json.loads(arguments)
    long = "word " * 1_000_000 + text + " word" * 100
    assert P.PARSERS[parser](long, C.TOOLS.get(parser))[1] == calls


def test_arguments_are_json_for_any_reader():
    def strict(text):
        return json.loads(text, parse_constant=lambda x: pytest.fail(x))

    for name in C.RENDER:
        for text, _, _ in C.parser_cases(name):
            for _, arguments in P.PARSERS[name](text, C.TOOLS.get(name))[1]:
                if name != "gpt-oss":
                    strict(arguments.replace("{N}", "1"))


def test_call_rows_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "n", '<tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call>'), (2, "m", None)], "place int, name string, t string")
    out = P.explode_calls(df, "t", "hermes")
    assert out.columns == ["place", "name", "t", "_place", "_name", "arguments"]
    assert [(r["place"], r["_place"], r["_name"], r["arguments"]) for r in out.collect()] == [(1, 0, "f", '{"x": 1}')]
