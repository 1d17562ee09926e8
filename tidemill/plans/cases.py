"""Texts for parsers and scorers with what they must give, written by hand from the formats.

In texts and results ``{N}`` stands for a document's number of characters and ``{S}`` for its source, so every row differs;
a document takes the case of its id's remainder. ``case_table`` has the texts in Spark, ``case_sql`` the results in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.fixtures import table

Args = list[tuple[str, str]]

#: (before, calls, after): calls of a name and (key, value in JSON).
COMMON: list[tuple[str, list[tuple[str, Args]], str]] = [
    ("ok ", [("f", [("x", "{N}")])], ""),
    ("", [("f", [("s", '"{S}"')])], " after"),
    ("two\n", [("f", [("x", "-{N}")]), ("g", [("s", '"a b"'), ("x", "0")])], "\nend"),
    ("no call, {S}", [], ""),
    ("é ", [("f", [("s", '"naïve 中 {S}"')])], ""),
    ("", [("f", [])], ""),
    ("three ", [("f", [("x", "1")]), ("f", [("x", "2")]), ("f", [("x", "{N}")])], ""),
    ("b ", [("f", [("b", "true"), ("x", "{N}")])], "."),
    ("n ", [("f", [("n", "1.5")])], ""),
    (" lines\n\n", [("g", [("s", '"{S}, {N}"')])], "\n\n"),
    ("false ", [("f", [("b", "false")])], ""),
    ("many ", [("f", [("x", "{N}"), ("s", '"t"'), ("n", "-0.5"), ("b", "true")])], " x"),
]


def _object(args: Args) -> str:
    return "{" + ", ".join(f'"{k}": {v}' for k, v in args) + "}"


def _bare(value: str) -> str:
    return value.strip('"')


RENDER = {
    "hermes": lambda name, args: f'<tool_call>{{"name": "{name}", "arguments": {_object(args)}}}</tool_call>',
    "gpt-oss": lambda name, args: f"<|start|>assistant<|channel|>commentary to=functions.{name} <|constrain|>json<|message|>{_object(args)}<|call|>",
    "qwen3_coder": lambda name, args: f"<tool_call>\n<function={name}>\n" + "".join(f"<parameter={k}>\n{_bare(v)}\n</parameter>\n" for k, v in args) + "</function>\n</tool_call>",
    "glm": lambda name, args: f"<tool_call>{name}\n" + "".join(f"<arg_key>{k}</arg_key>\n<arg_value>{_bare(v)}</arg_value>\n" for k, v in args) + "</tool_call>",
    "seed": lambda name, args: f"<seed:tool_call><function={name}>" + "".join(f"<parameter={k}>{_bare(v)}</parameter>" for k, v in args) + "</function></seed:tool_call>",
    "minimax": lambda name, args: f'<minimax:tool_call>\n<invoke name="{name}">' + "".join(f'<parameter name="{k}">{_bare(v)}</parameter>\n' for k, v in args) + "</invoke>\n</minimax:tool_call>",
    "kimi": lambda name, args: f"<|tool_call_begin|>{name}<|tool_call_argument_begin|>{_object(args)}<|tool_call_end|>",
    "gemma4": lambda name, args: f"<|tool_call>call:{name}{{" + ",".join(f"{k}:" + (f'<|"|>{_bare(v)}<|"|>' if v[0] == '"' else v) for k, v in args) + "}<tool_call|>",
}
KEEPS_AFTER = ("hermes", "gpt-oss")

#: Tools of the formats that look at them: types of parameters, and the parameters that a call must have.
TOOLS = {
    "qwen3_coder": [
        {"name": "f", "parameters": {"x": {"type": "integer"}, "s": {"type": "string"}, "b": {"type": "boolean"}, "n": "number", "i": {"type": "Int32"}, "u": {"type": "uint8"}, "l": {"type": "array"}, "o": {"type": "object"}, "d": {"type": "dict[str, int]"}, "q": {"type": "Numeric"}}},
        {"name": "g", "parameters": {"x": {"type": "long"}, "s": {}}},
    ],
    "kimi": [{"name": "f", "required": ["x"]}, {"name": "g", "required": ["s"]}, {"name": "read_file", "required": ["path", "mode"]}],
}

#: Deeper than any limit of nesting.
DEEP = "[" * 3000
Q, K = "<tool_call><function=f>", "<|tool_calls_section_begin|>"
#: (text, content, calls) of malformed and odd texts of a format.
ODD: dict[str, list[tuple[str, str, str]]] = {
    "hermes": [
        ("d " + "<tool_call>" + DEEP + "{N}</tool_call>", "d ", ""),
        ('<tool_call>{"name": null, "arguments": {}}</tool_call><tool_call>{"name": 5, "arguments": {}}</tool_call><tool_call>{"name": "f", "arguments": {"x": NaN, "y": [-Infinity, {N}]}}</tool_call>', "", 'f{"x": "NaN", "y": ["-Infinity", {N}]}'),
        ("a <tool_call>no json</tool_call> b", "a  b", ""),
        ('a <tool_call>{"name": "f"}</tool_call>', "a ", ""),
        ('a <tool_call>{"name": "f", "arguments": {"x": {N}}}', 'a <tool_call>{"name": "f", "arguments": {"x": {N}}}', ""),
        ('</tool_call> <tool_call>{"name": "f", "arguments": [1]}', '</tool_call> <tool_call>{"name": "f", "arguments": [1]}', ""),
        ('<tool_call>\n{"arguments": {"x": 1e999}, "name": "f"}\n</tool_call>', "", 'f{"x": "1e999"}'),
        ('<tool_call>[1]</tool_call><tool_call>{"name": "{S}", "arguments": null}</tool_call>', "", "{S}null"),
        ('x<tool_call>{"name": "f", "arguments": {"a": [1, {"b": "\\u00e9"}]}}</tool_call>y<tool_call>open', "xy<tool_call>open", 'f{"a": [1, {"b": "é"}]}'),
        ("", "", ""),
    ],
    "gpt-oss": [
        ('<|start|>assistant<|channel|>analysis<|message|>think <|call|> {S}<|end|>ok', "ok", ""),
        ('<|channel|>analysis<|message|>a<|end|><|start|>assistant<|channel|>commentary to=functions.f <|constrain|>json<|message|>{"x": {N}}<|call|>', "", 'f{"x": {N}}'),
        ("<|start|>assistant<|channel|>commentary to=functions.f <|constrain|>json<|message|>not json<|call|>z", "z", "fnot json"),
        ('<|start|>assistant<|channel|>commentary to=functions.f <|constrain|>json<|message|>{"x": 1}', '<|start|>assistant<|channel|>commentary to=functions.f <|constrain|>json<|message|>{"x": 1}', ""),
        ("<|start|>assistant<|channel|>final<|message|>{S}", "<|start|>assistant<|channel|>final<|message|>{S}", ""),
        ("<|channel|>analysis<|message|>open {N}", "<|channel|>analysis<|message|>open {N}", ""),
        ('<|start|>assistant<|channel|>analysis<|message|><|start|>assistant<|channel|>c to=functions.f <|constrain|>json<|message|>{}<|call|><|end|>rest', "rest", ""),
        ("", "", ""),
    ],
    "qwen3_coder": [
        (Q + "<parameter=l>[1e999, {N}]</parameter></function></tool_call>", "", 'f{"l": "[1e999, {N}]"}'),
        (Q + "<parameter=l>{1, 2}</parameter><parameter=o>" + DEEP + "</parameter></function></tool_call>", "", 'f{"l": "{1, 2}", "o": "' + DEEP + '"}'),
        ("a " + Q + "<parameter=x>{N}</parameter>", "a ", 'f{"x": {N}}'),
        ("a " + Q + "<parameter=x>\n{N}\n", "a ", 'f{"x": {N}}'),
        (Q + "<parameter=x>12.5</parameter><parameter=i>{N}</parameter><parameter=u>7</parameter></function></tool_call>", "", 'f{"x": "12.5", "i": {N}, "u": 7}'),
        (Q + "<parameter=n>inf</parameter><parameter=q>1e999</parameter></function></tool_call>", "", 'f{"n": "inf", "q": "1e999"}'),
        (Q + "<parameter=n>nan</parameter><parameter=q>2.0</parameter></function></tool_call>", "", 'f{"n": "nan", "q": 2}'),
        (Q + "<parameter=b>TRUE</parameter><parameter=x>Null</parameter></function></tool_call>", "", 'f{"b": true, "x": null}'),
        (Q + "<parameter=b>maybe</parameter><parameter=s>007</parameter></function></tool_call>", "", 'f{"b": false, "s": "007"}'),
        (Q + "<parameter=l>[1, 'a', None]</parameter><parameter=o>{\"k\": [true]}</parameter></function></tool_call>", "", 'f{"l": [1, "a", null], "o": {"k": [true]}}'),
        (Q + "<parameter=l>[1,</parameter><parameter=d>{'k': 1}</parameter></function></tool_call>", "", 'f{"l": "[1,", "d": {"k": 1}}'),
        (Q + "<parameter=new>{N}</parameter></function></tool_call>", "", 'f{"new": "{N}"}'),
        ("<tool_call><function=unknown><parameter=x>{N}</parameter></function></tool_call>", "", 'unknown{"x": "{N}"}'),
        ("a <tool_call>nothing {S}</tool_call>", "a <tool_call>nothing {S}</tool_call>", ""),
        ("a <tool_call><function=f</function></tool_call>", "a <tool_call><function=f</function></tool_call>", ""),
        ("a <function=f><parameter=x>1</parameter></function>", "a <function=f><parameter=x>1</parameter></function>", ""),
        (Q + "<parameter=s>\n\n  {S}\n\n</parameter></function></tool_call>", "", 'f{"s": "\\n  {S}\\n"}'),
        ("", "", ""),
    ],
    "glm": [
        ("d <tool_call>f<arg_key>x</arg_key><arg_value>" + DEEP + "</arg_value></tool_call>", "d ", 'f{"x": "' + DEEP + '"}'),
        ("<tool_call>f<arg_key>x</arg_key><arg_value>NaN</arg_value><arg_key>y</arg_key><arg_value>[1e400, {N}]</arg_value></tool_call>", "", 'f{"x": "NaN", "y": ["1e400", {N}]}'),
        (" <think>hm</think> so <tool_call>f</tool_call>", " so ", "f{}"),
        ("</think>so <tool_call>f\n<arg_key> x </arg_key> <arg_value> {N} </arg_value></tool_call>", "so ", 'f{"x": {N}}'),
        ("<think>open <tool_call>f</tool_call>", "<think>open ", "f{}"),
        ("a <tool_call>f<arg_key>x</arg_key></tool_call>", "a ", "f{}"),
        ("a <tool_call>f<arg_key>x</arg_key><arg_value>[1, {\"k\": null}]</arg_value></tool_call>", "a ", 'f{"x": [1, {"k": null}]}'),
        ("a <tool_call>f", "a <tool_call>f", ""),
        ("a <tool_call>f<arg_key>x</arg_key><arg_value>{bad</arg_value></tool_call>", "a ", 'f{"x": "{bad"}'),
        ("", "", ""),
    ],
    "seed": [
        ("<seed:tool_call><function=f><parameter=s>" + DEEP + "</parameter></function></seed:tool_call>", "", 'f{"s": "' + DEEP + '"}'),
        ("a <seed:tool_call>nothing</seed:tool_call>", "a ", ""),
        ("a <seed:tool_call><function=f><parameter=x> {N} </parameter></function><function=g></function></seed:tool_call>", "a ", 'f{"x": {N}}'),
        ("a <seed:tool_call><function=f><parameter=x>1</parameter></seed:tool_call>", "a ", ""),
        ("a <seed:tool_call><function=f></function>", "a <seed:tool_call><function=f></function>", ""),
        ("<seed:tool_call><function= f >\n<parameter=s>x y</parameter><parameter=t>1</function></seed:tool_call>", "", 'f{"s": "x y"}'),
        ("<seed:tool_call><function=f><parameter=s>[\"{S}\"]</parameter></function></seed:tool_call>", "", 'f{"s": ["{S}"]}'),
        ("<seed:tool_call><function=f><parameter=s>1e999</parameter></function></seed:tool_call>", "", 'f{"s": "1e999"}'),
        ("", "", ""),
    ],
    "minimax": [
        ('<minimax:tool_call><invoke name="f"><parameter name="s">' + DEEP + '</parameter><parameter name="t">Infinity</parameter></invoke></minimax:tool_call>', "", 'f{"s": "' + DEEP + '", "t": "Infinity"}'),
        ("a <minimax:tool_call>nothing</minimax:tool_call>", "a ", ""),
        ('a <minimax:tool_call><invoke name="f"></invoke><invoke name=" g "><parameter name="x">{N}</parameter></invoke></minimax:tool_call>', "a ", 'f{};g{"x": {N}}'),
        ('a <minimax:tool_call><invoke name="f"><parameter name="x">1</minimax:tool_call>', "a ", ""),
        ('a <minimax:tool_call><invoke name="f"></invoke>', 'a <minimax:tool_call><invoke name="f"></invoke>', ""),
        ('<minimax:tool_call><invoke name="f"><parameter name="s">{bad {S}</parameter></invoke></minimax:tool_call>', "", 'f{"s": "{bad {S}"}'),
        ('<minimax:tool_call><invoke name=f></invoke></minimax:tool_call>', "", ""),
        ('<minimax:tool_call><invoke name="f"><parameter name="s">null</parameter></invoke></minimax:tool_call>', "", 'f{"s": null}'),
        ("", "", ""),
    ],
    "kimi": [
        ("e " + K + "<|tool_call_begin|>g<|tool_call_argument_begin|>" + DEEP + "<|tool_call_end|>", "e ", "g{}"),
        (K + '<|tool_call_begin|>f<|tool_call_argument_begin|>{"x": [1e999, {N}]}<|tool_call_end|>', "", 'f{"x": ["1e999", {N}]}'),
        (K + '<|tool_call_begin|>functions.f:0<|tool_call_argument_begin|>{"z": {N}}<|tool_call_end|>', "", 'f{"z": {N}}'),
        (K + '<|tool_call_begin|>call_7<|tool_call_argument_begin|>{"path": "{S}", "mode": 1}<|tool_call_end|>', "", 'read_file{"path": "{S}", "mode": 1}'),
        ("a " + K + "<|tool_call_begin|>call_8<|tool_call_argument_begin|>no json<|tool_call_end|>", "a ", "call_8{}"),
        (K + "<|tool_call_begin|>call_8<|tool_call_argument_begin|>[1]<|tool_call_end|>", "", "call_8{}"),
        (K + "<|tool_call_begin|>READ-FILE<|tool_call_argument_begin|>{}<|tool_call_end|>", "", "READ-FILE{}"),
        (K + "<|tool_call_begin|>my-read-file<|tool_call_argument_begin|>{}<|tool_call_end|>", "", "my-read-file{}"),
        ("b " + K + "<|tool_call_begin|>g<|tool_call_argument_begin|>{}", "b ", ""),
        ("<|tool_call_begin|>g<|tool_call_argument_begin|>{}<|tool_call_end|>", "<|tool_call_begin|>g<|tool_call_argument_begin|>{}<|tool_call_end|>", ""),
    ],
    "gemma4": [
        ("a <|tool_call>call:f{x:1e999,y:nan,z:{N}}<tool_call|>", "a ", 'f{"x": "1e999", "y": "nan", "z": {N}}'),
        ("a <|tool_call>call:f{x:TRUE,y:Null}<tool_call|>", "a ", 'f{"x": true, "y": null}'),
        ('a <|tool_call>call:f{s:<|"|>a, b: {c}<|"|>,x:{N}}<tool_call|> z', "a ", 'f{"s": "a, b: {c}", "x": {N}}'),
        ("a <|tool_call>call:f{x:word,y: 2 }<tool_call|>", "a ", 'f{"x": "word", "y": 2}'),
        ("a <|tool_call>call:f{x:1}", "a <|tool_call>call:f{x:1}", ""),
        ("a <|tool_call>f{x:1}<tool_call|>", "a <|tool_call>f{x:1}<tool_call|>", ""),
        ("a <|tool_call>call:f{x:inf}<tool_call|>", "a ", 'f{"x": "inf"}'),
        ("a <|tool_call>call:f{x:}<tool_call|>", "a ", 'f{"x": ""}'),
        ("", "", ""),
    ],
}


def parser_cases(name: str) -> list[tuple[str, str, str]]:
    """(text, content, calls) of a format."""
    out = []
    for before, calls, after in COMMON:
        text = before + "".join(RENDER[name](f, args) for f, args in calls) + after
        if name == "kimi" and calls:
            text = before + K + text[len(before) :]
        content = text if not calls else before + after * (name in KEEPS_AFTER)
        out.append((text, content, ";".join(f + _object(args) for f, args in calls)))
    return out + ODD[name]


def call_cases(name: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """(text, calls as (name, arguments)) of a format's well-formed texts."""
    return [(text, [(f, _object(args)) for f, args in calls]) for (text, _, _), (_, calls, _) in zip(parser_cases(name), COMMON, strict=False)]


def call_rows_sql(cases: list[tuple[str, list[tuple[str, str]]]]) -> str:
    """SELECT with doc_id, place, name and arguments: a row for each call of the document's case."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {k}, {quote(f)}, {quote(a)})" for i, (_, calls) in enumerate(cases) for k, (f, a) in enumerate(calls))
    return f"SELECT doc_id, place, name, replace(replace(arguments, '{{N}}', CAST(n_chars AS VARCHAR)), '{{S}}', source) AS arguments FROM documents JOIN (VALUES {values}) AS c(i, place, name, arguments) ON doc_id % {len(cases)} = i"


# Scorers: (text, truth, result) with results as text

BOXED = [
    (r"\boxed{no} then \boxed{{x^{N}}+1} end", "", r"{x^{N}}+1"), (r"\boxed{ {N} }", "", " {N} "), (r"\boxed{}", "", ""), (r"\boxed{a{b}{c{d}}}", "", "a{b}{c{d}}"), ("no box, {S}", "", None), (r"\boxed{open {N}", "", None),
    (r"\boxed{a}\boxed{open", "", None), (r"\boxed 7", "", None), (r"\boxed{\frac{1}{2}} and text}", "", r"\frac{1}{2}"), (r"\fbox{1}\boxed{{S}}", "", "{S}"), ("", "", None), (r"\boxed{é\n}", "", r"é\n"),
]
FINAL = [
    (r"x = $\text{{N}}/2$ dollars", "", "{N}/2"), ("{N}", "", "{N}"), ("1,{N}", "", "1{N}"), ("a = b = 3", "", "3"), (r"\boxed{{N}}", "", "{N}"), (r"\frac12", "", r"\frac{1}{2}"), (r"\sqrt3", "", r"\sqrt{3}"), ("3 degrees", "", "3"), ("an apple", "", "apple"),
    (r"\text{ways} 7", "", r"7"), (r"90^\circ", "", "90"), ("(1,2)", "", "(1,2)"), ("$5$.", "", "5"), (r"\textbf{9}", "", "9"), (r"10\;cm", "", "10"), ("x=-1", "", "-1"), (r"\$ 12", "", "12"), ("", "", ""),
]
#: Texts, truths and scores of competition answers: the score, and the answer read.
COMPETITION = [
    ("So\nAnswer: ${N}$ units", "{N}", "1.0|{N}"), ("answer : {N}", "{N}", "1.0|{N}"), ("Answer: 1\nAnswer: {N}", "{N}", "1.0|{N}"), ("Answer: {N}\nAnswer: no", "{N}", "-1.0|no"), ("no line {N}", "{N}", "-1.0|[INVALID]"), ("", "{N}", "-1.0|[INVALID]"),
    (r"Answer: \boxed{{N}}", "{N}", "1.0|{N}"), ("Answer: x = {N}", "{N}", "1.0|{N}"), (r"Answer: \frac12", r"\frac{1}{2}", r"1.0|\frac{1}{2}"), ("Answer: 1,000", "1000", "1.0|1000"), ("Answer: 0.5", r"\frac{1}{2}", "-1.0|0.5"), ("Answer: 7 inches", "7", "1.0|7"),
]
LATEX = [
    (r"thus $\boxed{\dfrac 12}$", "0.5", "1.0"), (r"\boxed{\frac{1}{3}}", "0.5", "0.0"), (r"\boxed{{N}}", "{N}", "1.0"), (r"\boxed{{N} }", "{N}", "1.0"), (r"\boxed{x={N}}", "{N}", "1.0"), (r"\boxed{90^\circ}", "90", "1.0"), (r"\boxed{50\%}", "50", "1.0"),
    (r"\boxed{.5}", r"\tfrac12", "1.0"), (r"\boxed{1/2}", r"\frac{1}{2}", "1.0"), (r"\boxed{\left(1,2\right)}", "(1,2)", "1.0"), (r"\boxed{3\text{ cm}}", "3", "1.0"), (r"\boxed{\sqrt2}", r"\sqrt{2}", "1.0"), ("no box {N}", "{N}", "0.0"), (r"$\boxed {N}$", "{N}", "1.0"),
    (r"\fbox{{N}}", "{N}", "0.0"), (r"\boxed{open", "open", "0.0"), (r"\boxed{\frac{a}{b}}", r"\dfrac{a}{b}", "1.0"), (r"\boxed{-2}\boxed{{N}}", "-2", "0.0"), ("", "", "0.0"), (r"\boxed{\$5}", "5", "1.0"),
]
GEOMETRY = [
    (r"<think>so</think>it is \boxed{{N}}", "{N}", "1.0"), (r"it is \boxed{{N}}", "{N}", "0.9"), (r"<think>so</think>it is \boxed{no}", "{N}", "0.1"), (r"no", "{N}", "0.0"), (r" <think>so</think>\boxed{{N}}", "{N}", "0.9"), ("<think>a\nb</think>\n\\boxed{ {N} } end", "{N}", "1.0"),
    (r"<think>so \boxed{{N}}", "{N}", "0.9"), (r"<think></think>\boxed{}", "{N}", "0.1"), (r"<think>x</think>{N}", "{N}", "0.0"), ("", "{N}", "0.0"),
]
ANSWERS = [
    ("x <answer>no</answer> <answer> {S} </answer>", '["{S}"]', "1.0"), ("<answer>the {S}!</answer>", '["no", "{S}"]', "1.0"), ("<answer>{S}</answer>", '["{S} and more"]', "0.1"), ("{S}", '["{S}"]', "0.0"), ("", '["{S}"]', "0.0"), ("<answer>{S}", '["{S}"]', "0.0"),
    ("<answer>a\n{S}</answer>", '["A {S}."]', "1.0"), ("<answer></answer>", '["a"]', "1.0"), ("<answer>x</answer>" * 11 + "<answer>{S}</answer>", '["{S}"]', "0.25"), ("<answer>x</answer>" * 9 + "<answer>{S}</answer>", '["{S}"]', "1.0"), ("<answer>{S}</answer><answer>b</answer>", '["{S}"]', "0.1"),
]


M2 = r"\begin{pmatrix} 1 & {N} \\ 3 & 4 \end{pmatrix}"
#: Responses, truths and scores by rules.
STATED = [
    ("The answer is {N}", "{N}", "1.0"), ("So it holds. Answer: {N}.5", "{N}.5", "1.0"), (r"\boxed{50\%}", "0.5", "1.0"), ("answer: 50%", "50", "1.0"), (r"\boxed{\frac{1}{2}}", "0.5", "1.0"), (r"\boxed{\frac{2}{4}}", r"\frac12", "1.0"), (r"\boxed{(1, {N})}", "(1,{N})", "1.0"), (r"\boxed{[1,{N})}", "[1,{N}]", "0.0"),
    (r"\boxed{(1,2)}", "(1,3)", "0.0"), (r"\boxed{\sqrt{4}}", "2", "1.0"), (r"\boxed{2\pi}", "6.2832", "1.0"), (r"\boxed{2\pi}", "6.28", "1.0"), (r"\boxed{2\pi}", "6.3", "0.0"), (r"\boxed{1,000}", "1000", "1.0"), (r"\boxed{3 \times 10^2}", "300", "1.0"), (r"\boxed{x + 1}", "x+1", "1.0"), (r"\boxed{" + M2 + "}", M2.replace(" ", ""), "1.0"),
    (r"\boxed{[[1,{N}],[3,4]]}", M2, "1.0"), (r"\boxed{[[1,{N}],[3,5]]}", M2, "0.0"), ("no idea", "{N}", "0.0"), ("it is {N}. The end", "{N}", "1.0"), ("", "{N}", "0.0"), (r"The answer is -\frac{3}{4}", "-0.75", "1.0"), ("answer: 101_2", "101", "1.0"), ("x is {N} is the answer", "{N}", "1.0"), ("We get 2/4", r"\frac{1}{2}", "1.0"),
    ("answers are 1, 2", "1,2", "1.0"), ("answers are 1, 2", "2,1", "0.0"), ("x = 3.00001", "3", "1.0"), ("x = 3.01", "3", "0.0"), (r"\boxed{1/0}", "1", "0.0"), (r"\boxed{2^{10}}", "1024", "1.0"), (r"\boxed{\text{Yes}}", "yes", "1.0"), (r"\boxed{{N}\text{ cm}}", "{N}", "1.0"), (r"\boxed{(0, \infty)}", r"(0,\infty)", "1.0"),
]

#: Responses, truths and scores of expressions with unknowns.
IDENTITIES = [
    (r"\boxed{x^2-1}", "(x-1)(x+1)", "1.0"), (r"\boxed{x^2+1}", "(x-1)(x+1)", "0.0"), (r"\boxed{(x+{N})^2}", "x^2+2*{N}*x+{N}^2", "1.0"), (r"\boxed{(x+{N})^2}", "x^2+{N}*x+{N}^2", "0.0"), (r"\boxed{\frac{x}{2}}", "0.5x", "1.0"),
    (r"\boxed{\frac{x^2-1}{x-1}}", "x+1", "1.0"), (r"\boxed{\frac{x^2-1}{x-1}}", "x-1", "0.0"), (r"\boxed{(a+b)^3}", "a^3+3a^2b+3ab^2+b^3", "1.0"), (r"\boxed{(a+b)^3}", "a^3+b^3", "0.0"), (r"\boxed{2x+{N}}", "{N}+2x", "1.0"),
    (r"\boxed{\sqrt{x^4}}", "x^2", "1.0"), (r"\boxed{\sqrt{x^2}}", "x", "0.0"), (r"\boxed{|x|}", r"\sqrt{x^2}", "1.0"), (r"\boxed{\frac{1}{\sqrt{x}}}", r"\frac{\sqrt{x}}{x}", "1.0"), (r"\boxed{\sqrt[3]{x^3}}", "x", "1.0"),
    (r"\boxed{\sin^2 x+\cos^2 x}", "1", "1.0"), (r"\boxed{2\sin x\cos x}", r"\sin(2x)", "1.0"), (r"\boxed{\sin x}", r"\cos x", "0.0"), (r"\boxed{\tan x}", r"\frac{\sin x}{\cos x}", "1.0"), (r"\boxed{e^{2x}}", "(e^x)^2", "1.0"),
    (r"\boxed{\ln(x^2)}", r"2\ln x", "1.0"), (r"\boxed{\ln x^2}", r"\ln 2x", "0.0"), (r"\boxed{\log_2 8x}", r"3+\log_2 x", "1.0"), (r"\boxed{2^{x+1}}", r"2\cdot 2^x", "1.0"), (r"\boxed{2^{x+1}}", "2^x+1", "0.0"),
    (r"\boxed{y=2x+{N}}", "2x+{N}", "1.0"), (r"\boxed{f(x)={N}x}", "{N}x", "1.0"),
    (r"\boxed{(1+i)^2}", "2i", "1.0"), (r"\boxed{i^2+{N}+1}", "{N}", "1.0"), (r"\boxed{\frac{\pi r^2}{2}}", r"0.5\pi r^2", "1.0"), (r"\boxed{a_1+a_2}", "a_{2}+a_{1}", "1.0"), (r"\boxed{a_1+a_2}", "a_1+a_3", "0.0"),
    (r"\boxed{(x+1, 2y)}", "(1+x,y+y)", "1.0"), (r"\boxed{(x+1, 2y)}", "(1+x,y)", "0.0"), (r"\boxed{\frac{10}{x}}", "10x^{-1}", "1.0"), (r"\boxed{5!x}", "120x", "1.0"), (r"\boxed{{N}x(x+1)/2}", r"\frac{{N}x^2+{N}x}{2}", "1.0"),
    (r"\boxed{yes}", "sey", "0.0"), (r"\boxed{AB}", "BA", "0.0"), (r"\boxed{1/x}", "1/(x+10^{-20})", "0.0"), (r"\boxed{2305843009213693921x}", "0x", "0.0"), (r"\boxed{x^{2000000}}", "x^{1999999}x", "0.0"),
    (r"\boxed{" + "(" * 500 + "x" + ")" * 500 + "}", "x+0", "0.0"), (r"\boxed{" + "-" * 501 + "x}", "0-x", "0.0"), (r"\boxed{" + "x+" * 400 + "x}", "401x", "0.0"), (r"\boxed{" + "x+" * 40 + "x}", "41x", "1.0"), ("{S}", "x", "0.0"),
]
#: Responses, truths and scores of answers that are found by form and verified, sets included.
VERIFIED = [
    ("so it is {N}", "{N}", "1.0"), ("first $x+1$, then $2x+2$.", "2(x+1)", "1.0"), (r"thus \(x^2\) \[ x^3 \]", "x*x*x", "1.0"), (r"\boxed{\{1, {N}\}}", r"\{{N}, 1\}", "1.0"), (r"\boxed{\{1,2,2\}}", r"\left\{2,1\right\}", "1.0"),
    (r"\boxed{\{1,2\}}", r"\{1,3\}", "0.0"), (r"\boxed{\{1\}}", r"\{1,2\}", "0.0"), (r"\boxed{(1,2)}", "(2,1)", "0.0"), ("3 of 4, or 75%", "0.75", "1.0"), ("1,{N} and then 1,000", "1000", "1.0"), ("it is 3/4", r"\frac34", "1.0"),
    (r"\boxed{y=2x+1}", "2x-y+1=0", "1.0"), (r"\boxed{y=2x+1}", "4x-2y+2=0", "1.0"), (r"\boxed{y=2x+1}", "y=2x-1", "0.0"), (r"\boxed{x+y=1}", "x-y=1", "0.0"),
    ("no answer", "{N}", "0.0"), ("", "{N}", "0.0"), (r"\boxed{\{x+1,y\}}", r"\{y,1+x\}", "1.0"), (r"$$\frac{2}{4}$$", "0.5", "1.0"), (r"\boxed{1} and \boxed{2}", "1", "0.0"), ("$1$ but \\boxed{{N}}", "{N}", "1.0"),
]


_STOP = ', {"tool": "STOP"}]'
_TOP = '{"tool": "TOPK", "k": 2}'
#: Traces and what they become; an empty text where they are invalid.
TRACES = [
    (f"[{_TOP}]", f"[{_TOP}{_STOP}"), (f"[{_TOP}{_STOP}", f"[{_TOP}{_STOP}"), ('[{"tool": "topk", "k": 50}]', '[{"tool": "TOPK", "k": 50}' + _STOP), ('[{"tool": "TOPK", "k": 51}]', ""), ('[{"tool": "TOPK", "k": 0}]', ""), ('[{"tool": "TOPK", "k": true}]', ""), ('[{"tool": "TOPK"}]', ""),
    ('[{"tool": "FILTER", "field": "source_type", "op": "eq", "value": "{S}", "scope": "full_memory"}]', '[{"tool": "FILTER", "field": "source_type", "op": "eq", "value": "{S}", "scope": "full_memory"}' + _STOP), ('[{"tool": "FILTER", "field": "source_type", "op": "eq", "value": "{S}"}]', ""), ('[{"tool": "FILTER", "field": "author", "op": "eq", "value": "{S}", "scope": "full_memory"}]', ""),
    ('[{"tool": "FILTER", "field": "timestamp", "op": "before", "value": {N}, "scope": "current_pool"}]', '[{"tool": "FILTER", "field": "timestamp", "op": "before", "value": {N}, "scope": "current_pool"}' + _STOP), ('[{"tool": "FILTER", "field": "status", "op": "eq", "value": [1], "scope": "current_pool"}]', ""), ('[{"tool": "FILTER", "field": "status", "op": "like", "value": 1, "scope": "current_pool"}]', ""),
    ('[{"tool": "RETRIEVE"}]', '[{"tool": "RETRIEVE"}' + _STOP), ('[{"tool": "RETRIEVE", "method": "bm25", "top_k": 3, "query": "{S} {N}"}]', '[{"tool": "RETRIEVE", "method": "bm25", "top_k": 3, "query": "{S} {N}"}' + _STOP), ('[{"tool": "RETRIEVE", "query": " "}]', ""), ('[{"tool": "RETRIEVE", "method": "exact"}]', ""), ('[{"tool": "RETRIEVE", "query": "about memory_{N}"}]', ""), ('[{"tool": "RETRIEVE", "query": "M{N}"}]', ""), ('[{"tool": "RETRIEVE", "search_query": "x"}]', ""),
    ('[{"tool": "SORT", "field": "score", "order": "desc"}]', '[{"tool": "SORT", "field": "score", "order": "desc"}' + _STOP), ('[{"tool": "SORT", "field": "score"}]', ""), ('[{"tool": "EXPAND_NEIGHBORS", "window": 3}]', '[{"tool": "EXPAND_NEIGHBORS", "window": 3}' + _STOP), ('[{"tool": "EXPAND_NEIGHBORS", "window": 4}]', ""), ('[{"tool": "INSPECT_RAW"}]', '[{"tool": "INSPECT_RAW"}' + _STOP), ('[{"tool": "INSPECT_RAW", "target": "full_memory"}]', ""),
    ('[{"tool": "STOP"}, {"tool": "STOP"}]', ""), ('[{"tool": "STOP", "why": "{S}"}]', ""), ("[" + ", ".join([_TOP] * 8) + "]", ""), ("[" + ", ".join([_TOP] * 7) + "]", "[" + ", ".join([_TOP] * 7) + _STOP), ("[" + ", ".join([_TOP] * 7) + _STOP, "[" + ", ".join([_TOP] * 7) + _STOP), ("[" + ", ".join([_TOP] * 8) + _STOP, ""), ("[]", ""), ("{}", ""), ("not json {N}", ""), ("", ""), ('["TOPK"]', ""), ('[{"k": 2}]', ""), ('[{"tool": "JUMP"}]', ""), (DEEP, ""),
]


def _call(name: str, **parameters: str) -> str:
    return f'{{"name": "{name}", "parameters": {_object(list(parameters.items()))}}}'


def _calls(*calls: str, think: str = "<think>x</think>\n") -> str:
    return f"{think}<tool_call>\n" + "\n".join(calls) + "\n</tool_call>"


GOLD_CALL, TWO_CALLS, SAYS = _calls(_call("f", q='"{S}"', n="{N}")), _calls(_call("f", q='"{S}"'), _call("g", n="1")), "<think>x</think>\n<response>{S}</response>"
#: Of a gold with one call of two parameters at most 1 + 1 + 2 points are to be had, which are scaled to [-3, 3]; format is worth 1.
TOOL_ANSWERS = [
    (GOLD_CALL, GOLD_CALL, "4.0"), (_calls(_call("f", q='"{S}"', n="-1")), GOLD_CALL, str(1 + 6 * 3 / 4 - 3)), (_calls(_call("f", q='"{S}"', n="{N}"), think=""), GOLD_CALL, "3.0"), (_calls(_call("other", q='"{S}"', n="{N}")), GOLD_CALL, "-2.0"), ("<tool_call>\nno json\n</tool_call>", GOLD_CALL, "-3.0"),
    ("", GOLD_CALL, "-3.0"), (_calls(_call("f", q='"{S}"')), GOLD_CALL, str(round(1 + 6 * (1 + 0.5 + 1) / 4 - 3, 6))), (_calls(_call("f", n="{N}", q='"{S}"')), GOLD_CALL, "4.0"), (GOLD_CALL + GOLD_CALL, GOLD_CALL, "3.0"), (SAYS, SAYS, "1.0"), ("{S}", SAYS, "0.0"), (SAYS + " end", SAYS, "0.0"),
    (TWO_CALLS, TWO_CALLS, "4.0"), (_calls(_call("g", n="1"), _call("f", q='"{S}"')), TWO_CALLS, "4.0"), (_calls(_call("g", n="1")), TWO_CALLS, str(round(1 + 6 * (0.5 + 2) / 5 - 3, 6))), (_calls('{"name": "f"}'), GOLD_CALL, "-2.0"),
]
SEGMENTS = [
    ("see {S}<image>then<video>", "", "text:see {S},image:,text:then,video:"), ("<image>", "", "image:"), ("{S}", "", "text:{S}"), ("", "", ""), ("<image><image>", "", "image:,image:"), ("a<audio> b", "", "text:a,audio:,text: b"), ("<Image>{N}", "", "text:<Image>{N}"), ("<video>\n<image>", "", "video:,text:\n,image:"),
]


def _filled(text: F.Column) -> F.Column:
    return F.replace(F.replace(text, F.lit("{N}"), F.col("n_chars").cast("string")), F.lit("{S}"), F.col("source"))


def case_table(spark: SparkSession, sf_dir: str, cases: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """Every document with the texts of its case: doc_id and ``names``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    at = (F.col("doc_id") % len(cases) + 1).cast("int")
    return docs.select("doc_id", *[_filled(F.element_at(F.array(*[F.lit(c[k]) for c in cases]), at)).alias(n) for k, n in enumerate(names)])


def case_sql(cases: list[tuple], results: dict[str, tuple[int, str]]) -> str:
    """SELECT with doc_id and, for each name, an expression over ``v``, the filled column of that number of the document's case."""
    quote = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    columns = sorted({k for k, _ in results.values()})
    values = ", ".join(f"({i}, {', '.join(quote(c[k]) for k in columns)})" for i, c in enumerate(cases))
    filled = lambda k: f"replace(replace(CAST(c{k} AS VARCHAR), '{{N}}', CAST(n_chars AS VARCHAR)), '{{S}}', source)"
    chosen = ", ".join(f"{expr.replace('$v', filled(k))} AS {name}" for name, (k, expr) in results.items())
    return f"SELECT doc_id, {chosen} FROM documents JOIN (VALUES {values}) AS cases(i, {', '.join(f'c{k}' for k in columns)}) ON doc_id % {len(cases)} = i"
