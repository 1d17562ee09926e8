"""Validation of traces of the retrieval language over a table of them: strict, as what a policy may emit.

A trace is a JSON array of objects with ``tool`` and arguments. A tool's required and optional arguments are a table of
predicates; a valid trace is given back with its tools in upper case and a STOP at its end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# What arguments may be, names that no argument may have, ids that no value may name, and the default limits.
MODES = ("bm25", "dense", "vision", "hybrid")
ALLOWED = {
    "FILTER": {"field": ("modality", "source_type", "timestamp", "status"), "op": ("eq", "neq", "before", "after", "contains"), "scope": ("current_pool", "full_memory")},
    "SORT": {"field": ("timestamp", "turn_id", "score"), "order": ("asc", "desc")},
    "INSPECT_RAW": {"target": ("current_pool",), "instruction": ("answer_query_related_visual_details",)},
}
FORBIDDEN = ("memory_id", "memory_ids", "candidate_id", "candidate_ids", "search_query")
HIDDEN = re.compile(r"\b(?:m|memory|mau)[-_]?\d+\b", re.IGNORECASE)
MAX_ACTIONS, MAX_TOP_K, WINDOWS = 8, 50, (1, 2, 3)

Check = Callable[[object], bool]


def one_of(values: tuple) -> Check:
    return lambda v: isinstance(v, str) and v in values


def _whole(v: object) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


def rules(max_top_k: int = MAX_TOP_K, inspect: bool = True) -> Mapping[str, tuple[dict[str, Check], dict[str, Check]]]:
    """(required, optional) arguments of each tool."""
    top: Check = lambda v: _whole(v) and 1 <= v <= max_top_k
    chosen = {tool: {a: one_of(v) for a, v in arguments.items()} for tool, arguments in ALLOWED.items()}
    found = {
        "FILTER": ({**chosen["FILTER"], "value": lambda v: isinstance(v, (str, int, float, bool))}, {}),
        "SORT": (chosen["SORT"], {}),
        "TOPK": ({"k": top}, {}),
        "RETRIEVE": ({}, {"method": one_of(MODES), "top_k": top, "query": lambda v: isinstance(v, str) and bool(v.strip())}),
        "EXPAND_NEIGHBORS": ({"window": lambda v: _whole(v) and v in WINDOWS}, {}),
        "STOP": ({}, {}),
    }
    return {**found, "INSPECT_RAW": ({}, chosen["INSPECT_RAW"])} if inspect else found


class InvalidTraceError(ValueError):
    pass


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise InvalidTraceError(message)


def check_action(raw: object, known: Mapping[str, tuple[dict[str, Check], dict[str, Check]]]) -> dict:
    _require(isinstance(raw, dict), "an action is an object")
    arguments = {k: v for k, v in raw.items() if k != "tool"}
    tool = str(raw.get("tool") or "").upper()
    _require(tool in known, f"no tool {tool}")
    _require(not any(k in FORBIDDEN for k in arguments), f"{tool} has a forbidden argument")
    _require(not any(HIDDEN.search(json.dumps(v, ensure_ascii=False)) for v in arguments.values()), f"{tool} names a hidden id")
    required, optional = known[tool]
    _require(all(k in arguments for k in required), f"{tool} lacks an argument")
    _require(all(k in required or k in optional for k in arguments), f"{tool} has an unknown argument")
    for name, value in arguments.items():
        _require((required.get(name) or optional[name])(value), f"{tool} can't have that {name}")
    return {"tool": tool, **arguments}


def check_trace(actions: object, *, max_actions: int = MAX_ACTIONS, max_top_k: int = MAX_TOP_K, inspect: bool = True) -> list[dict]:
    """The actions of a valid trace, STOP last; InvalidTraceError for any other."""
    _require(isinstance(actions, list) and bool(actions), "a trace is a list of actions")
    _require(len(actions) <= max_actions, "too many actions")
    known = rules(max_top_k, inspect)
    found = [check_action(a, known) for a in actions]
    stops = [k for k, a in enumerate(found) if a["tool"] == "STOP"]
    _require(all(k == len(found) - 1 for k in stops), "STOP is the last action")
    if not stops:
        _require(len(found) < max_actions, "no place for STOP")
        found.append({"tool": "STOP"})
    return found


def checked(trace: Column, **limits: int | bool) -> Column:
    """struct(valid, error, trace) of a JSON text: ``trace`` is what a valid one becomes, ``error`` why another isn't; null is invalid."""

    @F.arrow_udf("valid boolean, error string, trace string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            try:
                found = check_trace(json.loads(text or ""), **limits)
                out.append((True, None, json.dumps(found, ensure_ascii=False)))
            except InvalidTraceError as error:
                out.append((False, str(error), None))
            except (ValueError, RecursionError):
                out.append((False, "no JSON", None))
        valid, error, trace = zip(*out, strict=True) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(valid, pa.bool_()), pa.array(error, pa.string()), pa.array(trace, pa.string())], ["valid", "error", "trace"])

    return run(trace)
