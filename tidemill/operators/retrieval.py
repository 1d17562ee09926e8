"""A small retrieval language over a memory store: FILTER, SORT, TOPK, RETRIEVE, EXPAND_NEIGHBORS, INSPECT_RAW, STOP.

A store is a table of records: memory_id, turn_id, timestamp, author, modality, source_type, summary, content,
raw_pointer, session_key, turn_index, metadata. A pool is records with ``score``, ``retrieved`` and ``ord``, the place
in the list. A trace of actions is validated on the driver and folded into one lazy plan.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.functions.text import query_variants, retrieval_tokens
from tidemill.operators.batch import with_dense_id

# The language's words and limits.
FIELDS = ("memory_id", "turn_id", "timestamp", "author", "modality", "source_type", "summary", "content", "status", "score")
OPS = ("eq", "neq", "contains", "before", "after")
METHODS = ("bm25", "dense", "vision", "hybrid")
SCOPES = ("current_pool", "full_memory")
ARGUMENTS = {"FILTER": {"field", "op", "value", "scope"}, "SORT": {"field", "order"}, "TOPK": {"k"}, "RETRIEVE": {"query", "method", "top_k"}, "EXPAND_NEIGHBORS": {"window"}, "INSPECT_RAW": {"question"}, "STOP": set()}
MAX_ACTIONS, MAX_TOP_K, MAX_WINDOW = 12, 50, 3
HIDDEN_ID = re.compile(r"\b(memory|turn)_id\s*[:=]", re.IGNORECASE)
DATE = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
BM25_K1, BM25_B = 1.5, 0.75


@dataclass(frozen=True)
class Action:
    tool: str
    arguments: dict = field(default_factory=dict)

    @staticmethod
    def of(raw: Action | dict) -> Action:
        if isinstance(raw, Action):
            return raw
        rest = {k: v for k, v in raw.items() if k not in ("tool", "action")}
        return Action(str(raw.get("tool") or raw.get("action") or "").upper(), rest.get("arguments", rest) if isinstance(rest.get("arguments", rest), dict) else rest)


def parse_trace(text: str) -> list[Action]:
    """Actions of a JSON array."""
    return [Action.of(x) for x in json.loads(text)]


def validate(trace: Sequence[Action | dict], *, max_actions: int = MAX_ACTIONS, max_top_k: int = MAX_TOP_K) -> list[Action]:
    """The trace with defaults filled in; anything outside the language raises ValueError."""
    actions = [Action.of(a) for a in trace]
    if not actions or len(actions) > max_actions:
        raise ValueError(f"a trace has 1 to {max_actions} actions")
    out = []
    for a in actions:
        if a.tool not in ARGUMENTS:
            raise ValueError(f"unknown tool {a.tool!r}")
        extra = set(a.arguments) - ARGUMENTS[a.tool]
        if extra:
            raise ValueError(f"{a.tool} takes no {sorted(extra)}")
        args = dict(a.arguments)
        if any(isinstance(v, str) and HIDDEN_ID.search(v) for v in args.values()):
            raise ValueError("actions can't name hidden ids")
        if a.tool == "FILTER":
            args.setdefault("scope", "current_pool")
            ok = args.get("field") in FIELDS[1:] and args.get("op") in OPS and args["scope"] in SCOPES and "value" in args
        elif a.tool == "SORT":
            args.setdefault("order", "asc")
            ok = args.get("field") in FIELDS[1:] and args["order"] in ("asc", "desc")
        elif a.tool == "TOPK":
            ok = isinstance(args.get("k"), int) and 1 <= args["k"] <= max_top_k
        elif a.tool == "RETRIEVE":
            args.setdefault("method", "hybrid")
            args.setdefault("top_k", 5)
            ok = args["method"] in METHODS and isinstance(args["top_k"], int) and 1 <= args["top_k"] <= max_top_k
        elif a.tool == "EXPAND_NEIGHBORS":
            args.setdefault("window", 1)
            ok = isinstance(args["window"], int) and 1 <= args["window"] <= MAX_WINDOW
        else:
            ok = True
        if not ok:
            raise ValueError(f"{a.tool} can't have {a.arguments}")
        out.append(Action(a.tool, args))
    if any(a.tool == "STOP" for a in out[:-1]):
        raise ValueError("STOP is the last action")
    return out


def initial_pool(store: DataFrame, order: str = "memory_id") -> DataFrame:
    """The whole store with score 0, in its own order (a column ``ord``, or by id)."""
    pool = store.withColumns({"score": F.lit(0.0), "retrieved": F.lit(False)})
    return pool if "ord" in store.columns else with_dense_id(pool, [order], "ord")


def searchable(store_columns: Sequence[str]) -> Column:
    return F.concat_ws(" ", *[F.col(c) for c in ("author", "summary", "content") if c in store_columns])


# FILTER
def canonical_date(text: Column) -> Column:
    """The first date in a text as yyyy-mm-dd, empty without one."""
    part = lambda g, n: F.lpad(F.regexp_extract(text, DATE, g), n, "0")
    return F.when(text.rlike(DATE), F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2))).otherwise("")


def normal_timestamp(text: Column) -> Column:
    """Lower case, the date in canonical form, and a time after it joined by "t"."""
    t = F.lower(F.trim(text))
    after = F.trim(F.regexp_extract(t, DATE + r"(.*)$", 4))
    return F.when(t.rlike(DATE), F.concat(canonical_date(t), F.when(after.rlike(r"^\d"), F.concat(F.lit("t"), after)).otherwise(after))).otherwise(t)


def _matches_time(current: Column, op: str, value: str) -> Column:
    target = F.lit(value)
    current_date, target_date = canonical_date(current), canonical_date(target)
    dated = (current_date != "") & (target_date != "")
    day = bool(re.fullmatch(r"\s*" + DATE + r"\s*", value))
    low = F.lower(current)
    equal = F.when(dated, current_date == target_date if day else normal_timestamp(current) == normal_timestamp(target)).otherwise(low == value.lower())
    if op in ("eq", "neq"):
        return equal if op == "eq" else ~equal
    if op == "contains":
        return F.contains(low, F.lit(value.lower())) | (dated & (current_date == target_date))
    a, b = (current_date, target_date) if day else (normal_timestamp(current), normal_timestamp(target))
    known = (a != "") & (b != "")
    a, b = F.when(known, a).otherwise(low), F.when(known, b).otherwise(value.lower())
    return a < b if op == "before" else a > b


def filter_pool(pool: DataFrame, name: str, op: str, value: object) -> DataFrame:
    """Rows by a case-insensitive comparison; missing values are empty texts; unknown fields come from the metadata."""
    raw = F.col(name) if name in pool.columns else F.try_element_at("metadata", F.lit(name)) if "metadata" in pool.columns else F.lit(None)
    current = F.coalesce(raw.cast("string"), F.lit(""))
    target = str(value)
    if name == "timestamp":
        return pool.filter(_matches_time(current, op, target))
    low, t = F.lower(current), target.lower()
    tests = {"eq": low == t, "neq": low != t, "contains": F.contains(low, F.lit(t)), "before": low < t, "after": low > t}
    return pool.filter(tests[op])


# SORT, TOPK
def natural_key(text: Column) -> Column:
    """A text that sorts digit runs as numbers: each run padded with zeros to 20 places."""
    padded = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p))
    return F.array_join(padded, "")


def sort_pool(pool: DataFrame, name: str, order: str = "asc") -> DataFrame:
    """A stable sort: ties keep their order in both directions."""
    key = F.col("score") if name == "score" else natural_key(F.col(name)) if name == "turn_id" else F.lower(F.coalesce(F.col(name).cast("string"), F.lit("")))
    first = key.asc_nulls_first() if order == "asc" else key.desc_nulls_last()
    return with_dense_id(pool.withColumnRenamed("ord", "_ord"), [first, F.col("_ord").asc()], "ord").drop("_ord")


def top_turns(pool: DataFrame, k: int) -> DataFrame:
    """All rows of the first ``k`` distinct turns."""
    first = pool.groupBy("turn_id").agg(F.min("ord").alias("_first")).orderBy("_first").limit(k).select("turn_id")
    return pool.join(first, "turn_id", "left_semi")


def ranked_top(pool: DataFrame, k: int) -> DataFrame:
    """The best ``k`` by falling score, then timestamp, turn and id, marked as retrieved, with new places."""
    best = pool.withColumn("retrieved", F.lit(True)).orderBy(F.desc("score"), "timestamp", "turn_id", "memory_id").limit(k)
    w = Window.orderBy(F.desc("score"), "timestamp", "turn_id", "memory_id")  # over k rows
    return best.withColumn("ord", F.row_number().over(w).cast("long") - 1)


# RETRIEVE
def bm25(pool: DataFrame, query: str, text: Column | None = None) -> DataFrame:
    """(memory_id, score): BM25 with k1 1.5 and b 0.75; terms of the query count as often as they occur in it.

    A record's counts of the query's terms stay in its row, so nothing is joined; the statistics over the pool (records, mean
    length, records with each term) are one aggregated row.
    """
    spark = pool.sparkSession
    terms = Counter(spark.range(1).select(retrieval_tokens(F.lit(query)).alias("t")).first()["t"])
    if not terms:
        return pool.select("memory_id", F.lit(0.0).alias("score"))
    wanted = F.array(*map(F.lit, terms))
    tokens = pool.select("memory_id", retrieval_tokens(text if text is not None else searchable(pool.columns)).alias("t"))
    found = tokens.select("memory_id", F.size("t").alias("len"), F.filter("t", lambda x: F.array_contains(wanted, x)).alias("hits"))
    times = lambda term: F.size(F.filter("hits", lambda x: x == term))
    counted = found.select("memory_id", "len", F.array(*[times(t) for t in terms]).alias("tf"))
    stats = counted.agg(F.struct(F.count("*").alias("n"), F.avg("len").alias("avg"), F.array(*[F.count_if(F.col("tf")[i] > 0) for i in range(len(terms))]).alias("df")).alias("stats")).scalar()
    rated = counted.withColumn("stats", stats)
    n, length = F.col("stats.n"), BM25_K1 * (1.0 - BM25_B + BM25_B * F.col("len") / F.greatest("stats.avg", F.lit(1.0)))

    def one(i: int, asked: int) -> Column:
        tf, df = F.col("tf")[i], F.col("stats.df")[i]
        return F.when(tf > 0, asked * F.log(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * (BM25_K1 + 1.0) / (tf + length)).otherwise(0.0)

    return rated.select("memory_id", sum((one(i, asked) for i, asked in enumerate(terms.values())), F.lit(0.0)).alias("score"))


def dense(pool: DataFrame, vectors: DataFrame, queries: Sequence[Sequence[float]]) -> DataFrame:
    """(memory_id, score): the largest dot product with the normalized query vectors; a missing vector or one of another
    length scores 0. ``vectors`` is (memory_id, embedding)."""
    scores = []
    for q in queries:
        norm = sum(x * x for x in q) ** 0.5 or 1.0
        lit = F.array(*[F.lit(float(x) / norm) for x in q])
        scores.append(F.when(F.size("embedding") == len(q), A.dot("embedding", lit)))
    if not scores:
        return pool.select("memory_id", F.lit(0.0).alias("score"))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    joined = pool.select("memory_id").join(vectors.select("memory_id", "embedding"), "memory_id", "left")
    return joined.select("memory_id", F.coalesce(best, F.lit(0.0)).alias("score"))


def vector_search(vectors: DataFrame, query: Sequence[float], k: int, *, among: DataFrame | None = None) -> DataFrame:
    """Exact top ``k`` by dot product with the normalized query, among a set of ids if given."""
    pool = vectors.join(among.select("memory_id"), "memory_id", "left_semi") if among is not None else vectors
    return dense(pool, pool, [query]).orderBy(F.desc("score"), "memory_id").limit(k)


def min_max(scores: DataFrame, name: str = "score") -> DataFrame:
    """Scores scaled to [0, 1]; where all are equal, 1 if they are above 0, else 0."""
    low, high = scores.agg(F.min(name)).scalar(), scores.agg(F.max(name)).scalar()
    s = scores.withColumns({"_low": low, "_high": high})
    scaled = F.when(F.col("_high") <= F.col("_low"), F.when(F.col("_high") > 0, 1.0).otherwise(0.0)).otherwise((F.col(name) - F.col("_low")) / F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")))
    return s.withColumn(name, scaled).drop("_low", "_high")


def weighted_hybrid(pool: DataFrame, lexical: DataFrame, semantic: DataFrame, visual: DataFrame | None = None, *, alpha: float = 0.5, has_image: bool = False, visual_query: bool = False) -> DataFrame:
    """Scaled lexical and semantic scores mixed by ``alpha``, and vision with weight .5 with a picture, .2 for a visual
    question, else 0."""
    weight = 0.5 if has_image else 0.2 if visual_query else 0.0
    named = lambda df, n: min_max(df).select("memory_id", F.col("score").alias(n))
    out = pool.select("memory_id").join(named(lexical, "_b"), "memory_id", "left").join(named(semantic, "_d"), "memory_id", "left")
    text = (1 - alpha) * F.coalesce("_b", F.lit(0.0)) + alpha * F.coalesce("_d", F.lit(0.0))
    if visual is None or weight == 0.0:
        return out.select("memory_id", text.alias("score"))
    out = out.join(named(visual, "_v"), "memory_id", "left")
    return out.select("memory_id", ((1 - weight) * text + weight * F.coalesce("_v", F.lit(0.0))).alias("score"))


@dataclass
class Encoders:
    """What a retriever needs beside the store: vector tables (memory_id, embedding) and functions from text to vector."""

    text_vectors: DataFrame | None = None
    joint_vectors: DataFrame | None = None
    image_vectors: DataFrame | None = None
    encode: Callable[[str], Sequence[float]] | None = None
    image: Sequence[float] | None = None


def scores_by(method: str, pool: DataFrame, query: str, enc: Encoders) -> DataFrame:
    """(memory_id, score) by a method; hybrid takes joint vectors, and the weighted mixture where these give only zeros."""
    zero = pool.select("memory_id", F.lit(0.0).alias("score"))
    variants = [enc.encode(v) for v in query_variants(query)] if enc.encode else []
    if method == "bm25":
        return bm25(pool, query)
    if method == "dense":
        return dense(pool, enc.text_vectors, variants) if enc.text_vectors is not None else zero
    if method == "vision":
        return dense(pool, enc.image_vectors, [enc.image]) if enc.image_vectors is not None and enc.image is not None else zero
    joint = dense(pool, enc.joint_vectors, variants) if enc.joint_vectors is not None else zero
    if enc.joint_vectors is not None and not joint.filter("score <> 0").isEmpty():
        return joint
    return weighted_hybrid(pool, bm25(pool, query), scores_by("dense", pool, query, enc), scores_by("vision", pool, query, enc), has_image=enc.image is not None)


def retrieve(store: DataFrame, query: str, *, method: str = "hybrid", top_k: int = 5, encoders: Encoders | None = None) -> DataFrame:
    """The best ``top_k`` records of the whole store, whatever the pool was."""
    pool = initial_pool(store).drop("score")
    scored = pool.join(scores_by(method, pool, query, encoders or Encoders()), "memory_id")
    return ranked_top(scored, top_k)


def propagate(turns: DataFrame, *, window: int = 1, decay: float = 0.9) -> DataFrame:
    """Turn scores (turn_id, session_key, turn_index, score): the largest of a turn's own and its neighbours', times
    ``decay`` to the power of the distance, within a session. A band join as an equi-join on exploded places."""
    placed = turns.filter("session_key is not null and session_key <> '' and turn_index is not null")
    offers = placed.select("session_key", F.col("score").alias("_s"), F.col("turn_index").alias("_at"), F.explode(F.array(*[F.lit(d) for d in range(-window, window + 1) if d])).alias("_d"))
    offers = offers.select("session_key", (F.col("_at") + F.col("_d")).alias("turn_index"), (F.col("_s") * F.pow(F.lit(decay), F.abs("_d"))).alias("_offer"))
    best = offers.groupBy("session_key", "turn_index").agg(F.max("_offer").alias("_offer"))
    return turns.join(best, ["session_key", "turn_index"], "left").withColumn("score", F.greatest("score", F.coalesce("_offer", F.col("score")))).drop("_offer")


def rank_turns(pool: DataFrame, turn_scores: DataFrame, top_k: int) -> DataFrame:
    """All records of the best turns (falling score, first timestamp, id), each with its turn's score."""
    first = pool.groupBy("turn_id").agg(F.min("timestamp").alias("_ts")).join(turn_scores.select("turn_id", F.col("score").alias("_score")), "turn_id")
    best = first.orderBy(F.desc("_score"), "_ts", "turn_id").limit(top_k)
    best = best.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("_score"), "_ts", "turn_id")))  # over top_k rows
    rows = pool.drop("score", "retrieved", "ord").join(F.broadcast(best), "turn_id")  # broadcast: top_k rows
    rows = rows.withColumns({"score": F.col("_score"), "retrieved": F.lit(True)})
    return with_dense_id(rows, ["_rank", "timestamp", "memory_id"], "ord").drop("_rank", "_ts", "_score")


def retrieve_turns(store: DataFrame, query: str, *, method: str = "hybrid", top_k: int = 5, window: int = 1, decay: float = 0.9, encoders: Encoders | None = None) -> DataFrame:
    """Retrieval by turn: the best record's score, spread to neighbouring turns, then the best turns with all records."""
    pool = initial_pool(store).drop("score")
    scored = pool.join(scores_by(method, pool, query, encoders or Encoders()), "memory_id")
    turns = scored.groupBy("turn_id").agg(F.max("score").alias("score"), F.min_by("session_key", "ord").alias("session_key"), F.min_by("turn_index", "ord").alias("turn_index"))
    return rank_turns(pool, propagate(turns, window=window, decay=decay) if window > 0 else turns, top_k)


# EXPAND_NEIGHBORS and pools
def expand_neighbors(pool: DataFrame, store: DataFrame, window: int) -> DataFrame:
    """The store's records whose turn is at most ``window`` from one of the pool's in its session; a turn's score is the
    pool's (the last one's in the list), 0 for new turns. Ordered by session, turn, timestamp and id."""
    keys = pool.filter("session_key is not null and turn_index is not null").select("session_key", F.explode(F.sequence(F.col("turn_index") - window, F.col("turn_index") + window)).alias("turn_index")).distinct()
    scores = pool.groupBy("turn_id").agg(F.max_by("score", "ord").alias("_score"))
    near = store.drop("score", "retrieved", "ord").join(keys, ["session_key", "turn_index"], "left_semi").join(scores, "turn_id", "left")
    near = near.withColumns({"score": F.coalesce("_score", F.lit(0.0)), "retrieved": F.lit(False)}).drop("_score")
    return with_dense_id(near, ["session_key", "turn_index", "timestamp", "memory_id"], "ord")


def merge_pools(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """By memory_id: the old place, the new record, the new score unless it is 0, retrieved if either was; new ones at the end."""
    old = existing.select(F.col("memory_id").alias("_id"), F.col("score").alias("_score"), F.col("retrieved").alias("_retrieved"), F.col("ord").alias("_ord"))
    both = incoming.join(old, F.col("memory_id") == F.col("_id"), "left")
    known = F.col("_id").isNotNull()
    came = both.withColumns({"score": F.when(known & (F.col("score") == 0), F.col("_score")).otherwise(F.col("score")), "retrieved": F.col("retrieved") | F.coalesce("_retrieved", F.lit(False)), "_new": F.when(known, 0).otherwise(1), "_at": F.coalesce("_ord", "ord")}).drop("_id", "_score", "_retrieved", "_ord", "ord")
    stay = existing.join(incoming.select("memory_id"), "memory_id", "left_anti").withColumns({"_new": F.lit(0), "_at": F.col("ord")}).drop("ord")
    return with_dense_id(stay.unionByName(came), ["_new", "_at", "memory_id"], "ord").drop("_new", "_at")


def append_unseen(evidence: DataFrame, pool: DataFrame) -> DataFrame:
    """Evidence and the pool's records that aren't in it yet."""
    return evidence.unionByName(pool.join(evidence.select("memory_id"), "memory_id", "left_anti"), allowMissingColumns=True)


def refresh_evidence(evidence: DataFrame, pool: DataFrame) -> DataFrame:
    """Evidence from looking at raw media stays while its record is in the pool; everything else is the pool."""
    raw = evidence.filter("source = 'INSPECT_RAW'").join(pool.select("memory_id"), "memory_id", "left_semi")
    return raw.unionByName(pool.withColumn("source", F.lit("POOL")), allowMissingColumns=True)


def project_evidence(pool: DataFrame) -> DataFrame:
    """A pool as evidence: content or else summary, the score unless it is 0, no empty fields."""
    content = F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("summary"))
    return pool.select("ord", "memory_id", "turn_id", "timestamp", content.alias("content"), F.nullif(F.col("score"), F.lit(0.0)).alias("score"))


def text_context(store: DataFrame, limit: int = 1200) -> DataFrame:
    """(turn_id, context): the texts of a turn's records without raw media, in order, cut to a limit."""
    texts = store.filter("raw_pointer is null").groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "memory_id", F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("summary")).alias("t")))).alias("_t"))
    return texts.select("turn_id", F.substring(F.array_join(F.transform("_t", lambda x: x["t"]), "\n"), 1, limit).alias("context"))


def any_shared(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables share a memory_id."""
    return not a.select("memory_id").join(b.select("memory_id"), "memory_id", "left_semi").limit(1).isEmpty()


def support_ranks(ranked: DataFrame, gold: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """One row: the smallest rank of a gold turn and the share of gold turns among the first k distinct ones, for each k."""
    turns = ranked.groupBy("turn_id").agg(F.min("ord").alias("_first"))
    turns = turns.withColumn("rank", F.row_number().over(Window.orderBy("_first", "turn_id")))  # a ranked list has at most MAX_TOP_K turns
    found = gold.select("turn_id").distinct().join(turns, "turn_id", "left")
    return found.agg(F.min("rank").alias("first_rank"), *[F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in ks])


def support_profile(ranked: DataFrame, gold: DataFrame, ks: Sequence[int] = (1, 3, 5, 10, 20)) -> DataFrame:
    """One row: where a ranking has the records of gold turns, as ranks of turns (the first of a turn's records counts).

    The smallest rank, the ranks by which all gold turns, and all records of gold turns, are there, how many of either are
    found, and whether any is among the first k. Ranks that aren't there are null.
    """
    turns = with_dense_id(ranked.groupBy("turn_id").agg(F.min("ord").alias("_first")), ["_first", "turn_id"], "_rank")
    wanted = gold.select("turn_id").distinct()
    per_turn = turns.join(wanted, "turn_id", "right").select("turn_id", (F.col("_rank") + 1).alias("rank"))
    records = ranked.join(wanted, "turn_id", "left_semi").agg(F.count("*")).scalar()
    best, found = F.min("rank"), F.count("rank")
    return per_turn.agg(
        best.alias("best_rank"), F.when(found == F.count("*"), F.max("rank")).alias("all_turns_rank"), F.max("rank").alias("all_records_rank"), found.alias("turns_found"), F.count("*").alias("turns"),
        *[F.coalesce(best <= k, F.lit(False)).alias(f"found_at_{k}") for k in ks],
    ).withColumn("records_found", records)


def oracle_profile(store: DataFrame, query: str, gold: DataFrame, *, methods: Sequence[str] = ("bm25", "dense", "hybrid"), top_k: int = MAX_TOP_K, encoders: Encoders | None = None) -> DataFrame:
    """``support_ranks`` for each method."""
    out = None
    for m in methods:
        one = support_ranks(retrieve(store, query, method=m, top_k=top_k, encoders=encoders), gold).select(F.lit(m).alias("method"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def advice(profile: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """(method, k, recall) best first: highest recall, then the smallest k, then the method's name."""
    return profile.select("method", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"recall_at_{k}").alias("recall")) for k in ks]))).orderBy(F.desc("recall"), "k", "method")


@dataclass
class Result:
    pool: DataFrame
    evidence: DataFrame
    steps: list[dict]
    stopped: bool = False
    error: str = ""


def run_trace(trace: Sequence[Action | dict], query: str, store: DataFrame, *, encoders: Encoders | None = None, inspect: Callable[[DataFrame, str], DataFrame] | None = None, by_turn: bool = False) -> Result:
    """Runs the actions in order. Nothing is computed but an emptiness test before EXPAND_NEIGHBORS, which stops the run with
    an error and keeps the pool; without evidence the last pool is the evidence."""
    pool, chosen = initial_pool(store), False
    evidence: DataFrame | None = None
    steps, stopped, error = [], False, ""
    for action in validate(trace):
        args = action.arguments
        if action.tool == "STOP":
            stopped = True
        elif action.tool == "FILTER":
            base = initial_pool(store) if args["scope"] == "full_memory" else pool
            pool, chosen = filter_pool(base, args["field"], args["op"], args["value"]), True
        elif action.tool == "SORT":
            pool = sort_pool(pool, args["field"], args["order"])
        elif action.tool == "TOPK":
            pool = top_turns(pool, args["k"])
        elif action.tool == "RETRIEVE":
            get = retrieve_turns if by_turn else retrieve
            pool, chosen = get(store, args.get("query") or query, method=args["method"], top_k=args["top_k"], encoders=encoders), True
        elif action.tool == "EXPAND_NEIGHBORS":
            if pool.isEmpty():
                error = "EXPAND_NEIGHBORS needs a pool that isn't empty"
            else:
                pool, chosen = merge_pools(pool, expand_neighbors(pool, store, args["window"])), True
        elif inspect is not None:
            looked = inspect(pool.filter("retrieved and raw_pointer is not null"), args.get("question") or query).withColumn("source", F.lit("INSPECT_RAW"))
            evidence = looked if evidence is None else evidence.unionByName(looked, allowMissingColumns=True)
        steps.append({"tool": action.tool, "arguments": args, "error": error})
        if stopped or error:
            break
    final = project_evidence(pool).withColumn("source", F.lit("POOL"))
    if evidence is not None:
        final = refresh_evidence(evidence, pool) if chosen else evidence
    return Result(pool, final, steps, stopped, error)


class Session:
    """A trace run action by action, with public previews of what each step leaves."""

    def __init__(self, query: str, store: DataFrame, *, encoders: Encoders | None = None, budget: int = MAX_ACTIONS):
        self.query, self.store, self.encoders, self.budget = query, store, encoders, budget
        self.trace: list[Action] = []

    def execute(self, action: Action | dict, *, show: int = 5, clip: int = 200) -> dict:
        """Adds an action and returns the pool's size and first records, without ids."""
        if len(self.trace) >= self.budget:
            return {"error": "the budget of actions is used up", "size": 0, "preview": []}
        result = run_trace([*self.trace, action], self.query, self.store, encoders=self.encoders)
        if not result.error:
            self.trace.append(Action.of(action))
        rows = result.pool.orderBy("ord").limit(show).select("timestamp", F.substring(F.coalesce("content", "summary"), 1, clip).alias("text")).collect()
        return {"error": result.error, "size": result.pool.count(), "preview": [r.asDict() for r in rows], "stopped": result.stopped}


def build_index(records: DataFrame, encode: Callable, path: str, *, dim: int, text: Column | None = None) -> DataFrame:
    """Vectors of all records by an encoder of batches of texts (normalized), written as Parquet (memory_id, embedding)."""
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        v = np.asarray(encode(texts.tolist()), np.float32).reshape(len(texts), dim)
        return pd.Series(list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)))

    records.select("memory_id", embed(text if text is not None else searchable(records.columns)).alias("embedding")).write.mode("overwrite").parquet(path)
    return records.sparkSession.read.parquet(path)
