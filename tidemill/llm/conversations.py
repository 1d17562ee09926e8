"""Repair of conversations by shortest paths: the cheapest edits that give a lawful order of roles.

The graph of a conversation has a node for each place between its rows and each state of the law
``(s?(ua)+)?``; edits are arcs of small integer costs. Dial's bucket queue runs backwards from the end, a bucket for
each distance, and records every node's distance to it; then a walk from the start takes, of the tight arcs, the one
whose initial is least. A state allows only one of user and assistant next, so initials tell the edits apart.

Rows are sorted over ranges of (conversation, turn). A conversation that lies in one part whole is repaired there. The
first and the last of a part may be cut by its bounds, so a conversation of any size is divided: each piece gives the
distances between the states before and after it, these are combined from the last piece backwards to what is
left after each piece, each piece tells where its walk from each state ends, which is followed from the first piece
forwards, and each piece then walks its own part of the path. Copies within a divided conversation are found
by a group-by of digests. Only the digest of a divided conversation's repaired text is one task's work, as SHA-256 has
no other way; it streams texts of about a megabyte and holds one at a time.

Defined results: null conversations are one conversation; null turns come first; rows of one turn are in the order of
role and of their text's hash, so repeated rows are neighbours, of which all but the first are duplicates; a null role or text is one
space, so such a role is unlawful and such a text blank; a role without a character has no initial and can't be
kept; a conversation all of whose rows are dropped has zeros, an empty audit and the digest of nothing; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import runs, spool, sql_type
from tidemill.llm.ranges import part_count, range_sorted

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
LAWFUL_PAIRS = ("su", "ua", "au")
#: States: nothing yet, after s, after u, after a. What a state allows next and where it leads.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
START, ENDS = 0, (0, 3)
N = len(STEPS)
KEEP, RENAME, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
FAR = 1 << 60
#: What is left at a conversation's end, by state.
FINAL = [0 if s in ENDS else FAR for s in range(N)]
#: A row's fault.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States that come to a state by a role: all, and those by user and assistant alone, which edits may name.
_INTO = {r: tuple(tuple(p for p in range(N) if STEPS[p].get(r) == s) for s in range(N)) for r in "sua"}
_NAMED = tuple(_INTO["u"][s] + _INTO["a"][s] for s in range(N))
_NONE = ((),) * N
ROLES = {"u": "user", "a": "assistant"}


def fault_of(text: str) -> int:
    """What is wrong with a text by itself."""
    seen = text.rstrip(BLANKS)
    return SOUND if seen and seen[-1] in ".!?" else TRUNCATED if seen else BLANK


def distances(initials: list[str], faults: list[int], ends: list[int]) -> list[int]:
    """Of each node (place * N + state) the cost of the cheapest way to the end, where a state costs ``ends``."""
    dist = [FAR] * (N * (len(initials) + 1))
    buckets: list[list[int]] = []

    def reach(node: int, cost: int) -> None:
        if cost < dist[node]:
            dist[node] = cost
            while len(buckets) <= cost:
                buckets.append([])
            buckets[cost].append(node)

    for state, cost in enumerate(ends):
        if cost < FAR:
            reach(N * len(initials) + state, cost)
    d = 0
    while d < len(buckets):
        for node in buckets[d]:  # grows by arcs that cost nothing
            if dist[node] != d:
                continue
            place, state = divmod(node, N)
            here = N * place
            for p in _NAMED[state]:
                reach(here + p, d + INSERT)
            if place:
                before, fault = here - N, faults[place - 1]
                reach(before + state, d + DELETE)
                if fault == SOUND or fault == TRUNCATED:
                    extra = d + (CUT_OFF if fault == TRUNCATED else 0)
                    for p in _INTO.get(initials[place - 1], _NONE)[state]:
                        reach(before + p, extra + KEEP)
                    for p in _NAMED[state]:
                        reach(before + p, extra + RENAME)
        buckets[d] = []
        d += 1
    return dist


def walk(initials: list[str], faults: list[int], dist: list[int], state: int, *, last: bool = True) -> Iterator[tuple[str, int, str, int]]:
    """The cheapest edits from the start in ``state``, least initials first: (initial, row, role's initial, state after).

    What is inserted between two pieces belongs to the later one, so only a conversation's last piece inserts at its end.
    """
    place = 0
    while last or place < len(initials):
        left = dist[N * place + state]
        named = "a" if state == 2 else "u"
        if place < len(initials):
            fault, after = faults[place], N * (place + 1)
            if dist[after + state] + DELETE == left:
                yield "D", place, "", state
                place += 1
                continue
        if dist[N * place + STEPS[state][named]] + INSERT == left:
            state = STEPS[state][named]
            yield "I", place, named, state
            continue
        if place == len(initials):
            return
        extra = CUT_OFF if fault == TRUNCATED else 0
        kept = STEPS[state].get(initials[place])
        if kept is not None and dist[after + kept] + extra + KEEP == left:
            state = kept
            yield "K", place, initials[place], state
        else:
            state = STEPS[state][named]
            yield "R", place, named, state
        place += 1


def repaired(rows: list[tuple[str, str]], edits: list[tuple[str, int, str, int]]) -> Iterator[str]:
    """The lines of the rows (role, text) after the edits."""
    for edit, place, role, _ in edits:
        if edit == "K":
            yield f"{rows[place][0]}:{rows[place][1]}"
        elif edit != "D":
            yield f"{ROLES[role]}:{rows[place][1] if edit == 'R' else ''}"


def _gaps(least: int | None, greatest: int | None, distinct: int) -> int:
    return 0 if least is None else greatest - least + 1 - distinct


def _unlawful(initials: list[str]) -> int:
    return sum(a + b not in LAWFUL_PAIRS for a, b in zip(initials, initials[1:], strict=False))


def repair(rows: list[tuple[int | None, str, str]]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and the digest of one conversation's rows (turn, role, text)."""
    seen, faults = set(), []
    for _, role, text in rows:
        fault = fault_of(text)
        if fault != BLANK:
            if (role, text) in seen:
                fault = DUPLICATE
            seen.add((role, text))
        faults.append(fault)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [role[:1] for _, role, _ in rows]
    dist = distances(initials, faults, FINAL)
    edits = list(walk(initials, faults, dist, START))
    text = "\n".join(repaired([r[1:] for r in rows], edits))
    gaps = _gaps(min(turns, default=None), max(turns, default=None), len(turns))
    counts = [faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)]
    return (gaps, *counts, _unlawful(initials), dist[START], "".join(e[0] for e in edits), sha256(text.encode()).hexdigest())


_FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_FOUND_NAMES = [f.split()[0] for f in _FOUND.split(", ")]
_FOUND_TYPES = [pa.int64()] * 6 + [pa.string()] * 2
#: Rows of conversations that a part's bounds may cut: which of the part's two ends, the place, and what its text tells.
_CUT = "part int, side int, place long, turn long, role string, text string, fault int, content binary"
_CUT_NAMES = [f.split()[0] for f in _CUT.split(", ")]
_CUT_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary()]


def _arrays(rows: list[tuple], types: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]


def _in_parts(ordered: DataFrame, id_type, schema: str, at_once: int = 1000) -> DataFrame:
    """Results of conversations within a part, and the rows of the part's first and last one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        ids_type, part = to_arrow_type(id_type), TaskContext.get().partitionId()

        def batch_of(ids: list, results: list[tuple], cut_ids: list, cut: list[tuple]) -> pa.RecordBatch:
            n, m = len(ids), len(cut)
            left = [pa.concat_arrays([c, pa.nulls(m, c.type)]) for c in _arrays(results, _FOUND_TYPES)]
            right = [pa.concat_arrays([pa.nulls(n, c.type), c]) for c in _arrays(cut, _CUT_TYPES)]
            return pa.RecordBatch.from_arrays([pa.array(ids + cut_ids, ids_type), *left, *right], ["conv_id", *_FOUND_NAMES, *_CUT_NAMES])

        def cut_row(side: int, place: int, row: tuple) -> tuple:
            turn, role, text, there = row
            content = blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest() if there else None
            return (part, side, place, turn, role, text, fault_of(text) if there else None, content)

        ids, results, cut_ids, cut, held = [], [], [], [], []
        current, began, side, place = None, False, 0, 0
        for batch in batches:
            for row_id, turn, role, text, times in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if began and row_id != current:
                    if side:
                        ids.append(current)
                        results.append(repair([r[:3] for r in held if r[3]]))
                    held, side = [], 1
                current, began = row_id, True
                for _ in range(max(1, times)):
                    if side:
                        held.append((turn, role, text, times > 0))
                    else:
                        cut_ids.append(row_id)
                        cut.append(cut_row(0, place, (turn, role, text, times > 0)))
                        place += 1
                if len(ids) + len(cut) >= at_once:
                    yield batch_of(ids, results, cut_ids, cut)
                    ids, results, cut_ids, cut = [], [], [], []
        for row in held:
            cut_ids.append(current)
            cut.append(cut_row(1, place, row))
            place += 1
        yield batch_of(ids, results, cut_ids, cut)

    return ordered.mapInArrow(work, schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    return runs(batches, ["part", "side"])


def _summary(piece: pa.Table) -> tuple:
    """Of a piece's rows: distances between states as one list, counts, ends and turns."""
    initials, faults = [r[:1] for r in piece.column("role").to_pylist()], piece.column("fault").to_pylist()
    between = []
    for end in range(N):
        dist = distances(initials, faults, [0 if s == end else FAR for s in range(N)])
        between += dist[:N]
    turns = [t for t in piece.column("turn").to_pylist() if t is not None]
    counts = [faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)]
    return between, *counts, _unlawful(initials), initials[0], initials[-1], min(turns, default=None), max(turns, default=None), len(set(turns))


_SUMMARY = "between array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string, least long, greatest long, turns long"
_SUMMARY_TYPES = [pa.list_(pa.int64()), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3]


def _backwards(pieces: pa.Table) -> pa.Table:
    """What is left after each piece of a conversation, by state, and the conversation's counts with its first piece."""
    rows = sorted(pieces.to_pylist(), key=lambda r: (r["part"], r["side"]))
    ends, out = FINAL, []
    for row in reversed(rows):
        out.append({"part": row["part"], "side": row["side"], "conv_id": row["conv_id"], "ends": ends})
        ends = [min(FAR, min(row["between"][N * t + s] + ends[t] for t in range(N))) for s in range(N)]
    out.reverse()
    turned = [r for r in rows if r["least"] is not None]
    shared = sum(a["greatest"] == b["least"] for a, b in zip(turned, turned[1:], strict=False))
    gaps = _gaps(turned[0]["least"], turned[-1]["greatest"], sum(r["turns"] for r in turned) - shared) if turned else 0
    illegal = sum(r["illegal"] for r in rows) + sum(a["last"] + b["first"] not in LAWFUL_PAIRS for a, b in zip(rows, rows[1:], strict=False))
    totals = {"gaps": gaps, "illegal": illegal, "cost": ends[START], **{f: sum(r[f] for r in rows) for f in ("blank", "duplicate", "truncated")}}
    for k, o in enumerate(out):
        o |= totals if k == 0 else dict.fromkeys(totals)
    return pa.Table.from_pylist(out, schema=pa.schema([("part", pa.int32()), ("side", pa.int32()), ("conv_id", pieces.schema.field("conv_id").type), ("ends", pa.list_(pa.int64())), *[(c, pa.int64()) for c in _FOUND_NAMES[:6]]]))


def _forwards(pieces: pa.Table) -> pa.Table:
    """The state in which the path enters each piece of a conversation."""
    rows, state, entered = sorted(pieces.to_pylist(), key=lambda r: (r["part"], r["side"])), START, []
    for row in rows:
        entered.append(state)
        state = row["exits"][state]
    return pa.table({"part": pa.array([r["part"] for r in rows], pa.int32()), "side": pa.array([r["side"] for r in rows], pa.int32()), "entered": pa.array(entered, pa.int32())})


def _divided(cut: DataFrame, id_type: str, segment_bytes: int) -> DataFrame:
    """Results of conversations from rows of _CUT, a conversation's rows in any number of parts."""
    there = cut.filter("fault is not null")
    none = cut.groupBy("conv_id").agg(F.count("fault").alias("n")).filter("n = 0")
    nothing = sha256(b"").hexdigest()
    empty = none.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in _FOUND_NAMES[:6]], F.lit("").alias("audit"), F.lit(nothing).alias("repaired_sha256"))
    # The first of equal contents isn't a duplicate: it is found by its place, which is no other row's.
    firsts = there.filter(F.col("fault") != BLANK).groupBy("conv_id", "content").agg(F.min(F.struct("part", "place")).alias("at")).select("at.part", "at.place", F.lit(True).alias("is_first"))
    faulty = F.when((F.col("fault") != BLANK) & F.col("is_first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    rows = there.join(firsts, ["part", "place"], "left").withColumn("fault", faulty).select("conv_id", "part", "side", "place", "turn", "role", "text", "fault")
    rows = spool(rows, "conversations-cut")

    def in_order(frame: DataFrame) -> DataFrame:
        return frame.repartition("part", "side").sortWithinPartitions("part", "side", "place")

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            key = [piece.column(c).slice(0, 1).combine_chunks() for c in ("conv_id", "part", "side")]
            values = [pa.array([v], t) for v, t in zip(_summary(piece), _SUMMARY_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([*[c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in key], *values], ["conv_id", "part", "side", *[f.split()[0] for f in _SUMMARY.split(", ")]])

    key_schema = f"conv_id {id_type}, part int, side int"
    summaries = in_order(rows.drop("text")).mapInArrow(summarize, f"{key_schema}, {_SUMMARY}")
    totals = ", ".join(f"{c} long" for c in _FOUND_NAMES[:6])
    after = spool(summaries.groupBy("conv_id").applyInArrow(_backwards, f"part int, side int, conv_id {id_type}, ends array<long>, {totals}"), "conversations-ends")
    # A piece's ends come before its rows.
    ends = after.select("part", "side", F.lit(-1).cast("long").alias("place"), "ends")

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            key, initials, faults, dist, last = _opened(piece)
            exits = list(range(N))
            for entry in range(N):
                for *_, after_edit in walk(initials, faults, dist, entry, last=last):
                    exits[entry] = after_edit
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in key] + [pa.array([exits], pa.list_(pa.int32()))], ["part", "side", "exits"])

    slim = rows.drop("text", "conv_id", "turn")
    exits = in_order(slim.unionByName(ends, allowMissingColumns=True)).mapInArrow(leave, "part int, side int, exits array<int>")
    keyed = exits.join(after.select("part", "side", "conv_id"), ["part", "side"])
    entered = keyed.groupBy("conv_id").applyInArrow(_forwards, "part int, side int, entered int")
    ends = after.select("part", "side", "conv_id", "ends").join(entered, ["part", "side"]).withColumn("place", F.lit(-1).cast("long"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            key, initials, faults, dist, last = _opened(piece)
            head, body = piece.slice(0, 1), piece.slice(1)
            state = head.column("entered")[0].as_py()
            edits = list(walk(initials, faults, dist, state, last=last))
            lines = _Lines(body)
            conv = head.column("conv_id").slice(0, 1).combine_chunks()
            conv = conv.chunk(0) if isinstance(conv, pa.ChunkedArray) else conv
            part = 0
            for audit, text in _segments(lines, edits, segment_bytes):
                yield pa.RecordBatch.from_arrays([conv, *[pa.array([v], pa.int32()) for v in (*key, part)], pa.array([audit], pa.string()), pa.array([text], pa.string())], ["conv_id", "part", "side", "at", "audit", "lines"])
                part += 1

    pieces = in_order(rows.drop("turn").unionByName(ends, allowMissingColumns=True)).mapInArrow(write, f"{key_schema}, at int, audit string, lines string")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple | None = None  # conversation, audits, digest, is empty
        for batch in batches:
            convs, audits, lines = batch.column(0), batch.column(4).to_pylist(), batch.column(5)
            for k, conv in enumerate(convs.to_pylist()):
                if state is None or state[0] != conv:
                    if state is not None:
                        yield done(state, convs.type)
                    state = [conv, [], sha256(), True]
                state[1].append(audits[k])
                text = lines[k].as_py()
                if text is not None:
                    state[2].update(("" if state[3] else "\n").encode() + text.encode())
                    state[3] = False
        if state is not None:
            yield done(state, convs.type)

    def done(state: list, ids: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([state[0]], ids), pa.array(["".join(state[1])], pa.string()), pa.array([state[2].hexdigest()], pa.string())], ["conv_id", "audit", "repaired_sha256"])

    digests = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "side", "at").mapInArrow(finish, f"conv_id {id_type}, audit string, repaired_sha256 string")
    counts = after.filter("cost is not null").select(F.col("conv_id").alias("c"), *_FOUND_NAMES[:6])
    found = digests.join(counts, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", *_FOUND_NAMES)
    return found.unionByName(empty)


def _opened(piece: pa.Table) -> tuple[tuple[int, int], list[str], list[int], list[int], bool]:
    """A piece's key, initials, faults, distances and whether it is the last; its first row has what is left after it."""
    body, ends = piece.slice(1), piece.column("ends")[0].as_py()
    initials, faults = [r[:1] for r in body.column("role").to_pylist()], body.column("fault").to_pylist()
    return (piece.column("part")[0].as_py(), piece.column("side")[0].as_py()), initials, faults, distances(initials, faults, ends), ends == FINAL


class _Lines:
    """A piece's rows (role, text), texts made when they are asked for."""

    def __init__(self, body: pa.Table):
        self.roles, self.texts = body.column("role"), body.column("text")

    def __getitem__(self, k: int) -> tuple[str, str]:
        return self.roles[k].as_py(), self.texts[k].as_py()


def _segments(rows: _Lines, edits: list[tuple], most: int) -> Iterator[tuple[str, str | None]]:
    """(audit, lines or null if there are none) of a piece, in segments of about ``most`` characters."""
    audit, held, size = [], [], 0
    for edit in edits:
        audit.append(edit[0])
        for line in repaired(rows, [edit]):
            held.append(line)
            size += len(line)
        if size >= most:
            yield "".join(audit), "\n".join(held)
            audit, held, size = [], [], 0
    if audit:
        yield "".join(audit), "\n".join(held) if held else None


def repair_conversations(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", times: str | None = None, part_bytes: int = 32 << 20, segment_bytes: int = 1 << 20) -> DataFrame:
    """conv_id and ``_FOUND`` of each conversation; ``times`` names a column that says how often a row is there (0: not)."""
    columns = [F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text")]
    given = rows.select(*columns, (F.col(times) if times else F.lit(1)).cast("int").alias("times"))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text")]
    ordered = range_sorted(given, keys, part_count(given, "text", part_bytes))
    id_type = sql_type(given, "conv_id")
    done = spool(_in_parts(ordered, given.schema["conv_id"].dataType, f"conv_id {id_type}, {_FOUND}, {_CUT}"), "conversations")
    whole = done.filter("part is null").select("conv_id", *_FOUND_NAMES)
    return whole.unionByName(_divided(done.filter("part is not null").select("conv_id", *_CUT_NAMES), id_type, segment_bytes))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` of (conv_id, turn, role, text) with faults by a hash of conversation and turn, and ``times``: how often each is there."""
    spaced = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    spaced = spaced.withColumn("kind", F.crc32(name.cast("binary")) % 20)
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return spaced.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))
