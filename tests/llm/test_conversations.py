import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemill.llm import conversations as cv
from tidemill.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, part int, side int, times int, audit string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def least(paths):
    paths = [p for p in paths if p]
    return min(paths) if paths else None


def brute(rows):
    """One conversation's results by trying all edits forwards: of each state the least (cost, audit) with its lines."""
    seen, faults = set(), []
    for _, role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if blank else "duplicate" if (role, text) in seen else "truncated" if re.search(r"[^\x20\x09-\x0D]", text[::-1]).group() not in ".!?" else "")
        seen.add((role, text))
    paths = {"": (0, "", ())}

    def insert(paths):
        for _ in range(2):
            new = defaultdict(list)
            for state, (cost, audit, lines) in paths.items():
                new[state].append((cost, audit, lines))
                for r in "ua":
                    if (state, r) in NEXT:
                        new[NEXT[state, r]].append((cost + 5, audit + "I", (*lines, f"{NAMES[r]}:")))
            paths = {s: min(p) for s, p in new.items()}
        return paths

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = defaultdict(list)
        for state, (cost, audit, lines) in insert(paths).items():
            new[state].append((cost + 2, audit + "D", lines))
            if fault in ("", "truncated"):
                extra = 5 if fault else 0
                if (state, role[:1]) in NEXT:
                    new[NEXT[state, role[:1]]].append((cost + extra, audit + "K", (*lines, f"{role}:{text}")))
                for r in "ua":
                    if (state, r) in NEXT:
                        new[NEXT[state, r]].append((cost + 1 + extra, audit + "R", (*lines, f"{NAMES[r]}:{text}")))
        paths = {s: min(p) for s, p in new.items()}
    paths = insert(paths)
    cost, audit, lines = min(paths[s] for s in ("", "a") if s in paths)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damage(rows):
    """``rows`` of (conv_id, turn, role, text) in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        found = out[conv]
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        if kind:
            found += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def ordered(spark, rows):
    hashed = rows.select("turn", "role", "text", F.xxhash64("text").alias("h")).collect()
    return [tuple(r)[:3] for r in sorted(hashed, key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"], r["h"]))]


def found(df):
    return Counter(tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect())


def test_query_against_brute_force(spark, sf_dir):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect())
    assert found(queries.op13_conversations(spark, sf_dir)) == Counter((c, *brute(r)) for c, r in damage(rows).items())


def odd_rows():
    rng = random.Random(5)
    texts = ["Yes.", "No!", "and then", "", " \t", None, "Why?", "again.", " ", "x " * 4000 + ".", "tail . \x0b"]
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "ux"])
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.randrange(2) * 100, role, rng.choice(texts), 1, 2, 3, "z"))
    # Conversations that are longer than parts, one of them of equal rows alone.
    rows += [(50, k, rng.choice(["user", "assistant", "tool"]), rng.choice(["Fine.", f"row {k}.", "cut"]), 1, 2, 3, "z") for k in range(700)]
    rows += [(51, 3, "user", "same.", 1, 2, 3, "z")] * 300
    rows += [(52, k, "assistant", "only.", 1, 2, 3, "z") for k in range(200)]
    return rows


@pytest.mark.parametrize("part_bytes,segment", [(200, 7), (3000, 100), (1 << 20, 1 << 20)])
def test_odd_rows_over_parts(spark, part_bytes, segment):
    given = spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)
    df = cv.damaged(given)
    rows = df.filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    want = Counter()
    for conv in {r["conv_id"] for r in given.select("conv_id").distinct().collect()}:
        want[(conv, *brute(ordered(spark, rows.filter(F.col("conv_id").eqNullSafe(F.lit(conv))))))] += 1
    assert found(cv.repair_conversations(df, times="times", part_bytes=part_bytes, segment_bytes=segment)) == want


def test_all_dropped_and_none(spark):
    df = spark.createDataFrame([(1, 1, "user", "a.", 0), (1, 2, "user", "b.", 0), (2, 1, "user", "c.", 1), (2, 2, "assistant", "d.", 1)], "conv_id long, turn long, role string, text string, times int")
    nothing = hashlib.sha256(b"").hexdigest()
    whole = hashlib.sha256(b"user:c.\nassistant:d.").hexdigest()
    assert found(cv.repair_conversations(df, times="times")) == Counter([(1, 0, 0, 0, 0, 0, 0, "", nothing), (2, 0, 0, 0, 0, 0, 0, "KK", whole)])
    assert cv.repair_conversations(df.filter("conv_id > 5"), times="times").count() == 0
    assert queries.conversations.damaged(df.filter("conv_id > 5")).count() == 0


def test_pieces_agree_with_the_whole():
    """Any division of a conversation gives the path of the undivided one."""
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randrange(1, 12)
        initials, faults = [rng.choice("suatu") for _ in range(n)], [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        whole = [(e[0], e[2]) for e in cv.walk(initials, faults, cv.distances(initials, faults, cv.FINAL), cv.START)]
        bounds = sorted({0, n, *(rng.randrange(n + 1) for _ in range(2))})
        pieces = list(zip(bounds, bounds[1:], strict=False))
        after, ends = [], cv.FINAL
        for a, z in reversed(pieces):
            after.append(ends)
            ends = cv.distances(initials[a:z], faults[a:z], ends)[: cv.N]
        state, joined = cv.START, []
        for (a, z), ends in zip(pieces, reversed(after), strict=True):
            for edit, _, role, state in cv.walk(initials[a:z], faults[a:z], cv.distances(initials[a:z], faults[a:z], ends), state, last=z == n):
                joined.append((edit, role))
        assert joined == whole


def test_a_conversation_that_a_third_of_all_rows_share(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("conv_id"), (F.col("id") % 50).alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), (F.col("id") % 11).cast("string"), F.lit(".")).alias("text"))
    out = cv.repair_conversations(rows, part_bytes=400)
    assert out.count() == 4000
    hot = out.filter("conv_id = 7").first()
    assert hot["duplicate"] == 2001 - 11 and len(hot["audit"]) >= 2001
