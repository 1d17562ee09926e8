"""A Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups' roots, a proof for each row.

A node's digest is the lower-case hex SHA-256 of its children's digests, concatenated as text; a tree of one leaf is
that leaf. Leaves are sorted over ranges of (group, id), and the sorted parts are kept in a checkpoint. Counts of a
part's rows by group, summed over the parts before it, give a leaf's place in its group. Each part builds the runs
of children that lie in it whole, level upon level. What is left at a part's two ends, a few nodes a level, is
shuffled by its coordinates and finished in blocks of parts, and the blocks' ends in blocks of blocks. A row's proof
comes from its part's own nodes and from the nodes that the part's two ends lack.

Defined results: null groups are one group before all others, null ids come before all others; rows of one id are in
the order of their leaves, so repeated rows are neighbours with equal leaves and proofs of their own; a null field
is ``-``, apart from an empty one (``0:``); an empty table gives an empty result. Columns that aren't asked for are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import runs, spool, sql_type
from tidemill.llm.ranges import checkpointed, range_sorted

#: Children of a node.
ARITY = 3
#: A proof: from the leaf's level upwards, the place among the run's nodes and the others' digests.
PROOF = "array<struct<place:int,others:array<string>>>"
_PROOF = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))
#: A node's place: its group, level and index, with the group's leaves, and the block of parts that it was made in.
_NODE = "block long, level int, idx long, total long, digest string, done boolean"


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """The digest of a row's fields: each ``-`` if null, else its UTF-8 byte count, a colon and the value as text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""

    def up(below: Column, level: Column) -> Column:
        others = level["others"]
        return F.sha2(F.array_join(F.concat(F.slice(others, 1, level["place"]), F.array(below), F.slice(others, level["place"] + 1, ARITY)), ""), 256)

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """One digest of all siblings of a proof, from the leaf's level upwards and from left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda level: level["others"])), ""), 256)


def parents_of(nodes: int) -> int:
    return -(-nodes // ARITY)


def climb(first: int, digests: list[str], total: int) -> list[tuple[int, list[str], int]]:
    """Levels (first index, digests, nodes of the whole group) that consecutive leaves lead to by themselves."""
    levels = [(first, digests, total)]
    while total > 1:
        end = first + len(digests)
        above = range(parents_of(first), parents_of(total) if end == total else end // ARITY)
        digests = [digest(digests[ARITY * r - first : ARITY * r + ARITY - first]) for r in above]
        first, total = above.start, parents_of(total)
        if not digests:
            break
        levels.append((first, digests, total))
    return levels


def unfinished(levels: list[tuple[int, list[str], int]]) -> Iterator[tuple[int, int, str, bool]]:
    """Nodes (level, index, digest, is root) whose parents such levels lack, and the root if it is there."""
    for k, (first, digests, total) in enumerate(levels):
        if total == 1:
            yield k, 0, digests[0], True
            continue
        low, high = (levels[k + 1][0], levels[k + 1][0] + len(levels[k + 1][1])) if k + 1 < len(levels) else (0, 0)
        for at, found in enumerate(digests, first):
            if not low <= at // ARITY < high:
                yield k, at, found, False


def _size_at(total: int, level: int) -> int:
    for _ in range(level):
        total = parents_of(total)
    return total


def _lacking(first: int, count: int, total: int) -> Iterator[tuple[int, int]]:
    """Coordinates (level, index) of the siblings that proofs of consecutive leaves need and ``climb`` doesn't give."""
    low, high, have, end, level = first, first + count - 1, first, first + count, 0
    while total > 1:
        for run in sorted({low // ARITY, high // ARITY}):
            for at in range(ARITY * run, min(ARITY * run + ARITY, total)):
                if not have <= at < end:
                    yield level, at
        have, end = parents_of(have), (parents_of(total) if end == total else end // ARITY)
        end = max(have, end)
        low, high, total, level = low // ARITY, high // ARITY, parents_of(total), level + 1


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict, list[str]]]:
    """(group, the piece's first row, digests) of the stretches of one group in a sorted part."""
    held, group, row = [], None, None
    for batch in batches:
        bounds = {c: batch.column(batch.schema.get_field_index(c)) for c in ("part", "head_first", "head_total", "tail_total")}
        for k, (g, d) in enumerate(zip(batch.column(batch.schema.get_field_index("grp")).to_pylist(), batch.column(batch.schema.get_field_index("digest")).to_pylist(), strict=True)):
            if held and g != group:
                yield group, row, held
                held = []
            if not held:
                group, row = g, {c: v[k].as_py() for c, v in bounds.items()}
            held.append(d)
    if held:
        yield group, row, held


class Forest:
    """Trees over ``leaves`` (grp, digest and the columns ``keep``), each group's in the order of ``order``."""

    def __init__(self, leaves: DataFrame, order: list[Column], keep: list[str], *, parts: int, fan_in: int = 16):
        self.keep, self.group_type = keep, sql_type(leaves, "grp")
        self.sorted = checkpointed(range_sorted(leaves.select("grp", "digest", *keep), [F.col("grp").asc_nulls_first(), *order], parts)).withColumn("part", F.spark_partition_id())
        counts = self.sorted.groupBy("part", "grp").agg(F.count("*").alias("n"))
        in_group = Window.partitionBy("grp").orderBy("part")
        before = F.coalesce(F.sum("n").over(in_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.select("part", "grp", "n", before.alias("first"), F.sum("n").over(Window.partitionBy("grp")).alias("total"))
        #: A row for each part and group in it: rows n, the first one's index and the group's total.
        self.pieces = spool(counts, "merkle-pieces")
        upper = self._in_parts()
        parts = self.sorted.rdd.getNumPartitions()
        done = [upper.filter("done")]
        while parts > 1 and not upper.filter(~F.col("done")).isEmpty():
            upper = self._in_blocks(upper.filter(~F.col("done")), fan_in)
            done.append(upper.filter("done"))
            parts = -(-parts // fan_in)
        #: Nodes that aren't children of a node of the same part, and roots.
        self.upper = done[0]
        for more in done[1:]:
            self.upper = self.upper.unionByName(more)

    def _in_parts(self) -> DataFrame:
        """Each part's unfinished nodes and roots. A part's first group may begin before it and its last may go on after it."""
        pieces = self.pieces.withColumn("opens", F.col("first") > 0)
        ends = pieces.filter((F.col("first") > 0) | (F.col("first") + F.col("n") < F.col("total")))
        bounds = ends.groupBy("part").agg(
            F.max(F.when(F.col("opens"), F.col("first"))).alias("head_first"),
            F.max(F.when(F.col("opens"), F.col("total"))).alias("head_total"),
            F.max(F.when(F.col("first") + F.col("n") < F.col("total"), F.col("total"))).alias("tail_total"),
        )
        rows = self.sorted.select("part", "grp", "digest").join(F.broadcast(bounds), "part", "left")  # a row for each part of the table

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = list(_pieces(batches))  # the digests of one part
            out: list[tuple] = []
            for k, (group, row, digests) in enumerate(found):
                first, total = 0, len(digests)
                if k == 0 and row["head_first"] is not None:
                    first, total = row["head_first"], row["head_total"]
                elif k == len(found) - 1 and row["tail_total"] is not None:
                    total = row["tail_total"]
                out += [(group, row["part"], level, at, total, d, top) for level, at, d, top in unfinished(climb(first, digests, total))]
            if out:
                yield _batch(out, group_type)

        group_type = rows.schema["grp"].dataType
        return spool(rows.mapInArrow(build, f"grp {self.group_type}, {_NODE}"), "merkle-ends")

    def _in_blocks(self, nodes: DataFrame, fan_in: int) -> DataFrame:
        """Nodes of ``fan_in`` neighbouring blocks, with the parents of the runs that are whole now."""

        def finish(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            known: dict[int, dict[int, str]] = {}
            for r in rows:
                known.setdefault(r["level"], {})[r["idx"]] = r["digest"]
            total, out, level = rows[0]["total"], [], 0
            while known.get(level) or any(k > level for k in known):
                at_level, size = known.get(level, {}), _size_at(total, level)
                for run in sorted({at // ARITY for at in at_level}) if size > 1 else ():
                    members = range(ARITY * run, min(ARITY * run + ARITY, size))
                    whole = all(at in at_level for at in members)
                    if whole:
                        known.setdefault(level + 1, {})[run] = digest([at_level[at] for at in members])
                    out += [(rows[0]["grp"], rows[0]["block"], level, at, total, at_level[at], whole) for at in members if at in at_level]
                if size == 1:
                    out += [(rows[0]["grp"], rows[0]["block"], level, 0, total, d, True) for d in at_level.values()]
                level += 1
            return pa.Table.from_batches([_batch(out, group_type)])

        group_type = nodes.schema["grp"].dataType
        blocks = nodes.withColumn("block", F.expr(f"block div {fan_in}"))
        return spool(blocks.groupBy("grp", "block").applyInArrow(finish, f"grp {self.group_type}, {_NODE}"), "merkle-blocks")

    def roots(self) -> DataFrame:
        """grp and the digest of its root."""
        return self.upper.filter(_is_root()).select("grp", "digest")

    def proofs(self, tops: DataFrame | None = None) -> DataFrame:
        """keep, digest, subroot, root and proof of each leaf; ``tops`` has (grp, root, top): what leads from a group's root on."""
        pieces = self.pieces.join(self.roots().select(F.col("grp").alias("g"), F.col("digest").alias("subroot")), F.col("grp").eqNullSafe(F.col("g"))).drop("g")
        if tops is None:
            pieces = pieces.withColumn("root", F.col("subroot")).withColumn("top", F.array().cast(PROOF))
        else:
            pieces = pieces.join(tops.select(F.col("grp").alias("g"), "root", "top"), F.col("grp").eqNullSafe(F.col("g"))).drop("g")
        pieces = spool(pieces, "merkle-tops")

        def want(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(r["part"], r["grp"], level, at) for r in batch.to_pylist() for level, at in _lacking(r["first"], r["n"], r["total"])]
                part, grp, level, at = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "grp": pa.array(grp, batch.schema.field("grp").type), "level": pa.array(level, pa.int32()), "idx": pa.array(at, pa.int64())})

        wanted = pieces.filter((F.col("first") > 0) | (F.col("first") + F.col("n") < F.col("total"))).select("part", "grp", "first", "n", "total").mapInArrow(want, f"part int, grp {self.group_type}, level int, idx long")
        nodes = self.upper.select(F.col("grp").alias("g"), "level", "idx", "digest")
        lent = wanted.join(nodes, [wanted["level"] == nodes["level"], wanted["idx"] == nodes["idx"], wanted["grp"].eqNullSafe(nodes["g"])]).groupBy("part", "grp")
        lent = lent.agg(F.collect_list(F.struct(wanted["level"], wanted["idx"], "digest")).alias("lent"))  # a few nodes a level
        lent = lent.withColumnRenamed("grp", "g").withColumnRenamed("part", "p")
        pieces = pieces.join(lent, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")), "left").drop("g", "p")
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # a row's place in its part
        rows = self.sorted.select("part", place.alias("place"), "grp", "digest", *[F.col(c).alias(f"keep_{c}") for c in self.keep])
        both = pieces.withColumn("place", F.lit(-1).cast("long")).unionByName(rows, allowMissingColumns=True)
        kept = [f"keep_{c}" for c in self.keep]

        def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in runs(batches, ["part"]):
                yield from _prove(part, kept)

        schema = ", ".join([*[f"keep_{c} {sql_type(self.sorted, c)}" for c in self.keep], f"digest string, subroot string, root string, proof {PROOF}"])
        proven = both.repartition("part").sortWithinPartitions("part", "place").mapInArrow(prove, schema)
        return proven.select(*[F.col(f"keep_{c}").alias(c) for c in self.keep], "digest", "subroot", "root", "proof")


def _is_root() -> Column:
    """Of a node: it is its group's root, at the level that its number of leaves leads to."""
    levels = F.when(F.col("total") == 1, 0)
    for k in range(1, 41):  # 3 to the 40th is beyond a long
        levels = levels.when(F.col("total") <= F.lit(min(ARITY**k, (1 << 63) - 1)), k)
    return F.col("level") == levels


def _batch(rows: list[tuple], group_type) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(group_type), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["grp", "block", "level", "idx", "total", "digest", "done"])


def _prove(part: pa.Table, kept: list[str], at_once: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows of proofs, a few thousand at a time, of a part's pieces (place -1) and leaves."""
    n_pieces = sum(1 for p in part.column("place").to_pylist() if p < 0)
    pieces = {r["grp"]: r for r in part.slice(0, n_pieces).select(["grp", "first", "n", "total", "subroot", "root", "top", "lent"]).to_pylist()}
    leaves = part.slice(n_pieces)
    groups, digests = leaves.column("grp").to_pylist(), leaves.column("digest").to_pylist()
    at = 0
    while at < len(groups):
        piece = pieces[groups[at]]
        first, count, total = piece["first"], piece["n"], piece["total"]
        levels = climb(first, digests[at : at + count], total)
        lent = {(x["level"], x["idx"]): x["digest"] for x in piece["lent"] or ()}
        paths: dict[tuple[int, int], list[dict]] = {}

        def path(level: int, idx: int, size: int) -> list[dict]:
            """What a proof has from this node on."""
            if size == 1:
                return piece["top"]  # noqa: B023
            if (level, idx) not in paths:  # noqa: B023
                run, others = idx // ARITY, []
                start, own, _ = levels[level] if level < len(levels) else (0, (), 0)  # noqa: B023
                for k in range(ARITY * run, min(ARITY * run + ARITY, size)):
                    if k != idx:
                        others.append(own[k - start] if start <= k < start + len(own) else lent[level, k])  # noqa: B023
                found = [{"place": idx - ARITY * run, "others": others}, *path(level + 1, run, parents_of(size))]
                if not level:
                    return found  # a leaf's own
                paths[level, idx] = found  # noqa: B023
            return paths[level, idx]  # noqa: B023

        for a in range(0, count, at_once):
            z = min(count, a + at_once)
            proofs = [path(0, first + k, total) for k in range(a, z)]
            taken = leaves.slice(at + a, z - a).combine_chunks()
            columns = [taken.column(c) for c in [*kept, "digest"]]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([piece["subroot"]] * (z - a), pa.string()), pa.array([piece["root"]] * (z - a), pa.string()), pa.array(proofs, _PROOF)], [*kept, "digest", "subroot", "root", "proof"])
        at += count


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "source", id_col: str = "doc_id", also: dict[str, Column] | None = None, part_rows: int = 50_000, fan_in: int = 16) -> DataFrame:
    """doc_id, source, leaf, subroot, root and proof of each row, and the columns ``also`` that are made of its row."""
    also = also or {}
    named = [F.col(id_col).alias("id"), F.col(group_col).alias("grp"), leaf_digest(*[F.col(c) for c in fields]).alias("digest")]
    leaves = spool(docs.select(*named, *[c.alias(f"also_{n}") for n, c in also.items()]), "merkle-leaves")
    cores = docs.sparkSession.sparkContext.defaultParallelism
    keep = ["id", *[f"also_{n}" for n in also]]
    trees = Forest(leaves, [F.col("id").asc_nulls_first(), F.col("digest")], keep, parts=max(cores, leaves.count() // part_rows), fan_in=fan_in)
    # The trees' roots are the leaves of one tree more.
    subroots = spool(trees.roots().select(F.lit(0).alias("grp"), "digest", F.col("grp").alias("of")), "merkle-subroots")
    top = Forest(subroots, [F.col("of").asc_nulls_first()], ["of"], parts=max(1, subroots.count() // part_rows), fan_in=fan_in)
    tops = top.proofs().select(F.col("of").alias("grp"), "root", F.col("proof").alias("top"))
    proven = trees.proofs(tops)
    return proven.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), *[F.col(f"also_{n}").alias(n) for n in also], "subroot", "root", "proof")


def verified_manifest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", group_col: str = "source", **sizes: int) -> DataFrame:
    """The manifest's digests, and whether rows still lead to the root when half of them have lost their line breaks.

    A row whose id's CRC-32 (of the decimal) is even is folded with its text's line feeds deleted; rows of null ids
    are left as they are.
    """
    fields = (id_col, group_col, "lang", "n_chars", text_col)
    tampers = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = leaf_digest(*[F.translate(F.col(c), "\n", "") if c == text_col else F.col(c) for c in fields])
    rows = manifest(docs, fields=fields, group_col=group_col, id_col=id_col, also={"found_leaf": F.when(tampers, changed)}, **sizes)
    rows = rows.withColumn("folded_root", folded(F.coalesce("found_leaf", "leaf"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
