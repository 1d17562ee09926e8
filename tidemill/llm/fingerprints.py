"""Document fingerprints: threshold-scaled sketches of word shingles.

A shingle is five consecutive words (runs of letters, digits and underscores of the lower-cased text); a text of
fewer words, but not none, is one shingle. A sketch keeps every distinct 64-bit shingle hash below a fixed fraction
of the range, however long the text, so sketches of very unequal documents estimate how much of one is in the other,
and the sketch of a union is the union of sketches. A text none of whose hashes is below the threshold keeps its
smallest, so only texts without words have empty sketches; merging keeps that rule. A fingerprint is the sketch's
hashes ascending, 16 hex digits each.

``edited_pairs`` compares each document with an edited form and with its successor by id. Documents are sorted over
ranges of their ids, a task computes what its stretch of them allows in one pass, and only the last document of each
stretch is joined with the first of the next.

Defined results: a null text is an empty one; texts without words have the empty fingerprint; two empty fingerprints
are alike (1), an empty one and another aren't (0); null ids come first; documents of one id are in the order of
their texts' hashes, and repeated rows are each other's successors; the last document's successor is the first, so
one alone succeeds itself; an empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import spool, sql_type
from tidemill.llm.ranges import part_count, range_sorted

WORD = re.compile(r"\w+")
SHINGLE_WORDS = 5
#: The part of all shingle hashes that a sketch keeps.
FRACTION = 0.125
HEX = 16
#: Odd multipliers: of a word's place in its shingle, and of the last mixing of a hash (SplitMix64; fixed values).
PLACE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_edited double, shared_next double"


class Sketcher:
    """Sketches of texts; hashes of words are kept for as long as there are few."""

    def __init__(self, fraction: float = FRACTION, words: int = SHINGLE_WORDS, kept_words: int = 200_000):
        self.words, self.kept_words = words, kept_words
        self.least_out = np.uint64(min((1 << 64) - 1, int(fraction * (1 << 64))))
        self.known: dict[str, int] = {}

    def hashes(self, text: str) -> np.ndarray:
        """The hashes of all shingles of a text, in its order."""
        if len(self.known) > self.kept_words:
            self.known = {}
        known, found = self.known, WORD.findall(text.lower())
        for w in set(found).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        of_words = np.array([known[w] for w in found], dtype=np.uint64)
        width = min(self.words, len(found))
        if not width:
            return of_words
        out = np.zeros(len(found) - width + 1, dtype=np.uint64)
        for k in range(width):
            out = out * np.uint64(PLACE) + of_words[k : k + len(out)]
        for shift, factor in ((30, MIX[0]), (27, MIX[1])):
            out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
        return out ^ (out >> np.uint64(31))

    def sketch(self, text: str) -> np.ndarray:
        return self.cut(np.unique(self.hashes(text)))

    def cut(self, ascending: np.ndarray) -> np.ndarray:
        """Those of ascending hashes that a sketch keeps."""
        return ascending[: max(int(np.searchsorted(ascending, self.least_out)), min(1, len(ascending)))]


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated Jaccard similarity of two texts' shingles."""
    if not len(a) and not len(b):
        return 1.0
    both = shared(a, b)
    return both / (len(a) + len(b) - both)


def contained(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated part of the first text's shingles that are in the second."""
    return shared(a, b) / len(a) if len(a) else 1.0


#: Results as they are stored: the edited text's sketch as the places of the hashes that it has of the text's own, and others.
_PACKED = "n_chars long, edited_sha256 binary, sketch binary, kept binary, added binary, near_edited double, near_next double, shared_edited double, shared_next double"
_PACKED_NAMES = [f.split()[0] for f in _PACKED.split(", ")]
_PACKED_TYPES = [pa.int64(), *[pa.binary()] * 4, *[pa.float64()] * 4]
_NAMES = [f.split()[0] for f in _RESULT.split(", ")]
_TYPES = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]


def _row(sketcher: Sketcher, own: tuple[str, np.ndarray], following: tuple[str, np.ndarray]) -> tuple:
    """What ``_PACKED`` has of a document and its successor, each with its sketch."""
    text, sketch = own
    n = len(text)
    edited = text[: n - n // 4] + following[0][: n // 4]
    other = sketch if edited == text else sketcher.sketch(edited)
    kept, added = np.isin(sketch, other, assume_unique=True), np.setdiff1d(other, sketch, assume_unique=True)
    return (
        n,
        sha256(edited.encode()).digest(),
        sketch.tobytes(),
        np.packbits(kept).tobytes(),
        added.tobytes(),
        likeness(sketch, other),
        likeness(sketch, following[1]),
        contained(sketch, other),
        contained(sketch, following[1]),
    )


def _unpacked(n: int, edited_sha256: bytes, sketch: bytes, kept: bytes, added: bytes, *rest: float) -> tuple:
    own = np.frombuffer(sketch, np.uint64)
    stays = np.unpackbits(np.frombuffer(kept, np.uint8), count=len(own)).astype(bool)
    return n, edited_sha256.hex(), written(own), written(np.sort(np.concatenate([own[stays], np.frombuffer(added, np.uint64)]))), *rest


def _arrays(rows: list[tuple], types: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]


def edited_pairs(docs: DataFrame, *, fraction: float = FRACTION, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 32 << 20, at_once: int = 500) -> DataFrame:
    """doc_id and ``_RESULT`` of each document.

    The edited text has the last quarter of its characters replaced by the first as many, or all, of its successor.
    ``near_`` columns estimate Jaccard similarity, ``shared_`` columns how much of the document's own shingles the
    other text has.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = range_sorted(rows, [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")], part_count(rows, "text", part_bytes))
    id_type = rows.schema["doc_id"].dataType

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        sketcher, part = Sketcher(fraction), TaskContext.get().partitionId()
        ids_type = to_arrow_type(id_type)

        def batch_of(ids: list, results: list[tuple], ends: list[tuple]) -> pa.RecordBatch:
            """Results of documents, then rows (id, is first, text) of the stretch's two ends."""
            n, m = len(ids), len(ends)
            columns = [pa.concat_arrays([c, pa.nulls(m, c.type)]) for c in _arrays(results, _PACKED_TYPES)]
            first = pa.array([None] * n + [e[1] for e in ends], pa.bool_())
            text = pa.array([None] * n + [e[2] for e in ends], pa.string())
            return pa.RecordBatch.from_arrays([pa.array([part] * (n + m), pa.int32()), first, text, pa.array(ids + [e[0] for e in ends], ids_type), *columns], ["part", "is_first", "text", "doc_id", *_PACKED_NAMES])

        before: tuple | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                ids, out, ends = [], [], []
                piece = batch.slice(at, at_once)
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    now = (doc_id, (text, sketcher.sketch(text)))
                    if before is None:
                        ends.append((doc_id, True, text))
                    else:
                        ids.append(before[0])
                        out.append(_row(sketcher, before[1], now[1]))
                    before = now
                yield batch_of(ids, out, ends)
        if before is not None:
            yield batch_of([], [], [(before[0], False, before[1][0])])

    schema = f"part int, is_first boolean, text string, doc_id {sql_type(rows, 'doc_id')}, {_PACKED}"
    done = spool(ordered.mapInArrow(compare, schema), "fingerprints")
    firsts = done.filter("is_first").select("part", F.col("text").alias("following"))
    following = F.lead("part").over(Window.orderBy("part"))  # a number for each part
    order = firsts.select("part", following.alias("then"))
    order = order.withColumn("then", F.coalesce("then", F.lit(0) + firsts.agg(F.min("part")).scalar()))
    lasts = done.filter("not is_first").select("part", "doc_id", "text").join(order, "part").join(firsts.withColumnRenamed("part", "then"), "then")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(fraction)
        for batch in batches:
            texts = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            results = [_row(sketcher, (a, sketcher.sketch(a)), (b, sketcher.sketch(b))) for a, b in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_arrays(results, _PACKED_TYPES)], ["doc_id", *_PACKED_NAMES])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                piece = batch.slice(at, at_once)
                results = [_unpacked(*r) for r in zip(*[c.to_pylist() for c in piece.columns[1:]], strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), *_arrays(results, _TYPES)], ["doc_id", *_NAMES])

    id_name = f"doc_id {sql_type(rows, 'doc_id')}"
    finished = lasts.select("doc_id", "text", "following").mapInArrow(finish, f"{id_name}, {_PACKED}")
    packed = done.filter("is_first is null").select("doc_id", *_PACKED_NAMES).unionByName(finished)
    return packed.mapInArrow(unpack, f"{id_name}, {_RESULT}")


def fingerprints(docs: DataFrame, *, fraction: float = FRACTION, text_col: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with a column of fingerprints, without a shuffle; a column of that name is replaced."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        sketcher = Sketcher(fraction)
        return pa.array([written(sketcher.sketch(t)) for t in texts.fill_null("").to_pylist()], pa.string())

    return docs.withColumn(into, of(F.col(text_col)))


def hashes_of(fingerprint: Column) -> Column:
    """The hashes of a fingerprint, as an array of texts that sort as the numbers do."""
    return F.regexp_extract_all(fingerprint, F.lit(f"[0-9a-f]{{{HEX}}}"), F.lit(0))


def merged(rows: DataFrame, by: list[str], *, fingerprint: str = "fingerprint", fraction: float = FRACTION) -> DataFrame:
    """(by, hash): the sketch of each group's texts taken together, a row for each hash; no group meets in one task.

    It has every hash below the threshold, or the smallest where there is none. A group whose texts have no words has
    no row.
    """
    hashes = rows.select(*by, F.explode(hashes_of(F.col(fingerprint))).alias("hash")).distinct()
    limit = f"{min((1 << 64) - 1, int(fraction * (1 << 64))):0{HEX}x}"
    least = hashes.groupBy(*by).agg(F.min("hash").alias("hash"))
    return hashes.filter(F.col("hash") < limit).unionByName(least).distinct()


def contained_in_groups(rows: DataFrame, groups: DataFrame, by: list[str], id_col: str = "doc_id", *, fingerprint: str = "fingerprint") -> DataFrame:
    """(id, by, shared): for each document and group that share a hash, the estimated part of its shingles the group has.

    ``groups`` is what ``merged`` returns. Documents and groups without a shared hash have no row.
    """
    taken = F.size(hashes_of(F.col(fingerprint))).alias("of")
    hashes = rows.select(F.col(id_col).alias("id"), taken, F.explode(hashes_of(F.col(fingerprint))).alias("hash"))
    both = hashes.join(groups.select("hash", *by), "hash").groupBy("id", *by).agg((F.count("*") / F.first("of")).alias("shared"))
    return both.withColumnRenamed("id", id_col)
