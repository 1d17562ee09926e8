"""Benchmark decontamination by Wu-Manber search for word windows of benchmark items.

Patterns are the items' windows of 13 consecutive words; an item of fewer words, but not none, is one pattern.
The search runs over word numbers with blocks of two words. A shift table says how far the window may move
when its last block stands nowhere, or only so far left, in any pattern; blocks that end a pattern lead to a
bucket of test strings, and direct comparison confirms each occurrence. Patterns of full length and shorter
ones are searched apart, as the shortest pattern limits all shifts.

The benchmark is cut into blocks of about ``block_words`` words. Tasks build the blocks' tables and write them to the
shared folder; the driver only sees their paths. A searching task holds ``KEPT`` blocks at a time; where there are more, it
takes its documents in parts of ``PART_BYTES`` and loads each block once for a part, so a large benchmark costs
time in proportion, not memory.

Defined results: null and wordless texts have no words, no hits and are not contaminated; null or wordless items
have no patterns; items with equal windows all count; repeated rows stay; an empty benchmark contaminates nothing.
Columns of the documents may have any name.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import fresh, open_fs, spool, work_path

#: Bytes that are no part of a word become spaces and A-Z become lower case; all bytes of other scripts are word bytes.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
HITS = "n_words long, n_hit long, item_ids array<string>"
#: Blocks of patterns that a task keeps, and bytes of text that it takes at a time where there are more blocks.
KEPT, PART_BYTES = 2, 32 << 20


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text after lower-casing A-Z, as UTF-8."""
    return text.encode().translate(_TABLE).split() if text else []


class PatternSet:
    """Wu-Manber tables of one block of patterns: words of a pattern -> ids of its items."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]], window: int):
        self.numbers: dict[bytes, int] = {}
        for p in patterns:
            for w in p:
                self.numbers.setdefault(w, len(self.numbers) + 1)
        self.base = len(self.numbers) + 1
        self.groups = []
        for chosen in ({p for p in patterns if len(p) == window}, {p for p in patterns if len(p) < window}):
            if chosen:
                self.groups.append(self._tables({tuple(self.numbers[w] for w in p): patterns[p] for p in chosen}))

    def _block(self, words: tuple[int, ...], end: int, size: int) -> int:
        return words[end - 1] * self.base + words[end] if size == 2 else words[end]

    def _tables(self, patterns: dict[tuple[int, ...], list[str]]):
        m = min(map(len, patterns))
        size = min(2, m)
        shift: dict[int, int] = {}
        buckets: dict[int, list] = defaultdict(list)
        for p, items in patterns.items():
            for end in range(size - 1, m):
                key = self._block(p, end, size)
                shift[key] = min(shift.get(key, m), m - 1 - end)
            buckets[self._block(p, m - 1, size)].append((p, len(p), items))
        return m, size, m - size + 1, shift, dict(buckets)

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Intervals of words that occurrences cover, and the items that occur."""
        get = self.numbers.get
        text = [get(w, 0) for w in words]
        spans, items, n, base = [], set(), len(text), self.base
        for m, size, most, shift, buckets in self.groups:
            at = m - 1
            find = shift.get
            while at < n:
                key = text[at - 1] * base + text[at] if size == 2 else text[at]
                step = find(key, most)
                if step:
                    at += step
                    continue
                start = at - m + 1
                for p, length, owners in buckets[key]:
                    if tuple(text[start : start + length]) == p:
                        spans.append((start, start + length))
                        items.update(owners)
                at += 1
        return spans, items


def write_pattern_blocks(benchmark: DataFrame, *, window: int = 13, block_words: int = 2_000_000, id_col: str = "item_id", text_col: str = "text") -> list[str]:
    """Write tables of the patterns to the shared folder, in blocks of about ``block_words`` words; returns the blocks' paths.

    There is a path for each block, so the driver holds as many as the benchmark has times ``block_words`` words.
    """
    folder = work_path(benchmark.sparkSession, "patterns")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, ...], list[str]] = defaultdict(list)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                fs, local = open_fs(folder)
                fs.create_dir(local, recursive=True)
                name = f"{uuid.uuid4().hex}.pickle"
                with fs.open_output_stream(f"{local}/{name}") as f:
                    f.write(pickle.dumps(PatternSet(held, window), pickle.HIGHEST_PROTOCOL))
                held.clear()
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"]})

        for batch in batches:
            for item, text in zip(*batch.columns, strict=True):
                words = words_of(text.as_py())
                for p in {tuple(words[k : k + window]) for k in range(max(1, len(words) - window + 1))} if words else ():
                    held[p].append(item.as_py() or "")
                    size += len(p)
                if size >= block_words:
                    yield from flush()
                    size = 0
        yield from flush()

    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    # A window has up to ``window`` words of its own; a word has at least two bytes with what parts it from the next.
    most = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-most * window // (2 * block_words)))
    written = spool(items.repartition(parts).mapInArrow(build, "path string"), "pattern-paths")
    return sorted(r["path"] for r in written.collect())


_BLOCKS: dict[str, PatternSet] = {}


def _load(path: str) -> PatternSet:
    if path not in _BLOCKS:
        while len(_BLOCKS) >= KEPT:
            _BLOCKS.pop(next(iter(_BLOCKS)))
        fs, local = open_fs(path)
        with fs.open_input_file(local) as f:
            _BLOCKS[path] = pickle.loads(f.read())
    return _BLOCKS[path]


def _parts(batches: Iterator[pa.Array], many_blocks: bool) -> Iterator[list[pa.Array]]:
    """Batches, alone or, with many blocks of patterns, together up to ``PART_BYTES``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if not many_blocks or size >= PART_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _covered(n_words: int, spans: list[tuple[int, int]]) -> int:
    """How many of a text's words lie in some interval."""
    if not spans:
        return 0
    hit = np.zeros(n_words + 1, dtype=np.int64)
    for a, z in set(spans):
        hit[a] += 1
        hit[z] -= 1
    return int((np.cumsum(hit) > 0).sum())


def find_hits(text: Column, paths: list[str]) -> Column:
    """A struct of n_words, n_hit and the sorted ids of the items that occur, for a text column."""
    schema = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string()))])

    @F.arrow_udf(HITS)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in _parts(batches, len(paths) > KEPT):
            n = sum(map(len, part))
            counts, spans, items = [0] * n, [[] for _ in range(n)], [set() for _ in range(n)]
            here = [p for p in paths if p in _BLOCKS]
            for b, path in enumerate([*here, *(p for p in paths if p not in here)] or [None]):
                patterns = _load(path) if path else None
                for k, text in enumerate(t for batch in part for t in batch):
                    words = words_of(text.as_py())
                    if b == 0:
                        counts[k] = len(words)
                    if patterns and words:
                        found, owners = patterns.search(words)
                        spans[k] += found
                        items[k] |= owners
            found = [{"n_words": c, "n_hit": _covered(c, s), "item_ids": sorted(i)} for c, s, i in zip(counts, spans, items, strict=True)]
            at = 0
            for batch in part:
                yield pa.array(found[at : at + len(batch)], schema)
                at += len(batch)

    return hits(text)


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """The contamination rule: at least one word in twenty stands in an occurrence, and at least one at all."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), block_words: int = 2_000_000) -> DataFrame:
    """The ``keep`` columns and n_words, n_hit, n_items, items_sha256 and contaminated for each document."""
    paths = write_pattern_blocks(benchmark, window=window, block_words=block_words)
    (hits,) = fresh(docs, "hits")
    found = docs.select(*keep, find_hits(F.col(text_col), paths).alias(hits))
    h = lambda c: F.col(f"{hits}.{c}")
    return found.select(*keep, h("n_words").alias("n_words"), h("n_hit").alias("n_hit"), F.size(h("item_ids")).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", h("item_ids")).cast("binary"), 256).alias("items_sha256"), contaminated(h("n_hit"), h("n_words")).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, text_col: str = "text", block_words: int = 2_000_000) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    paths = write_pattern_blocks(benchmark, window=window, block_words=block_words)
    (hits,) = fresh(docs, "hits")
    flagged = docs.withColumn(hits, find_hits(F.col(text_col), paths))
    return flagged.filter(~contaminated(F.col(f"{hits}.n_hit"), F.col(f"{hits}.n_words"))).select(*docs.columns)


def sha256_of_ids(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
