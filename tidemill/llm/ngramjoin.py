"""N-gram Jaccard self-join of documents by MinHash banding, with links verified on full n-gram sets.

Words are runs of letters, digits and underscores of the lower-cased text; a document's set holds its 5-word
shingles (64-bit hashes), or its one shingle where it has fewer words, but not none. Steps:

1. Sets, a 128-bit hash of each set (equal sets are one class, so copies are never paired) and band hashes.
   With 32 bands of 5 rows a pair at similarity 0.8 meets in some band with probability 1 - 3e-6, at 0.85
   1 - 1e-8 (``missed`` gives the figure for any choice).
2. Classes are dealt by (band, hash). Buckets of one class go. A bucket's members are dealt over blocks and each
   pair of blocks is a cell of bounded size, so a hot bucket is spread over many tasks and all its pairs are seen.
   A pair counts in the first band in which it meets, if the sizes of its sets let it be similar enough at all.
   This step has the band hashes and sizes alone, and keeps the memberships that are some such pair's first meeting.
3. Those memberships get their full sets, and cells verify their pairs. A cell returns a row for each member:
   how many documents it links to, and an edge of a spanning forest of the cell's links; never all pairs.
4. Components of the edges.

Result: a row for each document with its class, its number of links (copies included) and its component.

A class of many copies, or of many bands, is one key in joins; such keys are joined by broadcast.

Defined results: null and wordless texts have no set; they link with nothing. Repeated rows are copies. A null
document id is kept and is larger than any other; ids may have any type that can be ordered. An empty table gives an
empty result. Only id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import drop_spool, fresh, join_unique, keep_keys, runs, spool, sql_type
from tidemill.llm.components import connected_components

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_WORD_HASHES: dict[str, int] = {}


def missed(similarity: float, bands: int, rows: int) -> float:
    """The probability that a pair of this similarity meets in no band."""
    return (1 - similarity**rows) ** bands


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hash(word: str) -> int:
    if len(_WORD_HASHES) > 300_000:
        _WORD_HASHES.clear()
    found = _WORD_HASHES[word] = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")
    return found


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's n-word shingles."""
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    get = _WORD_HASHES.get
    hashes = np.fromiter((get(w) or _word_hash(w) for w in words), np.uint64, len(words))
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = _scramble(out * np.uint64(31) + hashes[k : k + len(out)])
    return np.unique(out)


def set_key(items: bytes) -> bytes:
    """A 128-bit hash of a set in bytes."""
    return blake2b(items, digest_size=16).digest()


def _seeds(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)


def band_hashes(items: np.ndarray, bands: int, rows: int, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A 64-bit hash for each band of the MinHash signature of a set."""
    a, b = seeds
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 2048):  # multiply-shift hashes, whose high bits are well mixed
        hashed = items[at : at + 2048, None] * a[None, :] + b[None, :]
        np.minimum(least, hashed.min(axis=0), out=least)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for r in least.reshape(bands, rows).T:
        out = _scramble(out * np.uint64(31) + r)
    return out


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, skey, n_items, bands): the set's 128-bit hash, null without words, its size and its band hashes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(bands, rows)
        for batch in batches:
            keys, sizes, signed = [], [], []
            for text in batch.column(1):
                items = shingles(text.as_py(), n)
                keys.append(set_key(items.tobytes()) if len(items) else None)
                sizes.append(len(items))
                signed.append(band_hashes(items, bands, rows, seeds).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signed, pa.binary())], names=["doc_id", "text_hash", "skey", "n_items", "bands"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(sign, f"doc_id {sql_type(docs, 'doc_id')}, text_hash long, skey binary, n_items long, bands binary")


def _cells(members: DataFrame, block: int) -> DataFrame:
    """Members (band, hash, size, ...) of buckets of ``size`` classes, once for each pair of blocks that has their own: adds x, y, side."""
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("skey", "band"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", other)
    return dealt.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("blocks", "other")


def _first_meetings(sign: np.ndarray, sizes: np.ndarray, band: int, own: np.ndarray, x: int, y: int, least: float) -> np.ndarray:
    """A matrix of a cell's pairs (upper triangle) that meet in no earlier band, belong to this pair of blocks and are not
    too unlike in size."""
    n = len(sign)
    first = np.triu(np.ones((n, n), bool), 1)
    if x != y:
        first &= own[:, None] != own[None, :]
    if sizes.min() < least * sizes.max() - 1e-9:
        first &= (sizes[:, None] >= least * sizes[None, :] - 1e-9) & (sizes[None, :] >= least * sizes[:, None] - 1e-9)
    for k in range(band):
        first &= sign[:, k][:, None] != sign[:, k][None, :]
        if not first.any():
            break
    return first


def _pair_cell(cell: pa.Table, bands: int, least: float) -> np.ndarray:
    sign = np.frombuffer(b"".join(cell.column("bands").to_pylist()), np.uint64).reshape(-1, bands)
    at = lambda name: cell.column(name)[0].as_py()
    return _first_meetings(sign, cell.column("n_items").to_numpy(), at("band"), cell.column("own").to_numpy(), at("x"), at("y"), least)


def _needed(cells: DataFrame, bands: int, least: float) -> DataFrame:
    """The members of cells with a pair that meets there first: (skey, band, hash, size)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, ["band", "hash", "x", "y"]):
            if cell.num_rows > 1:
                first = _pair_cell(cell, bands, least)
                used = first.any(axis=0) | first.any(axis=1)
                if used.any():
                    yield from cell.filter(pa.array(used)).select(["skey", "band", "hash", "size"]).combine_chunks().to_batches()

    keys = ["band", "hash", "x", "y"]
    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(keep, "skey binary, band int, hash long, size long")


def jaccard_at_least(sets: list[np.ndarray], pairs: np.ndarray, least: float) -> np.ndarray:
    """Of the wanted pairs (a boolean matrix), those whose sets' Jaccard similarity is at least ``least``."""
    out = np.zeros_like(pairs)
    sizes = np.array([len(s) for s in sets])
    low, high = np.minimum(sizes[:, None], sizes[None, :]), np.maximum(sizes[:, None], sizes[None, :])
    pairs = pairs & (low >= least * high - 1e-9)
    n = int(pairs.sum())
    if n == 0:
        return out
    if n <= 4 * len(sets):
        both = [(i, j, len(np.intersect1d(sets[i], sets[j], assume_unique=True))) for i, j in zip(*np.nonzero(pairs), strict=True)]
        for i, j, c in both:
            out[i, j] = c >= least * (sizes[i] + sizes[j] - c) - 1e-9
        return out
    vocabulary, where = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(where, kind="stable")
    where, rows = where[order], rows[order]
    common = np.zeros(pairs.shape, np.float32)  # counts up to 2**24 are exact
    for at in range(0, len(vocabulary), 4096):
        a, z = np.searchsorted(where, [at, at + 4096])
        has = np.zeros((len(sets), 4096), np.float32)
        has[rows[a:z], where[a:z] - at] = 1
        common += has @ has.T
    union = sizes[:, None] + sizes[None, :] - common.astype(np.float64)
    return pairs & (common >= least * union - 1e-9)


def forest(links: np.ndarray) -> np.ndarray:
    """For each member the smallest member of its component under a boolean matrix of links (either triangle)."""
    both = links | links.T
    np.fill_diagonal(both, True)
    label = np.arange(len(links))
    while True:
        new = np.where(both, label[None, :], len(links)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(cells: DataFrame, bands: int, least: float) -> DataFrame:
    """(skey, links, to): a row for each cell and linked member, with the documents it links to there and an edge."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, ["band", "hash", "x", "y"]):
            if cell.num_rows < 2:
                continue
            first = _pair_cell(cell, bands, least)
            if not first.any():
                continue
            sets = [np.frombuffer(s, np.uint64) for s in cell.column("items").to_pylist()]
            linked = jaccard_at_least(sets, first, least)
            if not linked.any():
                continue
            copies = np.array(cell.column("copies").to_pylist(), np.int64)
            both = linked | linked.T
            counts, root = both @ copies, forest(linked)
            keys = cell.column("skey").to_pylist()
            used = np.flatnonzero(both.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in used], pa.binary()), pa.array(counts[used], pa.int64()), pa.array([keys[root[k]] for k in used], pa.binary())], names=["skey", "links", "to"])

    keys = ["band", "hash", "x", "y"]
    return cells.repartition(*keys).sortWithinPartitions(*keys, "skey").mapInArrow(verify, "skey binary, links long, to binary")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [(k.as_py(), shingles(t.as_py(), n).tobytes()) for k, t in zip(part.column(0), part.column(1), strict=True)]
                made = [(k, i) for k, i in made if set_key(i) == k]  # a repeated id may have other texts too
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.binary()), pa.array([i for _, i in made], pa.binary())], names=["skey", "items"])

    return docs.mapInArrow(build, "skey binary, items binary")


def near_duplicates(docs: DataFrame, *, n: int = 5, least: float = 0.8, bands: int = 32, rows: int = 5, block: int = 192, sign_block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest id with an equal set), n_links, component_id (smallest id reachable) and kept."""
    found = _placed(docs, n=n, least=least, bands=bands, rows=rows, block=block, sign_block=sign_block, id_col=id_col, text_col=text_col)
    return found.select("doc_id", "class_id", "n_links", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _placed(docs: DataFrame, *, n: int = 5, least: float = 0.8, bands: int = 32, rows: int = 5, block: int = 192, sign_block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``near_duplicates`` with text_hash and ``stays``: the least (doc_id, text_hash) of the component, null without a set."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = spool(_signatures(docs, n, bands, rows), "jaccard-signatures")
    with_set = signed.filter("skey is not null")
    classes = with_set.groupBy("skey").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.first("n_items").alias("n_items"), F.first("bands").alias("bands"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("stays"))
    classes = spool(classes, "jaccard-classes")
    band_keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.struct(k.alias("band"), F.conv(F.hex(F.substring("bands", k * 8 + 1, F.lit(8))), 16, -10).cast("long").alias("hash")))
    spread = classes.select("skey", F.inline(band_keys))
    crowded = spool(spread.groupBy("band", "hash").agg(F.count("*").alias("size")).filter("size > 1"), "jaccard-buckets")
    n_rows, n_classes = (t.count() for t in (signed, classes))
    members = join_unique(spread, crowded.withColumn("members", F.col("size")), ["band", "hash"], weight="members", total=bands * n_classes)
    # A class is at most ``bands`` rows here.
    signed_members = spool(members.join(classes.select("skey", "n_items", "bands"), "skey"), "jaccard-members")
    needed = spool(_needed(_cells(signed_members, sign_block), bands, least).distinct(), "jaccard-needed")
    drop_spool(signed_members)
    # Full sets of the classes that are left, made again from a text of each: that of the row which would stay.
    # Rows that agree in id and text may be many, but not more than their class.
    chosen = needed.select("skey").distinct().join(classes, "skey").select("skey", F.struct(F.col("stays.doc_id").alias("doc_id"), F.col("stays.text_hash").alias("text_hash")).alias("row"), "copies")
    chosen = spool(chosen, "jaccard-chosen")
    one_text = join_unique(docs.select("text", F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("row")), chosen, ["row"], weight="copies", total=n_rows, merge=True)
    sets = spool(_sets(one_text.select("skey", "text"), n).dropDuplicates(["skey"]), "jaccard-sets")
    full = needed.join(sets, "skey").join(classes.select("skey", "copies", "n_items", "bands"), "skey")
    links = spool(_verified(_cells(full, block), bands, least), "jaccard-links")
    totals = links.groupBy("skey").agg(F.sum("links").alias("links"))
    found = connected_components(links.select(F.col("skey").alias("a"), F.col("to").alias("b")))
    named = found.join(classes.select(F.col("skey").alias("node"), "class_id", "stays"), "node")
    roots = spool(named.groupBy("root").agg(F.min("class_id").alias("component_id"), F.min("stays").alias("component_stays"), F.count("*").alias("nodes")), "jaccard-roots")
    n_nodes = roots.agg(F.sum("nodes")).first()[0] or 0
    component = join_unique(found, roots, ["root"], weight="nodes", total=n_nodes).select(F.col("node").alias("skey"), "component_id", "component_stays")
    per_class = classes.select("skey", "class_id", "copies", "stays").join(totals, "skey", "left").join(component, "skey", "left")
    first = F.coalesce("component_stays", "stays")
    per_class = per_class.select("skey", "copies", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id"), F.struct(first["doc_id"].alias("doc_id"), first["text_hash"].alias("text_hash")).alias("stays"))
    out = join_unique(signed.select("doc_id", "text_hash", "skey"), spool(per_class, "jaccard-results"), ["skey"], weight="copies", total=n_rows, outer=True)
    alone = F.col("skey").isNull()
    return out.select("doc_id", "text_hash", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "stays")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One document of each group of near duplicates, with all its columns, and every document without any.

    The one of the smallest id stays, of rows that share it the one of the least text hash, of rows that agree in
    both the first by all columns. Rows without words are in no group and all stay.
    """
    key, at = fresh(docs, "key", "at")
    placed = _placed(docs, id_col=id_col, text_col=text_col, **how).filter("stays is not null").select(F.struct("doc_id", "text_hash").alias(key), "stays")
    marked = placed.groupBy(key).agg(F.first("stays").alias("stays"), F.count("*").alias("rows"))
    marked = spool(marked.select(key, (F.col(key) != F.col("stays")).alias("goes"), F.col("rows")).filter("goes or rows > 1"), "jaccard-marked")
    keyed = docs.withColumn(key, F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash")))
    total = placed_rows(marked)
    left = keep_keys(keyed, marked.filter("goes"), key, weight="rows", total=total, having=False)
    again = marked.filter("not goes")
    if again.isEmpty():
        return left.select(*docs.columns)
    # Repeated rows are reduced before they are shuffled.
    row = F.struct(*docs.columns)
    one = keep_keys(left, again, key, weight="rows", total=total, having=True).groupBy(key).agg(F.min_by(row, F.to_json(row)).alias(at)).select(f"{at}.*")
    return keep_keys(left, again, key, weight="rows", total=total, having=False).select(*docs.columns).unionByName(one)


def placed_rows(marked: DataFrame) -> int:
    """How many rows the marked keys have."""
    return marked.agg(F.sum("rows")).first()[0] or 0
