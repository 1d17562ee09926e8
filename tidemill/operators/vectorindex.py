"""An inverted-list index over vectors with exact bounds: top-k by cosine that reads only the lists which can hold a result.

Vectors of length one are kept in lists around centroids, with each list's radius (the largest distance of a member to
its centroid). For a query at distance d of a centroid no member is nearer than d - radius, so no member's cosine is
above 1 - max(0, d - radius)**2 / 2. A first round reads the lists of the highest bounds that hold enough vectors; its
k-th score is a lower bound of the final one, so a second round reads the other lists whose bounds aren't below it, and
the result is that of a scan. Lists are folders of the stored table, so other lists' files aren't read.

Centroids come from a bounded sample (``sample_rows``); every vector with a direction is indexed. A list is stored in
blocks of a bounded number of rows, and queries meet blocks in chunks, so that a task holds a block and a chunk. Null,
empty and zero vectors, and those with a null or an infinite component, are in no list; queries like that find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import arrays as A

#: Rounding of distances; bounds are loosened by it, which costs reads and no results.
SLACK = 1e-9
#: Scores are rounded to this many digits, so that equal vectors tie whatever block they are in.
DIGITS = 12


def _directed(df: DataFrame, id_col: str, vector: str, length: Column | int | None = None) -> DataFrame:
    """(id, v): vectors as doubles of length one; those without a direction, or of another length, go."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    if length is not None:
        fine = fine & (F.size(v) == length)
    return df.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.coalesce(fine, F.lit(False))).select("id", A.l2_normalize(F.col("v")).alias("v"))


def _centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means; centroids without members stay."""
    rng = np.random.Generator(np.random.PCG64(seed))
    found = sample[rng.choice(len(sample), size=min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(sample @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), found)
    return found


@dataclass
class VectorIndex:
    """A stored index: its folder, the id's type, centroids, and of each list the members, the radius and the blocks."""

    path: str
    id_type: str
    centroids: np.ndarray
    members: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray

    @staticmethod
    def build(vectors: DataFrame, path: str, *, id_col: str = "memory_id", vector: str = "embedding", lists: int | None = None, sample_rows: int = 20_000, block_rows: int = 4096) -> VectorIndex:
        spark = vectors.sparkSession
        rows = _directed(vectors, id_col, vector)
        shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
        if not shape["n"]:
            raise ValueError("no vector has a direction")
        rows = rows.filter(F.size("v") == shape["dim"])
        lists = lists or int(np.clip(shape["n"] ** 0.5, 1, 4096))
        sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample_rows).collect()])
        centroids = _centroids(sample, lists)
        shared = spark.sparkContext.broadcast(centroids)  # at most 4096 or ``lists`` rows

        @F.arrow_udf("list int, distance double")
        def nearest(v: pa.Array) -> pa.Array:
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
            cosines = x @ shared.value.T
            at = np.argmax(cosines, axis=1)
            gap = np.linalg.norm(x - shared.value[at], axis=1)
            return pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(gap)], ["list", "distance"])

        placed = rows.withColumn("near", nearest(F.col("v"))).select("id", "v", "near.*")
        total = shape["n"]
        # A block's number is a hash; lists are cut by how many blocks the whole table would need, at least.
        blocks = max(1, -(-total // block_rows))
        placed = placed.withColumn("block", F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
        placed.repartition("list", "block").write.partitionBy("list").mode("overwrite").parquet(path)
        stored = spark.read.schema(f"id {dict(rows.dtypes)['id']}, v array<double>, distance double, block int, list int").parquet(path)
        stats = {r["list"]: r for r in stored.groupBy("list").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()}  # a row for each list
        members = np.array([stats[k]["n"] if k in stats else 0 for k in range(len(centroids))])
        radius = np.array([stats[k]["radius"] if k in stats else 0.0 for k in range(len(centroids))])
        return VectorIndex(path, dict(rows.dtypes)["id"], centroids, members, radius, np.maximum(1, -(-members // block_rows)))

    def _read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"id {self.id_type}, v array<double>, distance double, block int, list int").parquet(self.path)

    def _bounds(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, v, list, bound, first): of each query the lists with their bounds, and whether the first round reads them."""
        centroids, members, radius = self.centroids, self.members, self.radius

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    q = np.array(part.column(1).to_pylist()).reshape(part.num_rows, -1)
                    gap = np.sqrt(np.maximum(0.0, 2 - 2 * q @ centroids.T))
                    best = np.where(members > 0, 1 - np.maximum(0.0, gap - radius - SLACK) ** 2 / 2, -2.0)
                    order = np.argsort(-best, axis=1, kind="stable")
                    before = np.cumsum(members[order], axis=1) - members[order]
                    first = np.zeros_like(best, dtype=bool)
                    np.put_along_axis(first, order, before < 4 * k, axis=1)
                    for i in range(part.num_rows):
                        held = np.flatnonzero(members > 0)
                        yield pa.RecordBatch.from_arrays([part.column(0).slice(i, 1).take(pa.array(np.zeros(len(held), np.int64))), pa.array(held.astype(np.int32)), pa.array(best[i, held]), pa.array(first[i, held])], ["query", "list", "bound", "first"])

        id_type = dict(queries.dtypes)["query"]
        return queries.select("query", "v").mapInArrow(bound, f"query {id_type}, list int, bound double, first boolean")

    def _scored(self, pairs: DataFrame, queries: DataFrame, k: int, among: DataFrame | None, lists: list[int], query_chunk: int) -> DataFrame:
        """(query, id, score): the best k of each list that a query reads."""
        spark = queries.sparkSession
        vectors = self._read(spark).filter(F.col("list").isin(lists))
        if among is not None:
            vectors = vectors.join(among.select(F.col(among.columns[0]).alias("id")), "id", "left_semi")
        blocks = F.element_at(F.array(*[F.lit(int(b)) for b in self.blocks]), F.col("list") + 1)
        chunks = max(1, -(-queries.count() // query_chunk))
        chunk = F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("int")
        wanted = pairs.join(queries, "query").withColumn("chunk", chunk).withColumn("cell", F.explode(F.sequence(F.lit(0), blocks - 1)))
        cells = vectors.withColumn("cell", (F.col("block") % blocks).cast("int"))
        cells = cells.join(wanted.select("list", "cell", "chunk").distinct(), ["list", "cell"]).select(*[F.col(c).alias(f"of_{c}") for c in ("list", "cell", "chunk")], "id", "v")

        def product(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(x):
                return pd.DataFrame({"query": q["query"].iloc[:0], "id": x["id"].iloc[:0], "score": np.zeros(0)})
            scores = np.round(np.stack(q["v"].to_numpy()) @ np.stack(x["v"].to_numpy()).T, DIGITS)
            ids, out = x["id"].to_numpy(), []
            order = np.argsort(ids, kind="stable")
            for name, row in zip(q["query"].to_numpy(), scores[:, order], strict=True):
                best = np.argsort(-row, kind="stable")[:k]
                out.append(pd.DataFrame({"query": name, "id": ids[order][best], "score": row[best]}))
            return pd.concat(out)

        key = ["list", "cell", "chunk"]
        schema = f"query {dict(queries.dtypes)['query']}, id {self.id_type}, score double"
        return wanted.select(*key, "query", "v").groupBy(*key).cogroup(cells.groupBy(*[f"of_{c}" for c in key])).applyInPandas(product, schema)

    def search(self, queries: DataFrame, k: int, *, id_col: str = "query", vector: str = "v", among: DataFrame | None = None, query_chunk: int = 1024) -> tuple[DataFrame, DataFrame]:
        """((query, id, score) of the ``k`` nearest vectors of each query, ties to the smaller id; (query, lists, read) of what was
        read for it). ``among`` has the ids, in its first column, that may be found. Query ids are unique."""
        from tidemill.sources.storage import stored

        asked = stored(_directed(queries, id_col, vector, self.centroids.shape[1]).withColumnRenamed("id", "query"), "index-queries")
        pairs = stored(self._bounds(asked, k), "index-bounds")
        every = [int(r) for r in np.flatnonzero(self.members)]
        best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        top = lambda df: df.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= k)

        def lists_of(df: DataFrame) -> list[int]:
            return [r["list"] for r in df.select("list").distinct().collect()]  # as many as the index has, at most

        first = pairs.filter("first").select("query", "list")
        found = stored(top(self._scored(first, asked, k, among, lists_of(first), query_chunk)), "index-first")
        least = found.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        rest = stored(pairs.filter("not first").join(least, "query", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).select("query", "list"), "index-rest")
        more = self._scored(rest, asked, k, among, lists_of(rest), query_chunk)
        result = top(found.drop("k").unionByName(more)).drop("k")
        read = first.unionByName(rest).groupBy("query").agg(F.count("*").alias("read"))
        return result, read.select("query", F.lit(len(every)).alias("lists"), "read")
