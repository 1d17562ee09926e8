"""Near duplicates of embeddings by cosine: an exact metric range join on pivot cells.

Vectors are scaled to length 1, where cosine >= c is distance <= eps = sqrt(2 - 2c). Pivots are a bounded sample of
a cell's own vectors; a vector's home is the cell of its nearest pivot. By the triangle inequality (in its sharper form
for hyperplanes) a vector can be within eps of one whose home is cell j only if
``(d(v, p_j)**2 - d(v, p_home)**2) / (2 d(p_home, p_j)) <= eps``, so it visits these cells and no other. All vectors of
a label are one cell at first; a cell with more than ``cell_rows`` vectors at home is divided by up to ``fan`` pivots,
its parts likewise, for as long as that makes them smaller. A cell then finds all neighbours of its own vectors alone, so cells are
joined independently; the pivots decide how much is replicated, never what is found.

Equal vectors of a label are one class with a weight, so copies are never paired. A cell is joined in blocks of
bounded size, inside a task by rows of a block. Links are those whose cosine in double precision is at least
``least``. Where vectors have no clusters (random directions in many dimensions) the bound excludes few cells, and
the work grows with the square of a label, at the speed of matrix products.

Defined results: null, zero, empty and non-finite vectors, vectors of null labels and vectors of another length
than the label's compared one link with nothing; repeated rows are copies; null ids are kept and are larger than any
other; an empty table gives an empty result. Only the id, embedding and label are read; ids and labels may have any
type that can be ordered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import drop_spool, join_unique, runs, spool, sql_type
from tidemill.llm.components import connected_components

#: Slack on bounds, far above rounding of doubles; it can only add visits.
SLACK = 1e-9
CELL = ["label", "dim", "cell"]


def visits(vectors: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cells of unit vectors, and a boolean matrix of the cells that each must visit (its home included)."""
    squared = np.maximum(2 - 2 * vectors @ pivots.T, 0)
    home = squared.argmin(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    gap = squared - squared[np.arange(len(vectors)), home][:, None]
    return home, gap <= 2 * apart * (eps + SLACK) + SLACK


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # first by the largest component: squares neither overflow nor vanish
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors of a column, all of length ``dim``, as rows."""
    return pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _cell_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy(*CELL).agg(F.count("*").alias("members"), F.count_if("is_home").alias("homes"))


def _divided(members: DataFrame, sizes: DataFrame, eps: float, level: int, *, cell_rows: int, fan: int, task_rows: int = 8192) -> DataFrame:
    """Members with the parts of their cells that they visit, where a cell has too many at home, else as they are.

    A cell's pivots are sent along with each of its slices of about ``task_rows`` members, ahead of them.
    """
    total = sizes.agg(F.sum("members")).first()[0]
    large = sizes.filter(F.col("homes") > cell_rows).withColumns({"wanted": F.least(F.lit(fan), F.ceil(F.col("homes") / cell_rows)).cast("int"), "slices": F.ceil(F.col("members") / task_rows).cast("int")})
    placed = spool(join_unique(members, large, CELL, weight="members", total=total), "vectors-large")
    mixed = F.xxhash64("vkey", F.lit(level))
    # About twice as many as wanted by a threshold on a hash, then those of the least hash: no cell is ranked whole.
    drawn = placed.filter("is_home").filter(F.pmod(mixed, "homes") < 2 * F.col("wanted")).withColumn("rank", F.row_number().over(Window.partitionBy(*CELL).orderBy(F.xxhash64("vkey", F.lit(-level - 1)), "vkey")))
    pivots = drawn.filter("rank <= wanted").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("copies", F.lit(0).cast("long"))
    rows = placed.withColumn("slice", F.pmod(mixed, "slices").cast("int"))
    columns = ["vkey", *CELL, "vector", "copies", "is_home"]
    both = pivots.select(*columns, "slice", F.lit(0).alias("turn")).unionByName(rows.select(*columns, "slice", F.lit(1).alias("turn")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in runs(batches, [*CELL, "slice"]):
            first = int(np.count_nonzero(piece.column("turn").to_numpy() == 0))
            vectors = unit(matrix(piece.column("vector"), piece.column("dim")[0].as_py()))
            rows = piece.slice(first).select(columns).combine_chunks()
            home, visited = visits(vectors[first:], vectors[:first], eps) if first else (np.zeros(len(rows), int), np.ones((len(rows), 1), bool))
            at, part = np.nonzero(visited)
            taken = rows.take(pa.array(at))
            was_home = taken.column("is_home").to_numpy().astype(bool)
            cells = taken.column("cell").to_numpy() * fan + part
            taken = taken.set_column(taken.schema.get_field_index("cell"), "cell", pa.array(cells, pa.int64()))
            taken = taken.set_column(taken.schema.get_field_index("is_home"), "is_home", pa.array(was_home & (home[at] == part)))
            yield from taken.combine_chunks().to_batches()

    schema = ", ".join(f"{c} {sql_type(members, c)}" for c in columns)
    dealt = both.repartition(*CELL, "slice").sortWithinPartitions(*CELL, "slice", "turn", "vkey").mapInArrow(deal, schema)
    small = join_unique(members, sizes.filter(F.col("homes") <= cell_rows).select(*CELL, "members"), CELL, weight="members", total=total)
    return small.withColumn("cell", F.col("cell") * fan).select(*columns).unionByName(dealt)  # its only part


def _cells(classes: DataFrame, eps: float, *, cell_rows: int, fan: int, levels: int = 8) -> tuple[DataFrame, DataFrame]:
    """The members of every cell (vkey, label, dim, cell, vector, copies, is_home) and the cells' sizes."""
    members = classes.select("vkey", "label", "dim", F.lit(0).cast("long").alias("cell"), "vector", "copies", F.lit(True).alias("is_home"))
    sizes = spool(_cell_sizes(members), "vector-sizes")
    largest = sizes.agg(F.max("homes")).first()[0] or 0
    for level in range(levels):  # fan ** 8 cells of a label fit the numbers of cells
        if largest <= cell_rows:
            break
        now = spool(_divided(members, sizes, eps, level, cell_rows=cell_rows, fan=fan), "vector-cells")
        drop_spool(sizes)
        drop_spool(members)
        members, sizes = now, spool(_cell_sizes(now), "vector-sizes")
        before, largest = largest, sizes.agg(F.max("homes")).first()[0]
        if largest > 0.9 * before:  # vectors that no pivot tells apart: blocks bound what a task holds all the same
            break
    return members, sizes


def bipartite_forest(links: np.ndarray, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a matrix of links, the smallest row of its component (the number of rows where alone)."""
    n = len(links)
    rows = np.arange(n)
    while True:
        columns, new = np.full(links.shape[1], n), rows.copy()
        for at in range(0, n, step):
            np.minimum(columns, np.where(links[at : at + step], rows[at : at + step, None], n).min(axis=0, initial=n), out=columns)
        for at in range(0, n, step):
            new[at : at + step] = np.minimum(new[at : at + step], np.where(links[at : at + step], columns[None, :], n).min(axis=1, initial=n))
        if (new == rows).all():
            return rows, columns
        rows = new


def _joined(members: DataFrame, sizes: DataFrame, least: float, block: int, step: int = 512) -> DataFrame:
    """(vkey, links, to): for each home vector in a piece of its cell, the vectors it links to there, and edges."""
    total = sizes.agg(F.sum("members")).first()[0] or 0
    used = sizes.filter("homes > 0").select(*CELL, "members", F.ceil(F.col("members") / block).cast("int").alias("pieces"), F.ceil(F.col("homes") / block).cast("int").alias("blocks"))
    placed = spool(join_unique(members, used, CELL, weight="members", total=total), "vectors-placed")
    mixed = F.xxhash64("vkey")
    probes = placed.withColumn("y", F.pmod(mixed, "pieces").cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("is_probe", F.lit(True))
    homes = placed.filter("is_home").withColumn("x", F.pmod(mixed, "blocks").cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("is_probe", F.lit(False))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, [*CELL, "x", "y"]):
            probe = cell.column("is_probe").to_numpy().astype(bool)
            if probe.all() or not probe.any():
                continue
            names = np.array(cell.column("vkey").to_pylist(), object)
            vectors = unit(matrix(cell.column("vector"), cell.column("dim")[0].as_py()))
            mine, theirs, copies = names[~probe], names[probe], cell.column("copies").to_numpy()[probe]
            homes_here, probes_here = vectors[~probe], vectors[probe].T
            links = np.zeros((len(mine), len(theirs)), bool)
            for at in range(0, len(mine), step):
                links[at : at + step] = homes_here[at : at + step] @ probes_here >= least
            place = {name: k for k, name in enumerate(theirs)}
            for k, name in enumerate(mine):
                if name in place:
                    links[k, place[name]] = False
            if not links.any():
                continue
            counts = np.concatenate([links[at : at + step] @ copies for at in range(0, len(mine), step)])
            rows, columns = bipartite_forest(links)
            linked, met = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([*mine[linked], *theirs[met]], pa.binary()), pa.array([*counts[linked].tolist(), *[0] * len(met)], pa.int64()), pa.array([*mine[rows[linked]], *mine[columns[met]]], pa.binary())],
                names=["vkey", "links", "to"],
            )

    grouped = [*CELL, "x", "y"]
    both = probes.unionByName(homes).select("vkey", *grouped, "vector", "copies", "is_probe")
    return both.repartition(*grouped).sortWithinPartitions(*grouped, "vkey").mapInArrow(join, "vkey binary, links long, to binary")


def near_vectors(vectors: DataFrame, *, least: float = 0.93, cell_rows: int = 4096, fan: int = 64, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id (smallest id reachable, itself included) and kept, a row for each vector."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("vector"), F.col(label_col).alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0.0)
    valid = F.coalesce(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite, F.lit(False))
    # Text of doubles is exact; adding 0.0 makes -0.0 equal to 0.0. The label's length keeps any label apart from the numbers.
    label = F.col("label").cast("string")
    key = F.unhex(F.md5(F.concat_ws(",", F.length(label).cast("string"), label, F.transform("vector", lambda x: (x + 0.0).cast("string"))).cast("binary")))
    rows = spool(rows.withColumn("vkey", F.when(valid, key)).withColumn("vector", F.when(valid, F.col("vector"))), "vectors")
    classes = rows.filter("vkey is not null").groupBy("vkey").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = spool(classes.withColumn("dim", F.size("vector")), "vector-classes")
    members, sizes = _cells(classes, math.sqrt(2 - 2 * least), cell_rows=cell_rows, fan=fan)
    links = spool(_joined(members, sizes, least, block), "vector-links")
    totals = links.groupBy("vkey").agg(F.sum("links").alias("links"))
    found = connected_components(links.select(F.col("vkey").alias("a"), F.col("to").alias("b")))
    named = found.join(classes.select(F.col("vkey").alias("node"), "first_id"), "node")
    roots = spool(named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("nodes")), "vector-roots")
    n_nodes = roots.agg(F.sum("nodes")).first()[0] or 0
    component = join_unique(found, roots, ["root"], weight="nodes", total=n_nodes).select(F.col("node").alias("vkey"), "component_id")
    per_class = classes.select("vkey", "first_id", "copies").join(totals, "vkey", "left").join(component, "vkey", "left")
    per_class = per_class.select("vkey", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component_id", "first_id").alias("component"))
    out = join_unique(rows.select("vec_id", "vkey"), spool(per_class, "vector-results"), ["vkey"], weight="copies", total=rows.count(), outer=True)
    alone = F.col("vkey").isNull()
    return out.select("vec_id", F.when(alone, 0).otherwise(F.col("links")).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component")).alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
