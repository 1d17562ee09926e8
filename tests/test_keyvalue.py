"""The key-value data source: fields added and replaced, pruned columns and buckets, failed writes, and odd keys."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemill.sources import keyvalue as K


def test_fields_are_added_and_replaced(spark, tmp_path):
    path = str(tmp_path / "store")
    K.put(spark.range(200).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("a"), F.array("id").alias("xs")).repartition(3), path, buckets=8)
    K.put(spark.range(0, 200, 2).select(F.concat(F.lit("k"), "id").alias("key"), F.when(F.col("id") > 100, -F.col("id")).alias("a"), F.lit("s").alias("b")), path)
    rows = {r["key"]: r for r in K.get(spark, path, "key string, a long, b string, xs array<long>, none int").collect()}
    assert len(rows) == 200
    for k in range(200):
        r = rows[f"k{k}"]
        assert r["xs"] == [k] and r["none"] is None and r["b"] == ("s" if k % 2 == 0 else None)
        assert r["a"] == (k if k % 2 else -k if k > 100 else None)
    assert K.get(spark, path, "key string, a long").rdd.getNumPartitions() == 8


def test_filters_choose_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    K.put(spark.range(300).select(F.col("id").alias("key"), (F.col("id") * 2).alias("a")), path, buckets=16)
    one = K.get(spark, path, "key long, a long").filter("key = 77")
    assert [tuple(r) for r in one.collect()] == [(77, 154)] and one.rdd.getNumPartitions() == 1
    few = K.get(spark, path, "key long, a long").filter(F.col("key").isin(1, 2, 3, 9999))
    assert sorted(r["a"] for r in few.collect()) == [2, 4, 6] and few.rdd.getNumPartitions() <= 4
    schema = K.get(spark, path, "key long, a long").select("key")._jdf.queryExecution().executedPlan().toString()
    assert "keyvalue" in schema


def test_a_write_that_fails_leaves_nothing_to_read(spark, tmp_path):
    path = str(tmp_path / "store")
    K.put(spark.createDataFrame([("a", 1)], "key string, x int"), path, buckets=2)
    bad = spark.range(10).select(F.when(F.col("id") == 9, None).otherwise(F.col("id").cast("string")).alias("key"), F.lit(5).alias("x"))
    with pytest.raises(PySparkException):
        K.put(bad, path)
    with pytest.raises(PySparkException):
        K.put(spark.createDataFrame([("a", 1)], "key string, x int"), path, buckets=4)
    assert [tuple(r) for r in K.get(spark, path, "key string, x int").collect()] == [("a", 1)]
    assert len(os.listdir(tmp_path / "store" / "_writes")) == 1


def test_empty_stores_and_repeated_keys(spark, tmp_path):
    assert K.get(spark, str(tmp_path / "none"), "key string, x int").count() == 0
    path = str(tmp_path / "store")
    K.put(spark.createDataFrame([("a", 1), ("a", 2)], "key string, x int").coalesce(1), path)
    assert [tuple(r) for r in K.get(spark, path, "key string, x int").collect()] == [("a", 2)]
    with pytest.raises(PySparkException):
        spark.read.format("keyvalue").options(path=path).load()


def test_a_task_holds_a_cell_at_a_time(spark, tmp_path, monkeypatch):
    """Files hold batches of cells in turn; a reader makes its rows of a cell's alone, of one key's cell where one is wanted."""
    path = str(tmp_path / "store")
    K.put(spark.range(4000).select(F.col("id").alias("key"), F.lit(1).alias("a")), path, buckets=2)
    K.put(spark.range(0, 4000, 3).select(F.col("id").alias("key"), F.lit(None).cast("int").alias("a"), F.lit("s").alias("b")), path)
    from pyspark.sql.types import StructType

    reader = K.KeyValueReader(path, "key", StructType.fromDDL("key long, a int, b string"))
    held, newest = [], reader._newest
    monkeypatch.setattr(reader, "_newest", lambda parts: (held.append(sum(b.num_rows for b, _ in parts)), newest(parts))[1])
    rows = {r["key"]: (r["a"], r["b"]) for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()}
    assert rows == {k: (1, None) if k % 3 else (None, "s") for k in range(4000)}
    assert len(held) == 2 * K.CELLS and max(held) < 4000 / K.CELLS * 2
    held.clear()
    reader.wanted = {77}
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) < 200 and len(held) == 1


def test_memory_is_a_cells_whatever_the_store_has(spark, tmp_path):
    """A writer's peak doesn't grow with its rows, a reader's (of a few keys, of all) stays below the bytes of its store."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql.types import StructType

    def peak(work):
        usual = pa.default_memory_pool()
        counted = pa.proxy_memory_pool(usual)
        pa.set_memory_pool(counted)
        tracemalloc.start()
        try:
            return work(), tracemalloc.get_traced_memory()[1] + counted.max_memory()
        finally:
            tracemalloc.stop()
            pa.set_memory_pool(usual)

    def batches(rows):
        for low in range(0, rows, 10_000):
            yield pa.RecordBatch.from_pydict({"key": pa.array(range(low, low + 10_000), pa.int64()), "a": pa.array([0.5] * 10_000)})

    def rows_read(reader):
        return sum(b.num_rows for p in reader.partitions() for b in reader.read(p))

    writes = {}
    for rows in (150_000, 300_000):
        path = str(tmp_path / f"store{rows}")
        writer = K.KeyValueWriter(path, "key", 2)
        message, writes[rows] = peak(lambda w=writer, n=rows: w.write(batches(n)))
        writer.commit([message])
        reader = K.KeyValueReader(path, "key", StructType.fromDDL("key long, a double"))
        found, held = peak(lambda r=reader: rows_read(r))
        assert found == rows and held < 16 * rows
        reader.wanted = {77, 78}
        found, held = peak(lambda r=reader: rows_read(r))
        assert found < rows / 8 and held < 16 * rows
    assert writes[300_000] < 1.3 * writes[150_000]
