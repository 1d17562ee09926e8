"""A key-value store of batches as a data source: rows by key in buckets, fields that later writes add or replace.

``df.write.format("keyvalue")`` puts rows (a column ``key_column`` and fields) into ``buckets`` folders by a hash of the key,
an Arrow file a task and bucket, and a manifest of the files that is written when all tasks are done, so a write that
failed leaves nothing that is read. ``spark.read.format("keyvalue").schema(...)`` reads the fields of the schema alone, each
bucket in a task, and of each key the newest value of each field that a write gave it (a null among them counts). Equality and IN filters on the key
choose buckets before any file is opened. A bucket's rows lie in ``CELLS`` cells by the rest of the hash: the record batches of a file are of cells
0, 1, ... in turn, so a task reads and holds a cell of its bucket at a time, of a few keys only theirs.

Options: ``path`` (local, ``file:`` or another store that Arrow knows), ``key_column`` (``key``), ``buckets`` (32, on the first
write). A task holds a cell of a bucket, so buckets are chosen by the store's size. Rows without a key raise; a key that is twice in one
write has its last row, by file and place.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterator, Sequence
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

BUCKETS, BATCH_ROWS = 32, 10_000
#: Cells of a bucket; a writer sorts rows into them once it has this many bytes or rows, and a reader leaves this many files open.
CELLS, HELD_BYTES, HELD_ROWS, OPEN_FILES = 32, 32 << 20, 100_000, 128


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def place_of(key: object, buckets: int, cells: int = 1) -> tuple[int, int]:
    """A key's bucket and its cell there, the same on every machine: a CRC of the key's text."""
    rest, bucket = divmod(zlib.crc32(str(key).encode()), buckets)
    return bucket, rest % cells


def bucket_of(key: object, buckets: int) -> int:
    return place_of(key, buckets)[0]


def manifests(path: str) -> list[dict]:
    """The writes to a store that were committed, oldest first."""
    fs, folder = _open(path)
    found = fs.get_file_info(pafs.FileSelector(f"{folder}/_writes", allow_not_found=True))
    out = []
    for info in found:
        if info.path.endswith(".json"):
            with fs.open_input_stream(info.path) as f:
                out.append(json.loads(f.read()))
    return sorted(out, key=lambda m: (m["at"], m["id"]))


@dataclass
class Bucket(InputPartition):
    number: int
    files: list[str]
    #: How many cells the files' batches are of in turn, and those that are wanted.
    cells: int = 1
    wanted: Sequence[int] = (0,)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str]]


class KeyValueReader(DataSourceReader):
    def __init__(self, path: str, key: str, schema: StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.key, self.fields, self.arrow = path, key, schema.fieldNames(), to_arrow_schema(schema)
        self.wanted: set | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Filters on the key choose buckets; Spark filters the rows all the same."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (self.key,):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        writes = manifests(self.path)
        if not writes:
            return [Bucket(0, [])]
        # Stores written before there were cells have one.
        buckets, cells = writes[0]["buckets"], writes[0].get("cells", 1)
        chosen: dict[int, set[int]] = {}
        for v in self.wanted or ():
            if v is not None:
                number, cell = place_of(v, buckets, cells)
                chosen.setdefault(number, set()).add(cell)
        files: dict[int, list[str]] = {}
        for w in writes:
            for number, name in w["files"]:
                if self.wanted is None or number in chosen:
                    files.setdefault(number, []).append(name)
        return [Bucket(n, names, cells, sorted(chosen[n]) if n in chosen else list(range(cells))) for n, names in sorted(files.items())] or [Bucket(0, [])]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        """Of each key and field the value of the last file that has the field, and of its last row there; cell by cell."""
        fs, folder = _open(self.path)
        with ExitStack() as stack:

            def opened(name: str, within: ExitStack) -> tuple[pa.ipc.RecordBatchFileReader, list[str]]:
                source = within.enter_context(fs.open_input_file(f"{folder}/{name}"))
                names = pa.ipc.open_file(source).schema.names
                have = [c for c in self.fields if c in names]
                columns = sorted({names.index(c) for c in [self.key, *have]})
                return pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=columns)), have

            few = len(partition.files) <= OPEN_FILES
            kept = [opened(name, stack) for name in partition.files] if few else []
            for cell in partition.wanted:
                parts = []
                for k, name in enumerate(partition.files):
                    with ExitStack() as within:
                        reader, have = kept[k] if few else opened(name, within)
                        batches = [reader.get_batch(i) for i in range(cell, reader.num_record_batches, partition.cells)]
                        parts += [(b, have) for b in batches if b.num_rows]
                if parts:
                    yield from self._newest(parts)

    def _newest(self, parts: list[tuple[pa.RecordBatch, list[str]]]) -> Iterator[pa.RecordBatch]:
        """The newest values of the keys of batches, which come in the order of their writes, each with the fields it has."""
        kind = dict(zip(self.fields, self.arrow.types, strict=True)).get(self.key, parts[0][0].column(self.key).type)
        coded = pa.chunked_array([b.column(self.key).cast(kind) for b, _ in parts]).combine_chunks().dictionary_encode()
        codes, starts = coded.indices.to_numpy(), np.cumsum([0, *[b.num_rows for b, _ in parts]])
        columns: list[pa.Array] = []
        for f in self.arrow:
            given = [k for k, (_, have) in enumerate(parts) if f.name in have]
            if f.name == self.key or not given:
                columns.append(coded.dictionary if f.name == self.key else pa.nulls(len(coded.dictionary), f.type))
                continue
            values = pa.chunked_array([parts[k][0].column(f.name).cast(f.type) for k in given]).combine_chunks()
            last = np.full(len(coded.dictionary), -1)
            np.maximum.at(last, np.concatenate([codes[starts[k] : starts[k + 1]] for k in given]), np.arange(len(values)))
            columns.append(values.take(pa.array(last, mask=last < 0)))
        table = pa.Table.from_arrays(columns, schema=self.arrow)
        yield from table.to_batches(max_chunksize=BATCH_ROWS)


class KeyValueWriter(DataSourceArrowWriter):
    def __init__(self, path: str, key: str, buckets: int | None):
        earlier = manifests(path)
        self.path, self.key, self.id = path, key, uuid.uuid4().hex
        self.buckets, self.cells = (earlier[0]["buckets"], earlier[0].get("cells", 1)) if earlier else (buckets or BUCKETS, CELLS)
        if buckets and buckets != self.buckets:
            raise ValueError(f"the store has {self.buckets} buckets")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = _open(self.path)
        fs.create_dir(f"{folder}/rows", recursive=True)
        open_files: dict[int, tuple] = {}
        held: list[pa.RecordBatch] = []

        def put() -> None:
            """The held rows by bucket and cell, a batch for each cell of a bucket that has rows."""
            rows = pa.Table.from_batches(held)
            held.clear()
            places = [place_of(k, self.buckets, self.cells) for k in rows.column(self.key).to_pylist()]
            at = np.array([b * self.cells + c for b, c in places], np.int64)
            order = np.argsort(at, kind="stable")  # a key's rows stay in their order
            rows, at = rows.take(order).combine_chunks(), at[order]
            for number in np.unique(at // self.cells).tolist():
                if number not in open_files:
                    name = f"rows/{number:05d}-{self.id}-{uuid.uuid4().hex}.arrow"
                    stream = fs.open_output_stream(f"{folder}/{name}")
                    open_files[number] = (name, stream, pa.ipc.new_file(stream, rows.schema))
                ends = np.searchsorted(at, np.arange(number * self.cells, (number + 1) * self.cells + 1))
                for low, high in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    part = rows.slice(low, high - low).combine_chunks().to_batches()
                    open_files[number][2].write_batch(part[0] if part else pa.RecordBatch.from_pylist([], schema=rows.schema))

        try:
            for batch in iterator:
                if batch.column(batch.schema.get_field_index(self.key)).null_count:
                    raise ValueError("a row without a key")
                held.append(batch)
                if sum(b.num_rows for b in held) >= HELD_ROWS or sum(b.nbytes for b in held) >= HELD_BYTES:
                    put()
            if sum(b.num_rows for b in held):
                put()
        finally:
            for _, stream, writer in open_files.values():
                writer.close()
                stream.close()
        return Written([(n, name) for n, (name, _, _) in open_files.items()])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = sorted(f for m in messages if m is not None for f in m.files)
        fs, folder = _open(self.path)
        fs.create_dir(f"{folder}/_writes", recursive=True)
        with fs.open_output_stream(f"{folder}/_writes/{self.id}.tmp") as f:
            f.write(json.dumps({"id": self.id, "at": time.time(), "buckets": self.buckets, "cells": self.cells, "files": files}).encode())
        fs.move(f"{folder}/_writes/{self.id}.tmp", f"{folder}/_writes/{self.id}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = _open(self.path)
        for m in messages:
            for _, name in m.files if m is not None else ():
                fs.delete_file(f"{folder}/{name}")


class KeyValueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyvalue"

    def schema(self) -> StructType:
        raise ValueError("name the key and the wanted fields by .schema(...)")

    def _path(self) -> tuple[str, str]:
        return self.options["path"].rstrip("/"), self.options.get("key_column", "key")

    def reader(self, schema: StructType) -> DataSourceReader:
        return KeyValueReader(*self._path(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("batches are put with mode append; fields of known keys are replaced")
        path, key = self._path()
        if key not in schema.fieldNames():
            raise ValueError(f"no column {key!r} of keys")
        return KeyValueWriter(path, key, int(self.options["buckets"]) if "buckets" in self.options else None)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets filters on keys choose buckets."""
    spark.dataSource.register(KeyValueSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def put(df: DataFrame, path: str, *, key: str = "key", buckets: int | None = None) -> None:
    register(df.sparkSession)
    options = {"path": path, "key_column": key} | ({"buckets": str(buckets)} if buckets else {})
    df.write.format("keyvalue").options(**options).mode("append").save()


def get(spark: SparkSession, path: str, fields: str, *, key: str = "key") -> DataFrame:
    """The keys and ``fields``, a schema that has the key among them."""
    register(spark)
    return spark.read.format("keyvalue").options(path=path, key_column=key).schema(fields).load()
