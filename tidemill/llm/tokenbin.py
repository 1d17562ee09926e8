"""Token ids as flat binary files: unsigned integers, with 64-bit document offsets beside them.

Documents are range-partitioned by id, so part ``k`` holds the ids of one range in ascending order; there is a part for
each ``part_bytes`` of text, and at least one a core. A part is
``<name>.bin`` (little-endian ids, 16 bits where the vocabulary allows, else 32) and ``<name>.idx`` (document
ids and offsets of the documents, relative to the part). Bases of the parts are prefix sums over the manifest,
which has a row for each part. Files are named by a fresh id and only the manifest says which count, so a task
that runs twice leaves an orphan at worst.

Defined results: a null text is an empty one and has only the end id; null document ids come first; repeated
ids stay, ordered by text; an empty table gives an empty manifest. Ids are numbers, as the files have them. Other
columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import LATIN_END, Kept, byte_alphabet, open_fs, spool, work_path

MAGIC = b"TMTOKIDX"
MANIFEST = "part int, path string, dtype string, n_docs long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class SpacedEncoder:
    """Ids of whole texts from the ids of their pieces between white space, which are kept.

    For tokenizers that drop white space and never look across it (of those here, ``word_bpe_49k``): a text's
    ids are then the ids of its pieces, in order. Long pieces are encoded each time, and the store holds a bounded
    number of the pieces used lately.
    """

    def __init__(self, path: str, dtype: str, max_entries: int = 1_000_000, max_piece: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.code, self.max_piece = Tokenizer.from_file(path), {"<u2": "H", "<u4": "I"}[dtype], max_piece
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])], [n["type"] for n in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.model = self.tokenizer.model if steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) else None
        self.alphabet = {b: c for c, b in byte_alphabet().items()}
        self.kept = Kept(max_entries)

    def _word(self, piece: str) -> bytes | None:
        """Ids of a piece that is one Latin word, by the model alone; None for others."""
        if piece.isascii():
            if not piece.isalpha():
                return None
            symbols = piece.lower()
        else:
            symbols = piece.lower()
            if not symbols.isalpha() or max(piece) >= LATIN_END or not unicodedata.is_normalized("NFC", piece):
                return None
            symbols = "".join(map(self.alphabet.__getitem__, symbols.encode()))
        ids = [t.id for t in self.model.tokenize(symbols)]
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _encode(self, pieces: list[str]) -> dict[str, bytes]:
        out = {p: self._word(p) if self.model is not None else None for p in pieces}
        rest = [p for p, b in out.items() if b is None]
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else [], strict=True):
            out[p] = struct.pack(f"<{len(e.ids)}{self.code}", *e.ids)
        return out

    def encode(self, text: str) -> bytes:
        pieces = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        try:
            return b"".join(map(self.kept.new.__getitem__, pieces))
        except KeyError:
            pass
        at_once, get = self.kept.new.get, self.kept.get
        found = {p: at_once(p) or get(p) for p in set(pieces)}
        missing = [p for p, b in found.items() if b is None]
        if missing:
            # A letter ends a word before a full stop or comma, so the word alone may be known; case doesn't matter.
            stems = {p: (p[:-1] if len(p) > 1 and p[-1] in ".," and p[-2].lower()[-1].isalpha() else p) for p in missing}
            stems = {p: (s.lower() if s.isascii() and "<|" not in s else s) for p, s in stems.items()}
            ends = {p: p[len(s) :] for p, s in stems.items()}
            parts = {s: get(s) for s in {*stems.values(), *ends.values()}}
            fresh = self._encode([s for s, b in parts.items() if b is None])
            parts.update(fresh)
            for p in missing:
                found[p] = parts[stems[p]] + (parts[ends[p]] if ends[p] else b"")
            for p, b in (*fresh.items(), *((p, found[p]) for p in missing)):
                if len(p) <= self.max_piece:
                    self.kept.put(p, b)
        return b"".join([found[p] for p in pieces])


_ENCODERS: dict[tuple, SpacedEncoder] = {}


def _encoder(path: str, dtype: str) -> SpacedEncoder:
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = SpacedEncoder(path, dtype)
    return _ENCODERS[path, dtype]


def id_dtype(tokenizer_path: str) -> str:
    """The narrowest of 16 and 32 bits that holds every id of the tokenizer."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, tokenizer_path: str, *, end_id: int, out_dir: str | None = None, parts: int | None = None, part_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id``, write the files and return their manifest (MANIFEST's columns)."""
    spark = docs.sparkSession
    out_dir = out_dir or work_path(spark, "token-files")
    if parts is None:
        bytes_of_text = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        parts = max(spark.sparkContext.defaultParallelism, bytes_of_text // part_bytes)
    dtype = id_dtype(tokenizer_path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, dtype)
        end = np.array([end_id], dtype=dtype).tobytes()
        width = np.dtype(dtype).itemsize
        fs, folder = open_fs(out_dir)
        part, stream, ids, known, lengths = TaskContext.get().partitionId(), None, array("q"), bytearray(), array("q")
        path = f"part-{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            texts, doc_ids = batch.column(1), batch.column(0)
            for k in range(batch.num_rows):
                if stream is None:
                    fs.create_dir(folder, recursive=True)
                    stream = fs.open_output_stream(f"{folder}/{path}.bin")
                found = encoder.encode(texts[k].as_py() or "") + end
                stream.write(found)
                ids.append(doc_ids[k].as_py() or 0)
                known.append(doc_ids[k].is_valid)
                lengths.append(len(found) // width)
        if stream is None:
            return
        stream.close()
        with fs.open_output_stream(f"{folder}/{path}.idx") as index:
            index.write(MAGIC + struct.pack("<2sxxxxxxQ", dtype[1:].encode(), len(ids)))
            index.write(bytes(known))
            index.write(np.array(ids, dtype="<i8").tobytes())
            index.write(np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{out_dir}/{path}"], "dtype": [dtype], "n_docs": [len(ids)], "n_tokens": [sum(lengths)]})

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return spool(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def bases(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``: how many ids all earlier parts hold (prefix sums over a row for each part)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


class Part:
    """A part's document ids (None where null), offsets (one more than documents) and token ids.

    Token ids are memory-mapped where the part is a file; of another store only the ranges asked for are read.
    """

    def __init__(self, path: str, dtype: str):
        self.dtype = np.dtype(dtype)
        self.fs, local = open_fs(path)
        with self.fs.open_input_file(f"{local}.idx") as f:
            raw = f.read()
        assert raw[:8] == MAGIC, f"{path}.idx is no index"
        _, n = struct.unpack("<2sxxxxxxQ", raw[8:24])
        self.known = np.frombuffer(raw, "u1", n, 24)
        self.ids = np.frombuffer(raw, "<i8", n, 24 + n)
        self.offsets = np.frombuffer(raw, "<u8", n + 1, 24 + 9 * n).astype("i8")
        self.mapped = self.file = None
        if isinstance(self.fs, pafs.LocalFileSystem):
            self.mapped = np.memmap(f"{local}.bin", dtype=dtype, mode="r") if self.offsets[-1] else np.zeros(0, dtype)
        else:
            self.file = self.fs.open_input_file(f"{local}.bin")

    def doc_ids(self, a: int, z: int) -> list[int | None]:
        return [i if k else None for i, k in zip(self.ids[a:z].tolist(), self.known[a:z].tolist(), strict=True)]

    def tokens(self, a: int, z: int) -> np.ndarray:
        """The token ids from document ``a`` to before document ``z``."""
        start, end = int(self.offsets[a]), int(self.offsets[z])
        if self.mapped is not None:
            return self.mapped[start:end]
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((end - start) * width, start * width), self.dtype)

    def stretches(self, most_docs: int, most_tokens: int) -> Iterator[tuple[int, int]]:
        """Documents a to before z, at most ``most_docs`` and, unless it is one alone, ``most_tokens`` token ids at a time."""
        a, n = 0, len(self.ids)
        while a < n:
            z = int(np.searchsorted(self.offsets, self.offsets[a] + most_tokens, side="right")) - 1
            z = min(max(z, a + 1), a + most_docs, n)
            yield a, z
            a = z


def open_part(path: str, dtype: str) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, offsets and all token ids of a part; these are memory-mapped where it is a file."""
    part = Part(path, dtype)
    return part.doc_ids(0, len(part.ids)), part.offsets, part.tokens(0, len(part.ids))


def read_token_files(manifest: DataFrame, docs_at_once: int = 4096, tokens_at_once: int = 1 << 20) -> DataFrame:
    """A row for each document, from the files: doc_id, start, n_tokens and the CRC-32 of its ids as 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = Part(row["path"], row["dtype"])
                for a, z in part.stretches(docs_at_once, tokens_at_once):
                    tokens, at = part.tokens(a, z).astype("<u4"), part.offsets[a : z + 1] - part.offsets[a]
                    crcs = [zlib.crc32(tokens[i:j].tobytes()) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(part.doc_ids(a, z), pa.int64()), "start": pa.array(row["base"] + part.offsets[a:z]), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(crcs, pa.int64())})

    tasks = manifest.count()  # a row for each part
    return bases(manifest).repartition(max(1, tasks), "part").mapInArrow(read, ROWS)
