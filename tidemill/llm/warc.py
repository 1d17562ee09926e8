"""WARC archives with an index first: write, index, then read selected records by coalesced byte ranges.

``write_archives`` writes one archive a task, a gzip member for each record, and returns the index: a row for
each record with file, offset, length, URL and digest. Which record is the first of its payload is decided on ids and
digests alone; pages with a payload that many share find it by broadcast, small payloads need not. ``read_records``
takes any selection of index rows, sorts them by file and offset, joins neighbouring ranges into single reads and parses
the records. Archives are named
by a fresh id; only the index says which count, so a task that runs twice leaves an orphan at worst.

Of records with equal payloads of at least ``least_bytes``, that with the smallest page id is a response and the
others are revisits that refer to it; smaller payloads are all responses.

Defined results: a null html is an empty payload; a null URL is empty and control characters and spaces in a URL
are percent-encoded; repeated page ids stay, and rows that repeat the smallest id of equal payloads are all
responses; null page ids are the largest; an empty table gives an empty index. Other columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import join_unique, open_fs, runs, spool, work_path

INDEX = "page_id long, path string, offset long, length long, url string, digest string, payload_bytes long, record_type string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id: int | None) -> str:
    """A name for a page's record: a UUID made of its id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    """One record as a gzip member."""
    target = _UNSAFE.sub(lambda m: f"%{ord(m.group()):02X}", url or "")
    block = HTTP_HEAD + (b"" if is_revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (the HTTP message's body) of a gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, *, out_dir: str | None = None, least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of (page_id, url, html) and return the index (INDEX's columns)."""
    out_dir = out_dir or work_path(pages.sparkSession, "warc")
    html = F.coalesce("html", F.lit("")).cast("binary")
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload")})
    # Digests of payloads that are too small to be shared are left out of the joins.
    keyed = read.withColumn("shared", F.when(F.col("n") >= least_bytes, F.col("digest")))
    first = spool(keyed.groupBy("shared").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")), "warc-first")
    total = first.agg(F.sum("copies")).first()[0] or 0
    decided = join_unique(keyed, first.filter("shared is not null and copies > 1"), ["shared"], weight="copies", total=total, outer=True)
    decided = decided.select("page_id", "url", "payload", "digest", "first_id", (F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("is_revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(out_dir)
        name, stream, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("page_id", "path", "offset", "length", "url", "digest", "payload_bytes", "record_type")}
            for k in range(batch.num_rows):
                page_id, url, payload, digest, first_id, is_revisit = (c[k].as_py() for c in batch.columns)
                if stream is None:
                    fs.create_dir(folder, recursive=True)
                    stream = fs.open_output_stream(f"{folder}/{name}", compression=None)
                member = make_record(page_id, url, payload, digest, first_id, is_revisit, date)
                stream.write(member)
                for key, value in zip(rows, (page_id, f"{out_dir}/{name}", at, len(member), url, digest, len(payload), "revisit" if is_revisit else "response"), strict=True):
                    rows[key].append(value)
                at += len(member)
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("page_id", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string())]))
        if stream is not None:
            stream.close()

    return spool(decided.mapInArrow(write, INDEX), "warc-index")


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, int, int]]:
    """Sorted (offset, length) joined into reads (start, end, first, last + 1): gaps up to ``gap``, reads up to ``most`` bytes."""
    reads: list[tuple[int, int, int, int]] = []
    for k, (offset, length) in enumerate(ranges):
        if reads and offset - reads[-1][1] <= gap and offset + length - reads[-1][0] <= most:
            start, end, first, _ = reads[-1]
            reads[-1] = (start, max(end, offset + length), first, k + 1)
        else:
            reads.append((offset, offset + length, k, k + 1))
    return reads


def read_records(index: DataFrame, *, segment: int = 8 << 20, gap: int = 64 << 10, most: int = 4 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """The records of the given index rows, from the archives (RECORDS' columns); payload digests are verified.

    Rows are dealt by file and segment of it, so that a large archive is read by many tasks in order: a task for each
    ``task_bytes`` of records, and at least one a core.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in runs(batches, ["path", "segment"]):
            fs, path = open_fs(piece.column("path")[0].as_py())
            ranges = list(zip(piece.column("offset").to_pylist(), piece.column("length").to_pylist(), strict=True))
            rows: list[dict] = []
            with fs.open_input_file(path) as f:
                for start, end, first, last in coalesce_ranges(ranges, gap, most):
                    data = f.read_at(end - start, start)
                    for offset, length in ranges[first:last]:
                        rows.append(_row(data[offset - start : offset - start + length]))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    tasks = max(index.sparkSession.sparkContext.defaultParallelism, (index.agg(F.sum("length")).first()[0] or 0) // task_bytes)
    dealt = index.select("path", "offset", "length", F.expr(f"offset div {segment}").alias("segment"))
    return dealt.repartition(tasks, "path", "segment").sortWithinPartitions("path", "segment", "offset").mapInArrow(read, RECORDS)


def _row(member: bytes) -> dict:
    import hashlib

    headers, payload = parse_record(member)
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    is_response = headers["WARC-Type"] == "response"
    if is_response and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {headers['WARC-Record-ID']} doesn't match its digest")
    number = lambda name: int(headers[name]) if headers.get(name) else None
    return {"page_id": number("X-Page-Id"), "url": headers["WARC-Target-URI"], "payload_bytes": len(payload) if is_response else number("X-Payload-Length"), "payload_digest": digest, "record_type": headers["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id")}
