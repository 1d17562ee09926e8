import hashlib

from tidemill.llm import warc
from tidemill.llm.common import open_fs

SCHEMA = "page_id long, url string, html string, digest string, n int, first_id string"


def want(rows):
    payload = {k: (r[2] or "").encode() for k, r in enumerate(rows)}
    out = []
    for k, r in enumerate(rows):
        p = payload[k]
        same = [x[0] for j, x in enumerate(rows) if payload[j] == p and x[0] is not None]
        first = min(same, default=None)
        revisit = len(p) >= 100 and first is not None and r[0] != first
        out.append((r[0], len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip_of_odd_pages(spark):
    long = "é" * 60
    rows = [(1, "http://a/ b\n", long), (2, None, long), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "short"), (6, "http://f", "short"), (7, "http://g", "x" * 300_000), (8, "http://g", "\r\n\r\nWARC/1.1\r\n" * 20), (None, "http://h", long), (1, "http://a/ b\n", long)]
    pages = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA).repartition(3)
    index = warc.write_archives(pages)
    back = warc.read_records(index)
    keys = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[k] for k in keys) for r in back.collect()), key=str) == want(rows)
    assert warc.write_archives(pages.limit(0)).count() == 0
    assert warc.read_records(index.limit(0)).count() == 0


def test_selected_records_and_index(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = warc.write_archives(pages)
    some = {r["page_id"] for r in warc.read_records(index.filter("page_id % 7 = 3")).collect()}
    assert some == {r["page_id"] for r in pages.filter("page_id % 7 = 3").collect()}
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    for r in index.filter("record_type = 'response'").collect():
        fs, path = open_fs(r["path"])
        with fs.open_input_file(path) as f:
            headers, payload = warc.parse_record(f.read_at(r["length"], r["offset"]))
        assert payload == html[r["page_id"]] and headers["WARC-Type"] == "response"


def test_ranges_are_coalesced():
    assert warc.coalesce_ranges([(0, 10), (10, 5), (40, 5), (500, 5)], gap=30, most=100) == [(0, 45, 0, 3), (500, 505, 3, 4)]
    assert len(warc.coalesce_ranges([(0, 60), (60, 60)], gap=10, most=100)) == 2
