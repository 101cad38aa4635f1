"""Round trips through archives, revisits against brute force, and odd rows."""

import hashlib

from panelgrid.llm.archives import archive_corpus, parse, read_archives, resolve, write_archives
from panelgrid.session import scratch_path

SF = "/root/testdata/sf0.01"
LONG = "<p>" + "héllo\r\n\r\nWARC/1.1\r\n" * 30


def plain(rows):
    """rows: (page_id, html); ids may be null or repeat"""
    first, out = {}, []
    data = [(i, (html or "").encode()) for i, html in rows]
    for i, b in data:
        if i is not None and len(b) >= 100:
            first[b] = min(first.get(b, i), i)
    for i, b in data:
        again = i is not None and len(b) >= 100 and i > first[b]
        out.append((-1 if i is None else i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def got(frame):
    return sorted(((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect()), key=str)


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert got(archive_corpus(pages)) == plain([(r.page_id, r.html) for r in pages.collect()])


ROWS = [(5, "http://a/\r\nX: y", LONG), (3, None, LONG), (3, "u", LONG), (9, "u", LONG), (9, "v", LONG), (1, "u", None), (2, "u", ""), (4, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", "y" * 100), (8, "é", "y" * 100), (None, "u", LONG), (None, "u", "z" * 200), (10, "u", "\r\n" * 400000), (11, "u", "é" * 50), (12, "u", "é" * 50)]


def test_odd_rows(spark):
    pages = spark.createDataFrame([(*r, "k") for r in ROWS], "page_id long, url string, html string, digest string")
    assert got(archive_corpus(pages)) == plain([(r[0], r[2]) for r in ROWS])
    assert archive_corpus(pages.limit(0)).count() == 0


def test_payloads_and_headers_survive(spark):
    path = scratch_path(spark, "test-warc")
    write_archives(spark.createDataFrame(ROWS, "page_id long, url string, payload string"), path)
    records = read_archives(spark, path).collect()
    payloads = sorted(r.payload.decode() for r in records if r.record_type == "response")
    assert len(records) == len(ROWS) and set(payloads) == {r[2] or "" for r in ROWS}
    assert sum(len(p) > 99 and payloads.count(p) == 1 for p in set(payloads)) >= 3
    assert all(r.payload is None and r.refers_to_page is not None for r in records if r.record_type == "revisit")
    assert {r.url for r in records} == {"http://a/%20%20X:%20y", None, "u", "v", "é"}


def test_foreign_archives_resolve(spark):
    head = "WARC/1.0\r\nWARC-Type: {}\r\nX-Page: {}\r\nWARC-Payload-Digest: sha256:{}\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    body = "b" * 300
    digest = hashlib.sha256(body.encode()).hexdigest()
    text = head.format("response", 1, digest, 300, body) + head.format("revisit", 2, digest, 0, "") + head.format("revisit", 3, "f" * 64, 0, "")
    records = list(parse(text.encode()))
    assert [r[0]["warc-type"] for r in records] == ["response", "revisit", "revisit"] and records[0][1] == body.encode()
    rows = [(1, "response", 300, digest), (2, "revisit", None, digest), (3, "revisit", None, "f" * 64)]
    frame = spark.createDataFrame(rows, "page_id long, record_type string, payload_bytes long, payload_digest string")
    assert {r.page_id: (r.payload_bytes, r.refers_to) for r in resolve(frame).collect()} == {1: (300, None), 2: (300, 1), 3: (None, None)}


def test_a_long_page_does_not_shorten_all_files(spark):
    path = scratch_path(spark, "test-warc")
    pages = spark.range(400).selectExpr("id as page_id", "'u' as url", "if(id = 7, repeat('x', 16000000), concat('page ', id)) as payload").coalesce(4)
    write_archives(pages, path)
    files = [f for f in spark.read.format("binaryFile").load(path).select("path", "content").collect()]
    records = [fields for f in files for fields, _ in parse(bytes(f.content))]
    assert len(files) <= 8 and len(records) == 400 and len({r["warc-record-id"] for r in records}) == 400


def test_record_ids(spark):
    """Revisits refer to a response there is; ids are unique but for repeated referable rows."""
    path = scratch_path(spark, "test-warc")
    rows = [(1, "u", "y" * 200), (2, "u", "y" * 200), (2, "v", "y" * 200), (3, "u", "short"), (3, "u", "short"), (None, "u", "y" * 200), (None, "u", "y" * 200)]
    write_archives(spark.createDataFrame(rows, "page_id long, url string, payload string"), path)
    records = [fields for f in spark.read.format("binaryFile").load(path).collect() for fields, _ in parse(bytes(f.content))]
    assert len({r["warc-record-id"] for r in records}) == 7
    responses = {r["warc-record-id"] for r in records if r["warc-type"] == "response"}
    assert sorted(r["warc-type"] for r in records) == ["response"] * 5 + ["revisit"] * 2 and all(r["warc-refers-to"] in responses for r in records if r["warc-type"] == "revisit")
