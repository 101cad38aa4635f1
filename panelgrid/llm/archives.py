"""WARC archives: deduplicated writing, reading, and resolution of revisit records.

Writing: the headers of all records (id, digest, length) are shuffled by payload digest, without the payloads. Of records
with equal payloads of at least `LEAST` bytes the one with the smallest id becomes the response and the others revisit
records that refer to it and have no payload. The decisions go back to the records by id (where there are too many to broadcast, that join
shuffles the records, payloads included, once), and Spark's text writer
writes them as WARC/1.1 with fresh headers: a record ends with two line ends, which is the writer's separator, so a
file is a sequence of whole records (gzip over each file, not over each record, as Spark has no writer for that). Records are written
by classes of payload length, so that one long page does not make all files short.

Reading: files are bounded in size and parsed where they lie, by the length that each record states. Digests and
lengths of responses come from their payloads. Revisit records are joined to the response with their digest to find
what they stand for.

Defined cases: a null payload is empty; a null url has no target header; line ends and other controls in a url are
escaped; record ids are unique but for repeated rows of one id and payload that are responses and can be referred to, which share theirs; a record without an id is a response and nothing refers to it; of repeated ids with equal payloads each is a response if the id is the smallest,
else each is a revisit; no records give no archive; extra columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid.session import scratch_path, stage

LEAST = 100  # bytes of a payload that may be revisited
FILE_BYTES = 32 << 20  # payload bytes of a file, at most, but for single records beyond it
SIZES = (16 << 10, 256 << 10, 4 << 20)  # upper bounds of the classes of payload length; longer ones are a class too
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_headers(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes and digest of records (page_id, url, payload); payloads are hashed where they lie."""
    payload = F.coalesce(F.col("payload"), F.lit("")).cast("binary")
    return records.select("page_id", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("digest"))


def revisits(headers: DataFrame) -> DataFrame:
    """page_id, digest and refers_to of the records that become revisits."""
    usable = headers.where((F.col("payload_bytes") >= LEAST) & F.col("page_id").isNotNull())
    firsts = usable.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    return usable.select("page_id", "digest").distinct().join(firsts, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to")


def _urn(*parts) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts)), F.lit(">"))


def _header(name: str, value) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def archive_records(records: DataFrame, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """One column, the text of each record without its closing line ends. `records`: page_id, url, payload, digest, refers_to."""
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    page = F.col("page_id").cast("string")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"), _header("Content-Length", F.octet_length("payload").cast("string")), F.lit(END))
    block = F.when(F.col("refers_to").isNull(), F.concat(head, F.col("payload"))).otherwise("")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    referable = F.col("refers_to").isNull() & F.col("page_id").isNotNull() & (F.octet_length("payload") >= LEAST)
    fresh = F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))
    original = F.when(F.col("refers_to").isNotNull(), _urn(F.col("refers_to").cast("string"), F.col("digest")))
    lines = F.concat(
        F.lit(f"WARC/1.1{END}"), _header("WARC-Type", kind), _header("WARC-Record-ID", F.when(referable, _urn(page, F.col("digest"))).otherwise(fresh)),
        _header("WARC-Date", F.lit(date)), _header("WARC-Target-URI", url), _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Profile", F.when(original.isNotNull(), PROFILE)), _header("WARC-Refers-To", original), _header("X-Refers-To-Page", F.col("refers_to").cast("string")),
        _header("X-Page", page), _header("Content-Type", F.when(original.isNull(), "application/http; msgtype=response")), _header("Content-Length", F.octet_length(block).cast("string")), F.lit(END))
    return records.select(F.concat(lines, block).alias("value"))


def write_archives(records: DataFrame, path: str) -> None:
    """Write records (page_id, url, payload) to `path`, deduplicated."""
    headers = stage(record_headers(records), "warc-headers")
    refer = stage(revisits(headers), "revisits")
    payload = F.coalesce(F.col("payload"), F.lit(""))
    longest = dict(headers.groupBy(_size_class(F.col("payload_bytes")).alias("c")).agg(F.max("payload_bytes")).collect()) or {0: 0}  # at most one row for each class
    for i, c in enumerate(sorted(longest)):
        rows = records.select("page_id", "url", payload.alias("payload")).where(_size_class(F.octet_length("payload")) == c)
        rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).join(refer, ["page_id", "digest"], "left")
        per_file = max(1, FILE_BYTES // (longest[c] + 1024))
        archive_records(rows).write.mode("append" if i else "errorifexists").option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _size_class(length: Column) -> Column:
    """Number of the class of a payload length."""
    return sum(((length > bound).cast("int") for bound in SIZES), F.lit(0))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of a file."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
        start = stop + 4
        at = start + int(fields["content-length"])
        yield fields, data[start:at]
        at += 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, url, payload (responses), payload_bytes, payload_digest (stated only, for revisits) and refers_to_page of all records."""
    schema = "page_id long, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to_page long"
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda v: None if v is None else int(v)
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for fields, block in parse(data.as_py()):
                    kind, payload, size, digest = fields["warc-type"], None, None, fields.get("warc-payload-digest", "").partition(":")[2]
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :] if re.match(b"HTTP/", block) else block
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        held += size
                    rows.append((number(fields.get("x-page")), kind, fields.get("warc-target-uri"), payload, size, digest, number(fields.get("x-refers-to-page"))))
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to; revisits take them from the response with their digest."""
    narrow = records.select("page_id", "record_type", "payload_bytes", "payload_digest")
    responses = narrow.where("record_type = 'response'")
    originals = responses.where((F.col("payload_bytes") >= LEAST) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("bytes"))
    seen = narrow.where("record_type = 'revisit'").join(originals, "payload_digest", "left")
    seen = seen.select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(seen)


def archive_corpus(pages: DataFrame) -> DataFrame:
    """Write the pages table as archives, read them back and resolve them."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages.select("page_id", "url", F.col("html").alias("payload")), path)
    return resolve(stage(read_archives(spark, path).drop("payload"), "warc-index"))


ORACLE = f"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {LEAST} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""
