"""Legacy archives to WARC.

ARC files hold a version block, whose last line names the fields of the header lines, and records: a header line as that
version has it, and as many bytes as it declares. The converter parses both versions, synthesises for every record an
identifier, timestamp, type and digest of WARC, and writes a `revisit` for a payload that another record holds.

Archives are written by Spark's text writer: the record separators (a line feed in ARC, two CRLF in WARC) are its line
separator, so any store that Spark writes to will do. Files are read whole by Spark and parsed as streams.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import batch_rows, new_path, table, written

#: Shorter payloads are always stored.
LEAST_REVISIT = 1000
#: Duplicate payloads that are broadcast at most (100 bytes each); more are joined.
MOST_BROADCAST = 200_000
#: The field names of the two versions of ARC header lines.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARC_DATE = "19961105000000"
#: Bytes of records after which a new version block starts in a file.
ARC_VOLUME = 100_000_000


def arc_header(version: int, url: str, date: str, mime: str, length: int, checksum: str = "-", offset: int = 0) -> str:
    head = f"{url} 0.0.0.0 {date} {mime}"
    return f"{head} {length}" if version == 1 else f"{head} 200 {checksum} - {offset} pages.arc {length}"


def arc_version_block(version: int, date: str = ARC_DATE) -> str:
    body = f"{version} 0 quire\n{ARC_FIELDS[version]}\n"
    return f"{arc_header(version, 'filedesc://pages.arc', date, 'text/plain', len(body))}\n{body}"


def _arc_url(url: str | None) -> str:
    """A url as a header line can hold it: without blanks and control characters, `-` for none."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "-"


def http_block(page_id: int | None, payload: bytes) -> bytes:
    ident = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{ident}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def write_arc(pages: DataFrame, path: str) -> None:
    """pages (page_id, url, html) as ARC files: version 1 and 2 by turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, offset = 1 + TaskContext.get().partitionId() % 2, 0
        for b in batches:
            out = []
            for page_id, url, html in zip(*(b.column(k).to_pylist() for k in ("page_id", "url", "html")), strict=True):
                if offset == 0 or offset > ARC_VOLUME:
                    out.append(arc_version_block(version))
                    offset = len(out[-1]) + 1
                block = http_block(page_id, (html or "").encode())
                out.append(arc_header(version, _arc_url(url), ARC_DATE, "text/html", len(block), offset=offset) + "\n" + block.decode())
                offset += len(out[-1].encode()) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "value string").write.option("lineSep", "\n").option("compression", "gzip").text(path)


def parse_arc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of an ARC stream, version blocks excluded.

    The fields are those that the last version block names; a url may hold blanks, so fields are split from the right.
    Raises ValueError for a header line without the version's fields and for a block that ends early.
    """
    names: list[str] = ARC_FIELDS[1].split()
    while line := stream.readline():
        if not (head := line.decode().rstrip("\r\n")):
            continue
        if head.startswith("filedesc://"):
            length = int(head.rsplit(" ", 1)[1])
            lines = stream.read(length).decode().splitlines()
            names = lines[1].split() if len(lines) > 1 else ARC_FIELDS[int(lines[0].split()[0])].split()
            continue
        values = head.rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"no ARC header line: {head[:100]}")
        fields = dict(zip(names, values, strict=True))
        block = stream.read(int(fields["Archive-length"]))
        if len(block) != int(fields["Archive-length"]):
            raise ValueError(f"an ARC record of {head[:100]} ends early")
        yield fields, block


def _http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    return head.decode(), {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}, payload


def _opened(content: bytes) -> io.BufferedIOBase:
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, date, http_head, payload, payload_bytes, sha1, key) of every record; payload null unless asked for."""
    kinds = "page_id long, url string, date string, http_head string, payload string, payload_bytes long, sha1 string, key binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows, held = [], 0
                for fields, block in parse_arc(_opened(content.as_py())):
                    head, values, payload = _http(block)
                    ident = int(values["x-page-id"]) if "x-page-id" in values else None
                    key = hashlib.sha256(payload).digest()
                    rows.append((ident, fields["URL"], fields["Archive-date"], head, payload.decode() if payloads else None, len(payload), hashlib.sha1(payload).hexdigest(), key))
                    held += len(payload) if payloads else 100
                    if held > 8_000_000:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        columns = list(zip(*rows, strict=True)) or [()] * len(types)
        names = [k.split()[0] for k in kinds.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return _files(spark, path).mapInArrow(run, kinds)


def record_id(page_id: Column) -> Column:
    """A UUID of version 8 whose free bits hold the id, so it is the same in every run and can be read back."""
    h = F.lpad(F.hex(page_id), 16, "0")
    part = lambda a, n: F.substring(h, a, n)
    some = F.concat(F.lit("urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(13, 3), F.lit("-8"), part(16, 1), F.lit("00-717569726500"))
    return F.lower(F.coalesce(some, F.lit("urn:uuid:ffffffff-ffff-8fff-8f01-717569726500")))


def page_of(record: str) -> int | None:
    h = record.strip("<>").removeprefix("urn:uuid:").replace("-", "")
    if h[18:20] == "01":
        return None
    value = int(h[0:12] + h[13:16] + h[17], 16)
    return value - (1 << 64) if value >> 63 else value


def convert(spark: SparkSession, arc: str, warc: str) -> None:
    """Writes the WARC files of the ARC files."""
    digests = written(read_arc(spark, arc, payloads=False).select("page_id", "payload_bytes", "key"), "digests")
    several = digests.filter(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("key").agg(F.max("page_id").alias("stored"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = written(several.select("key", "stored"), "several")
    small = several.count() <= MOST_BROADCAST
    met = read_arc(spark, arc).join(F.broadcast(several) if small else several, "key", "left")
    revisit = F.col("stored").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("stored"))
    d = F.col("date")
    stamp = F.concat_ws("", *(x for a, n, sep in ((1, 4, "-"), (5, 2, "-"), (7, 2, "T"), (9, 2, ":"), (11, 2, ":"), (13, 2, "Z")) for x in (F.substring(d, a, n), F.lit(sep))))
    body = F.concat(F.col("http_head"), F.lit("\r\n\r\n"), F.when(revisit, "").otherwise(F.col("payload")))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), record_id(F.col("page_id")), F.lit(">"))),
        line("WARC-Date", stamp),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
            line("WARC-Refers-To", F.concat(F.lit("<"), record_id(F.col("stored")), F.lit(">"))),
        )).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )
    met.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc)


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of every record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:100]!r}")
        fields = {}
        while head := stream.readline().rstrip(b"\r\n"):
            k, _, v = head.decode().partition(": ")
            fields[k.lower()] = v
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError("a WARC record ends early")
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, target_uri, date) of every record.

    A response's length and digest are of its payload as read, checked against its header; a revisit's are those its
    headers declare.
    """
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, date string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = [k.split()[0] for k in kinds.split(", ")]
        for b in batches:
            for content in b.column("content"):
                rows = []
                for fields, block in parse_warc(_opened(content.as_py())):
                    _, http, payload = _http(block)
                    declared, size, refers = fields["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"]), None
                    if fields["warc-type"] == "revisit":
                        digest, refers = declared, page_of(fields["warc-refers-to"])
                    else:
                        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                        if digest != declared:
                            raise ValueError(f"digest of {fields['warc-record-id']} differs")
                    rows.append((page_of(fields["warc-record-id"]), size, digest, fields["warc-type"], refers, fields["warc-record-id"], fields["warc-target-uri"], fields["warc-date"]))
                columns = list(zip(*rows, strict=True)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return _files(spark, path).mapInArrow(run, kinds)


def archived(pages: DataFrame) -> DataFrame:
    """pages written as ARC, converted to WARC and read back: see read_warc for the columns.

    Null html is an empty payload, a null url is `-`. Of equal payloads of LEAST_REVISIT bytes or more, the record with
    the largest page_id is the response; rows that repeat that page_id are responses too, a null page_id is below any
    other. An empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    with batch_rows(spark):
        write_arc(pages, arc)
    with batch_rows(spark, 1):  # a row is a whole file
        convert(spark, arc, warc)
        return written(read_warc(spark, warc), "records")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
             max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
      FROM pages)
"""
