"""Legacy archive converter: ARC to WARC, with revisits for equal payloads, and a WARC reader.

An ARC archive starts with a ``filedesc:`` record whose block names the version and the fields of each
header line (later records are captures, whatever their URL); a header line ends with the declared length of its record.  Version 1 lines have five fields, version 2
lines ten.  Conversion parses the lines and lengths and synthesises the WARC side: a record id (UUID
of target, date and content), an ISO date, the type (response for a captured HTTP message, else
resource) and SHA-1 digests of block and payload in base32.

Spark does the rest.  Records are grouped by payload digest with a combining maximum, so
thousands of copies of a page are one row per task; the winners join back and the others become
``revisit`` records.  A WARC file is a row of gzip members, one a record as WARC readers expect, closed by size or by number of records;
Spark's own text writer writes each as a file (and ends it with one zero byte, which gzip readers skip as padding), so the
commit protocol covers lost executors.  Files are read back as binary files, record by record, through a decompressing stream.

Defined results: a null payload is empty; a null url becomes ``urn:page:<id>``; white space in a url is percent-encoded in headers;
a null id is kept as null and loses to every other id; rows that repeat an id and payload are the same record
(all responses, if their id is the largest); empty tables write no records; damaged or mismatching records raise.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewcast.session import scratch_path

ARCHIVE_BYTES = 8_000_000      # about the size of one ARC archive in memory
RECORDS_PER_FILE = 10_000
FILE_BYTES = 16_000_000        # a WARC file is closed once it has as many compressed bytes
LEVEL = 5                      # of compression
CAPTURED = "20240101000000"    # ARC date of rows that have none
LINE, END, PADDING = b"\r\n", b"\r\n\r\n", "\0"
# The field lines of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
SPACE = re.compile(rb"[\x00-\x20\x7f]")
WARC_FIELDS = "warc_type string, record_id string, date string, uri string, page_id long, content_type string, " \
              "block_digest string, payload_digest string, payload_bytes long"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ------------------------------------------------------------------ ARC

def arc_open(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 converter\n{ARC_FIELDS[version]}\n\n".encode()
    extra = "200 - - 0 - " if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {extra}{len(block)}\n".encode() + block + b"\n"


def arc_record(version: int, uri: bytes, date: str, content_type: str, block: bytes, offset: int, name: str) -> bytes:
    extra = f"200 {hashlib.md5(block).hexdigest()} - {offset} {name} " if version == 2 else ""
    return uri + f" 0.0.0.0 {date} {content_type} {extra}{len(block)}\n".encode() + block + b"\n"


def arc_records(data: bytes) -> Iterator[dict[str, str | bytes]]:
    """The records of one ARC archive but its version block, by the header fields that declares; ``block`` has the bytes."""
    at, fields = 0, None
    while at < len(data):
        if data[at:at + 1] == b"\n":                     # separator
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header line cut off at byte {at}")
        parts = data[at:end].decode("utf-8").split(" ")
        size = int(parts[-1])
        block = data[end + 1:end + 1 + size]
        if len(block) < size:
            raise ValueError(f"ARC record at byte {at} declares {size} bytes, {len(block)} are there")
        first = fields is None
        if first:                                        # the first record alone is the version block
            if not parts[0].startswith("filedesc:"):
                raise ValueError("ARC archive without a version block")
            lines = block.decode("utf-8").split("\n")
            fields = ARC_FIELDS[int(lines[0].split(" ")[0])].split(" ")
            if lines[1].split(" ") != fields:
                raise ValueError(f"unknown ARC fields: {lines[1]}")
        if len(parts) != len(fields):
            raise ValueError(f"ARC header line of {len(parts)} fields, {len(fields)} declared")
        if not first:
            yield dict(zip(fields, parts, strict=True)) | {"block": block}
        at = end + 1 + size


def pages_to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 date: str = CAPTURED) -> DataFrame:
    """Legacy archives (name, content) of about ARCHIVE_BYTES each, versions 1 and 2 in turn; a page is an HTTP capture that
    carries its id as a header."""
    import pyarrow as pa

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = number = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"name": [f"pages-{number}.arc"], "content": pa.array([b"".join(parts)], pa.large_binary())})

        for b in batches:
            ids, urls, html = b.columns
            for i in range(b.num_rows):
                version, name, key = 1 + number % 2, f"pages-{number}.arc", ids[i].as_py()
                if not parts:
                    parts.append(arc_open(version, name, date))
                    size = len(parts[0])
                url = urls[i].as_py()
                uri = SPACE.sub(lambda m: b"%%%02X" % m[0][0], (f"urn:page:{key}" if url is None or url == "" else url).encode())
                mark = b"" if key is None else b"X-Page-Id: %d\r\n" % key
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + mark + LINE + (html[i].as_py() or "").encode()
                parts.append(arc_record(version, uri, date, "text/html", block, size, name))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    parts, size, number = [], 0, number + 1
        if parts:
            yield close()

    return pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col)).mapInArrow(run, "name string, content binary")


# ------------------------------------------------------------------ ARC to WARC

def convert_record(arc: dict[str, str | bytes]) -> tuple:
    """One ARC record as WARC_FIELDS plus (http head, payload)."""
    block, uri, stamp = arc["block"], arc["URL"], arc["Archive-date"].ljust(14, "0")
    date = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"
    head, payload, kind, page = b"", block, "resource", None
    content_type = arc["Content-type"]
    if block.startswith(b"HTTP/") and (cut := block.find(b"\r\n\r\n")) >= 0:
        head, payload = block[:cut + 4], block[cut + 4:]
        kind, content_type = "response", "application/http; msgtype=response"
        if m := re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head):
            page = int(m[1])
    digest = sha1_base32(block)
    record = uuid.uuid5(uuid.NAMESPACE_URL, f"{uri} {date} {digest}")
    return (kind, f"urn:uuid:{record}", date, uri, page, content_type, digest, sha1_base32(payload), len(payload), head, payload)


def arc_to_warc(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """Rows of WARC_FIELDS, head and payload for every record of the archives but their version blocks."""
    import pyarrow as pa

    kinds = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 3 + [pa.int64(), pa.large_binary(), pa.large_binary()]
    names = [f.split(" ")[0] for f in WARC_FIELDS.split(", ")] + ["head", "payload"]
    out = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell in b.column(0):
                rows = [convert_record(r) for r in arc_records(cell.as_py())]
                for at in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=k) for c, k in zip(zip(*rows[at:at + 500]), kinds, strict=True)], schema=out)

    return archives.select(content_col).mapInArrow(run, f"{WARC_FIELDS}, head binary, payload binary")


def mark_revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds refers_to_id and refers_to_page: of records with equal payloads of at least ``least_bytes``, all but that
    of the largest page id become revisits of it."""
    big = F.col("payload_bytes") >= least_bytes
    best = records.where(big).groupBy("payload_digest").agg(F.max(F.struct("page_id", "record_id")).alias("best"))
    joined = records.join(best, "payload_digest", "left")
    other = big & ~F.col("page_id").eqNullSafe(F.col("best.page_id"))
    return joined.select(*[c for c in records.columns if c != "warc_type"],
                         F.when(other, "revisit").otherwise(F.col("warc_type")).alias("warc_type"),
                         F.when(other, F.col("best.record_id")).alias("refers_to_id"),
                         F.when(other, F.col("best.page_id")).alias("refers_to_page"))


def warc_text(r: DataFrame) -> Column:
    """One WARC/1.1 record as a string, without the two line ends that close it."""
    revisit = F.col("warc_type") == "revisit"
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))

    lines = [
        F.lit("WARC/1.1\r\n"), field("WARC-Type", F.col("warc_type")), field("WARC-Record-ID", F.format_string("<%s>", "record_id")),
        field("WARC-Date", F.col("date")), field("WARC-Target-URI", F.col("uri")),
        F.coalesce(field("WARC-Page-ID", F.col("page_id")), F.lit("")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(
            field("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.col("block_digest")))),
        F.coalesce(field("WARC-Refers-To", F.format_string("<%s>", "refers_to_id")), F.lit("")) if "refers_to_id" in r.columns else F.lit(""),
        F.coalesce(field("WARC-Refers-To-Page-ID", F.col("refers_to_page")), F.lit("")),
        field("WARC-Payload-Length", F.col("payload_bytes")), field("Content-Type", F.col("content_type")),
        field("Content-Length", F.octet_length(block)), F.lit("\r\n"),
    ]
    return F.concat(*lines, block.cast("string"))


def write_warc(records: DataFrame, name: str = "warc", per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> str:
    """Writes WARC files to the shared folder, one gzip member a record; returns their path.  A file is closed at ``per_file``
    records or ``file_bytes`` compressed bytes, so only a single record can make it larger."""
    import pyarrow as pa

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        size = 0
        for b in batches:
            for cell in b.column(0):
                members.append(gzip.compress(cell.as_py() + END, LEVEL, mtime=0))
                size += len(members[-1])
                if size >= file_bytes or len(members) >= per_file:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.large_binary())], names=["file"])
                    members, size = [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.large_binary())], names=["file"])

    path = scratch_path(records.sparkSession, name)
    files = records.select(warc_text(records).cast("binary").alias("record")).mapInArrow(run, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1) \
        .option("lineSep", PADDING).text(path)
    return path


# ------------------------------------------------------------------ reading WARC

def warc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record in turn, from a stream of bytes already decompressed."""
    while line := stream.readline():
        if line == LINE:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (LINE, b""):
            k, _, v = line.decode("utf-8").rstrip("\r\n").partition(": ")
            head[k] = v
        size = int(head["Content-Length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"WARC record {head.get('WARC-Record-ID')} is cut off")
        yield head, block


def read_warc(df_paths: DataFrame) -> DataFrame:
    """Rows (record_type, record_id, uri, date, page_id, payload_bytes, payload_digest, refers_to_id, refers_to) of binary
    files (``spark.read.format("binaryFile")``); a payload that does not match its digest raises."""
    import pyarrow as pa

    out = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("date", pa.string()),
                     ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("refers_to_id", pa.string()), ("refers_to", pa.int64())])

    def number(x: str | None) -> int | None:
        return None if x is None else int(x)

    def rows(content: bytes) -> Iterator[tuple]:
        raw = io.BytesIO(content)
        for head, block in warc_records(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw):
            payload = block
            if head["Content-Type"].startswith("application/http"):
                payload = block[block.find(b"\r\n\r\n") + 4:]
            kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
            size = int(head["WARC-Payload-Length"])
            if kind != "revisit" and (len(payload) != size or sha1_base32(payload) != digest):
                raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
            yield (kind, head["WARC-Record-ID"].strip("<>"), head["WARC-Target-URI"], head["WARC-Date"], number(head.get("WARC-Page-ID")),
                   size, digest, (head.get("WARC-Refers-To") or "").strip("<>") or None, number(head.get("WARC-Refers-To-Page-ID")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell in b.column(0):
                found = list(rows(cell.as_py()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found), out, strict=True)], schema=out)

    return df_paths.select("content").mapInArrow(
        run, "record_type string, record_id string, uri string, date string, page_id long, payload_bytes long, "
             "payload_digest string, refers_to_id string, refers_to long")
