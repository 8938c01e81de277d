"""WARC archives: a writer that stores equal payloads once, and a sequential reader.

Every record is a gzip member of its own. Of records with equal payloads of at least LEAST
bytes, that of the smallest identifier is a response and the others are revisits that refer
to it. The equal ones are found by digest with partial sums; digests that make up over
1/HOT of the repeated rows (so at most HOT of them) are told by a broadcast table, and their
rows don't go through the shuffle under their digest.

Archives are files of about ARCHIVE bytes (one record more at most), so that reading one
never needs more memory than that. Spark's text sink writes them to any file system that it
knows, with its own commit of tasks that run again: a row is an archive without its last
byte, which is 0 in every archive (the high byte of the last member's length; members of
16 MB and more are followed by an empty one) and which the sink adds as the row's end.

The reader inflates a member in steps, takes the record's block by its Content-Length, and
tests what must follow it and the digests of block and payload. What is damaged raises, or
becomes a row with its fault; reading then goes on at the next member that holds a record.

Defined cases: a null payload counts as empty; payloads under LEAST bytes are never revisits;
a null identifier comes after all others and is written as such; rows that share the smallest
identifier of equal payloads are all responses; a null address gives a record without one;
control characters and spaces in addresses are percent-encoded; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, shared_folder

LEAST = 100
ARCHIVE = 16 << 20
HOT = 1000
STEP = 1 << 16  # compressed bytes that are inflated at once
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = b"\x1f\x8b\x08"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
RECORD = (
    "path string, offset long, fault string, type string, record_id string, target_uri string, date string, refers_to string,"
    " payload_digest string, payload_bytes long, payload binary"
)


def _member(data: bytes) -> bytes:
    gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gzip.compress(data) + gzip.flush()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*headers, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def record_name(key: str | None) -> str:
    """The record identifier of a page's identifier."""
    return "<urn:null>" if key is None else f"<urn:page:{quote(key, safe='')}>"


def page_id(name: str, kind: str) -> Column:
    """The page's identifier out of its record's."""
    return F.when(F.col(name) != "<urn:null>", F.url_decode(F.regexp_extract(name, "^<urn:page:(.*)>$", 1))).cast(kind)


def page_record(key: str | None, uri: str | None, payload: bytes, digest: str, first: str | None, date: str) -> bytes:
    """A response, or a revisit of the page first, as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_name(key)), ("WARC-Date", date)]
    if uri is not None:
        headers.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m.group()):02X}", uri)))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if first is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_name(first))]
        payload = b""
    return _member(_record(headers, http + payload))


def archives(records: DataFrame, archive_bytes: int = ARCHIVE, date: str = DATE) -> DataFrame:
    """Archives of records (key, uri, payload, digest, first), a row each, without their last byte, which is 0."""
    about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:about>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = _member(_record(about, b"format: WARC File Format 1.1\r\n"))
        parts, size = [start], 0

        def whole() -> pa.RecordBatch:
            data = b"".join(parts)
            data += b"" if data[-1] == 0 else _member(b"")
            return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["archive"])

        for batch in batches:
            for key, uri, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.append(page_record(key, uri, payload, digest, first, date))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield whole()
                    parts, size = [start], 0
        if size:
            yield whole()

    return records.mapInArrow(run, "archive binary")


def records_of(pages: DataFrame, key: str = "page_id", uri: str = "url", text: str = "html") -> DataFrame:
    """(key, uri, payload, digest, first): first is the page that a revisit refers to."""
    payload = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("id"), F.col(uri).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.select("id", "uri", "payload", F.sha2("payload", 256).alias("digest"))
    long = F.octet_length("payload") >= LEAST
    groups = cut(rows.where(long).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    repeated = groups.agg(F.sum("n")).first()[0] or 0
    hot, others = groups.where(F.col("n") * HOT > repeated), groups.where(F.col("n") * HOT <= repeated)
    rows = rows.join(F.broadcast(hot.select("digest", F.col("first").alias("hot"))), "digest", "left")  # at most HOT rows
    # what is no longer asked for by digest is dealt out by row
    asked = F.when(F.col("hot").isNull() & long, F.col("digest")).otherwise(F.xxhash64("id", "uri").cast("string"))
    rows = rows.withColumn("asked", asked).join(others.select(F.col("digest").alias("asked"), "first"), "asked", "left")
    first = F.when(long, F.coalesce("hot", "first"))
    first = F.when(~F.col("id").eqNullSafe(first), first)
    return rows.select(F.col("id").cast("string").alias("key"), "uri", "payload", "digest", first.cast("string").alias("first"))


def write_archives(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", text: str = "html", archive_bytes: int = ARCHIVE) -> None:
    """Writes a record for every page into archives in the folder path."""
    bounded_batches(pages.sparkSession)
    files = archives(records_of(pages, key, uri, text), archive_bytes).select(F.col("archive").cast("string"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def members(data: bytes) -> Iterator[tuple[int, bytes, str | None]]:
    """(offset, content, fault) of every gzip member; after a damaged one, from the next that holds a record."""
    at, lost = 0, False
    while at < len(data):
        inflate, parts, place, fault = zlib.decompressobj(31), [], at, None
        try:
            while not inflate.eof and place < len(data):
                step = data[place : place + STEP]
                parts.append(inflate.decompress(step))
                place += len(step) - len(inflate.unused_data)
        except zlib.error as e:
            fault = str(e)
        content = b"".join(parts)
        if fault is None and not inflate.eof:
            fault = "member is cut short"
        if fault is None and (not lost or content.startswith(b"WARC/")):
            yield at, content, None
            at, lost = place, False
            continue
        if not lost:
            yield at, content, fault
        lost = True
        at = data.find(_MAGIC, at + 1)
        if at < 0:
            return


def _is_digest(value: str, data: bytes) -> bool:
    name, _, digest = value.partition(":")
    if name.lower() not in ("sha1", "sha256", "md5"):
        return True  # nothing to test it by
    own = hashlib.new(name.lower(), data)
    return digest.lower() == own.hexdigest() or digest.rstrip("=").upper() == base64.b32encode(own.digest()).decode().rstrip("=")


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parsed(content: bytes) -> Iterator[dict]:
    """The records of a member's content."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            yield {"fault": "no record"}
            return
        fields = _fields(content[at:end])
        length = fields.get("content-length", "")
        if not (length.isascii() and length.isdigit() and len(length) < 19):
            yield {"fault": "no content length"}
            return
        start = end + 4
        block = content[start : start + int(length)]
        at = start + int(length) + 4
        kind, fault = fields.get("warc-type"), None
        if content[at - 4 : at] != b"\r\n\r\n":
            fault = "block and content length differ"
        elif not _is_digest(fields.get("warc-block-digest", ""), block):
            fault = "block and digest differ"
        payload, n, digest = block, len(block), fields.get("warc-payload-digest", "")
        if fields.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            http = _fields(head)
            n = int(http["content-length"]) if kind == "revisit" and http.get("content-length", "").isdigit() else len(payload)
            if fault is None and kind != "revisit" and "transfer-encoding" not in http and not _is_digest(digest, payload):
                fault = "payload and digest differ"
        yield {
            "fault": fault, "type": kind, "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
            "refers_to": fields.get("warc-refers-to"), "payload_digest": digest.partition(":")[2] or None, "payload_bytes": n, "payload": payload,
        }
        if fault:
            return


def read_archives(spark: SparkSession, path: str, faults: str = "fail") -> DataFrame:
    """A row per record of the archives in path; what is damaged raises (fail) or is a row with its fault (rows)."""
    if faults not in ("fail", "rows"):
        raise ValueError("faults: fail or rows")
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, RECORD.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, held, size = batch.column(0)[i].as_py(), [], 0
                for offset, content, fault in members(batch.column(1)[i].as_buffer().to_pybytes()):
                    for record in [{"fault": fault}] if fault else parsed(content):
                        if record["fault"] and faults == "fail":
                            raise ValueError(f"{file} at {offset}: {record['fault']}")
                        held.append({name: record.get(name) for name in schema.names} | {"path": file, "offset": offset})
                        size += len(content)
                    if size >= ARCHIVE:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, RECORD)


def pages_digest(records: DataFrame, kind: str = "long") -> DataFrame:
    """The pages' records by their identifiers (of type kind), with the size and digest of their full payloads."""
    pages = records.where(F.col("type").isin("response", "revisit"))
    return pages.select(
        page_id("record_id", kind).alias("page_id"),
        F.col("payload_bytes"),
        F.col("payload_digest"),
        F.col("type").alias("record_type"),
        page_id("refers_to", kind).alias("refers_to"),
    )


def archived(pages: DataFrame, key: str = "page_id", uri: str = "url", text: str = "html") -> DataFrame:
    """The records of pages, written to archives in the shared folder and read back."""
    path = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, key, uri, text)
    return read_archives(pages.sparkSession, path)
