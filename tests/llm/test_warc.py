"""WARC archives."""

import gzip
import hashlib
import random
import zlib
from collections import Counter

import pytest

from meetloom.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first string, path string"


def page_rows():
    rng = random.Random(5)
    long = ["".join(rng.choice("abc <>é\r\n") for _ in range(n)) for n in (99, 100, 101, 5000)]
    texts = [None, "", "", "short", "short", "é" * 50, "é" * 50, "x" * 99, "x" * 99, *long, *long, *long, "y" * 200_000, *["hot" * 40] * 300]
    rows = [(500 - i, None if i % 7 == 0 else f"http://h{i}.org/a b\r\nX: y", t, "d", "f", "p") for i, t in enumerate(texts)]
    return [*rows, rows[12], (None, "http://null.org", long[3], None, None, None), (None, None, "alone" * 40, None, None, None)]


def plain_digest(rows):
    data = [(r[0], (r[2] or "").encode()) for r in rows]
    first = {}
    for key, d in data:
        if len(d) >= 100 and key is not None:
            first[d] = min(key, first.get(d, key))
    out = []
    for key, d in data:
        f = first.get(d)
        revisit = f is not None and f != key
        out.append((key, len(d), hashlib.sha256(d).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return Counter(out)


def test_archives_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, SCHEMA).repartition(5)
    records = warc.archived(pages)
    assert Counter(map(tuple, warc.pages_digest(records).collect())) == plain_digest(rows)
    kept = Counter(bytes(r.payload) for r in records.where("type = 'response'").collect())
    assert set(kept) == {(r[2] or "").encode() for r in rows}
    assert kept[b"hot" * 40] == 1
    assert all(r.payload == b"" for r in records.where("type = 'revisit'").collect())
    assert records.where("target_uri LIKE '%0D%0AX:%'").count() > 0
    none = spark.createDataFrame([], SCHEMA)
    assert warc.pages_digest(warc.archived(none)).count() == 0


def test_files_are_plain_gzip_members(spark, tmp_path):
    rows = page_rows()
    folder = str(tmp_path / "a")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(2), folder, archive_bytes=2000)
    files = sorted((tmp_path / "a").glob("part-*"))
    assert len(files) > 4
    for f in files:
        data = f.read_bytes()
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        found = list(warc.members(data))
        assert all(fault is None and content.count(b"WARC-Type:") <= 1 for _, content, fault in found)
        assert found[0][0] == 0 and [x[0] for x in found] == sorted(x[0] for x in found)
    assert Counter(map(tuple, warc.pages_digest(warc.read_archives(spark, folder)).collect())) == plain_digest(rows)


def test_members_of_16_mb_end_in_an_empty_one(spark):
    big = "z" * (16 << 20) + "end"
    pages = spark.createDataFrame([(1, "u", big, "", "", ""), (2, "u", big, "", "", ""), (3, "u", "small", "", "", "")], SCHEMA)
    assert {r.page_id: (r.payload_bytes, r.refers_to) for r in warc.pages_digest(warc.archived(pages)).collect()} == {1: (len(big), None), 2: (len(big), 1), 3: (5, None)}


def damaged(case: str) -> tuple[bytes, int]:
    """An archive of five records with a damaged third, and how many records are whole."""
    parts = [warc.page_record(str(i), "http://x.org", f"page {i} ".encode() * 40, hashlib.sha256(f"page {i} ".encode() * 40).hexdigest(), None, warc.DATE) for i in range(5)]
    if case == "bytes":
        parts[2] = parts[2][:60] + bytes(20) + parts[2][80:]
    elif case == "cut":
        parts[2] = parts[2][:-30]
    elif case == "digest":
        parts[2] = warc._member(zlib.decompress(parts[2], 31).replace(b"page 2 page", b"page 3 page"))
    elif case == "length":
        parts[2] = warc._member(zlib.decompress(parts[2], 31).replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9"))
    elif case == "no length":
        parts[2] = warc._member(zlib.decompress(parts[2], 31).replace(b"Content-Length", b"Content-Size"))
    elif case == "end":
        parts[4] = parts[4][:-9]
    return b"".join(parts), 4


@pytest.mark.parametrize("case", ["bytes", "cut", "digest", "length", "no length", "end"])
def test_damage(spark, tmp_path, case):
    data, whole = damaged(case)
    (tmp_path / "part-0").write_bytes(data)
    rows = warc.read_archives(spark, str(tmp_path), faults="rows").collect()
    assert sum(r.fault is None for r in rows) == whole
    assert sum(r.fault is not None for r in rows) == 1
    with pytest.raises(Exception, match="part-0 at"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_reads_records_of_other_writers(spark, tmp_path):
    body = b"<p>hello</p>"
    import base64

    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    block = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n" + body
    head = f"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(block)}\r\n\r\n"
    one = head.encode() + block + b"\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(b"") + gzip.compress(one + one))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert [(r.type, bytes(r.payload), r.payload_digest) for r in rows] == [("response", body, digest)] * 3


def test_extra_and_missing_columns_of_pages(spark):
    """Identifiers of text, with every kind of character."""
    pages = spark.createDataFrame([("a b/ü%>", "u", "p" * 100), ("null", None, "p" * 100), (None, None, "p" * 100)], "page_id string, url string, html string")
    rows = warc.pages_digest(warc.archived(pages), "string").collect()
    assert {(r.page_id, r.refers_to) for r in rows} == {("a b/ü%>", None), ("null", "a b/ü%>"), (None, "a b/ü%>")}
