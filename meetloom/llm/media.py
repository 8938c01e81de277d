"""Media columns: documents as greyscale PNG files in a binary column, read back and hashed.

The payload (UTF-8 bytes, zero-filled to a positive multiple of 64) becomes an 8-bit image
64 samples wide. Writing picks one row filter an image by the smallest sum of absolute
residuals. Reading walks the chunks, tests their checksums, inflates, and unfilters in
numpy. The feature is a hash of low-frequency cosine-transform coefficients.

Defined cases: null text counts as empty and gives one row of zeros; a broken file (bad
signature, checksum, length or filter) raises; an empty table gives an empty result; equal
texts give equal files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8  # the hash sees a 32 x 32 image and keeps its 8 x 8 lowest frequencies


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: np.ndarray, level: int = 1) -> bytes:
    """An 8-bit greyscale PNG of a (rows, columns) array."""
    up = samples.copy()
    up[1:] -= samples[:-1]
    left = samples.copy()
    left[:, 1:] -= samples[:, :-1]
    best, kept = 0, samples
    least = np.minimum(samples, 0 - samples).sum(dtype=np.int64)
    for kind, x in ((1, left), (2, up)):
        if (cost := np.minimum(x, 0 - x).sum(dtype=np.int64)) < least:
            best, kept, least = kind, x, cost
    lines = np.empty((samples.shape[0], samples.shape[1] + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = kept
    head = struct.pack(">IIBBBBB", samples.shape[1], samples.shape[0], 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray) -> np.ndarray:
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    if not kinds.any():
        return out
    if (kinds == 1).all():
        return np.cumsum(out, axis=1, dtype=np.uint8)
    if (kinds == 2).all():
        return np.cumsum(out, axis=0, dtype=np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for kind, row in zip(kinds, out, strict=True):
        if kind == 1:
            row[:] = np.cumsum(row, dtype=np.uint8)
        elif kind == 2:
            row += above
        elif kind:
            a = c = 0
            for i, b in enumerate(above.tolist()):
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                a, c = (int(row[i]) + guess) & 255, b
                row[i] = a
        above = row
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG; raises ValueError when anything is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, size, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        (n,) = struct.unpack_from(">I", data, at)
        kind, content = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(content) != n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + content)):
            raise ValueError(f"bad checksum in chunk {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", content)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("only 8-bit greyscale without interlace")
            size = height, width
        elif kind == b"IDAT":
            body.append(content)
        ended = kind == b"IEND"
        at += 12 + n
    if size is None or not ended:
        raise ValueError("chunks are missing")
    raw = zlib.decompress(b"".join(body))
    if len(raw) != size[0] * (size[1] + 1):
        raise ValueError("wrong number of samples")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(size[0], size[1] + 1))


def _cosines() -> np.ndarray:
    k, i = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * i + 1) / (2 * SIDE))


_C = _cosines()


def _shrink(x: np.ndarray, n: int) -> np.ndarray:
    """Means over n equal parts of axis 0, parts of samples counted in proportion."""
    total = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=np.float64)])
    at = np.linspace(0, x.shape[0], n + 1)
    low = np.minimum(at.astype(int), x.shape[0] - 1)
    edge = total[low] + (at - low)[:, None] * (total[low + 1] - total[low])
    return np.diff(edge, axis=0) * n / x.shape[0]


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which low-frequency coefficients lie above their median (the mean level left out).

    Coefficients are rounded, so that those that are zero (of a flat picture) tell nothing.
    """
    small = _shrink(_shrink(samples, SIDE).T, SIDE).T
    low = np.round(_C @ small @ _C.T, 6).ravel()
    low[0] = 0
    return np.packbits(low > np.median(low[1:])).tobytes()


def to_media(docs: DataFrame, key: str = "doc_id", text: str = "text", level: int = 1) -> DataFrame:
    """doc_id, n_bytes and the file in the binary column `media`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, files = [], []
            for t in batch.column(1).to_pylist():
                data = (t or "").encode()
                n.append(len(data))
                padded = data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b"\0")
                files.append(encode_png(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH), level))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Adds to doc_id, n_bytes, media what reading the file back gives: payload and cosine hash, both binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels = [decode_png(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x.tobytes() for x in pixels], pa.binary()), pa.array([cosine_hash(x) for x in pixels], pa.binary())],
                names=["doc_id", "n_bytes", "media", "payload", "cosine_hash"],
            )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, cosine_hash binary")


def media_digest(read: DataFrame) -> DataFrame:
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("cosine_hash")).alias("feature"),
    )
