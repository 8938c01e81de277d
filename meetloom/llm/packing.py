"""Packing documents into fixed windows of tokens: concatenate and cut.

Pass one tokenises the documents in order of identifier and totals the tokens of every
partition; prefix sums over those totals give each document its global offset. Pass two
cuts at the multiples of the window: piece by piece, with a boundary record wherever a
document goes on in the next sequence. Only the last sequence of all is padded.

Defined cases: null text counts as empty, and an empty document is its end token alone; a
document longer than the window spans sequences; texts of any length and any runs of
white space have the ids of `tokenizers`; repeated rows are packed as often as they
stand; a null identifier sorts first; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

WINDOW = 2048
END_ID = 1


class Encoder:
    """Ids of a byte-level BPE file as little-endian 32-bit bytes.

    The ids are those that `tokenizers` gives for the file (add_special_tokens=False); its
    vocabulary and special tokens are run by tiktoken, which takes a quarter of the CPU.
    Texts that tiktoken can't split (very long runs of white space) go to `tokenizers` itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # such files write bytes as characters: printable ones as themselves, the others from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.path, self.defining = path, None

    def encode(self, text: str) -> bytes:
        try:
            ids = self.encoding.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its pattern matcher backtracks over white space, and ends at about half a million
            ids = np.array(self._tokenizer().encode(text, add_special_tokens=False).ids)
        return ids.astype("<u4").tobytes()

    def _tokenizer(self):
        from tokenizers import Tokenizer

        if self.defining is None:
            self.defining = Tokenizer.from_file(self.path)
        return self.defining


_loaded: dict[str, Encoder] = {}  # one a Python worker


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_table(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Per document in order of identifier: its partition, tokens, those before it in the partition, and ids (zlib)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, pid, before = encoder(path).encode, TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = [encode(t or "") + end for t in batch.column(1).to_pylist()]
            n = [len(x) // 4 for x in ids]
            starts = before + np.cumsum([0, *n[:-1]]) if n else []
            before += sum(n)
            # a row of shuffled columns: the low bytes of all ids, then the next, compress better
            packed = [zlib.compress(np.frombuffer(x, np.uint8).reshape(-1, 4).T.tobytes(), 1) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([pid] * len(n), pa.int32()), pa.array(n, pa.int64()), pa.array(starts, pa.int64()), pa.array(packed, pa.binary())],
                names=["doc_id", "pid", "doc_tokens", "before", "ids"],
            )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    n = shuffle_partitions(docs.sparkSession)
    ordered = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return ordered.mapInArrow(run, "doc_id long, pid int, doc_tokens long, before long, ids binary")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    tokens = cut(token_table(docs, path or default_tokenizer(), key, text, end_id))
    totals = tokens.groupBy("pid").agg(F.sum("doc_tokens").alias("n"))  # a row per partition
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(bases), "pid").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "doc_tokens", "ids")

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for doc_id, at, n, packed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.tobytes()
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(window - offset, n - start)
                    for k, v in zip(out, (doc_id, start, length, ids[4 * start : 4 * (start + length)], n, sequence, offset), strict=True):
                        out[k].append(v)
                    start += length
            kinds = {"ids": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))

    return placed.mapInArrow(cuts, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pack_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum for their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
