"""Counting quotient filters of packed n-grams: sorted, lossless and mergeable.

An n-gram of ids is packed into 64-bit words, as many ids in each as fit. The first word is
permuted invertibly, keyed by the others, so that its high bits, the quotient, are spread
evenly; what remains of it and the other words stay in full. A filter keeps, in the order of
the permuted words, the quotients in unary (a bit per entry and per quotient), the remainders
in the least whole bytes that hold them, and the counts in a byte each, larger ones apart.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from .hashing import mix

ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
MANY = 255  # counts from here on stand apart
U = np.uint64


def _kind(bits: int) -> str:
    return next(f"<u{n}" for n in (1, 2, 4, 8) if bits <= 8 * n)


@dataclass(frozen=True)
class Packing:
    """How n-grams of ids below 2**bits are packed and permuted."""

    n: int
    bits: int

    @property
    def each(self) -> int:
        """Ids in a word."""
        return max(1, 64 // self.bits)

    @property
    def width(self) -> int:
        """Bits of the first word."""
        return self.bits * min(self.n, self.each)

    def pack(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """Permuted words of the n-grams whose i-th ids are ids[i]."""
        words = []
        for a in range(0, self.n, self.each):
            word = np.zeros(len(ids[0]), U)
            for column in ids[a : a + self.each]:
                word = word << U(self.bits) | column.astype(U)
            words.append(word)
        mask, half = U((1 << self.width) - 1), U((self.width + 1) // 2)
        x = words[0] ^ (self._rest(words) & mask)
        for odd in ODD:
            x ^= x >> half
            x = x * U(odd & int(mask)) & mask
        return [x ^ x >> half, *words[1:]]

    def unpack(self, words: list[np.ndarray]) -> list[np.ndarray]:
        mask, half = U((1 << self.width) - 1), U((self.width + 1) // 2)
        x = words[0] ^ words[0] >> half
        for odd in reversed(ODD):
            x = x * U(pow(odd, -1, 1 << self.width)) & mask
            x ^= x >> half
        plain = [x ^ (self._rest(words) & mask), *words[1:]]
        ids = []
        for a, word in zip(range(0, self.n, self.each), plain, strict=True):
            m = min(self.each, self.n - a)
            ids += [word >> U(self.bits * (m - 1 - i)) & U((1 << self.bits) - 1) for i in range(m)]
        return ids

    @staticmethod
    def _rest(words: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(words[0]), U)
        for word in words[1:]:
            out = mix(out ^ word)
        return out

    def hashes(self, words: list[np.ndarray]) -> np.ndarray:
        """A 64-bit hash of each n-gram."""
        return mix(words[0] ^ self._rest(words))


def counted(words: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct n-grams in order, with how often they stand or the sums of their counts; may sort words in place."""
    if len(words) == 1 and counts is None:
        words[0].sort()
        starts = np.flatnonzero(np.concatenate([[True], words[0][1:] != words[0][:-1]])) if len(words[0]) else np.zeros(0, np.int64)
        return [words[0][starts]], np.diff(np.append(starts, len(words[0]))) if len(starts) else np.zeros(0, np.int64)
    order = np.argsort(words[0], kind="stable") if len(words) == 1 else np.lexsort(words[::-1])
    words = [w[order] for w in words]
    if not len(order):
        return words, np.zeros(0, np.int64)
    new = np.concatenate([[True], np.logical_or.reduce([w[1:] != w[:-1] for w in words])])
    starts = np.flatnonzero(new)
    sums = np.diff(np.append(starts, len(order))) if counts is None else np.add.reduceat(counts[order], starts)
    return [w[starts] for w in words], sums.astype(np.int64)


def encode(packing: Packing, words: list[np.ndarray], counts: np.ndarray, shard_bits: int) -> list[tuple[int, bytes]]:
    """(shard, filter) of sorted distinct n-grams; the shard is the first shard_bits of the quotient."""
    width = packing.width - shard_bits
    shards = words[0] >> U(width) if shard_bits else np.zeros(len(counts), U)
    out = []
    starts = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(counts) else []
    for a, b in zip(starts, [*starts[1:], len(counts)], strict=True):
        n = int(b - a)
        q = min(width, n.bit_length())
        first = words[0][a:b] & U((1 << width) - 1) if shard_bits else words[0][a:b]
        r = width - q
        unary = np.zeros(n + (1 << q), np.uint8)
        unary[(first >> U(r) if q else np.zeros(n, U)).astype(np.int64) + np.arange(n)] = 1
        parts = [struct.pack("<IB", n, q), np.packbits(unary).tobytes(), (first & U((1 << r) - 1)).astype(_kind(r)).tobytes()]
        parts += [w[a:b].astype(_kind(packing.bits * packing.each)).tobytes() for w in words[1:]]
        own = counts[a:b]
        parts += [np.minimum(own, MANY).astype(np.uint8).tobytes(), own[own >= MANY].astype("<i8").tobytes()]
        out.append((int(shards[a]), b"".join(parts)))
    return out


def decode(packing: Packing, shard: int, data: bytes, shard_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The words and counts of a filter."""
    n, q = struct.unpack_from("<IB", data)
    width, at = packing.width - shard_bits, 5
    r = width - q

    def take(kind: str, m: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, m, at)
        at += got.nbytes
        return got

    unary = np.unpackbits(take("u1", -(-(n + (1 << q)) // 8)))
    quotient = (np.flatnonzero(unary[: n + (1 << q)]) - np.arange(n)).astype(U)
    remainder = take(_kind(r), n).astype(U)
    words = [(quotient << U(r) if q else U(0)) | remainder | (U(shard) << U(width) if shard_bits else U(0))]
    words += [take(_kind(packing.bits * packing.each), n).astype(U) for _ in range(packing.each, packing.n, packing.each)]
    counts = take("u1", n).astype(np.int64)
    many = counts == MANY
    counts[many] = take("<i8", int(many.sum()))
    return words, counts
