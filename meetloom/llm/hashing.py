"""Vectorised polynomial hashing of byte strings, words and word shingles."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE (or its inverse) to the powers 0..n-1, modulo 2**64."""
    name = "inverse" if inverse else "base"
    if name not in _powers or len(_powers[name]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        factors = np.full(size, INVERSE if inverse else BASE, np.uint64)
        factors[0] = 1
        _powers[name] = np.multiply.accumulate(factors)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (byte + 1) * BASE**j over j < i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def substring_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal strings wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(len(prefix), True)[start]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts (runs without bytes 0x20 and 0x09-0x0D), and where each text's begin."""
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = np.empty(len(data) + 1, bool)
    space[0] = True
    np.logical_or(data == 32, (data >= 9) & (data <= 13), out=space[1:])
    start = np.flatnonzero(space[:-1] & ~space[1:])
    end = np.flatnonzero(~space[:-1] & space[1:])
    hashes = mix(substring_hashes(prefix_hashes(data), start, end) + (end - start).astype(np.uint64))
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    return hashes, np.searchsorted(start, first)


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles; of fewer words, the whole sequence as one."""
    h, bounds = word_hashes(texts)
    n = max(0, len(h) - words + 1)
    all_ = np.zeros(n, np.uint64)
    for k in range(words):
        all_ = all_ * BASE + h[k : k + n]
    all_ = mix(all_)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(all_[a : b - words + 1]))
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                one = one * BASE + h[k]
            out.append(mix(~one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minwise(sets: list[np.ndarray], m: int, seed: int) -> np.ndarray:
    """A (texts, m) array of minwise hashes (64 bits); empty sets get zeros."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, m, dtype=np.uint64)
    out = np.zeros((len(sets), m), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        end, size = at, 0
        while end < len(full) and (end == at or size + len(sets[full[end]]) <= 1 << 14):  # stay in the cache
            size += len(sets[full[end]])
            end += 1
        part = [sets[i] for i in full[at:end]]
        x = np.concatenate(part)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in part])[:-1]])
        rows = np.array(full[at:end])
        for t in range(m):
            out[rows, t] = np.minimum.reduceat(x * a[t] + b[t], starts)
        at = end
    return out


def in_slices(texts: list[bytes], most: int = 1_000_000):
    """(start, end) ranges of texts of about `most` bytes."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
