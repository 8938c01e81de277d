"""Phrase collocations and the quotient filters they are counted in."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from meetloom.llm import collocations, quotient_filter
from meetloom.llm.quotient_filter import Packing, counted, decode, encode


@pytest.mark.parametrize("bits", [1, 2, 5, 13, 16, 21, 22, 32, 33, 64])
@pytest.mark.parametrize("n", [2, 3, 5])
def test_filters_lose_nothing(bits, n):
    rng = np.random.default_rng(bits * 10 + n)
    packing = Packing(n, bits)
    ids = [rng.integers(0, 2 ** min(bits, 6), 4000, dtype=np.uint64) << np.uint64(max(0, bits - 6)) for _ in range(n)]
    words = packing.pack(ids)
    assert all((a == b).all() for a, b in zip(ids, packing.unpack(words), strict=True))
    want = Counter(zip(*[i.tolist() for i in ids], strict=True))
    own, counts = counted(words)
    shard_bits = min(4, packing.width)
    got, halves = Counter(), []
    for shard, data in encode(packing, own, counts * 97, shard_bits):
        w, c = decode(packing, shard, data, shard_bits)
        assert ((w[0] >> np.uint64(packing.width - shard_bits)) == shard).all() and (np.diff(w[0].astype(object)) >= 0).all()
        got.update(dict(zip(zip(*[i.tolist() for i in packing.unpack(w)], strict=True), c.tolist(), strict=True)))
        halves.append((w, c))
    assert got == {k: v * 97 for k, v in want.items()}
    both, sums = counted([np.concatenate([*x, *x]) for x in zip(*[w for w, _ in halves], strict=True)], np.concatenate([c for _, c in halves] * 2))
    assert len(sums) == len(want) and sums.sum() == 2 * 97 * 4000


def test_permutation_spreads_quotients():
    packing = Packing(2, 12)
    ids = [np.arange(4096, dtype=np.uint64), np.full(4096, 5, np.uint64)]
    shards = np.bincount((packing.pack(ids)[0] >> np.uint64(20)).astype(int), minlength=16)
    assert len(np.unique(packing.pack(ids)[0])) == 4096 and shards.max() < 2 * shards.mean()


def plain(rows, least, top, covered=100):
    """Counts by dictionaries, cuts and coverage by their definitions."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least}
        found = []
        for p, a in frequent.items():
            if len(p) == 1:
                continue
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_rows(seed: int = 2) -> list[tuple]:
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "délta", "É", "x\x01y", "the", "of", " ", "z" * 90, "new", "york", "city"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "?!"]) for _ in range(40))
        rows.append((rng.choice(["en", "en", "fr", None]), text + " the new York City hall stands" * rng.randrange(3)))
    return [*rows, ("en", None), ("en", ""), (None, " . "), ("de", "solo"), ("und", "new york city " * 5), rows[3], rows[3]]


SCHEMA = "lang string, text string, ids int, f int, id int, n int, rank string, block string"


@pytest.mark.parametrize("case", ["plain", "small parts", "wide ids", "few bits", "covered"])
def test_collocations_against_dictionaries(spark, monkeypatch, case):
    covered = 60 if case == "covered" else 100
    if case == "small parts":  # many blocks, filters, shards and parts of the top
        monkeypatch.setattr(collocations, "BLOCK", 150)
        monkeypatch.setattr(collocations, "FILTER", 100)
        monkeypatch.setattr(collocations, "TOP_ROWS", 20)
        monkeypatch.setattr(collocations, "HEAD", 20)
    if case == "wide ids":  # n-grams of several words
        monkeypatch.setattr(collocations, "Packing", lambda n, bits: quotient_filter.Packing(n, 28))
    if case == "few bits":  # the table of shorter phrases lets nearly all through
        monkeypatch.setattr(collocations, "BITS_WORDS", 2)
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, "5", "6") for r in rows], SCHEMA).repartition(5)
    got = collocations.collocations(docs, least=3, top=40, covered=covered).collect()
    assert sorted(map(tuple, got)) == plain(rows, 3, 40, covered)


def test_texts_without_phrases(spark, docs, no_docs):
    assert collocations.collocations(no_docs).count() == 0
    assert collocations.collocations(docs).where("a < 100").count() == 0
    few = spark.createDataFrame([("en", "one two three"), (None, None), ("fr", "...")], "lang string, text string")
    assert collocations.collocations(few).count() == 0
    assert [r.phrase for r in collocations.collocations(few, least=1).collect()] == ["one two three"]


def test_one_long_text(spark):
    """A text of several slices, in one piece, with a word longer than a slice."""
    text = "a b " * 1_100_000 + "w" * 5_000_000 + " a b"
    rows = {r.phrase: (r.a, r.n) for r in collocations.collocations(spark.createDataFrame([("en", text)], "lang string, text string")).collect()}
    n = 1_100_000
    assert rows == {p: (a, 2 * n + 3) for p, a in (("a b", n + 1), ("a b a b", n - 1), ("a b a b a", n - 2), ("b a b a b", n - 2))}
    for size in (1, 3, 7, 50):
        for data in (b"", b"abc", b"ab cd.ef  ghijklmnop .. q", b"x" * 40 + b" y", b" " * 20):
            collocations_slice = collocations.SLICE
            try:
                collocations.SLICE = size
                parts = list(collocations.sliced(data))
            finally:
                collocations.SLICE = collocations_slice
            assert b"".join(parts) == data
            assert b".".join(parts).replace(b".", b" ").split() == data.replace(b".", b" ").split()
