"""Spelling variants."""

import random
import re
import zlib
from collections import Counter

import pytest

from meetloom.llm import spelling


def one_apart(u: str, v: str) -> bool:
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(u) + 1 == len(v) and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def plain_counts(rows, slip_every=None):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if slip_every and h % slip_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_variants(counts):
    out, forms = {}, {}
    for w, n in counts.items():
        near = sorted((v for v in counts if one_apart(w, v)), key=lambda v: (-counts[v], v))
        forms[w] = near[0] if near and counts[near[0]] >= 5 * n else None
        out[w] = len(near)
    rows = set()
    for w, form in forms.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.add((w, form, root, counts[w], out[w], counts[form] if form else None))
    return rows


@pytest.mark.parametrize("lengths", [(4, 5), (1, 2), (7, 8), (3, 4, 3, 3)])
def test_one_edit_against_all_pairs(lengths):
    rng = random.Random(sum(lengths))
    for _ in range(400):
        words = sorted({"".join(rng.choice("abé") for _ in range(rng.choice(lengths))) for _ in range(rng.randrange(1, 60))})
        prefixes = spelling.common_prefixes(words)
        for w in words:
            if len(w) == min(lengths):
                assert [words[i] for i in spelling.one_edit(w, words, prefixes)] == [x for x in words if one_apart(w, x)]


def texts(seed: int, n: int, letters: str) -> list[tuple]:
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 10))) for _ in range(40)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = rng.choice(stems)
            p = rng.randrange(len(w))
            w = rng.choice([w, w, w, w, w[:p] + w[p + 1 :], w[:p] + rng.choice(letters) + w[p:], w[:p] + rng.choice(letters) + w[p + 1 :]])
            words.append(rng.choice([w, w, w.upper()]) + rng.choice([" ", "-", "7", "×y ", "\n"]))
        rows.append((i, "".join(words)))
    return rows


@pytest.mark.parametrize("group", [10_000, 40, 13])
def test_variants_against_all_pairs(spark, monkeypatch, group):
    """Also with groups that are dealt again and again."""
    monkeypatch.setattr(spelling, "GROUP", group)
    rows = texts(3, 150, "abÉ")
    rows += [(None, "Straße straße STRASSE " * 9), (None, None), (7, ""), rows[3], (900, "abcdef" * 3000), (901, "éééééé " * 5 + "ÉÉÉÉÉÉ " * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n", "'k' AS key").repartition(4)
    counts = spelling.word_counts(docs, slip_every=19)
    want = plain_counts(rows, 19)
    assert {(r.word, r.n) for r in counts.collect()} == set(want.items())
    got = spelling.variants(counts).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == plain_variants(want)


def test_chains_and_ties(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "zzzzzz": 5, "zzzzzy": 30, "zzzzzx": 30, "qqqqqqqq": 7, "éàaaaa": 5, "éaaaaa": 24, "xaaaaaa": 5, "a" * 200: 9, "a" * 201: 45}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert set(map(tuple, spelling.variants(words).collect())) == plain_variants(counts)


def test_no_words(spark, no_docs, docs, corpus):
    assert spelling.variants(spelling.word_counts(no_docs)).count() == 0
    want = plain_counts([(r[0], r[1]) for r in corpus])
    assert {(r.word, r.n) for r in spelling.word_counts(docs).collect()} == set(want.items())


def test_groups_stay_small_whatever_the_words(spark, monkeypatch):
    """A third of all words begin alike; every group is at most GROUP and rows grow by halvings only."""
    monkeypatch.setattr(spelling, "GROUP", 200)
    rng = random.Random(8)
    words = {"prefix" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)} | {"".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(4000)}
    rows = spelling.groups_of(spark.createDataFrame([(w, 5) for w in words], "word string, n long"))
    sizes = [r["count"] for r in rows.groupBy("key").count().collect()]
    assert max(sizes) <= 200 and sum(sizes) <= 16 * len(words)
