"""Exact, near and substring deduplication against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from meetloom.llm import components, exact_dedup, near_dedup, suffix_dedup
from meetloom.llm.hashing import mix


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("partitions", [1, 5])
def test_content_sort(spark, docs, corpus, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows = exact_dedup.content_runs(docs).collect()
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    groups = defaultdict(list)
    for r in corpus:
        groups[lower(r[1])].append(r[0])
    assert len(rows) == len(corpus)
    kept = defaultdict(int)
    for r in rows:
        kept[r.text_sha256] += r.kept
    want = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert kept == dict.fromkeys(want, 1)
    for r in rows:
        ids = want[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)


def test_one_group_over_many_partitions(spark):
    docs = spark.createDataFrame([(i, "Same text") for i in range(500)], "doc_id long, text string").repartition(7)
    rows = exact_dedup.content_runs(docs).collect()
    assert {(r.keep_id, r.group_size) for r in rows} == {(499, 500)}
    assert [r.doc_id for r in rows if r.kept] == [499]


def test_runs_leave_as_they_come(monkeypatch):
    """A run of any length is never held: every batch goes out before the next but one comes in."""
    import pyarrow as pa
    import pyspark

    class Task:
        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: Task()))
    taken = 0

    def batches():
        nonlocal taken
        for i in range(40):
            taken = i + 1
            yield pa.RecordBatch.from_arrays([pa.array(range(i * 100, i * 100 + 100), pa.int64()), pa.array([b"same" if i < 39 else b"tail"] * 100, pa.binary())], names=["doc_id", "__norm"])

    rows = 0
    for out in exact_dedup._runs(["doc_id"], 0)(batches()):
        rows += out.num_rows
        assert rows >= (taken - 1) * 100 - 1
        sizes = [n for n in out.column(out.schema.get_field_index("__n")).to_pylist() if n is not None]
        assert sizes in ([], [3900], [100])
    assert rows == 4000


def test_drop_copies_keeps_columns(docs, no_docs, corpus):
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == len({lower(r[1]) for r in corpus})
    assert exact_dedup.drop_copies(no_docs).count() == 0


def brute_sets(corpus):
    sets = {}
    for r in corpus:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(r[1]))
        sets[r[0]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    return sets


def brute_components(sets):
    ids = [i for i in sets if i is not None]
    component = {i: i for i in ids}
    while True:
        before = dict(component)
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if a != b and sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    component[a] = component[b] = min(component[a], component[b])
        if component == before:
            return component


def test_near_duplicates(docs, corpus):
    sets = brute_sets(corpus)
    want = brute_components(sets)
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id)


def test_large_near_group(spark, monkeypatch):
    """A chain of near copies wider than a node, so that nodes branch."""
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*words[:i], "x", *words[i + 1 :]])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {0}


def test_near_duplicates_of_nothing(no_docs):
    assert near_dedup.near_duplicates(no_docs).count() == 0
    assert near_dedup.drop_near_duplicates(no_docs).columns == no_docs.columns


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 9), (1, 1)], "a long, b long")
    assert {(r.id, r.component) for r in components.components(links).collect()} == {(2, 1), (3, 1), (4, 1), (5, 1), (8, 7), (9, 7)}


def brute_removal(corpus, span=50):
    first = {}
    for r in corpus:
        data = (r[1] or "").encode()
        for p in range(len(data) - span + 1):
            i = 1 << 62 if r[0] is None else r[0]
            first[data[p : p + span]] = min(first.get(data[p : p + span], 1 << 62), i)
    out = {}
    for r in corpus:
        data = (r[1] or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - span + 1):
            if first[data[p : p + span]] < (1 << 62 if r[0] is None else r[0]):
                gone[p : p + span] = True
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[r[0]] = (len(data), int(gone.sum()), spans, kept)
    return out


def test_suffix_sort_removal(docs, no_docs, corpus):
    want = brute_removal(corpus)
    rows = suffix_dedup.remove_repeats(docs).collect()
    assert len(rows) == len(corpus)
    assert sum(r.n_removed for r in rows) > 1000
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize(("hot", "chunk"), [(1, 32), (40, 3), (400, 1)])
def test_hot_buckets_in_parts(spark, monkeypatch, hot, chunk):
    """One passage in every document, one anchor in ever other surroundings, and small blocks: parts of hot buckets against brute force."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 600)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    passage, anchor = "a passage that stands in every single document of this corpus, word for word", "common eighteen by"

    def noise(n):
        return "".join(chr(c) for c in rng.integers(97, 123, n))

    corpus = [(100 - i, f"{noise(30)}{passage}{noise(25)}{anchor}{noise(40)}{anchor[:12]}{noise(9)}" if i % 9 else passage * 2) for i in range(60)]
    corpus += [(500, corpus[3][1]), (501, corpus[3][1][10:]), (None, passage)]
    want = brute_removal(corpus)
    rows = suffix_dedup.remove_repeats(spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows} == want


def test_a_hot_anchor_takes_a_row_a_chunk():
    """An anchor of every block reaches its bucket once for all blocks of a chunk; the others once a block."""
    rng = np.random.default_rng(3)
    hot = np.arange(7, dtype=np.uint64)
    chunk = []
    for i in range(20):
        prints = np.concatenate([hot, rng.integers(1000, 1 << 39, 50, dtype=np.uint64)])
        chunk.append((i, prints, np.concatenate([np.full(7, 5), rng.integers(0, 8, 50)]), np.zeros(57, bool)))
    chunk[4][3][30] = True  # several documents of one block
    rows = [r for batch in suffix_dedup._chunk_rows(chunk) for r in batch.to_pylist()]
    known = [r for r in rows if r["bucket"] < 0]
    assert {r["block_id"] for r in known} == set(range(20)) and all(r["bucket"] == -1 - r["block_id"] for r in known)
    assert sum(np.unpackbits(np.frombuffer(r["payload"], np.uint8), count=57).sum() for r in known) == 20 * 7 + 1
    of_chunk = [r for r in rows if r["block_id"] < 0]
    assert sum(len(r["payload"]) // 5 - 1 for r in of_chunk) == 8
    assert sum(int.from_bytes(r["payload"][-5:], "little") for r in of_chunk) == 20 * 7 + 1
    assert sum(len(r["payload"]) // 5 for r in rows if r["bucket"] >= 0 and r["block_id"] >= 0) == 20 * 50 - 1


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 240])
def test_rows_are_of_chunks_and_buckets(spark, monkeypatch, group):
    """However many blocks a chunk has, it exchanges a row or two with a bucket; what it sends may go in groups of blocks."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 600)
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = np.random.default_rng(5)
    lines = ["".join(chr(c) for c in rng.integers(97, 123, 150)) for _ in range(60)]
    corpus = [(int(i), "".join(lines[j] for j in rng.integers(0, 60, 2)) + "é" * int(i % 3)) for i in rng.permutation(200)]
    counts, dealt = [], suffix_dedup._dealt
    monkeypatch.setattr(suffix_dedup, "_dealt", lambda rows, *order: (counts.append(rows.where("bucket >= 0").count()), dealt(rows, *order))[1])
    rows = suffix_dedup.remove_repeats(spark.createDataFrame(corpus, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows} == brute_removal(corpus)
    blocks, buckets = 200, 4  # a document is over half a block
    chunks = -(-blocks // suffix_dedup.CHUNK)
    assert len(counts) == 2 and counts[0] <= 2 * chunks * buckets
    assert counts[1] <= chunks * buckets if group != 240 else chunks * buckets < counts[1] <= blocks * buckets


@pytest.mark.parametrize("most", [1, 1000, 1 << 40])
def test_equal_contexts_are_sorted_once(most):
    """Copies of a context take the place of one in the sort, and bits go to each of them."""
    rng = np.random.default_rng(6)
    text = rng.integers(97, 123, 3000).astype(np.uint8)

    def sent(doc_id, data):
        block = suffix_dedup.Block(suffix_dedup._pack(np.array([doc_id], np.int64), np.zeros(1, np.uint8), np.array([len(data)], np.int64), data))
        a, low, _ = block.contexts(np.arange(len(block.first)))
        first, windows = block.first[a], block.last[a] - block.first[a] + 1
        return [(block.anchor[a] - first).astype(np.uint8), windows.astype(np.uint8), low, block.data[suffix_dedup._ragged(first, windows + 49)]]

    parts = [sent(7, text), sent(5, text[100:2000]), sent(9, text)]
    found, different = np.zeros(sum(len(p[1]) for p in parts), object), 0
    for i, w in suffix_dedup.windows_of(parts, most=most):
        different += len(w.x)
        for j, bits in zip(i.tolist(), np.split(w.smaller(w.all()), np.cumsum(w.windows)[:-1]), strict=True):
            found[j] = int(bits.sum())
    assert 2951 <= different < 3100  # of 7,753; the cut document has other contexts at its ends
    of = np.repeat([0, 1, 2], [len(p[1]) for p in parts])
    assert [int(found[of == k].sum()) for k in range(3)] == [1851, 0, 2951]


def test_blocks_take_their_bits_in_turn():
    bits = suffix_dedup.Bits(4, [(2, np.packbits([1, 0, 1, 1, 0, 0, 1]).tobytes()), (0, np.packbits([0, 1, 1]).tobytes())])
    assert bits.take(np.array([2, 0, 3, 2]), np.array([2, 1, 2, 1])).tolist() == [True, False, False, False, False, True]
    assert bits.take(np.array([1, 0, 2]), np.array([1, 2, 4])).tolist() == [False, True, True, True, False, False, True]


def test_suffix_classes_against_sets():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    x = rng.integers(0, 3900, 3000)
    group = np.sort(rng.integers(0, 3, 3000))
    value = rng.integers(0, 10**6, 3000)
    found = suffix_dedup.Suffixes(data, 9).classes(x, group, value)
    least = {}
    for a, g, v in zip(x, group, value, strict=True):
        key = (g, data[a : a + 9].tobytes())
        least[key] = min(least.get(key, 1 << 60), v)
    assert [least[g, data[a : a + 9].tobytes()] for a, g in zip(x, group, strict=True)] == found.tolist()


def test_common_extension():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 500).astype(np.uint8)
    s = suffix_dedup.Suffixes(data, 20)
    x, y = rng.integers(0, 480, 200), rng.integers(0, 480, 200)
    want = [next((k for k in range(20) if data[a + k] != data[b + k]), 20) for a, b in zip(x, y, strict=True)]
    assert s.extension(x, y).tolist() == want
    assert len(set(mix(np.arange(1000, dtype=np.uint64)).tolist())) == 1000
