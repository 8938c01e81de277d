"""Sharding, mixing, packing and media columns."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from meetloom.llm import media, mixing, packing, sharding


def by_value(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_feistel_permutes(n):
    assert sorted(sharding.feistel(np.arange(n), n, 5).tolist()) == list(range(n))


def plain_position(row: int, n: int, seed: int) -> int:
    """The Feistel network in Python's own integers."""
    half = max(1, (max(2, n) - 1).bit_length() + 1 >> 1)
    keys = [int(k) for k in np.random.default_rng(seed).integers(0, 2**63, sharding.ROUNDS, dtype=np.uint64)]
    while True:
        left, right = row >> half, row & ((1 << half) - 1)
        for k in keys:
            f = (right ^ k) * 0x9E3779B97F4A7C15 % 2**64
            f = (f ^ (f >> 29)) * 0xBF58476D1CE4E5B9 % 2**64
            left, right = right, left ^ ((f ^ (f >> 32)) & ((1 << half) - 1))
        row = left << half | right
        if row < n:
            return row


@pytest.mark.parametrize("n", [1, 2, 5, 100, 777])
def test_feistel_against_plain_integers(n):
    assert sharding.feistel(np.arange(n), n, 8).tolist() == [plain_position(i, n, 8) for i in range(n)]


def test_shards(docs, no_docs, corpus):
    from pyspark.sql import functions as F

    dealt = sharding.shard(docs)
    rows = sharding.shard_digest(dealt).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in corpus)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert (r.shard, r.slot) == (r.position % 16, r.position // 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shard_digest(sharding.shard(docs.repartition(1))).collect()
    assert sorted(rows, key=by_value) == sorted(again, key=by_value)
    assert sharding.shard(no_docs).count() == 0
    # positions by plain counting: by bucket, then hash
    hashed = docs.select("*", F.xxhash64(F.struct(*docs.columns)).alias("h")).collect()
    order = sorted(hashed, key=lambda r: (r.h % sharding.LEAST_BUCKETS, r.h))
    want = Counter((*r[:-1], plain_position(i, len(order), 20240229)) for i, r in enumerate(order))
    assert Counter(map(tuple, dealt.drop("shard", "slot").collect())) == want
    # a partition holds slots of one shard in their order
    for part in dealt.select("shard", "slot", F.spark_partition_id().alias("p")).groupBy("p").agg(F.collect_list(F.struct("shard", "slot")).alias("x")).collect():
        assert len({x.shard for x in part.x}) == 1


def test_shards_carry_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"t{i}", -i, "x") for i in range(40)], "doc_id long, text string, slot long, position string")
    dealt = sharding.shard(docs, 3)
    assert dealt.columns == [*docs.columns, "dealt_position", "shard", "dealt_slot"]
    assert {(r.doc_id, r.slot) for r in dealt.collect()} == {(i, -i) for i in range(40)}


def test_mixing_meets_weights(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "big" if i % 4 else "small") for i in range(8000)], "doc_id long, text string, source string")
    mixed = mixing.mix_sources(docs, {"big": 1.0, "small": 1.0})
    counts = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(counts["big"] - 4000) < 300 and abs(counts["small"] - 4000) < 300
    keys = [r.order_key for r in mixed.select("order_key").collect()]
    assert keys == sorted(keys)


def test_mixing_odd_rows(docs, no_docs, corpus):
    rows = mixing.mix_sources(docs).collect()
    assert sorted(map(by_value, rows)) == sorted(map(by_value, mixing.mix_sources(docs.repartition(1)).collect()))
    draws = Counter((r.doc_id, r.text, r.copy_no) for r in rows)
    times = Counter((r[0], r[1]) for r in corpus)
    assert all(n == times[d, t] for (d, t, _), n in draws.items())
    assert mixing.mix_sources(no_docs).count() == 0
    assert mixing.mix_sources(docs, {"nowhere": 1.0}).count() == 0


def test_mixing_clashing_columns(spark):
    """Columns that mixing adds, or uses inside, are carried where docs has them."""
    rows = [(i, f"text {i}", "ab"[i % 2], 7, 8, 9, 10) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate int, copy_no int, order_key int, n_rows int")
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == [*docs.columns, "mix_copy_no", "mix_rate", "mix_order_key"]
    found = mixed.collect()
    assert {(r.rate, r.copy_no, r.order_key, r.n_rows) for r in found} == {(7, 8, 9, 10)}
    plain = mixing.mix_sources(docs.select("doc_id", "text", "source")).collect()
    assert Counter((r.doc_id, r.mix_copy_no) for r in found) == Counter((r.doc_id, r.copy_no) for r in plain)


def test_mixing_runs_no_python(docs):
    plan = mixing.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_packing_round_trip(docs, no_docs, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    pieces = packing.pack(docs, window=64).collect()
    want = Counter((r[0], tuple([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in corpus)
    ids = [r[0] for r in corpus]
    found = defaultdict(list)
    for p in pieces:
        found[p.doc_id].append(p)
        assert len(p.ids) == 4 * p.length
    for (doc_id, tokens), n in want.items():
        if n == ids.count(doc_id) == 1:
            parts = sorted(found[doc_id], key=lambda p: p.start)
            assert b"".join(p.ids for p in parts) == np.array(tokens, "<u4").tobytes()
            assert {p.doc_tokens for p in parts} == {len(tokens)}
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for s, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or s == len(sequences) - 1
    assert packing.pack(no_docs).count() == 0


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer, own = Tokenizer.from_file(path), packing.Encoder(path)
    rng = np.random.default_rng(1)
    alphabet = list("ab1 \n\t'é　\x1c\x85!<|>‍½²٣😀")
    texts = ["", "don't I'LL", "<|endoftext|>", " a <|endoftext|>  b", *("".join(rng.choice(alphabet, 20)) for _ in range(500))]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_very_long_runs(spark):
    """Texts that end tiktoken's pattern matcher have the ids of the tokenizers library, through Spark and among others."""
    from tokenizers import Tokenizer

    texts = [c * 1_000_000 for c in (" ", "\t", "\n", "\r", "\x0b")] + [" \n" * 1_500_000, "word " + "\u00a0 \t" * 400_000 + "end<|endoftext|>", "a" * 1_000_000, "x" + " " * 600_000 + "y"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "plain text", None])], "doc_id long, text string").repartition(4)
    got = {}
    for r in packing.pack(docs).collect():
        got.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    plain = Tokenizer.from_file(packing.default_tokenizer())
    for i, t in enumerate([*texts, "plain text", None]):
        ids = np.frombuffer(b"".join(x for _, x in sorted(got[i])), "<u4").tolist()
        assert ids == [*plain.encode(t or "", add_special_tokens=False).ids, packing.END_ID]


def test_media_round_trip(docs, no_docs, corpus):
    rows = media.read_media(media.to_media(docs)).collect()
    want = Counter()
    for r in corpus:
        data = (r[1] or "").encode()
        want[r[0], len(data), data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")] += 1
    assert Counter((r.doc_id, r.n_bytes, bytes(r.payload)) for r in rows) == want
    assert media.media_digest(media.read_media(media.to_media(no_docs))).count() == 0


def plain_hash(samples):
    """The cosine hash by areas and sums, one coefficient at a time."""
    height, width = samples.shape
    small = np.zeros((media.SIDE, media.SIDE))
    for i in range(media.SIDE):
        for j in range(media.SIDE):
            total = 0.0
            for y in range(int(i * height / media.SIDE), min(height, int(np.ceil((i + 1) * height / media.SIDE)))):
                tall = min(y + 1, (i + 1) * height / media.SIDE) - max(y, i * height / media.SIDE)
                for x in range(int(j * width / media.SIDE), min(width, int(np.ceil((j + 1) * width / media.SIDE)))):
                    total += tall * (min(x + 1, (j + 1) * width / media.SIDE) - max(x, j * width / media.SIDE)) * samples[y, x]
            small[i, j] = total / (height / media.SIDE * width / media.SIDE)
    low = []
    for k in range(media.LOW):
        for m in range(media.LOW):
            low.append(sum(small[i, j] * np.cos(np.pi * k * (2 * i + 1) / (2 * media.SIDE)) * np.cos(np.pi * m * (2 * j + 1) / (2 * media.SIDE)) for i in range(media.SIDE) for j in range(media.SIDE)))
    low = [0.0, *(round(x, 6) for x in low[1:])]
    middle = sorted(low[1:])[len(low) // 2 - 1]
    return [x > middle for x in low], min(abs(x - middle) for x in low if abs(x - middle) > 1e-6)


@pytest.mark.parametrize("height", [1, 3, 32, 77])
def test_cosine_hash_against_plain_transform(height):
    samples = np.random.default_rng(height).integers(0, 256, (height, media.WIDTH)).astype(np.uint8)
    bits, gap = plain_hash(samples.astype(float))
    got = np.unpackbits(np.frombuffer(media.cosine_hash(samples), np.uint8)).astype(bool).tolist()
    assert gap > 1e-5 and got == bits
    shifted = np.clip(samples.astype(int) + 1, 0, 255).astype(np.uint8)  # nearly the same picture
    near = np.unpackbits(np.frombuffer(media.cosine_hash(shifted), np.uint8)).astype(bool)
    assert (near != np.array(bits)).sum() <= 6


def test_all_row_filters():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (10, 7)).astype(np.uint8)
    lines = []
    for y, row in enumerate(image):
        up = image[y - 1] if y else np.zeros(7, np.uint8)
        out = [y % 5]
        for x, v in enumerate(row.tolist()):
            a, b, c = (int(row[x - 1]) if x else 0), int(up[x]), (int(up[x - 1]) if x else 0)
            near = min((abs(a + b - c - g), i, g) for i, g in enumerate((a, b, c)))[2]
            out.append((v - (0, a, b, (a + b) // 2, near)[y % 5]) % 256)
        lines.append(out)
    assert (media._unfilter(np.array(lines, np.uint8)) == image).all()


def test_broken_files_raise():
    good = media.encode_png(np.zeros((2, 64), np.uint8))
    assert (media.decode_png(good) == 0).all()
    for bad in (good[:-1], b"x" + good[1:], good[:20] + b"\xff" + good[21:], good[:33]):
        with pytest.raises(ValueError):
            media.decode_png(bad)
