"""Quality scores from random-indexing word vectors, pooled per document, and a two-layer network.

Every word, and every word shape (capitals, digits, punctuation, length, repetition), has a
sparse ternary index vector drawn from its own hash. The words and shapes that make up at
least SHARE of all of the corpus, of which there can be 1 / SHARE at most, also have a
context vector: the sum of the index vectors around all their occurrences (of words within
REACH and the word's shape, or of shapes within REACH and the shape's word), added up over
the whole corpus. A document is the mean of its words' index and context vectors, the same of
its shapes, and its length; rarer words count with their index vectors. The network is
numpy, trained on a bounded labelled sample; its probabilities are calibrated by a
temperature found on a part of the sample that it hasn't seen.

Defined cases: null, empty or blank text has a zero vector and gets the network's score for
that; without any positive or negative label every score is 0; a null identifier counts as
not held out; repeated rows score alike; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, shuffle_partitions
from .hashing import in_slices, mix, prefix_hashes, substring_hashes
from .learning import ROWS_PER_CLASS, Adam, calibrate, sigmoid, training_sample

SHARE = 2.0**-16  # of all words: rarer ones have no context vector
DIMENSIONS, NONZERO = 64, 4
REACH = 2  # words on either side that count as context
HIDDEN = 32
THRESHOLD = 0.7
PARTS = 16
SLICE = 1 << 20
STEP = 1 << 15  # words whose vectors are gathered at once


def index_entries(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, NONZERO) dimensions and signs of the index vectors of hashes."""
    x = mix(h ^ np.uint64(0xA0761D6478BD642F))
    each = np.arange(NONZERO, dtype=np.uint64)
    width = DIMENSIONS // NONZERO  # each entry falls into a part of its own
    at = (x[:, None] >> (each * np.uint64(8))) % np.uint64(width) + each * np.uint64(width)
    return at.astype(np.int64), np.where(x[:, None] >> (each + np.uint64(60)) & np.uint64(1), 1.0, -1.0)


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (runs without white space), of their shapes, and where each text's words begin."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    change = np.diff(space.astype(np.int8))
    start, end = np.flatnonzero(change == -1) + 1, np.flatnonzero(change == 1) + 1
    first = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    bounds = np.searchsorted(start, first)
    whole = mix(substring_hashes(prefix_hashes(data), start, end))
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    letter = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128))])
    n = end - start
    caps, digits, letters = upper[end] - upper[start], digit[end] - digit[start], letter[end] - letter[start]
    tail = np.where(letters == n, 0, data[end - 1]) if len(n) else n  # the last byte, unless all are letters
    kind = (caps >= np.maximum(2, letters)).astype(np.int64) + 2 * (digits > 0) + 4 * np.minimum(3, n - letters - digits)
    again = np.zeros(len(n), np.int64)
    if len(n):
        again[1:] = whole[1:] == whole[:-1]
        again[bounds[:-1][bounds[:-1] < len(n)]] = 0
    shape = ((kind * 2 + again) * 256 + tail) * 8 + np.minimum(7, n // 3)
    return whole, mix(shape.astype(np.uint64) + np.uint64(1 << 40)), bounds


def _counted(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes and their summed counts."""
    kinds, place = np.unique(np.concatenate(hashes), return_inverse=True)
    return kinds, np.bincount(place, np.concatenate(counts), len(kinds)).astype(np.int64)


def common_words(docs: DataFrame, text: str = "text", share: float = SHARE) -> np.ndarray:
    """Sorted hashes of the words and shapes that make up at least share of all words of docs: 2 / share at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = [], []
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in in_slices([t or "" for t in texts], SLICE):
                words, shapes, _ = words_of(texts[a:b])
                for h, n in (np.unique(x, return_counts=True) for x in (words, shapes)):
                    hashes.append(h)
                    counts.append(n)
                if sum(map(len, hashes)) > SLICE:
                    own = _counted(hashes, counts)
                    hashes, counts = [own[0]], [own[1]]
                    if len(own[0]) > SLICE // 2:  # memory stays bounded; Spark adds up what tasks tell
                        yield _rows(*own)
                        hashes, counts = [], []
        if hashes:
            yield _rows(*_counted(hashes, counts))

    def _rows(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    told = docs.select(F.col(text).alias("text")).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    told = cut(told)
    total = told.agg(F.sum("n")).first()[0] or 0  # words and shapes, so twice the words
    found = told.where(F.col("n") >= share * total / 2).select("h").toArrow()
    return np.sort(found["h"].to_numpy().view(np.uint64))


class Known:
    """Places of common words in a table, from 1; others have 0."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes

    def find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at + 1, 0)


def contexts(texts: list[str | None], known: Known, out: np.ndarray) -> None:
    """Adds index vectors to each common word's row of out: those of the words near it and of its own shape; for shapes those of the shapes near them and of their words."""
    words, shapes, bounds = words_of(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    rows, entries = [known.find(x) for x in (words, shapes)], [index_entries(x) for x in (words, shapes)]
    flat = out.reshape(-1)

    def add(row: np.ndarray, at: np.ndarray, sign: np.ndarray) -> None:
        met = np.flatnonzero(row)
        if len(met):
            np.add.at(flat, (row[met, None] * DIMENSIONS + at[met]).ravel(), sign[met].ravel())

    for row, (at, sign) in zip(rows, reversed(entries), strict=True):
        add(row, at, sign)
    for step in range(1, REACH + 1):
        near = doc[step:] == doc[:-step]
        for row, (at, sign) in zip(rows, entries, strict=True):
            add(np.where(near, row[:-step], 0), at[step:], sign[step:])
            add(np.where(near, row[step:], 0), at[:-step], sign[:-step])


def context_vectors(docs: DataFrame, known: Known, text: str = "text") -> np.ndarray:
    """Unit context vectors of the common words, from the whole of docs; row 0 is that of all others, zero."""
    size = len(known.hashes) + 1

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, DIMENSIONS))
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in in_slices([t or "" for t in texts], SLICE):
                contexts(texts[a:b], known, total)
        if total.any():
            parts = [p.astype(np.float32).tobytes() for p in np.array_split(total, PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(x, np.float32).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in sums.values()], pa.binary())], names=["part", "sums"])

    partial = docs.select(F.col(text).alias("text")).mapInArrow(collect, "part int, sums binary")
    n = shuffle_partitions(docs.sparkSession)
    salted = partial.repartition(n, "part", F.spark_partition_id() % max(1, n // PARTS)).mapInArrow(add, "part int, sums binary")
    rows = salted.repartition(PARTS, "part").mapInArrow(add, "part int, sums binary").collect()  # PARTS rows
    if not rows:
        return np.zeros((size, DIMENSIONS), np.float32)
    out = np.concatenate([np.frombuffer(r["sums"], np.float32) for r in sorted(rows, key=lambda r: r["part"])]).reshape(size, DIMENSIONS)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(texts: list[str | None], known: Known, vectors: np.ndarray) -> np.ndarray:
    """Per text the means of the index and context vectors of its words, of those of its shapes, and the log of its length."""
    words, shapes, bounds = words_of(texts)
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(texts)), n)
    out = np.zeros((len(texts), 4 * DIMENSIONS + 1))
    for k, x in enumerate((words, shapes)):
        for i in range(0, len(x), STEP):
            part, own = x[i : i + STEP], doc[i : i + STEP]
            first = own[0]
            width = int(own[-1] - first) + 1
            at, sign = index_entries(part)
            index = np.bincount(((own - first)[:, None] * DIMENSIONS + at).ravel(), sign.ravel(), width * DIMENSIONS).reshape(width, DIMENSIONS)
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            out[first : first + width, 2 * k * DIMENSIONS : (2 * k + 1) * DIMENSIONS] += index
            out[own[heads], (2 * k + 1) * DIMENSIONS : (2 * k + 2) * DIMENSIONS] += np.add.reduceat(vectors[known.find(part)], heads)
    out[:, :-1] /= np.maximum(n, 1)[:, None]
    out[:, -1] = np.log1p(n)
    return out.astype(np.float32)


@dataclass
class Model:
    known: Known
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self.params
        return np.tanh((x - self.mean) / self.scale @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(self.logits(pooled(texts, self.known, self.vectors)).astype(np.float64) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, known: Known, vectors: np.ndarray, epochs: int = 60, seed: int = 9) -> Model | None:
    y = np.asarray(y, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    unseen, own = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    params = {"w1": rng.standard_normal((x.shape[1], HIDDEN)).astype(np.float32) / np.sqrt(x.shape[1]), "b1": np.zeros(HIDDEN, np.float32), "w2": rng.standard_normal(HIDDEN).astype(np.float32) / np.sqrt(HIDDEN), "b2": np.zeros(1, np.float32)}
    model, adam = Model(known, vectors, mean, scale.astype(np.float32), params), Adam(params, 0.005)
    z, w = ((x - mean) / scale).astype(np.float32), (weight / weight.mean()).astype(np.float32)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
            h = np.tanh(z[part] @ params["w1"] + params["b1"])
            d = w[part] * (sigmoid(h @ params["w2"] + params["b2"]) - y[part]) / len(part)
            back = d[:, None] * params["w2"] * (1 - h * h)
            adam.step({"w1": z[part].T @ back + 1e-4 * params["w1"], "b1": back.sum(axis=0), "w2": h.T @ d, "b2": d.sum(keepdims=True)})
    if len(unseen):
        a, _ = calibrate(model.logits(x[unseen]).astype(np.float64), y[unseen].astype(np.float64), weight[unseen], shift=False)
        model.temperature = 1 / a
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> Model | None:
    known = Known(common_words(docs, text))
    vectors = context_vectors(docs, known, text)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            x = np.concatenate([pooled(texts[a:b], known, vectors) for a, b in in_slices([t or "" for t in texts], SLICE)] or [pooled([], known, vectors)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "weight", "x"])

    sample = training_sample(docs, labels, label, key, text, 2 * ROWS_PER_CLASS).mapInArrow(pool, "doc_id long, label int, weight double, x binary").orderBy("doc_id").toArrow()
    x = np.frombuffer(b"".join(sample["x"].to_pylist()), np.float32).reshape(-1, 4 * DIMENSIONS + 1)
    return train(x, sample["label"].to_numpy(), sample["weight"].to_numpy(), known, vectors)


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted, a row per document."""
    model = fit(docs, labels, label, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, scores = batch.column(1).to_pylist(), np.zeros(batch.num_rows)
            if model is not None:
                for a, b in in_slices([t or "" for t in texts], SLICE):
                    scores[a:b] = model.scores(texts[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    out = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
