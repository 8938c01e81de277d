"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A word enters as the embedding of itself (words known from training) and of its character
n-grams with word boundaries. Every document is cut into overlapping windows of words, all
of which are scored; the document's score is its highest window's, calibrated on the
training sample. Everything is numpy: training on a bounded labelled sample at the driver,
scoring in the tasks.

Training looks for the toxic part itself: a document teaches through the windows that
score highest so far, first by log odds of words and n-grams, then by the network. How clearly
words and n-grams must tell of the label to get an embedding is chosen by cross-validation
inside the sample; a fifth of it, from which the network doesn't learn, calibrates. Rows whose
labels are held out decide nothing.

Defined cases: a null or empty text, or one without any word, scores 0; without any positive
or negative label (of a text of up to SAMPLE_BYTES) every score is 0; a null identifier counts
as not held out; repeated rows score alike; an empty table gives an empty result; other
columns are ignored (`score`) or carried (`drop_toxic`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .hashing import BASE, in_slices, mix, prefix_hashes, substring_hashes
from .learning import Adam, calibrate, sigmoid, training_sample

WINDOW, STRIDE = 48, 32
HIDDEN, EMBED = 8, 8
GRAMS = (4, 6)  # bytes of the n-grams, boundaries counted
VOCABULARY = 20_000  # words, and n-grams, with an embedding
CLEAR = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5)  # deviations from no relation to the label that may earn one
FOLDS = 5
SAMPLE_BYTES = 1 << 16  # of a text that is learnt from, so that the sample fits the driver
SLOT_BITS = 20
THRESHOLD = 0.3
SLICE = 1 << 20


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts, starts and ends of their words, and where each text's words begin.

    A word is a run of letters (any byte over 127 counts as one) and digits.
    """
    raw = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    inner = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    change = np.diff(inner.astype(np.int8))
    start, end = np.flatnonzero(change == 1) + 1, np.flatnonzero(change == -1) + 1
    first = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    return data, start, end, np.searchsorted(start, first)


def gram_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of the words, and the word each belongs to; the byte on either side counts as a boundary."""
    n = end - start + 2
    at = np.repeat(np.cumsum(n) - n, n)
    source = np.repeat(start - 1, n) + np.arange(int(n.sum())) - at
    chars = data[source].copy()
    ends = np.cumsum(n)
    chars[ends - n] = 1
    chars[ends - 1] = 2
    prefix = prefix_hashes(chars)
    hashes, owners = [], []
    owner = np.repeat(np.arange(len(n)), n)
    stop = np.repeat(ends, n)
    places = np.arange(len(chars))
    for g in GRAMS:
        ok = np.flatnonzero(places + g <= stop)
        hashes.append(mix(substring_hashes(prefix, ok, ok + g) + np.uint64(g)))
        owners.append(owner[ok])
    short = np.flatnonzero(n < GRAMS[0])
    hashes.append(mix(substring_hashes(prefix, ends[short] - n[short], ends[short])))
    owners.append(short)
    return np.concatenate(hashes), np.concatenate(owners)


class Vocabulary:
    """Known 64-bit hashes with indices from 1; unknown ones get 0. On a shared slot the weightier stays."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        order = np.argsort(-weights, kind="stable")[:VOCABULARY]
        hashes = hashes[order]
        _, firsts = np.unique(hashes >> np.uint64(64 - SLOT_BITS), return_index=True)
        firsts.sort()
        self.keys = np.concatenate([[np.uint64(0)], hashes[firsts]])
        self.chosen = order[firsts]
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)
        self.slots[(self.keys[1:] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = np.arange(1, len(self.keys))

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = self.slots[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        return np.where(self.keys[at] == h, at, 0)


@dataclass
class Words:
    """Texts as places in a table of their different words, which have words and n-grams of the vocabularies."""

    bounds: np.ndarray  # where each text's words begin
    place: np.ndarray  # each word's row in the table
    word: np.ndarray  # hash of each row
    gram: np.ndarray  # hashes of the rows' n-grams
    owner: np.ndarray  # and their rows


def _table(texts: list[str | None]) -> Words:
    data, start, end, bounds = words_of(texts)
    h = mix(substring_hashes(prefix_hashes(data), start, end) + BASE)
    kinds, first, place = np.unique(h, return_index=True, return_inverse=True)
    gram, owner = gram_hashes(data, start[first], end[first])
    return Words(bounds, place, kinds, gram, owner)


def tabulate(texts: list[str | None]) -> Words:
    """One table of texts, made in slices so that memory follows its different words."""
    known = np.zeros(0, np.uint64)
    places, grams, owners, bounds = [], [], [], [np.zeros(1, np.int64)]
    for a, b in in_slices([t or "" for t in texts], SLICE):
        part = _table(texts[a:b])
        fresh = ~np.isin(part.word, known)
        row = np.empty(len(part.word), np.int64)  # rows are numbered as words come
        order = np.argsort(known)
        row[~fresh] = order[np.searchsorted(known[order], part.word[~fresh])] if len(known) else 0
        row[fresh] = len(known) + np.arange(int(fresh.sum()))
        known = np.concatenate([known, part.word[fresh]])
        places.append(row[part.place])
        own = fresh[part.owner]
        grams.append(part.gram[own])
        owners.append(row[part.owner[own]])
        bounds.append(bounds[-1][-1] + part.bounds[1:])
    if not places:
        return _table(texts)
    return Words(np.concatenate(bounds), np.concatenate(places), known, np.concatenate(grams), np.concatenate(owners))


def _windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per window: its text, where it begins among all words, its length."""
    n = np.diff(bounds)
    many = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, 1)
    text = np.repeat(np.arange(len(n)), many)
    begin = bounds[text] + (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    return text, begin, np.minimum(WINDOW, bounds[text + 1] - begin)


class Network:
    """Embeddings, two gated recurrent layers (one a direction), attention and an output unit."""

    def __init__(self, n_words: int, n_grams: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        d, h = 2 * EMBED, HIDDEN

        def r(*shape, s=0.3):
            return (rng.standard_normal(shape) * s).astype(np.float32)

        self.p = {"word": r(n_words, EMBED, s=0.05), "gram": r(n_grams, EMBED, s=0.05), "out": r(2 * h), "bias": np.zeros(1, np.float32), "key": r(2 * h, h), "query": r(h)}
        for side in "fb":
            self.p |= {f"in_{side}": r(d, 3 * h), f"rec_{side}": r(h, 3 * h), f"b_{side}": np.zeros(3 * h, np.float32)}
        self.p["word"][0] = self.p["gram"][0] = 0

    def embed(self, words: np.ndarray, gram: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Inputs of table rows with these vocabulary indices; the n-grams' embeddings are summed."""
        out = np.zeros((len(words), 2 * EMBED), np.float32)
        out[:, :EMBED] = self.p["word"][words]
        known = np.flatnonzero(gram)
        for j in range(EMBED):
            out[:, EMBED + j] = np.bincount(owner[known], self.p["gram"][gram[known], j], len(words))
        return out

    def _direction(self, side: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """x: (time, batch, 3 * HIDDEN) projected inputs. The states by time, and what going back needs."""
        h, u = np.zeros((x.shape[1], HIDDEN), np.float32), self.p[f"rec_{side}"]
        states, kept = np.empty((len(x), x.shape[1], HIDDEN), np.float32), []
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            rec = h @ u
            gates = sigmoid(x[t, :, : 2 * HIDDEN] + rec[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(x[t, :, 2 * HIDDEN :] + r * rec[:, 2 * HIDDEN :])
            z = 1 - mask[t][:, None] * (1 - z)  # a padded step keeps the state
            before, h = h, n + z * (h - n)
            states[t] = h
            if keep:
                kept.append((t, before, z, r, n, rec[:, 2 * HIDDEN :]))
        return states, kept

    def forward(self, rows: np.ndarray, places: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: places (time, batch) into rows of the inputs; mask 0 where padded."""
        sides, caches = [], {}
        for side in "fb":
            x = (rows @ self.p[f"in_{side}"] + self.p[f"b_{side}"])[places]
            states, caches[side] = self._direction(side, x, mask, keep)
            sides.append(states)
        h = np.concatenate(sides, axis=2)
        k = np.tanh(h @ self.p["key"])
        e = np.where(mask > 0, k @ self.p["query"], np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        e *= mask
        a = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", a, h)
        logit = pooled @ self.p["out"] + self.p["bias"]
        return (logit, (h, k, a, pooled, caches)) if keep else logit

    def backward(self, rows, places, mask, state, dlogit) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients, and that of the inputs' rows."""
        h, k, a, pooled, caches = state
        g = {"out": pooled.T @ dlogit, "bias": dlogit.sum(keepdims=True)}
        dpooled = dlogit[:, None] * self.p["out"]
        dh = a[:, :, None] * dpooled
        da = np.einsum("bh,tbh->tb", dpooled, h)
        de = a * (da - (a * da).sum(axis=0))
        g["query"] = np.einsum("tb,tbh->h", de, k)
        dk = de[:, :, None] * self.p["query"] * (1 - k * k)
        g["key"] = np.einsum("tbi,tbj->ij", h, dk)
        dh += dk @ self.p["key"].T
        drows = np.zeros_like(rows)
        for side, part in (("f", dh[:, :, :HIDDEN]), ("b", dh[:, :, HIDDEN:])):
            u = self.p[f"rec_{side}"]
            dx = np.zeros((*places.shape, 3 * HIDDEN), np.float32)
            gu, carry = np.zeros_like(u), np.zeros((places.shape[1], HIDDEN), np.float32)
            for t, before, z, r, n, recn in reversed(caches[side]):
                d = part[t] + carry
                dn, dz = d * (1 - z), d * (before - n)
                dn *= 1 - n * n
                live = mask[t][:, None]
                gate = 1 - (1 - z) / np.maximum(live, 1e-9)  # z before masking
                dz = np.where(live > 0, dz * gate * (1 - gate), 0)
                dr = dn * recn * r * (1 - r)
                drec = np.concatenate([dz, dr, dn * r], axis=1)
                dx[t] = np.concatenate([dz, dr, dn], axis=1)
                gu += before.T @ drec
                carry = d * z + drec @ u.T
            g[f"rec_{side}"], g[f"b_{side}"] = gu, dx.sum(axis=(0, 1))
            per_row = np.zeros((len(rows), 3 * HIDDEN), np.float32)
            np.add.at(per_row, places.ravel(), dx.reshape(-1, 3 * HIDDEN))
            g[f"in_{side}"] = rows.T @ per_row
            drows += per_row @ self.p[f"in_{side}"].T
        return g, drows


def _places(place: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.arange(WINDOW)[:, None]
    mask = t < length[None, :]
    at = np.where(mask, begin[None, :] + t, 0)
    return (place[at] if len(place) else np.zeros(at.shape, np.int64)), mask.astype(np.float32)


@dataclass
class Model:
    words: Vocabulary
    grams: Vocabulary
    network: Network
    scale: float
    shift: float

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Each text's highest window logit."""
        table = tabulate(texts)
        rows = self.network.embed(self.words.find(table.word), self.grams.find(table.gram), table.owner)
        rows = rows if len(rows) else np.zeros((1, 2 * EMBED), np.float32)
        text, begin, length = _windows(table.bounds)
        out = np.empty(len(text), np.float32)
        for at in range(0, len(text), 2048):
            part = slice(at, at + 2048)
            places, mask = _places(table.place, begin[part], length[part])
            used, local = np.unique(places, return_inverse=True)
            out[part] = self.network.forward(rows[used], local.reshape(places.shape), mask)
        return np.maximum.reduceat(out, np.flatnonzero(np.diff(text, prepend=-1))) if len(text) else out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = sigmoid(self.scale * self.logits(texts).astype(np.float64) + self.shift)
        out[np.diff(words_of(texts)[3]) == 0] = 0.0
        return out


class Rows:
    """Which n-grams the rows of a table have."""

    def __init__(self, gram: np.ndarray, owner: np.ndarray, n: int):
        order = np.argsort(owner, kind="stable")
        self.gram, self.first = gram[order], np.searchsorted(owner[order], np.arange(n + 1))

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of rows, and for each which of rows has it."""
        size = self.first[rows + 1] - self.first[rows]
        at = np.repeat(self.first[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.gram[at], np.repeat(np.arange(len(rows)), size)


def _log_odds(n: np.ndarray, pos: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of what is in n documents, pos of them positive, and how many deviations they are from none."""
    odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((n - pos + 0.5) / ((1 - y).sum() + 1))
    return odds, np.abs(odds) / np.sqrt(1 / (pos + 0.5) + 1 / (n - pos + 0.5))


class Evidence:
    """What words and n-grams of a table tell of the labels of some of its documents."""

    def __init__(self, table: Words, y: np.ndarray, learnt: np.ndarray):
        self.table, (self.gkinds, gid) = table, np.unique(table.gram, return_inverse=True)
        have = Rows(gid.astype(np.int32), table.owner, len(table.word))
        n, pos, gn, gpos = (np.zeros(k) for k in (len(table.word), len(table.word), len(self.gkinds), len(self.gkinds)))
        for d in np.flatnonzero(learnt):  # in how many documents, and positive ones, words and n-grams are
            own = np.unique(table.place[table.bounds[d] : table.bounds[d + 1]])
            for total, positive, kinds in ((n, pos, own), (gn, gpos, np.unique(have.of(own)[0]))):
                total[kinds] += 1
                positive[kinds] += y[d]
        self.odds, self.clear = _log_odds(n, pos, y[learnt])
        self.godds, self.gclear = _log_odds(gn, gpos, y[learnt])

    def vocabularies(self, least: float) -> tuple[Vocabulary, np.ndarray, Vocabulary, np.ndarray]:
        """Words and n-grams that are so clear, and their log odds; others would only be learnt by heart."""
        told, gtold = np.flatnonzero(self.clear >= least), np.flatnonzero(self.gclear >= least)
        words, grams = Vocabulary(self.table.word[told], self.clear[told]), Vocabulary(self.gkinds[gtold], self.gclear[gtold])
        return words, np.clip(self.odds[told][words.chosen], -4, 8) / 4, grams, np.clip(self.godds[gtold][grams.chosen], -4, 8) / 4

    def worth(self, words: Vocabulary, odds: np.ndarray, grams: Vocabulary, godds: np.ndarray) -> np.ndarray:
        """Summed log odds of each row of the table: of the word with all its n-grams."""
        odds, godds = np.concatenate([[0], odds]), np.concatenate([[0], godds])
        if not len(self.table.word):
            return np.zeros(1)
        return odds[words.find(self.table.word)] + np.bincount(self.table.owner, godds[grams.find(self.table.gram)], len(self.table.word))


def _seeds(table: Words, begin: np.ndarray, length: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Each window's highest worth of a word."""
    out = np.empty(len(begin))
    for at in range(0, len(begin), 2048):
        places, mask = _places(table.place, begin[at : at + 2048], length[at : at + 2048])
        out[at : at + 2048] = np.where(mask > 0, worth[places], -9).max(axis=0)
    return out


def log_loss(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Of logits calibrated on these rows."""
    scale, shift = calibrate(logits, y, weight, shift=True)
    p = np.clip(sigmoid(scale * logits + shift), 1e-9, 1 - 1e-9)
    return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum())


def clearest(table: Words, y: np.ndarray, weight: np.ndarray, seed: int = 5) -> float:
    """Which of CLEAR tells best, by log odds alone, of documents that the odds don't come from (FOLDS parts in turn)."""
    text, begin, length = _windows(table.bounds)
    firsts = np.flatnonzero(np.diff(text, prepend=-1))
    fold = np.empty(len(y), np.int64)
    for label in (0, 1):  # as many of a label in each
        rows = np.random.default_rng(seed).permutation(np.flatnonzero(y == label))
        fold[rows] = np.arange(len(rows)) % FOLDS
    highest = np.zeros((len(CLEAR), len(y)))
    for f in range(FOLDS):
        away = fold == f
        if not 0 < y[~away].sum() < (~away).sum():
            continue
        evidence, windows = Evidence(table, y, ~away), np.flatnonzero(away[text])
        for i, least in enumerate(CLEAR):
            worth = evidence.worth(*evidence.vocabularies(least))
            seeds = np.full(len(text), -9.0)
            seeds[windows] = _seeds(table, begin[windows], length[windows], worth)
            highest[i, away] = np.maximum.reduceat(seeds, firsts)[away]
    losses = [log_loss(h, y, weight) for h in highest]
    return CLEAR[int(np.argmin(losses))]


def train(texts: list[str], y: np.ndarray, weight: np.ndarray, epochs: int = 6, seed: int = 5) -> Model | None:
    y = np.asarray(y, np.float64)
    if not len(y) or y.min() == y.max():
        return None
    table = tabulate(texts)
    text, begin, length = _windows(table.bounds)
    firsts = np.flatnonzero(np.diff(text, prepend=-1))
    evidence = Evidence(table, y, np.ones(len(y), bool))
    words, odds, grams, godds = chosen = evidence.vocabularies(clearest(table, y, weight, seed))
    seeds = _seeds(table, begin, length, evidence.worth(*chosen))
    rng = np.random.default_rng(seed)
    unseen = rng.random(len(texts)) < 0.2  # left to calibration
    unseen &= all(0 < y[m].sum() < m.sum() for m in (unseen, ~unseen))
    judged = unseen if unseen.any() else ~unseen
    net = Network(len(words), len(grams), seed)
    net.p["word"][1:, 0], net.p["gram"][1:, 0] = odds, godds
    wi, gi = words.find(table.word), grams.find(table.gram)
    indexed = Rows(gi, table.owner, len(table.word))
    adam, model = Adam(net.p, 0.01), Model(words, grams, net, 1.0, 0.0)
    learnt, clean = ~unseen[text], np.flatnonzero((y[text] == 0) & ~unseen[text])
    for epoch in range(epochs):
        if epoch:
            rows = net.embed(wi, gi, table.owner)
            for at in range(0, len(text), 2048):
                seeds[at : at + 2048] = net.forward(rows, *_places(table.place, begin[at : at + 2048], length[at : at + 2048]))
        ranked = np.lexsort((-seeds, text))
        rank = np.arange(len(text)) - np.repeat(np.flatnonzero(np.diff(text[ranked], prepend=-1)), np.unique(text, return_counts=True)[1])
        best = ranked[(rank < 1) & learnt[ranked]]
        others = ranked[(rank >= 1) & (rank < 3) & learnt[ranked]]
        others = np.concatenate([others[y[text[others]] == 0], rng.choice(clean, len(texts) // 2)])
        picked = rng.permutation(np.concatenate([best, others]))
        for at in range(0, len(picked), 256):
            part = picked[at : at + 256]
            places, mask = _places(table.place, begin[part], length[part])
            used, local = np.unique(places, return_inverse=True)
            local = local.reshape(places.shape)
            own, owner = indexed.of(used)
            rows = net.embed(wi[used], own, owner)
            logit, state = net.forward(rows, local, mask, keep=True)
            d = ((sigmoid(logit) - y[text[part]]) / len(part)).astype(np.float32)
            g, drows = net.backward(rows, local, mask, state, d)
            g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(g["word"], wi[used], drows[:, :EMBED])
            np.add.at(g["gram"], own, drows[owner][:, EMBED:])
            g["word"][0] = g["gram"][0] = 0
            adam.step(g)
    rows = net.embed(wi, gi, table.owner)
    for at in range(0, len(text), 2048):
        seeds[at : at + 2048] = net.forward(rows, *_places(table.place, begin[at : at + 2048], length[at : at + 2048]))
    highest = np.maximum.reduceat(seeds, firsts)
    model.scale, model.shift = calibrate(highest[judged], y[judged], weight[judged], shift=True)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model | None:
    sample = training_sample(docs, labels, label, key, text).where(F.octet_length("text") <= SAMPLE_BYTES).orderBy("doc_id").toArrow()
    return train(sample["text"].to_pylist(), sample["label"].to_numpy(), sample["weight"].to_numpy())


def scored(docs: DataFrame, model: Model | None, text: str, carry: list[str], name: str = "score") -> DataFrame:
    """Columns carry of docs and the score."""
    schema = docs.select(*carry).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            scores = np.zeros(len(texts))
            if model is not None:
                for a, b in in_slices([t or "" for t in texts], SLICE):
                    scores[a:b] = model.scores(texts[a:b])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*carry, name])

    return docs.select(*carry, F.col(text).alias("__scored")).mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted, a row per document."""
    out = scored(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), fit(docs, labels, label, key, text), "text", ["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those whose score reaches the threshold; columns as they were."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    model = fit(docs, labels, "toxic", key, text)
    left = scored(docs.toDF(*names.values()), model, names[text], list(names.values()), "__score").where(F.col("__score") < threshold)
    return left.select(*[F.col(n).alias(c) for c, n in names.items()])
