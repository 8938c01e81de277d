"""Personal data: base patterns, and candidates that boosted trees accept on top of them.

Base spans follow fixed patterns with checks (octets, Luhn, digit counts) and always stay.
High-recall generators propose further, overlapping spans that the base patterns miss
(written-out mail and network addresses, numbers without a plus sign or with other
separators). Gradient boosted trees judge them by format and context; a threshold calibrated
for precision on unseen candidates selects, and of overlapping selections the likeliest stays.

The trees learn from a bounded sample of the documents' own base spans: those, and
rewritten forms of them that the base patterns miss, are positives. Negatives are forms that
are known to be wrong, put where a base span stands: broken check digits, parts over 255,
dates, amounts and other numbers, places and sites after "at". What the generators propose
elsewhere in the sample is not labelled, so it neither trains nor calibrates: a corpus with
many written-out addresses doesn't teach that these are none.

Defined cases: null or empty text has no spans; places are code points; repeated rows give
equal rows; without any base span in the sample nothing is added; an empty table gives an
empty result; other columns are ignored (`find_personal_data`) or carried (`redact`). All
patterns and comparisons take time in proportion to a text's length.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .learning import sigmoid

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, SAMPLE_SPANS = 3000, 16  # the bounds of the sample that the trees are fitted on: documents, and base spans of each
TREES, DEPTH, BINS, RATE, LEAF_ROWS = 40, 3, 24, 0.2, 10
PRECISION = 0.98
#: What stands for personal data of a kind and is none.
WRONG = {
    "email": ("look at www.example.org", "open at 10.30", "seen at the.end", "only at shop.example.com", "at home.Then", "one at 3.5"),
    "ip": ("1[.]2 dot 3.4", "10 . 20 . 300 . 40", "400.1.1.1", "2.10.2023 . 5", "1 . 000 . 000 . 00", "3.14.15.926"),
    "phone": ("2023-11-05 14", "2021-03-12 09.30", "12.03.2021 09", "05/11/2023 16.45", "1.2.3 2024-01-02 10", "1.000.000.000", "3.1415926535", "1999-2004 2010-2015", "978-3-16-148410-0", "20231105143000", "10/20/30/40/50"),
}
LEAST = 0.9  # no threshold is lower

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9.]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TELLING = re.compile("[0-9@]")
_DIGITS = re.compile("[0-9]+")
_SPELLED = re.compile(r"(?: at | ?[(\[]at[)\]] ?|@)[A-Za-z0-9-]+(?:(?: dot |\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?: dot | ?\. ?|[(\[](?:\.|dot)[)\]])[0-9]{1,3}){3}(?![0-9])")
_NUMBERS = re.compile(r"[0-9](?:[\x20()./_-]{0,3}[0-9]){7,}")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def _is_byte(digits: str) -> bool:
    short = digits.lstrip("0")  # Python converts no more than some thousand digits
    return len(short) <= 3 and int(short or "0") <= 255


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _addresses(text: str) -> Iterator[Span]:
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, place = [], run.start()
        for part in run.group().split("."):
            parts.append((place, part))
            place += len(part) + 1
        i = 0
        while i + 3 < len(parts):
            four = parts[i : i + 4]
            if all(p for _, p in four):
                if all(_is_byte(p) for _, p in four):
                    yield "ip", four[0][0], four[3][0] + len(four[3][1])
                i += 4
            else:
                i += 1


def base_spans(text: str) -> list[Span]:
    """The base spans, by start, then kind."""
    if not _TELLING.search(text):
        return []
    found = [*_emails(text), *_addresses(text)]
    for m in _CARD.finditer(text):
        if 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_digits(m.group())) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def proposals(text: str) -> list[Span]:
    """Spans that may be personal data; kinds overlap."""
    found: set[Span] = set()
    for m in _SPELLED.finditer(text) if "at" in text or "@" in text else ():
        start = m.start()
        while start and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.add(("email", start, m.end()))
    found.update(("ip", *m.span()) for m in _QUAD.finditer(text))
    for m in _NUMBERS.finditer(text):
        n = len(_digits(m.group()))
        start = m.start() - (m.start() > 0 and text[m.start() - 1] in "(+")
        if 9 <= n <= 15:
            found.add(("phone", start, m.end()))
        if 13 <= n <= 19:
            found.add(("card", m.start(), m.end()))
    return sorted(found)


_WORDS = {"email": ("mail", "contact", "write", "@"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "pay", "credit"), "phone": ("tel", "phone", "call", "fax")}
N_FEATURES = 20


def features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - 24) : a].lower(), text[b : b + 12].lower()
    d = _digits(s)
    groups = _DIGITS.findall(s)
    right = 2.0 if kind not in ("card", "ip") else float(luhn(d) if kind == "card" else all(map(_is_byte, groups)))
    last = re.split(r"[^A-Za-z]+", s)[-1]
    return [
        KINDS.index(kind), len(s), len(d), len(d) / max(1, len(s)), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), len(groups[-1]) if groups else 0,
        right, float(s[:1] == "+"), s.count("(") + s.count("["), s.count("-"), s.count(" "), s.count("."), float("@" in s), len(last),
        float(bool(before) and before[-1].isalnum()), float(bool(after) and (after[0].isalnum() or after[0] in "=:_")), float(any(w in before for w in _WORDS[kind])), (float(len(set(d)) <= 2) if kind != "email" else 2.0),
    ]


def rewritten(text: str, span: Span, choice: int) -> tuple[str, Span]:
    """text with a base span in a form that the base patterns miss."""
    kind, a, b = span
    s = text[a:b]
    if kind == "email":
        at, dot = ((" at ", " dot "), (" (at) ", "."), ("[at]", "[dot]"), (" at ", "."))[choice % 4]
        new = s.replace("@", at).replace(".", dot) if choice % 2 == 0 else s.replace("@", at)
    elif kind == "phone":
        new = (s[1:], s[1:].replace(" ", "-"), s[1:].replace("(", "").replace(")", ""), s[1:].replace("-", "."))[choice % 4].lstrip()
    elif kind == "card":
        d = _digits(s)
        new = ("/", "_", " - ", ".")[choice % 4].join(d[i : i + 4] for i in range(0, len(d), 4))
    else:
        new = s.replace(".", ("[.]", " dot ", "(.)", " . ")[choice % 4])
    return text[:a] + new + text[b:], (kind, a, a + len(new))


def wrong_forms(text: str, span: Span) -> Iterator[tuple[str, Span]]:
    """text with something that is none in place of a base span."""
    kind, a, b = span
    if kind == "card":  # the same forms with a wrong check digit
        broken = text[: b - 1] + str((int(text[b - 1]) + 1) % 10) + text[b:]
        yield broken, span
        yield from (rewritten(broken, span, c) for c in range(4))
    if kind == "ip":  # the same forms with a part over 255
        rest = text[a + text[a:b].index(".") : b]
        yield from (rewritten(f"{text[:a]}391{rest}{text[b:]}", (kind, a, a + 3 + len(rest)), c) for c in range(4))
    for other in WRONG.get(kind, ()):
        yield text[:a] + other + text[b:], (kind, a, a + len(other))


@dataclass
class Trees:
    """Boosted trees of one depth over binned features."""

    cuts: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)  # per tree, of its inner nodes in breadth-first order
    bin: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out, rows = np.full(len(b), self.start), np.arange(len(b))
        for f, c, leaf in zip(self.feature, self.bin, self.leaf, strict=True):
            node = np.zeros(len(b), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, f[node]] > c[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    def chances(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.logits(x) + self.shift)


def boost(x: np.ndarray, y: np.ndarray, seed: int = 2) -> Trees | None:
    """Trees, calibrated on a fifth that they haven't seen, with a threshold for PRECISION there."""
    from .learning import calibrate

    if len(y) < 20 or y.min() == y.max():
        return None
    unseen = np.random.default_rng(seed).random(len(y)) < 0.2
    t = Trees([np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x[~unseen].T])
    b, z = t.binned(x[~unseen]), y[~unseen]
    t.start = float(np.log((z.sum() + 1) / (len(z) - z.sum() + 1)))
    f = np.full(len(z), t.start)
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = sigmoid(f)
        g, h = p - z, p * (1 - p)
        node = np.zeros(len(z), np.int64)
        feature, cut_at, leaf = np.zeros(inner, np.int64), np.full(inner, BINS + 1), np.zeros(2**DEPTH)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            for j in range(b.shape[1]):
                key = (node - first) * (BINS + 1) + b[:, j]
                gs, hs = (np.cumsum(np.bincount(key, v, width * (BINS + 1)).reshape(width, -1), axis=1) for v in (g, h))
                ns = np.cumsum(np.bincount(key, minlength=width * (BINS + 1)).reshape(width, -1), axis=1)
                gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                gain[(ns < LEAF_ROWS) | (ns[:, -1:] - ns < LEAF_ROWS)] = 0  # single spans that only look negative decide nothing
                top = gain.argmax(axis=1)
                better = gain[np.arange(width), top] > best + 1e-9
                best = np.where(better, gain[np.arange(width), top], best)
                feature[first : first + width][better] = j
                cut_at[first : first + width][better] = top[better]
            node = 2 * node + 1 + (b[np.arange(len(z)), feature[node]] > cut_at[node])
        at = node - inner
        leaf = -RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + 1)
        f += leaf[at]
        t.feature.append(feature)
        t.bin.append(cut_at)
        t.leaf.append(leaf)
    t.scale, t.shift = calibrate(t.logits(x[unseen]), y[unseen], np.ones(unseen.sum()), shift=True)
    p = t.chances(x[unseen])
    order = np.argsort(-p)
    right = np.cumsum(y[unseen][order]) / (np.arange(len(order)) + 1)
    good = np.flatnonzero(right >= PRECISION)
    t.threshold = max(LEAST, float(p[order][good[-1]])) if len(good) else 2.0
    return t


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Trees | None:
    bounded_batches(docs.sparkSession)
    telling = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("h"), F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]"))
    least = telling.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS)  # hashes alone meet in one task
    sample = telling.join(F.broadcast(least), "h", "left_semi").dropDuplicates(["h"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(label, np.array(x)) for t in batch.column(0).to_pylist() for label, x in examples(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].tobytes() for r in rows], pa.binary())], names=["label", "x"])

    rows = sample.select("text").mapInArrow(learn, "label int, x binary").orderBy("x", "label").toArrow()
    x = np.frombuffer(b"".join(rows["x"].to_pylist())).reshape(len(rows), N_FEATURES)
    return boost(x, rows["label"].to_numpy().astype(np.float64))


def examples(text: str) -> Iterator[tuple[int, list[float]]]:
    """What SAMPLE_SPANS base spans of text teach, evenly over it."""
    base = base_spans(text)
    for span in base[:: max(1, -(-len(base) // SAMPLE_SPANS))]:
        near = max(0, span[1] - 64)
        own = text[near : span[2] + 64]  # features look no further
        span = (span[0], span[1] - near, span[2] - near)
        for form in ((own, span), *(rewritten(own, span, c) for c in range(4))):
            yield 1, features(*form)
        for form in wrong_forms(own, span):
            yield 0, features(*form)


class Taken:
    """Spans by place, to ask which others they meet."""

    def __init__(self, spans: list[Span]):
        spans = sorted(s[1:] for s in spans)
        self.starts, self.ends, last = [s for s, _ in spans], [], 0
        for _, e in spans:
            self.ends.append(last := max(last, e))

    def meets(self, span: Span) -> bool:
        before = bisect.bisect_left(self.starts, span[2])  # those that begin before span's end
        return before > 0 and self.ends[before - 1] > span[1]

    def add(self, span: Span) -> None:
        """span, which meets none."""
        at = bisect.bisect(self.starts, span[1])
        self.starts.insert(at, span[1])
        self.ends.insert(at, span[2])


def all_spans(text: str, trees: Trees | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, each by start, then kind."""
    base = base_spans(text)
    taken = Taken(base)
    open_ = [s for s in proposals(text) if not taken.meets(s)] if trees else []
    if not open_:
        return base, base
    chances = trees.chances(np.array([features(text, s) for s in open_]))
    chosen, taken = [], Taken([])
    for i in np.argsort(-chances, kind="stable").tolist():
        if chances[i] >= trees.threshold and not taken.meets(open_[i]):
            chosen.append(open_[i])
            taken.add(open_[i])
    return base, sorted([*base, *chosen], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str, spans: list[Span]) -> str:
    """text with every run of overlapping spans replaced by the kind of its first."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the personal data in their texts replaced by its kind; columns as they were, a null text stays null."""
    trees = fit(docs, key, text)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else redacted(t, all_spans(t, trees)[1]))

    return docs.withColumn(text, clean(F.col(text)))


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end), a row per document."""
    trees = fit(docs, key, text)
    kind = "array<struct<kind:string,start:long,end:long>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t or "", trees) for t in batch.column(1).to_pylist()]
            columns = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f[i]] for f in found], arrow) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "base", "spans"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def pii_digest(found: DataFrame) -> DataFrame:
    def joined(c: str):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
