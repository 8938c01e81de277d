"""Removal of repeated byte strings across documents by a hash-compared suffix sort.

A byte goes if some 50-byte string covering it also starts in a document with a smaller
identifier. Every 50-byte window is assigned to its minimizer, an 18-byte anchor, and equal
windows have equal anchors at equal offsets, so the corpus falls into buckets by anchor:

1. documents are packed into compressed blocks, CHUNK of which are a chunk; a task looks a
   chunk through for anchors that several documents have, and tells these to their buckets
   once for all of them; of the others it tells each bucket in one row which the chunk's
   blocks have (five bytes each), and learns which of them other documents have too;
2. of those, each block gives the bytes around each anchor that its windows need, once for
   every different context; what a chunk's blocks have for one bucket goes in one row;
3. a bucket folds equal contexts, tested byte by byte, and sorts the suffixes of the different
   ones at the window starts: a mergesort that merges by ranking, where comparing two suffixes
   means finding their common extension by binary search over prefix polynomial hashes;
   suffixes equal over 50 bytes are verified byte by byte and become one class with its
   smallest identifier;
4. a bit per window goes back to the chunks, whose blocks mark and remove in their order.

Rows are exchanged between chunks and buckets, not blocks and buckets, as their number grows
with the product of both. Hot passages stay cheap: in the first step they take a row per chunk,
a block gives equal contexts once, a bucket sorts them once, and the merge folds equal suffixes
as it goes. Nothing is proportional to the square of a group. Where the contexts of a
bucket are too many for a task (HOT anchors), the blocks are dealt into parts; each part sorts
its own contexts and passes on one window of every class, which is dealt by its own hash and
sorted again, so neither a passage nor an anchor that is in every document meets in one task
more often than there are parts.

Defined cases: null text counts as empty; texts under 50 bytes lose nothing; rows with
equal identifiers don't remove from each other; a null identifier counts as larger than
any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions
from .hashing import mix, powers, prefix_hashes, substring_hashes

SPAN = 50
ANCHOR = 26
BLOCK_BYTES = 1 << 20
BUCKET_BYTES = 6 << 20  # text bytes a bucket stands for at most
HOT = 500_000  # anchors shared by documents, with those of every block counted, that one task sorts
CHUNK = 32  # blocks that a task looks through together for anchors they share
GROUP = 12 << 20  # windows that blocks of a chunk send together at most, and a twelfth of them to one bucket
TILE = 1 << 15  # places whose hashes stay in the cache
SLICE = 1 << 17  # windows that are sorted together at most, but for those of one anchor
NO_ID = np.iinfo(np.int64).max
PLACES = (1 << 32) - 1  # of a block's number: its place in its partition
COMPRESSOR, DECOMPRESSOR = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(a.tobytes()) for a in arrays], "<i8")
    return COMPRESSOR.compress(sizes.tobytes() + b"".join(a.tobytes() for a in arrays))


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = DECOMPRESSOR.decompress(data)
    sizes = np.frombuffer(raw, "<i8", len(kinds))
    ends = np.cumsum(sizes) + 8 * len(kinds)
    return [np.frombuffer(raw, k, n // np.dtype(k).itemsize, e - n) for k, n, e in zip(kinds, sizes.tolist(), ends.tolist(), strict=True)]


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(block_id, blob): identifiers, null flags, lengths and bytes of some documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def out() -> pa.RecordBatch:
            known = np.array([NO_ID if i is None else i for i in ids], np.int64)
            null = np.array([i is None for i in ids], np.uint8)
            blob = _pack(known, null, np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([blob], pa.binary())], names=["block_id", "blob"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (t or "").encode()
                if size and size + len(data) > BLOCK_BYTES:
                    yield out()
                    block, ids, texts, size = block + 1, [], [], 0
                ids.append(i)
                texts.append(data)
                size += len(data)
        if ids:
            yield out()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "block_id long, blob binary")


def _minimizers(hashes: np.ndarray, w: int) -> np.ndarray:
    """For every run of w hashes the place of its least, the first of equals (by their upper 40 bits)."""
    places = np.uint64((1 << 24) - 1)
    if len(hashes) <= 1 << 24:  # hash and place in one number
        least, have = (hashes & ~places) | np.arange(len(hashes), dtype=np.uint64), 1
        while have < w:
            step = min(have, w - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        return (least & places).astype(np.int64)
    least, at, have = hashes & ~places, np.arange(len(hashes)), 1
    while have < w:
        step = min(have, w - have)
        right = least[step:] < least[:-step]
        at, least = np.where(right, at[step:], at[:-step]), np.where(right, least[step:], least[:-step])
        have += step
    return at


class Block:
    """A block's documents, its windows' anchors and their contexts."""

    def __init__(self, blob: bytes, span: int = SPAN, k: int = ANCHOR):
        self.ids, self.null, self.lengths, self.data = _unpack(blob, "<i8", "u1", "<i8", "u1")
        self.span, n, w = span, len(self.data), span - k + 1
        self.ends = np.cumsum(self.lengths)
        self.prefix = prefix_hashes(self.data)
        none = np.zeros(0, np.int64)
        self.first = self.last = self.anchor = self.doc = none
        self.hash = np.zeros(0, np.uint64)
        if n < span:
            return
        at, inverse = np.empty(n - span + 1, np.int32 if n < 1 << 31 else np.int64), powers(n, True)
        for a in range(0, len(at), TILE):
            b = min(a + TILE, len(at))
            c = b + w - 1
            at[a:b] = _minimizers(mix((self.prefix[a + k : c + k] - self.prefix[a:c]) * inverse[a:c]), w) + a
        fits = np.ones(n, bool)
        over = (self.ends[:, None] - np.arange(1, span)).ravel()  # windows that would cross their document's end
        fits[over[over >= 0]] = False
        fits, moved = fits[: len(at)], at[1:] != at[:-1]
        self.first = np.flatnonzero(fits & np.concatenate([[True], moved | ~fits[:-1]]))  # an anchor's windows start at first..last
        self.last = np.flatnonzero(fits & np.concatenate([moved | ~fits[1:], [True]]))
        self.anchor, self.doc = at[self.first].astype(np.int64), np.searchsorted(self.ends, self.first, "right")
        self.hash = mix(substring_hashes(self.prefix, self.anchor, self.anchor + k))

    def told(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different anchors by hash: five-byte prints without the bucket's bits and the flag, buckets, several documents?, and each anchor's place here."""
        kinds, place = np.unique(self.hash, return_inverse=True)
        low, high = np.full(len(kinds), NO_ID), np.full(len(kinds), -1)
        np.minimum.at(low, place, self.doc)
        np.maximum.at(high, place, self.doc)
        even = mix(kinds + np.uint64(0x5851F42D4C957F2D))  # minimizers are small hashes, buckets want even ones
        bucket = (even >> np.uint64(64 - bits)).astype(np.int64)
        return (even << np.uint64(bits)) >> np.uint64(25), bucket, low != high, place

    def contexts(self, shared: np.ndarray):
        """Of anchors (by index) the different contexts: representative anchors, smallest identifier, and each anchor's place."""
        a = shared
        start, end = self.first[a], self.last[a] + self.span
        h = substring_hashes(self.prefix, start, end)
        print_ = mix(h + mix((self.anchor[a] - start).astype(np.uint64) * np.uint64(4096) + (end - start).astype(np.uint64)))
        kinds, rep, place = np.unique(print_, return_index=True, return_inverse=True)
        _test_folded(self.data, start, end - start, rep, place, self.span)
        low = np.full(len(kinds), NO_ID)
        np.minimum.at(low, place, self.ids[self.doc[a]])
        return a[rep], low, place


def _test_equal(data: np.ndarray, x: np.ndarray, y: np.ndarray, span: int) -> None:
    """Strings of span bytes that have one hash must be equal."""
    rows = np.lib.stride_tricks.sliding_window_view(data, span) if len(x) else data
    for at in range(0, len(x), 50_000):
        if not (rows[x[at : at + 50_000]] == rows[y[at : at + 50_000]]).all():
            raise ArithmeticError("two different strings have one 64-bit hash; choose another hash base")


def _test_folded(data: np.ndarray, start: np.ndarray, length: np.ndarray, rep: np.ndarray, place: np.ndarray, span: int) -> None:
    """Contexts (of span to twice span bytes) must equal the ones that stand for them."""
    again = np.flatnonzero(rep[place] != np.arange(len(place)))
    one = rep[place[again]]
    if (length[again] != length[one]).any():
        raise ArithmeticError("two contexts have one 64-bit hash; choose another hash base")
    rest = length[again] - span
    _test_equal(data, start[again], start[one], span)
    _test_equal(data, start[again] + rest, start[one] + rest, span)


def _in_order(buckets: np.ndarray) -> np.ndarray:
    """Stable; numbers of two bytes are sorted by their digits."""
    return np.argsort(buckets.astype(np.uint16) if buckets.max(initial=0) < 1 << 16 else buckets, kind="stable")


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(buckets):
        return
    order = _in_order(buckets)
    sorted_ = buckets[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    for b, start, end in zip(sorted_[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        yield b, order[start:end]


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each length."""
    before = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Suffixes:
    """Suffixes of data compared over span bytes by prefix hashes."""

    def __init__(self, data: np.ndarray, span: int):
        self.data, self.span, self.prefix = data, span, prefix_hashes(data)
        self.inverse = powers(len(data) + 1, True)
        self.whole = (self.prefix[span:] - self.prefix[:-span]) * self.inverse[: max(0, len(data) - span + 1)]

    def hashes(self, x: np.ndarray, n) -> np.ndarray:
        return (self.prefix[x + n] - self.prefix[x]) * self.inverse[x]

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes x and y, up to span, by binary search."""
        out = np.full(len(x), self.span)
        open_ = np.flatnonzero(self.whole[x] != self.whole[y])
        x, y = x[open_], y[open_]
        of_x, of_y, by_x, by_y = self.prefix[x], self.prefix[y], self.inverse[x], self.inverse[y]
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.span - 1)
        for _ in range((self.span - 1).bit_length()):  # as many steps for all
            middle = (low + high + 1) >> 1
            same = (self.prefix[x + middle] - of_x) * by_x == (self.prefix[y + middle] - of_y) * by_y
            low = np.where(same, middle, low)
            high = np.where(same, high, np.maximum(middle - 1, low))
        out[open_] = low
        return out

    def less(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether x < y, and whether they are equal over span bytes."""
        n = self.extension(x, y)
        equal = n == self.span
        off = np.where(equal, 0, n)
        return ~equal & (self.data[x + off] < self.data[y + off]), equal

    def classes(self, x: np.ndarray, group: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The least value of each suffix's class of equal suffixes; group (sorted): only those of one group can be equal.

        A bottom-up mergesort in every group at once. Each level ranks the suffixes of the
        right runs within the left ones; equal suffixes fold into one.
        """
        least, into = value.copy(), np.arange(len(x))
        order = np.arange(len(x))
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(x) else order
        run = order - np.repeat(starts, np.diff(np.append(starts, len(x))))  # place in the group
        while len(order):
            g = group[order]
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            busy = np.repeat(np.maximum.reduceat(run, starts) > 0, np.diff(np.append(starts, len(order))))  # of several runs yet
            order, run, g = order[busy], run[busy], g[busy]
            if not len(order):
                break
            head = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (run[1:] != run[:-1])]))
            which = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
            tail = np.append(head[1:], len(order))
            right = np.flatnonzero(run & 1)  # its partner, the left run, stands just before
            low, high = head[which[right] - 1], tail[which[right] - 1]
            alike = np.zeros(len(right), bool)  # equal to the suffix at high
            while len(open_ := np.flatnonzero(low < high)):
                middle = (low[open_] + high[open_]) // 2
                before, equal = self.less(x[order[middle]], x[order[right[open_]]])
                low[open_[before]] = middle[before] + 1
                high[open_[~before]], alike[open_[~before]] = middle[~before], equal[~before]
            gone = np.flatnonzero(alike)
            a, b = order[low[gone]], order[right[gone]]
            self.verify(x[a], x[b])
            np.minimum.at(least, a, least[b])
            into[b] = a
            place = np.arange(len(order)) * 2 + 1
            place[right] = low * 2
            keep = np.ones(len(order), bool)
            keep[right[gone]] = False
            sorted_ = np.argsort(place[keep], kind="stable")
            order, run = order[keep][sorted_], (run >> 1)[keep][sorted_]
        while (moved := into[into] != into).any():
            into[moved] = into[into[moved]]
        return least[into]

    def verify(self, x: np.ndarray, y: np.ndarray) -> None:
        _test_equal(self.data, x, y, self.span)


class Windows:
    """The windows of contexts that several blocks sent; equal contexts are folded, and the windows of the different ones sorted.

    Of the different contexts' windows in order: suffixes s, places x, offsets of the anchor
    back, and the least identifier of each one's class.
    """

    def __init__(self, offset: np.ndarray, windows: np.ndarray, low: np.ndarray, data: np.ndarray, prints: np.ndarray, anchor: np.ndarray, span: int = SPAN):
        self.windows, self.low = windows, low
        length = windows + span - 1
        begin = np.cumsum(length) - length
        kinds, rep, self.place = np.unique(prints, return_index=True, return_inverse=True)
        _test_folded(data, begin, length, rep, self.place, span)
        low = np.full(len(kinds), NO_ID)
        np.minimum.at(low, self.place, self.low)
        n, anchor = windows[rep], anchor[rep]
        self.s = s = Suffixes(data[_ragged(begin[rep], length[rep])], span)
        begin = np.cumsum(length[rep]) - length[rep]
        self.first = np.cumsum(n) - n  # of each different context's windows
        self.x = x = _ragged(begin, n)
        self.back = np.repeat(offset[rep] + begin, n) - x
        _, same, times = np.unique(anchor, return_inverse=True, return_counts=True)
        self.least = np.repeat(low, n)
        open_ = np.flatnonzero(np.repeat(times[same] > 1, n))  # an anchor with one context has nothing to sort
        group = mix(np.repeat(anchor, n)[open_] + mix(self.back[open_].astype(np.uint64)))
        order = np.argsort(group)
        open_ = open_[order]
        self.least[open_] = s.classes(x[open_], group[order], self.least[open_])

    def all(self) -> np.ndarray:
        """For each window of all contexts its place among the windows of the different ones."""
        return _ragged(self.first[self.place], self.windows)

    def smaller(self, all_: np.ndarray) -> np.ndarray:
        """Whether a window equals one of a smaller identifier."""
        return self.least[all_] < np.repeat(self.low, self.windows)


def windows_of(parts: list[list[np.ndarray]], span: int = SPAN, k: int = ANCHOR, most: int = SLICE) -> Iterator[tuple[np.ndarray, Windows]]:
    """Windows of the contexts (offsets of the anchor, windows, smallest identifiers, bytes) of all parts, with these contexts' numbers.

    Contexts of one anchor are together; others are apart, so that what is sorted stays in the
    cache however much a bucket holds.
    """
    offset, windows, low, data = (np.concatenate(c) for c in zip(*parts, strict=True))
    offset, windows = offset.astype(np.int64), windows.astype(np.int64)
    length = windows + span - 1
    begin = np.cumsum(length) - length
    prints, anchor, at, base = np.empty(len(length), np.uint64), np.empty(len(length), np.uint64), 0, 0
    for _, n, _, own in parts:
        mine = slice(at, at + len(n))
        prefix, start = prefix_hashes(own), begin[mine] - base
        prints[mine] = substring_hashes(prefix, start, start + length[mine])
        anchor[mine] = substring_hashes(prefix, start + offset[mine], start + offset[mine] + k)
        at, base = at + len(n), base + len(own)
    prints = mix(prints + mix((offset * 4096 + length).astype(np.uint64)))
    order = np.argsort(anchor, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], anchor[order[1:]] != anchor[order[:-1]]])) if len(order) else order
    before = np.cumsum(windows[order]) - windows[order]
    cuts = head[np.flatnonzero(np.diff(before[head] // most, prepend=-1))]
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        i = order[a:b]
        yield i, Windows(offset[i], windows[i], low[i], data[_ragged(begin[i], length[i])], prints[i], anchor[i], span)


def classes_of(s: Suffixes, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Different windows: one place of each, each window's number among them, and the numbers that go to each of n further buckets."""
    kinds, rep, place = np.unique(mix(s.whole[x]), return_index=True, return_inverse=True)
    s.verify(x, x[rep][place])
    to = (kinds >> np.uint64(20)) % np.uint64(n)
    return rep, place, [np.flatnonzero(to == i) for i in range(n)]


def _rows_by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows that are sorted by their first column, a bucket at a time."""
    now, held = None, []
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() if len(bucket) else []
        for a, b in zip(edges, [*edges[1:], len(bucket)], strict=False):
            if bucket[a] != now:
                if held:
                    yield now, pa.Table.from_batches(held)
                now, held = int(bucket[a]), []
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


ROWS = "bucket long, block_id long, payload binary"


def _answer(found) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True) if found else ((), (), ()), kinds, strict=True)], names=["bucket", "block_id", "payload"])


def _dealt(rows: DataFrame, order: str = "block_id") -> DataFrame:
    n = shuffle_partitions(rows.sparkSession)
    return rows.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).sortWithinPartitions("bucket", order)


def _chunk_of(size: int) -> Column:
    return F.col("block_id") - F.pmod(F.col("block_id").bitwiseAND(F.lit(PLACES)), F.lit(size))


def _to_chunks(stored: DataFrame, told: DataFrame, judged: DataFrame | None, size: int, most: int) -> DataFrame:
    """(chunk, step, block_id, bucket, payload): each chunk's answers of step 1 and 2, then its blocks; most: chunks a partition has at most."""
    rows = stored.select("block_id", F.lit(-1).cast("long").alias("bucket"), F.col("blob").alias("payload"), F.lit(3).alias("step"))
    for step, answers in ((1, told), (2, judged)):
        if answers is not None:
            rows = rows.unionByName(answers.select("block_id", "bucket", "payload", F.lit(step).alias("step")))
    n, chunk = shuffle_partitions(stored.sparkSession), _chunk_of(size)
    number = F.shiftright("block_id", 32) * most + F.floor(F.col("block_id").bitwiseAND(F.lit(PLACES)) / size)
    return rows.select(chunk.alias("chunk"), "step", "block_id", "bucket", "payload", number.alias("number")).repartitionById(n, F.pmod("number", F.lit(n)).cast("int")).drop("number").sortWithinPartitions("chunk", "step", "block_id", "bucket")


class Bits:
    """A chunk's answers of many buckets, whose bits its blocks take in turn."""

    def __init__(self, buckets: int, answers: list[tuple[int, bytes]]):
        size = np.array([8 * len(p) for _, p in answers], np.int64)
        self.flat = np.concatenate([np.unpackbits(np.frombuffer(b"".join(p for _, p in answers), np.uint8)).view(bool), np.zeros(256, bool)])
        self.none = int(size.sum())  # from here on there are zeros, for buckets without an answer
        self.next, self.known = np.full(buckets, self.none), np.zeros(buckets, bool)
        of = np.array([b for b, _ in answers], np.int64)
        self.next[of], self.known[of] = np.cumsum(size) - size, True

    def take(self, bucket: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The next n (up to 256) bits of each bucket named, in the order given."""
        order = _in_order(bucket)
        b, m = bucket[order], n[order]
        before = np.cumsum(m) - m
        head = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else order
        before -= np.repeat(before[head], np.diff(np.append(head, len(b))))
        at = np.empty(len(b), np.int64)
        at[order] = self.next[b] + np.where(self.known[b], before, 0)
        self.next += np.where(self.known, np.bincount(bucket, n, len(self.next)), 0).astype(np.int64)
        return self.flat[_ragged(at, n)]


class Groups:
    """The blocks of a chunk in groups that send their contexts together, each named by its first block."""

    def __init__(self, buckets: int, most: int):
        self.first, self.most, self.held = -1, most, np.zeros(buckets, np.int64)

    def of(self, block_id: int, bucket: np.ndarray, windows: np.ndarray) -> int:
        held = self.held + np.bincount(bucket, windows, len(self.held)).astype(np.int64)
        if self.first < 0 or held.sum() > self.most or held.max() > self.most // 12:
            self.first, held = block_id, held - self.held
        self.held = held
        return self.first


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict[int, list[tuple[int, bytes]]]], Iterator[tuple[int, bytes]]]]:
    """Of each chunk the answers of either step by the block they name, and its blocks, one at a time."""
    rows = ((c, s, i, b, p) for batch in batches for c, s, i, b, p in zip(*(batch.column(j).to_pylist() for j in range(4)), batch.column(4), strict=True))
    for _, mine in groupby(rows, key=lambda r: r[0]):
        answers: list[dict[int, list[tuple[int, bytes]]]] = [{}, {}]
        for _, step, block_id, bucket, payload in mine:
            if step < 3:
                answers[step - 1].setdefault(block_id if bucket >= 0 else bucket, []).append((bucket, payload.as_py()))
                continue
            yield answers, chain([(block_id, payload.as_py())], ((r[2], r[4].as_py()) for r in mine))
            break


def _words(prints: np.ndarray, several: np.ndarray | int) -> np.ndarray:
    """Five bytes for each print and flag."""
    return (prints << np.uint64(1) | np.uint64(several)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def _chunk_rows(chunk: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """What the blocks of a chunk (block_id, prints, buckets, several) tell.

    Each block's bits of the anchors that several documents of the chunk have (under a bucket
    of its own, below 0); these anchors once for the whole chunk (under a block below 0), the
    last word of a row being how often they stand in its blocks; and the blocks' others, one
    block after the other (under the first block).
    """
    keys = [bucket.astype(np.uint64) << np.uint64(39) | prints for _, prints, bucket, _ in chunk]
    kinds, place, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    known = times > 1
    known[place[np.concatenate([several for *_, several in chunk])]] = True
    edges = np.cumsum([0, *map(len, keys)])
    rows, here = [], known[place]
    for (block_id, *_), a, b in zip(chunk, edges[:-1], edges[1:], strict=True):
        if here[a:b].any():
            rows.append((-1 - block_id, block_id, np.packbits(here[a:b]).tobytes()))
    left = np.concatenate(keys)[~here]
    words = _words(left & np.uint64((1 << 39) - 1), 0)
    for k, part in _by_bucket((left >> np.uint64(39)).astype(np.int64)):
        rows.append((k, chunk[0][0], words[part].tobytes()))
    yield _answer(rows)
    kinds, times = kinds[known], times[known]
    words = _words(kinds & np.uint64((1 << 39) - 1), 1)
    rows = []
    for k, part in _by_bucket((kinds >> np.uint64(39)).astype(np.int64)):
        rows.append((k, -1 - chunk[0][0], words[part].tobytes() + int(times[part].sum()).to_bytes(5, "little")))
    yield _answer(rows)


def _shared(block: Block, block_id: int, bits: int, told: dict[int, list[tuple[int, bytes]]], left: Bits) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the anchors that another document has too, and their buckets; left takes the chunk's blocks in their order."""
    _, bucket, _, place = block.told(bits)
    flags = np.zeros(len(bucket), bool)
    for _, own in told.get(-1 - block_id, ()):
        flags = np.unpackbits(np.frombuffer(own, np.uint8), count=len(bucket)).astype(bool)
    rest = np.flatnonzero(~flags)
    flags[rest] = left.take(bucket[rest], np.ones(len(rest), np.int64))
    shared = np.flatnonzero(flags[place])
    return shared, bucket[place[shared]]


def _of_chunk(batches: Iterator[pa.RecordBatch], bits: int, span: int, most: int):
    """(group, answers to the group, block, shared anchors, contexts): every block of every chunk in order."""
    for (told, judged), blobs in _chunks(batches):
        groups, left, given = Groups(1 << bits, most), None, {}
        for block_id, blob in blobs:
            if left is None:
                left = Bits(1 << bits, told.pop(block_id, []))
            block = Block(blob, span)
            shared, bucket = _shared(block, block_id, bits, told, left)
            a, low, place = block.contexts(shared)
            where = np.empty(len(a), np.int64)
            where[place] = bucket
            windows = block.last[a] - block.first[a] + 1
            group = groups.of(block_id, where, windows)
            if group not in given:
                given = {group: Bits(1 << bits, judged.pop(group, []))}
            yield group, given[group], block, shared, (a, low, place, where, windows)


def _sent(group: int, held: list[tuple[np.ndarray, ...]], span: int) -> pa.RecordBatch:
    """A group's contexts (buckets, offsets of the anchor, windows, smallest identifiers, bytes), a row a bucket."""
    where, offset, windows, low, data = (np.concatenate(c) for c in zip(*held, strict=True))
    length = windows + span - 1
    begin = np.cumsum(length) - length
    rows = []
    for b, part in _by_bucket(where):
        rows.append((b, group, _pack(offset[part].astype(np.uint8), windows[part].astype(np.uint8), low[part], data[_ragged(begin[part], length[part])])))
    return _answer(rows)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes), n_removed and n_spans, a row per document."""
    spark = docs.sparkSession
    stored = cut(blocks(docs, key, text))
    n_blocks, last = stored.agg(F.count("*"), F.max(F.col("block_id").bitwiseAND(F.lit(PLACES)))).first()
    size, group, most = CHUNK, GROUP, (last or 0) // CHUNK + 1
    bits = max(1, (max(shuffle_partitions(spark), -(-n_blocks * BLOCK_BYTES // BUCKET_BYTES)) - 1).bit_length())

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = ((i, blob) for batch in batches for i, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for _, mine in groupby(blobs, key=lambda r: r[0] - (r[0] & PLACES) % size):
            yield from _chunk_rows([(i, *Block(blob.as_py(), span).told(bits)[:3]) for i, blob in mine])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _rows_by_bucket(batches):
            if bucket < 0:  # what a block knows already
                yield pa.RecordBatch.from_arrays([*rows.combine_chunks().to_batches()[0].columns, pa.array([0], pa.int64())], names=["bucket", "block_id", "payload", "n"])
                continue
            ids, payload = rows.column(1).to_numpy(), rows.column(2).combine_chunks()
            ends = np.frombuffer(payload.buffers()[1], np.int32)[payload.offset : payload.offset + len(payload) + 1].astype(np.int64)
            words = np.zeros(((ends[-1] - ends[0]) // 5, 8), np.uint8)
            words[:, :5] = np.frombuffer(payload.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, 5)
            words = words.view("<u8").ravel()
            ends = (ends - ends[0]) // 5
            chunks = np.flatnonzero(ids < 0)
            known = int(words[ends[chunks + 1] - 1].sum())
            if known:
                yield pa.RecordBatch.from_arrays([*_answer([(bucket, -1, b"")]).columns, pa.array([known], pa.int64())], names=["bucket", "block_id", "payload", "n"])
            words[ends[chunks + 1] - 1] = np.uint64((1 << 40) - 1)  # the counts stand for no anchor
            kinds, place, times = np.unique(words >> np.uint64(1), return_inverse=True, return_counts=True)
            several = times > 1
            several[place[(words & np.uint64(1)).astype(bool)]] = True
            found = several[place]
            for at in range(0, len(ids), 10_000):
                mine = [(i, found[a:b]) for i, a, b in zip(ids[at : at + 10_000].tolist(), ends[at:-1].tolist(), ends[at + 1 :].tolist(), strict=False)]
                out = [(bucket, i, np.packbits(f).tobytes(), int(f.sum())) for i, f in mine if i >= 0 and f.any()]
                yield pa.RecordBatch.from_arrays([*_answer([r[:3] for r in out]).columns, pa.array([r[3] for r in out], pa.int64())], names=["bucket", "block_id", "payload", "n"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        now = -1
        for of, _, block, _, (a, low, _, where, windows) in _of_chunk(batches, bits, span, group):
            if of != now and held:
                yield _sent(now, held, span)
                held = []
            now = of
            if len(a):
                first = block.first[a]
                held.append((where, block.anchor[a] - first, windows, low, block.data[_ragged(first, windows + span - 1)]))
        if held:
            yield _sent(now, held, span)

    def contexts(rows: pa.Table) -> list[list[np.ndarray]]:
        return [_unpack(p, "u1", "u1", "<i8", "u1") for p in rows.column(2).to_pylist()]

    def told_back(bucket: int, ids: list[int], parts: list[list[np.ndarray]], answers: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        n = np.concatenate([p[1] for p in parts]).astype(np.int64)
        first, found = np.cumsum(n) - n, np.zeros(int(n.sum()), bool)
        for i, smaller in answers:  # of some contexts
            found[_ragged(first[i], n[i])] = smaller
        ends = np.cumsum([int(p[1].sum(dtype=np.int64)) for p in parts])
        return _answer([(bucket, i, np.packbits(f).tobytes()) for i, f in zip(ids, np.split(found, ends[:-1]), strict=True)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _rows_by_bucket(batches):
            parts = contexts(rows)
            yield told_back(bucket, rows.column(1).to_pylist(), parts, ((i, w.smaller(w.all())) for i, w in windows_of(parts, span)))

    # a hot bucket's part is a bucket of its own; its windows go on to others, by their hash
    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _rows_by_bucket(batches):
            ((_, w),) = windows_of(contexts(rows), span, most=NO_ID)
            first = rows.column(3)[0].as_py()
            rep, _, dealt = classes_of(w.s, w.x, rows.column(4)[0].as_py())
            for i, mine in enumerate(dealt):
                if len(mine):
                    at = rep[mine]
                    data = w.s.data[_ragged(w.x[at], np.full(len(at), span))]
                    yield _answer([(first + i, part, _pack(w.back[at].astype(np.uint8), np.ones(len(at), np.uint8), w.least[at], data))])

    def take_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _rows_by_bucket(batches):
            kind = rows.column("answer").to_numpy(zero_copy_only=False)
            answers, rows = rows.filter(pa.array(kind)), rows.filter(pa.array(~kind))
            given = dict(zip(answers.column(1).to_pylist(), answers.column(2).to_pylist(), strict=True))
            parts = contexts(rows)
            ((of, w),) = windows_of(parts, span, most=NO_ID)
            first = rows.column(3)[0].as_py()
            rep, place, dealt = classes_of(w.s, w.x, rows.column(4)[0].as_py())
            smaller = np.zeros(len(rep), bool)
            for i, mine in enumerate(dealt):
                if len(mine):
                    smaller[mine] = np.unpackbits(np.frombuffer(given[first + i], np.uint8), count=len(mine)).astype(bool)
            yield told_back(rows.column("home")[0].as_py(), rows.column(1).to_pylist(), parts, iter([(of, w.smaller(all_ := w.all()) | smaller[place[all_]])]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, given, block, shared, (_, low, place, where, windows) in _of_chunk(batches, bits, span, group):
            if not given.known[where].all():
                raise LookupError("a bucket has not answered for all contexts that it was sent")
            yield _removed(block, shared, low, place, windows, given.take(where, windows), span)

    answered = cut(_dealt(stored.mapInArrow(tell, ROWS)).mapInArrow(ask, f"{ROWS}, n long"))
    told = answered.where("block_id >= 0")
    sent = _to_chunks(stored, told, None, size, most).mapInArrow(send, ROWS)
    sizes = answered.where("bucket >= 0").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > HOT)
    if sizes.limit(1).count():
        parts = F.ceil(F.col("n") * 2 / HOT)
        first = F.xxhash64("bucket", F.lit(0)).bitwiseAND(F.lit((1 << 40) - 1)) * (1 << 20) + (1 << 60)  # apart from the buckets themselves
        hot = cut(sizes.select("bucket", first.alias("first"), parts.alias("parts")))
        part = F.xxhash64("bucket", F.pmod(F.xxhash64("block_id"), F.col("parts")))
        asked = cut(sent.join(hot, "bucket").select(part.alias("bucket"), "block_id", "payload", "first", "parts", F.col("bucket").alias("home"), F.lit(False).alias("answer")))
        passed = _dealt(asked).mapInArrow(pass_on, ROWS)
        answers = _dealt(passed).mapInArrow(judge, ROWS)
        back = answers.select(F.col("block_id").alias("bucket"), F.col("bucket").alias("block_id"), "payload", *[F.lit(None).cast("long").alias(c) for c in ("first", "parts", "home")], F.lit(True).alias("answer"))
        returned = _dealt(asked.unionByName(back)).mapInArrow(take_back, ROWS)
        judged = _dealt(sent.join(hot, "bucket", "left_anti")).mapInArrow(judge, ROWS).unionByName(returned)
    else:
        judged = _dealt(sent).mapInArrow(judge, ROWS)
    both = _to_chunks(stored, told, judged, size, most)
    return both.mapInArrow(remove, "doc_id long, n_bytes long, kept binary, n_removed long, n_spans long")


def _removed(block: Block, shared: np.ndarray, low: np.ndarray, place: np.ndarray, windows: np.ndarray, found: np.ndarray, span: int) -> pa.RecordBatch:
    """A block's documents without repeats; found: a bit for each window of its contexts."""
    begin = np.cumsum(windows) - windows
    n = windows[place]  # the windows of all anchors with these contexts
    smaller = np.repeat(block.ids[block.doc[shared]] > low[place], n) | found[_ragged(begin[place], n)]
    starts = _ragged(block.first[shared], n)[smaller]
    latest = np.full(len(block.data), -span)
    latest[starts] = starts
    gone = np.arange(len(block.data)) - np.maximum.accumulate(latest) < span
    ends = block.ends.tolist()
    out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "kept", "n_removed", "n_spans")}
    for i, null, n, end in zip(block.ids.tolist(), block.null.tolist(), block.lengths.tolist(), ends, strict=True):
        g = gone[end - n : end]
        removed = int(g.sum())
        kept = block.data[end - n : end]
        spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if removed else 0
        for k, v in zip(out, (None if null else i, n, (kept[~g] if removed else kept).tobytes(), removed, spans), strict=True):
            out[k].append(v)
    kinds = {"kept": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))


def removal_digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
