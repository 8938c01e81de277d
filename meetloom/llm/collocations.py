"""Phrase collocation mining with counting quotient filters.

Tasks turn texts into blocks of word numbers with a dictionary each; dictionaries are summed
to the vocabulary of words with at least LEAST occurrences, whose dense identifiers are told
back to the blocks. Then, length by length, tasks count the n-grams of their blocks in
quotient filters, cut by shards of the quotient; filters of a shard are merged sorted, and
n-grams of LEAST occurrences stay. A longer n-gram is only counted where its first and last
part (one word shorter) may be frequent: a bit table of at most BITS_WORDS words tells that,
which only errs by letting through; with very many frequent phrases it saves less, and
counts stay exact.

What blocks and phrases ask of words and parts is told by a broadcast of the most frequent
ones (HEAD at most) and by a shuffle for the others, whose askers are few: none of them has
more than one in HEAD of all occurrences.

Defined cases: null and empty texts have no words; a null lang is `und`; repeated rows count
as often as they stand; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, stage_table
from .quotient_filter import Packing, counted, decode, encode

LEAST, LONGEST, TOP, COVERED = 100, 5, 2000, 100
UNKNOWN = "und"
BLOCK = 1 << 19  # tokens of a block, one document more at most
FILE_BLOCKS = 16  # a reader holds a file's blocks at once
BATCH_BYTES = 8 << 20
SLICE = 1 << 22  # bytes that are split into tokens at once
FILTER = 1 << 21  # n-grams that a task holds before it emits its filters
SHARD = 1 << 21  # tokens of the corpus for each shard
BITS_WORDS = 1 << 21  # 64-bit words: 16 MB
HEAD = 100_000
HEAD_BYTES = 64  # longer words are never broadcast
TOP_ROWS = 200_000
#: Lower case, all that ends a piece as a full stop, and tab as space.
_TABLE = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Block:
    """Word numbers of a block, from 1 on in the order of first sight; 0 ends a piece."""

    class Ids(dict):
        def __init__(self, block: _Block, lang: str):
            super().__init__({b".": 0})
            self.block, self.lang = block, lang

        def __missing__(self, word: bytes) -> int:
            self.block.entries.append((self.lang, word))
            self[word] = n = len(self.block.entries)
            return n

    def __init__(self):
        self.entries: list[tuple[str, bytes]] = []
        self.langs: dict[str, _Block.Ids] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.langs:
            self.langs[lang] = self.Ids(self, lang)
        ids = self.langs[lang]
        for part in sliced(text.translate(_TABLE)):
            self._put([ids[w] for w in part.replace(b".", b" . ").split(b" ") if w])
        self._put([0])

    def _put(self, ids: list[int]) -> None:
        self.parts.append(np.array(ids, np.int32))
        self.size += len(ids)

    def row(self, number: int) -> pa.RecordBatch:
        ids = np.concatenate(self.parts)
        n = np.bincount(ids, minlength=len(self.entries) + 1)[1:]
        langs, words = zip(*self.entries, strict=True) if self.entries else ((), ())
        entry = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])
        entries = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), entry)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), entries, pa.array([ids.tobytes()], pa.binary())], names=["block", "words", "ids"])


def sliced(data: bytes) -> Iterator[bytes]:
    """data in slices that end between words."""
    at = 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            end = max(data.rfind(b" ", at, end), data.rfind(b".", at, end)) + 1
            if end <= at:  # one word throughout
                found = [i for i in (data.find(b" ", at + SLICE), data.find(b".", at + SLICE)) if i >= 0]
                end = min(found) if found else len(data)
        yield data[at:end]
        at = end


def blocks_of(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """block, words (lang, word, n) and ids (32-bit numbers into words from 1 on, 0 between pieces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for of, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(of, content.as_py())
                if block.size >= BLOCK:
                    yield block.row(number)
                    number, block = number + 1, _Block()
        if block.size:
            yield block.row(number)

    bounded_batches(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)  # rows are whole blocks
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)), F.col(text).cast("binary").alias("text")).where("octet_length(text) > 0")
    return rows.mapInArrow(run, "block long, words array<struct<lang string, word string, n long>>, ids binary")


def told(rows: DataFrame, on: str, table: DataFrame, count: str, may_lead: Column | None = None) -> DataFrame:
    """rows with the columns of table (a row for each value of on), inner.

    The rows of table with the largest counts are broadcast, HEAD at most; may_lead can keep
    rows from that.
    """
    lead = F.lit(True) if may_lead is None else may_lead
    sizes = table.where(lead).groupBy(F.floor(F.log2(count)).cast("int").alias("power")).agg(F.count("*").alias("rows")).collect()  # a row per power of two
    least, some = 64, 0
    for power, size in sorted(map(tuple, sizes), reverse=True):
        some += size
        if some > HEAD:
            break
        least = power
    is_head = (F.floor(F.log2(count)) >= least) & lead
    hot = table.where(is_head).select(on, F.struct(*[c for c in table.columns if c != on]).alias("__hot"))
    rows = rows.join(F.broadcast(hot), on, "left")
    names = [c for c in rows.columns if c != "__hot"]
    known = rows.where("__hot IS NOT NULL").select(*names, "__hot.*")
    return known.unionByName(rows.where("__hot IS NULL").drop("__hot").join(table.where(~is_head), on))


def vocabulary(blocks: DataFrame, least: int = LEAST) -> tuple[DataFrame, int]:
    """(lang, word, f, id, n) of the frequent words, n the occurrences of all words of lang; and how many these are in all."""
    counts = blocks.select(F.inline("words")).groupBy("lang", "word").agg(F.sum("n").alias("f"))
    totals = cut(blocks.select(F.inline("words")).groupBy("lang").agg(F.sum("n").alias("n")))
    total = totals.agg(F.sum("n")).first()[0] or 0
    row = F.monotonically_increasing_id()
    words = cut(counts.where(F.col("f") >= least).select("lang", "word", "f", F.shiftright(row, 33).alias("part"), row.bitwiseAND((1 << 33) - 1).alias("row")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = words.groupBy("part").agg(F.count("*").alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    words = words.join(F.broadcast(offsets), "part")  # a row per partition
    words = words.select("lang", "word", "f", (F.col("offset") + F.col("row") + 1).alias("id"))
    return cut(told(words, "lang", totals, "n", F.octet_length("lang") <= HEAD_BYTES)), total


def encoded(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """The blocks' ids as those of the vocabulary, 0 for rare words and between pieces, 64 bits each where 32 don't do."""
    asked = blocks.select("block", F.posexplode("words").alias("at", "w")).select("block", "at", F.struct("w.lang", "w.word").alias("w"))
    table = words.select(F.struct("lang", "word").alias("w"), "id", "f")
    known = told(asked, "w", table, "f", F.octet_length("w.word") + F.octet_length("w.lang") <= HEAD_BYTES)
    size = (words.agg(F.max("id")).first()[0] or 0).bit_length()
    kind = np.int32 if size < 32 else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # what is known of the block to come
        for batch in batches:
            places, ids, blobs = batch.columns
            ends = np.flatnonzero(blobs.is_valid().to_numpy(zero_copy_only=False)).tolist()
            start = 0
            for end in [*ends, batch.num_rows]:
                parts.append((places.slice(start, end - start).to_numpy(zero_copy_only=False), ids.slice(start, end - start).to_numpy(zero_copy_only=False)))
                start = end + 1
                if end < batch.num_rows:
                    local = np.frombuffer(blobs[end].as_buffer(), np.int32)
                    table = np.zeros(int(local.max(initial=0)) + 1, kind)
                    for at, id_ in parts:
                        table[at.astype(np.int64) + 1] = id_
                    parts = []
                    yield pa.RecordBatch.from_arrays([pa.array([table[local].tobytes()], pa.binary())], names=["ids"])

    # a block comes after the identifiers of its words
    rows = known.select("block", F.lit(False).alias("whole"), "at", "id", F.lit(None).cast("binary").alias("ids"))
    rows = rows.unionByName(blocks.select("block", F.lit(True).alias("whole"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("id"), "ids"))
    return rows.repartition("block").sortWithinPartitions("block", "whole").select("at", "id", "ids").mapInArrow(run, "ids binary")


def _windows(packing: Packing, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where n-grams of frequent words begin, and their words."""
    n, some = packing.n, ids > 0
    m = max(0, len(ids) - n + 1)
    whole = np.logical_and.reduce([some[i : m + i] for i in range(n)])
    starts = np.flatnonzero(whole)
    return starts, packing.pack([ids[starts + i] for i in range(n)])


def _may_be_frequent(packing: Packing, bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """At which positions an n-gram may begin that bits hold."""
    out = np.zeros(len(ids) + 1, bool)
    starts, words = _windows(packing, ids)
    h = packing.hashes(words)
    out[starts] = bits[(h >> np.uint64(65 - len(bits).bit_length())).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)
    return out


def frequent(ids: DataFrame, packing: Packing, shorter: np.ndarray | None, total: int, least: int = LEAST) -> DataFrame:
    """(ids, f, h): the n-grams with least occurrences, and their hashes; shorter are the bits of those one word shorter."""
    kind = np.int32 if packing.bits < 32 else np.int64
    shard_bits = min(packing.width, max(4, (total // SHARD).bit_length()))
    before = Packing(packing.n - 1, packing.bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def whole() -> Iterator[pa.RecordBatch]:
            words = [np.concatenate(w) for w in zip(*held, strict=True)]
            held.clear()
            words, counts = counted(words)
            for shard, data in encode(packing, words, counts, shard_bits):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([data], pa.binary())], names=["shard", "filter"])

        size = 0
        for batch in batches:
            for row in batch.column(0):
                own = np.frombuffer(row.as_buffer(), kind)
                starts, words = _windows(packing, own)
                if shorter is not None:
                    may = _may_be_frequent(before, shorter, own)
                    keep = may[starts] & may[starts + 1]
                    words = [w[keep] for w in words]
                held.append(words)
                size += len(words[0])
                if size >= FILTER:
                    yield from whole()
                    size = 0
        if size:
            yield from whole()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: int | None = None
        held: list[tuple[list[np.ndarray], np.ndarray]] = []

        def merged() -> tuple[list[np.ndarray], np.ndarray]:
            return counted([np.concatenate(w) for w in zip(*[w for w, _ in held], strict=True)], np.concatenate([c for _, c in held]))

        def whole() -> pa.RecordBatch:
            words, counts = merged()
            keep = counts >= least
            words = [w[keep] for w in words]
            own = np.stack(packing.unpack(words), axis=1).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * packing.n, pa.int32()), pa.array(own.ravel()))
            return pa.RecordBatch.from_arrays([lists, pa.array(counts[keep]), pa.array(packing.hashes(words).view(np.int64))], names=["ids", "f", "h"])

        for batch in batches:
            for s, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if s != shard and held:
                    yield whole()
                    held = []
                shard = s
                held.append(decode(packing, s, data.as_py(), shard_bits))
                if len(held) > 1 and sum(len(c) for _, c in held[1:]) > max(FILTER, len(held[0][1])):
                    held = [merged()]
        if held:
            yield whole()

    filters = ids.mapInArrow(count, "shard int, filter binary")
    return filters.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, "ids array<long>, f long, h long")


def bits_of(phrases: DataFrame, n: int) -> np.ndarray:
    """A bit table of the n phrases' hashes, 32 bits for each as far as BITS_WORDS words go."""
    size = min(BITS_WORDS, 1 << max(4, (n // 2).bit_length()))
    word = F.shiftrightunsigned("h", 65 - size.bit_length()).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("h", F.lit(64)).cast("int"))
    rows = phrases.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most size rows
    bits = np.zeros(size, np.int64)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return bits.view(np.uint64)


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """The frequent words, and (ids, f) of the frequent phrases of two to longest words."""
    blocks = stage_table(blocks_of(docs, text, lang), "blocks", FILE_BLOCKS)
    words, total = vocabulary(blocks, least)
    ids = stage_table(encoded(blocks, words), "ids", FILE_BLOCKS)
    bits = max(1, (words.agg(F.max("id")).first()[0] or 0).bit_length())
    found, shorter = [], None
    for n in range(2, longest + 1):
        found.append(cut(frequent(ids, Packing(n, bits), shorter, total, least)))
        size = found[-1].count()
        if not size or n == longest:
            break
        shorter = bits_of(found[-1], size)
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    return words, phrases.select("ids", "f")


def first_of(rows: DataFrame, group: str, order: list[Column], n: int, size: int) -> DataFrame:
    """rows' first n of each group with rank; groups are thinned out in parts of about TOP_ROWS rows first."""
    parts = -(-size // TOP_ROWS)
    while parts > 1:
        part = Window.partitionBy(group, F.pmod(F.xxhash64("ids"), F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= n).drop("rank")
        parts = parts // 64 if parts > 64 else 1
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases by their weakest cut.

    A phrase goes if a longer one around it has covered per cent of its occurrences. It is
    enough to look at those one word longer: one in between is no rarer than the longest.
    """
    words, phrases = frequent_phrases(docs, text, lang, least, longest)
    parts = words.select(F.array("id").alias("ids"), "f").unionByName(phrases)
    size = F.size("ids")
    cuts = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.select("ids", "a", "cut", F.slice("ids", F.lit(1), F.col("cut")).alias("left"), F.slice("ids", F.col("cut") + 1, size - F.col("cut")).alias("right"))

    def of(side: str, count: str) -> tuple[str, DataFrame, str]:
        return side, parts.select(F.col("ids").alias(side), F.col("f").alias(count)), count

    cuts = cut(told(told(cuts, *of("left", "l")), *of("right", "r")))
    of_first = told(phrases.select("ids", "f", F.element_at("ids", 1).alias("id")), "id", words.select("id", "lang", "n", F.col("f").alias("own")), "own", F.octet_length("lang") <= HEAD_BYTES)
    longer = F.size("ids") > 2
    begins = cuts.where(longer & (F.col("cut") == F.size("ids") - 1) & (F.col("a") * 100 >= F.col("l") * covered)).select(F.col("left").alias("ids"))
    ends = cuts.where(longer & (F.col("cut") == 1) & (F.col("a") * 100 >= F.col("r") * covered)).select(F.col("right").alias("ids"))
    kept = of_first.select("ids", "lang", "n").join(begins.unionByName(ends).distinct(), "ids", "left_anti")
    scored = cuts.join(kept, "ids").withColumn("score", F.expr("cast(cast(1000 * a as decimal(19,0)) * cast(n as decimal(18,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(18,0))) as long)"))
    best = scored.groupBy("ids", "lang", "n", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    best = cut(best.select("ids", "lang", "a", "c.l", "c.r", "n", "c.score"))
    texts = told(best.select("ids", F.posexplode("ids").alias("at", "id")), "id", words.select("id", "word", "f"), "f", F.octet_length("word") <= HEAD_BYTES)
    texts = texts.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    rows = best.join(texts, "ids")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    ranked = first_of(rows, "lang", order, top, best.count())
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
