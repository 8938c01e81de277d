"""Grouping of spelling variants: the words within one edit of each other.

Words are counted by Spark over whole texts. Two words one edit apart share the first or the
last half of the shorter one, so each word goes to the groups of its two halves, once as the
shorter and once as the longer of a pair; a group of more than GROUP words is dealt again by
halves of what its words don't share yet, until the rest is one letter or two (of an alphabet
of 90, so that no group stays larger). What two words share already stands in a group's path;
a pair that shares both halves is only taken where it shares the first.

Inside a group the words are sorted and each is compared with all by dynamic programming over
the sorted list: rows of the edit matrix, three cells wide, are kept for the letters that a
word shares with the one before it, and where a row has no cell of one edit or less, all words
that begin alike are passed over at once. A group tells each word how many near words it has
and which is the commonest, so no pair is ever written.

Defined cases: null and empty texts have no words; a null identifier is an empty one; repeated
rows count as often as they stand; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut

RUN = r"[A-Za-zÀ-ÿ]+"
LETTERS, LEAST, TIMES = 6, 5, 5
#: Larger than any group whose words differ in two letters at most: 90 + 90 * 90.
GROUP = 10_000
SALTS = 64
OUT_ROWS = 10_000
LAST = "\U0010ffff"  # after every letter


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LETTERS, least: int = LEAST, slip_every: int | None = None) -> DataFrame:
    """(word, n) of all words of so many letters and occurrences; A-Z is lower-cased.

    With slip_every, one in so many (document, word) loses a letter, as its checksum says:
    misspellings at a known rate.
    """
    runs = docs.select(
        F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":")).alias("of"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"),
    )
    word = F.translate("run", UPPER, LOWER)
    if slip_every:
        runs = runs.select(word.alias("run"), F.crc32(F.concat("of", word).cast("binary")).alias("h"))
        at = (F.col("h") % F.char_length("run")).cast("int")
        word = F.when(F.col("h") % slip_every == 0, F.concat(F.expr("left(run, cast(h % char_length(run) as int))"), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.char_length("word") >= letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def halved(rows: DataFrame) -> DataFrame:
    """rows (short, path, from, to, word, n) dealt by the first (p) and the last (s) half of what isn't shared yet.

    short is the length of the shorter words of a group, from and to how much of begin and end its words share.
    """
    half = F.floor((F.col("short") - F.col("from") - F.col("to")) / 2).cast("int")
    ends = F.array(
        F.struct(F.concat("path", F.lit("p")).alias("path"), (F.col("from") + half).alias("from"), F.col("to").alias("to")),
        F.struct(F.concat("path", F.lit("s")).alias("path"), F.col("from").alias("from"), (F.col("to") + half).alias("to")),
    )
    return rows.select("short", F.inline(ends), "word", "n").select("short", "path", "from", "to", "word", "n")


def groups_of(words: DataFrame, letters: int = LETTERS) -> DataFrame:
    """(key, short, path, word, n): groups of at most GROUP words that hold all pairs one edit apart."""
    length = F.char_length("word").cast("int")
    zero = F.lit(0).alias("from"), F.lit(0).alias("to")
    rows = words.select(F.explode(F.array(length, length - 1)).alias("short"), F.lit("").alias("path"), *zero, "word", "n").where(F.col("short") >= letters)
    key = F.concat_ws(":", "short", "path", F.expr("left(word, from)"), F.expr("right(word, to)"))
    salt = F.pmod(F.xxhash64("word"), F.lit(SALTS))
    out = None
    while True:
        rows = halved(rows).withColumn("key", key)
        large = cut(rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > GROUP).select("key"))
        done = rows
        again = large.limit(1).count() > 0
        if again:  # a large group's rows meet its key in SALTS tasks
            salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            rows = rows.withColumn("salt", salt)
            done = rows.join(salted, ["key", "salt"], "left_anti")
        done = done.select("key", "short", "path", "word", "n")
        out = done if out is None else out.unionByName(done)
        if not again:
            return out
        rows = cut(rows.join(salted, ["key", "salt"], "left_semi").drop("key", "salt"))


def shared(short: int, path: str) -> tuple[int, int, list[tuple[int, int]]]:
    """How much of begin and end a group's words share, and the parts in which a pair must differ."""
    begin = end = 0
    differ = []
    for step in path:
        half = (short - begin - end) // 2
        if step == "p":
            begin += half
        else:
            differ.append((begin, begin + half))
            end += half
    return begin, end, [part for part in differ if part[0] < part[1]]


def common_prefixes(words: list[str]) -> list[int]:
    """How many letters each word shares with the one before it."""
    out = [0]
    for before, word in zip(words, words[1:], strict=False):
        n = 0
        for x, y in zip(before, word, strict=False):
            if x != y:
                break
            n += 1
        out.append(n)
    return out


def one_edit(word: str, words: list[str], prefixes: list[int]) -> Iterator[int]:
    """Which of the sorted words (of len(word) or one more letter) are exactly one edit from word.

    Row i of the edit matrix has the distances of a word's first i letters to the first i - 1,
    i and i + 1 letters of word.
    """
    n, padded = len(word), f"\0{word}\0\0"
    rows, i = [(2, 0, 1)], 0
    while i < len(words):
        other, depth = words[i], prefixes[i]
        del rows[depth + 1 :]
        less, same, more = rows[depth]
        dead = 0
        for d in range(depth, len(other)):
            letter = other[d]
            x = less + (padded[d] != letter)
            if same + 1 < x:
                x = same + 1
            y = same + (padded[d + 1] != letter)
            if more + 1 < y:
                y = more + 1
            if x + 1 < y:
                y = x + 1
            z = more + (padded[d + 2] != letter)
            if y + 1 < z:
                z = y + 1
            less, same, more = x, y, z
            if x > 1 and y > 1 and z > 1:
                dead = d + 1
                break
            rows.append((x, y, z))
        if dead:  # what begins with these letters is further away
            i += 1
            if i < len(words) and prefixes[i] >= dead:
                i = bisect_left(words, other[:dead] + LAST, i)  # shares with the last one passed over what it shares with this
            continue
        if (same if len(other) == n else less) == 1:
            yield i
        i += 1


def near_in_group(short: int, path: str, counts: dict[str, int]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, the commonest one's count, it) of a group's words that have near ones."""
    begin, end, differ = shared(short, path)
    middle = sorted((w[begin : len(w) - end], w) for w in counts)
    parts, words = [m for m, _ in middle], [w for _, w in middle]
    prefixes = common_prefixes(parts)
    found: dict[str, tuple[int, int, str]] = {}

    def note(word: str, near: str) -> None:
        k, n, best = found.get(word, (0, 0, ""))
        m = counts[near]
        found[word] = (k + 1, m, near) if not k or m > n or m == n and near < best else (k + 1, n, best)

    for part, word in middle:
        if len(word) > short:
            continue
        for i in one_edit(part, parts, prefixes):
            near = words[i]
            if any(word[a:b] == near[a:b] for a, b in differ):
                continue
            note(word, near)
            if len(near) > short:
                note(near, word)
    for word, (k, n, best) in found.items():
        yield word, k, n, best


def near_words(words: DataFrame, letters: int = LETTERS) -> DataFrame:
    """(word, n_near, near_n, near) of the words (word, n) that have near ones: how many, and the commonest, the smallest of equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(held: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["word", "k", "n", "near"])

        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held: list[tuple] = []
        for _, group in groupby(rows, key=lambda r: r[0]):
            members = list(group)
            if len(members) > 1:
                held.extend(near_in_group(members[0][1], members[0][2], {r[3]: r[4] for r in members}))
            if len(held) >= OUT_ROWS:
                yield whole(held)
                held = []
        if held:
            yield whole(held)

    dealt = groups_of(words, letters).repartition("key").sortWithinPartitions("key")
    told = dealt.mapInArrow(run, "word string, k long, n long, near string")
    best = F.min(F.struct((-F.col("n")).alias("n"), "near")).alias("best")
    return told.groupBy("word").agg(F.sum("k").alias("n_near"), best).select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.near").alias("near"))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the last form that one leads to. Counts grow along forms, so there are no circles."""
    steps = cut(forms.select("word", F.col("form").alias("root")))
    while True:  # what each word knows doubles the steps it goes at once
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = cut(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not steps.where("moved").limit(1).count():
            return steps.select("word", "root")
        steps = steps.drop("moved")


def variants(words: DataFrame, times: int = TIMES, letters: int = LETTERS) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n): form is the commonest near word if it is so many times commoner."""
    words = cut(words)
    near = words.join(near_words(words, letters), "word", "left")
    is_form = F.col("near_n") >= F.col("n") * times
    known = cut(near.select("word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near_n")).alias("form_n")))
    roots = roots_of(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
