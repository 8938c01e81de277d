"""Reproducible global shuffle and sharding by a Feistel permutation over row numbers.

Rows get global numbers (buckets by hash of the whole row, numbered inside the bucket, plus
the sizes of the buckets before), a keyed Feistel network with cycle walking permutes
0..N-1, and position p lies in shard p mod S at slot p div S. Both follow from the row
number alone, shard sizes differ by one at most (the law `rows`), and nothing depends on
how Spark partitioned the input. Documents are then dealt out: a partition holds a range of
slots of one shard, in their order.

Defined cases: null text has size 1 and checksum 0 in the digest; null identifiers are
numbered like any other; fully repeated rows get numbers of their own; an empty table gives
an empty result; other columns are carried, and where one of them has the name of a column
that is added, the added one is called `dealt_` and that name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

BUCKET_ROWS, LEAST_BUCKETS = 10_000, 1024  # of which each bucket has about so many, so buckets follow from the number of rows alone
ROUNDS = 6


def feistel(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Permutes rows (each in 0..n-1) by a balanced Feistel network, walking cycles back into range."""
    half = max(1, (max(2, n) - 1).bit_length() + 1 >> 1)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(seed).integers(0, 2**63, ROUNDS, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    out = once(rows.astype(np.uint64))
    while (away := out >= n).any():
        out[away] = once(out[away])
    return out.astype(np.int64)


def permuted(row: Column, n: int, seed: int) -> Column:
    @F.pandas_udf("long")
    def position(rows: pd.Series) -> pd.Series:
        return pd.Series(feistel(rows.to_numpy(np.int64), n, seed))

    return position(row)


def row_numbers(rows: DataFrame, n: int) -> DataFrame:
    """The n rows with __row from 0 on without gaps, in an order that only depends on the rows."""
    buckets = max(LEAST_BUCKETS, 1 << (n // BUCKET_ROWS).bit_length())
    hashed = rows.withColumn("__hash", F.xxhash64(F.struct(*rows.columns)))
    bucketed = hashed.withColumn("__bucket", F.pmod("__hash", F.lit(buckets)))
    sizes = bucketed.groupBy("__bucket").agg(F.count("*").alias("__size"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__bucket", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    # rows of equal hashes that differ are told apart by their columns
    inside = Window.partitionBy("__bucket").orderBy("__hash", *rows.columns)
    numbered = bucketed.join(offsets, "__bucket").withColumn("__row", F.col("__offset") + F.row_number().over(inside) - 1)
    return numbered.select(*rows.columns, "__row")


def shard(docs: DataFrame, shards: int = 16, seed: int = 20240229) -> DataFrame:
    """docs with position, shard and slot, a partition for each range of slots of a shard."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    n = docs.count()
    placed = row_numbers(docs.toDF(*names.values()), n).withColumn("position", permuted(F.col("__row"), n, seed))
    placed = placed.withColumns({"shard": F.pmod("position", F.lit(shards)).cast("int"), "slot": F.floor(F.col("position") / shards).cast("long")})
    parts = max(1, shuffle_partitions(docs.sparkSession) // shards)  # of a shard
    part = F.col("shard") * parts + F.floor(F.col("slot") * parts / (n // shards + 1)).cast("int")
    dealt = placed.repartitionById(shards * parts, part).sortWithinPartitions("shard", "slot")
    return dealt.select(*[F.col(x).alias(c) for c, x in names.items()], *[F.col(c).alias(f"dealt_{c}" if c in names else c) for c in ("position", "shard", "slot")])


def shard_digest(dealt: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each dealt document's size, checksum, shard and slot."""
    position, dealt_to, slot = dealt.columns[-3:]
    utf8 = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return dealt.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(utf8) + 1).cast("long").alias("size"),
        F.crc32(utf8).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col(dealt_to).alias("shard"),
        F.col(slot).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col(position).alias("position"),
    )
