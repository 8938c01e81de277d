"""A filter of fixed size that keeps most rows out of a shuffle before an exact join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 19  # 64-bit words: 4 MB, whatever the number of identifiers


def may_hold(ids: DataFrame, key: str):
    """A function of a column of identifiers: false only for those that ids doesn't hold.

    The filter has a bit per hash value and never more than WORDS words; with many
    identifiers it fills up and lets more rows through, which the exact join then sorts out.
    """
    h = F.xxhash64(key)
    word = F.pmod(F.shiftright(h, 6), F.lit(WORDS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    rows = ids.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most WORDS rows
    bits = np.zeros(WORDS, np.int64)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    table = bits.view(np.uint64)

    def probe(hashes: pd.Series) -> pd.Series:
        x = hashes.to_numpy(np.int64)
        hit = table[(x >> 6) % WORDS] >> (x % 64).astype(np.uint64) & np.uint64(1)
        return pd.Series(hit.astype(bool))

    udf = F.pandas_udf(probe, "boolean")
    return lambda column: udf(F.xxhash64(column if isinstance(column, Column) else F.col(column)))
