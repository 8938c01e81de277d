"""Did a listing change: snapshots against stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = ("folder", "name", "uploaded_at")


def snapshot_diff(remote: DataFrame, cached: DataFrame, key: str = "inbox_id") -> DataFrame:
    """Entries added and removed (U4), each once; nulls are equal."""
    new, old = remote.select(key, *ENTRY), cached.select(key, *ENTRY)
    added = new.subtract(old).withColumn("change", F.lit("added"))
    return added.unionByName(old.subtract(new).withColumn("change", F.lit("removed")))


def snapshot_changed(remote: DataFrame, cached: DataFrame, key: str = "inbox_id") -> DataFrame:
    """Whether each inbox changed.

    Nothing listed: unchanged; nothing stored: changed; equal sets: unchanged; fewer entries
    than stored, all of them known (a partial outage): unchanged; else changed.
    """
    both = remote.select(key, *ENTRY, F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(cached.select(key, *ENTRY, F.lit(0).alias("r"), F.lit(1).alias("c")))
    entries = both.groupBy(key, *ENTRY).agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    sums = entries.groupBy(key).agg(
        F.sum("r").alias("n_remote"),
        F.sum("c").alias("n_cached"),
        F.count_if(F.col("c") == 0).alias("n_new"),
        F.count_if(F.col("r") == 0).alias("n_gone"),
    )
    changed = (
        F.when(F.col("n_remote") == 0, False)
        .when(F.col("n_cached") == 0, True)
        .when((F.col("n_new") == 0) & (F.col("n_gone") == 0), False)
        .when((F.col("n_remote") < F.col("n_cached")) & (F.col("n_new") == 0), False)
        .otherwise(True)
    )
    return sums.select(key, "n_remote", "n_cached", "n_new", "n_gone", changed.alias("changed"))


def cache_misses(slots: DataFrame, results: DataFrame, key: str = "content_key") -> DataFrame:
    """Slots without a stored result."""
    return slots.join(results.select(key).distinct(), key, "left_anti")


def ordered_distinct(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """First place of every value of a key."""
    return rows.groupBy(key, value).agg(F.min(order).alias(order))
