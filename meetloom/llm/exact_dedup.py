"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised texts, every partition is sorted
externally by Spark, equal texts become neighbours and are compared in full. A group of
equal texts may span several partitions (the identifier is part of the range key, so a hot
group is split); only the first and last run of each partition are matched across
partitions, which is at most two rows a partition. Rows leave a task as they come, whatever
the length of their run; a run's last row tells its length.

The range key is the text's first PREFIX characters, then a hash of the whole of it: whole
texts would make the sample that the driver gets for the splitters grow with their length
(Spark samples 100 rows a partition and a million at most).

Defined cases: null text counts as empty; empty texts are equal to each other; a null
identifier loses against any other; of fully repeated rows exactly one stays; an empty
table gives an empty result; other columns are carried untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, cut, shuffle_partitions

PREFIX = 48  # characters of the text in the range key; bounds what sampling sends to the driver
#: What a row knows of its run: __best stays unless the group goes on elsewhere, __n is the length of the run on its last row.
RUN = {"__pid": T.IntegerType(), "__run": T.LongType(), "__head": T.BooleanType(), "__best": T.LongType(), "__digest": T.StringType(), "__n": T.LongType(), "__final": T.BooleanType()}


def _runs(carry: list[str], n_key: int):
    """Rows (carry, __norm) sorted by content, with the run of equal texts they are in. Column n_key of carry has the identifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, names = TaskContext.get().partitionId(), [*carry, *RUN]
        last: pa.Table | None = None  # the row before, held back until it is known whether it ends its run
        norm: pa.Array | None = None  # and its text
        run_no, length, best, digest = -1, 0, None, ""

        def ended(final: bool) -> pa.Table:
            return last.set_column(len(carry) + 5, "__n", pa.array([length], pa.int64())).set_column(len(carry) + 6, "__final", pa.array([final]))

        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.concat_arrays([*([norm] if norm is not None else []), batch.column(len(carry))])
            fresh = pc.not_equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False)
            fresh = fresh if norm is not None else np.concatenate([[True], fresh])
            norm = batch.column(len(carry))[-1:]
            n, starts = len(fresh), np.flatnonzero(fresh)
            out = [ended(False)] if last is not None and fresh[0] else [last] if last is not None else []
            # the runs of this batch; the first may go on from the one before
            bounds = np.unique([0, *starts.tolist(), n])
            kinds: list[tuple[int, int | None, str]] = []
            lengths = np.full(n, -1)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if fresh[a]:
                    run_no, length, best = run_no + 1, 0, batch.column(n_key)[a].as_py()  # sorted: the first row is the one that stays
                    digest = hashlib.sha256(batch.column(len(carry))[a].as_buffer()).hexdigest()
                kinds.append((run_no, best, digest))
                length += b - a
                if b < n:
                    lengths[b - 1] = length
            place = pa.array(np.repeat(np.arange(len(kinds)), np.diff(bounds)))
            runs, bests, digests = (pa.array(c, k).take(place) for c, k in zip(zip(*kinds, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True))
            known = [pa.array(np.full(n, pid, np.int32)), runs, pa.array(fresh), bests, digests, pa.array(lengths, mask=lengths < 0), pa.array(np.zeros(n, bool))]
            rows = pa.table([*batch.columns[: len(carry)], *known], names=names)
            last = rows.slice(n - 1)
            yield from pa.concat_tables([*out, rows.slice(0, n - 1)]).combine_chunks().to_batches()
        if last is not None:
            yield from ended(True).combine_chunks().to_batches()

    return run


def _placed(docs: DataFrame, text: str, key: str, keep: str, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """Every row with its run, whether it stays (__kept), and for runs at the edge of a partition their group's __id and __all; the latter by run."""
    spark = docs.sparkSession
    order = F.col(key).desc_nulls_last() if keep == "largest" else F.col(key).asc_nulls_last()
    rows = docs.select(*carry, ascii_lower(text).cast("binary").alias("__norm")).withColumns(
        {"__prefix": F.substring(F.col("__norm").cast("string"), 1, PREFIX), "__hash": F.xxhash64("__norm"), "__row": F.monotonically_increasing_id()}
    )
    ranged = rows.repartitionByRange(shuffle_partitions(spark), "__prefix", "__hash", order, "__row")
    ranged = ranged.sortWithinPartitions("__prefix", "__hash", "__norm", order, "__row").select(*carry, "__norm")
    schema = T.StructType([ranged.schema[c] for c in carry])
    for name, kind in RUN.items():
        schema = schema.add(name, kind)
    runs = cut(ranged.mapInArrow(_runs(carry, carry.index(key)), schema))
    best = F.max if keep == "largest" else F.min
    # at most two runs a partition, so the size of these is bound by the partition count
    edges = runs.where("__n IS NOT NULL AND (__run = 0 OR __final)").select("__pid", "__run", "__best", "__digest", "__n")
    groups = edges.groupBy("__digest").agg(best("__best").alias("__id"), F.sum("__n").alias("__all"), F.min("__pid").alias("__first"))
    edges = edges.join(groups, "__digest").select("__pid", "__run", "__id", "__all", "__first")
    placed = runs.join(F.broadcast(edges), ["__pid", "__run"], "left")
    return placed.withColumn("__kept", F.col("__head") & (F.col("__first").isNull() | (F.col("__pid") == F.col("__first")))), runs


def content_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "largest", carry: list[str] | None = None) -> DataFrame:
    """Every row of docs (columns carry, key among them) with keep_id, group_size, kept and text_sha256."""
    carry = carry or [key]
    placed, runs = _placed(docs, text, key, keep, carry)
    known = F.coalesce("__all", F.when(F.col("__n") == 1, F.lit(1)))  # rows of longer runs learn from their last
    lengths = runs.where("__n > 1").select("__pid", "__run", F.col("__n").alias("__length"))
    names = ["keep_id", "group_size", "kept", "text_sha256"]

    def out(rows: DataFrame, size) -> DataFrame:
        keep_id = F.when(F.col("__first").isNotNull(), F.col("__id")).otherwise(F.col("__best"))
        return rows.select(*carry, *[c.alias(n) for c, n in zip((keep_id, size.cast("long"), F.col("__kept"), F.col("__digest")), names, strict=True)])

    return out(placed.where(known.isNotNull()), known).unionByName(out(placed.where(known.isNull()).join(lengths, ["__pid", "__run"]), F.col("__length")))


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "largest") -> DataFrame:
    """docs without the copies of equal texts; columns as they were."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.toDF(*names.values())  # own columns may clash with the run columns
    placed, _ = _placed(renamed, names[text], names[key], keep, list(names.values()))
    return placed.where("__kept").select(*[F.col(n).alias(c) for c, n in names.items()])
