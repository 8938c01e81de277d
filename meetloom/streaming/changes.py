"""Listing snapshots as a stream: changes against the last accepted one, and new slots.

A store outlives the streams that write to it: a query that is changed starts with a new
checkpoint folder and counts its batches from 0 again. Outputs are therefore kept by stream
(the query's identifier, which its checkpoint keeps) and batch. Runs of the change stream are
numbered on over all streams by a log beside the state, whose entry is written last and makes
the run count: a batch that was logged is never done again, and what an interrupted one left
is overwritten by the next run. One stream writes to a store at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.changes import ENTRY, snapshot_changed, snapshot_diff

KEYS = ["inbox_id", *ENTRY]
COMPACT = 16  # runs between two full states
LOG = "stream string, batch long, of_run long, run long"
DIRECT = "direct"  # the stream of batches that no query made


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    """What is stored at path; no rows if there is nothing yet. Other faults are raised."""
    schema = schema.schema if isinstance(schema, DataFrame) else schema
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stream_of(batch: DataFrame) -> str:
    """The streaming query that a micro-batch is of; its checkpoint keeps the identifier."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or DIRECT


def logged(spark: SparkSession, state: str) -> tuple[int, dict[str, int]]:
    """The last run that counts (-1 without one), and the last batch of every stream that has one."""
    log = _table(spark, f"{state}.runs", LOG)
    last = log.agg(F.max("run")).first()[0]
    rows = [] if last is None else log.where(F.col("run") == last).collect()  # a row per stream
    return -1 if last is None else last, {r.stream: r.batch for r in rows}


def changes_so_far(spark: SparkSession, sink: str, state: str) -> DataFrame:
    """The changes of all runs that count."""
    return spark.read.parquet(sink).where(F.col("run") <= logged(spark, state)[0])


def latest_state(spark: SparkSession, state: str, before: int, like: DataFrame) -> DataFrame:
    """The last accepted snapshot of every inbox before a run.

    Each run stores the inboxes it accepted; every COMPACT-th stores all inboxes instead, so
    at most COMPACT runs are read, however long the streams have run.
    """
    first = before - 1 - (before - 1) % COMPACT
    runs = _table(spark, state, like.withColumn("run", F.lit(0).cast("long"))).where(F.col("run").between(first, before - 1))
    last = runs.groupBy("inbox_id").agg(F.max("run").alias("run"))
    return runs.join(last, ["inbox_id", "run"]).select(*KEYS)


def accept(batch: DataFrame, batch_id: int, sink: str, state: str, stream: str = DIRECT) -> None:
    """One micro-batch (T1): the newest snapshot of each inbox against its state; older ones in it are superseded.

    Changes are written first, then the state, both into the run's folders, and the run's log
    entry last. Unchanged inboxes keep their state; a snapshot without entries (name null) is
    a failed one. Old runs of the state go once two full ones came after them.
    """
    spark = batch.sparkSession
    last, batches = logged(spark, state)
    if batch_id <= batches.get(stream, -1):
        return
    run = last + 1
    newest = batch.groupBy("inbox_id").agg(F.max("snapshot_id").alias("snapshot_id"))
    remote = batch.join(newest, ["inbox_id", "snapshot_id"]).where("name IS NOT NULL").select(*KEYS)
    before = latest_state(spark, state, run, remote)
    cached = before.join(newest.select("inbox_id"), "inbox_id", "left_semi")
    changed = snapshot_changed(remote, cached).where("changed AND n_remote > 0").select("inbox_id")
    rows = snapshot_diff(remote.join(changed, "inbox_id", "left_semi"), cached.join(changed, "inbox_id", "left_semi"))
    rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{sink}/run={run}")
    accepted = remote.join(changed, "inbox_id", "left_semi")
    if run % COMPACT == 0:
        accepted = accepted.unionByName(before.join(changed, "inbox_id", "left_anti"))
    accepted.write.mode("overwrite").parquet(f"{state}/run={run}")
    entries = spark.createDataFrame([(s, b, run) for s, b in (batches | {stream: batch_id}).items()], "stream string, batch long, of_run long")
    entries.coalesce(1).write.mode("overwrite").parquet(f"{state}.runs/run={run}")
    if run % COMPACT == 0:
        for old in range(max(0, run - 2 * COMPACT), run - COMPACT):
            _remove(spark, f"{state}/run={old}")
            _remove(spark, f"{state}.runs/run={old}")


def change_stream(snapshots: DataFrame, sink: str, state: str, checkpoint: str) -> DataStreamWriter:
    """Writer of the changes of a stream of snapshots (inbox_id, snapshot_id, folder, name, uploaded_at)."""
    return snapshots.writeStream.foreachBatch(lambda df, i: accept(df, i, sink, state, stream_of(df))).option("checkpointLocation", checkpoint)


def process_new_slots(batch: DataFrame, batch_id: int, results: str, compute: Callable[[DataFrame], DataFrame], stream: str = DIRECT, is_new: bool = False) -> None:
    """One micro-batch of slots (T2): compute makes results of those whose content_key has none yet, one a key.

    Keys with a result don't reach compute. Outputs are kept by stream and batch, so a batch
    that is run again computes and replaces its own. Where the stream itself knows that keys
    are new to it (is_new), only results of other streams are looked up.
    """
    like = batch.select("content_key", F.lit("").alias("stream"), F.lit(0).cast("long").alias("batch"))
    others = F.col("stream") != stream
    stored = _table(batch.sparkSession, results, like).where(others if is_new else others | (F.col("batch") < batch_id))
    new = batch.join(stored.select("content_key").distinct(), "content_key", "left_anti")
    first = new.groupBy("content_key").agg(F.min_by(F.struct(*[c for c in batch.columns if c != "content_key"]), "slot_id").alias("s")).select("content_key", "s.*")
    compute(first).write.mode("overwrite").parquet(f"{results}/stream={stream}/batch={batch_id}")


def first_of_keys(slots: DataFrame) -> DataFrame:
    """Of a stream of slots those whose content_key comes for the first time, of a batch's equal keys that of the smallest slot_id.

    Spark keeps the keys as the query's state, so that a batch reads no earlier results. A
    null key is one of its own.
    """
    columns, schema = slots.columns, slots.schema
    at = columns.index("slot_id")

    def first(key: tuple, frames: Iterator[pd.DataFrame], seen: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for frame in frames:
            if not seen.exists:
                for row in frame.sort_values("slot_id").head(1).itertuples(index=False, name=None):
                    best = row if best is None or row[at] < best[at] else best
        if best is not None:
            seen.update((True,))
            yield pd.DataFrame([best], columns=columns)

    return slots.groupBy("content_key").applyInPandasWithState(first, schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def incremental_slots(slots: DataFrame, results: str, checkpoint: str, compute: Callable[[DataFrame], DataFrame]) -> DataStreamWriter:
    """Writer of the results of a stream of slots (content_key, slot_id and what compute takes)."""
    new = first_of_keys(slots).writeStream.foreachBatch(lambda df, i: process_new_slots(df, i, results, compute, stream_of(df), is_new=True))
    return new.option("checkpointLocation", checkpoint)
