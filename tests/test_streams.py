"""Streams that start anew over a store that is there already."""

import pytest
from pyspark.sql import functions as F

from meetloom.streaming import changes as streams

SNAPSHOT = "inbox_id long, snapshot_id long, folder string, name string, uploaded_at timestamp"
SLOT = "content_key string, slot_id long, payload string"


def add(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run_changes(spark, tmp_path, source, check):
    stream = spark.readStream.schema(SNAPSHOT).parquet(str(source))
    streams.change_stream(stream, f"{tmp_path}/sink", f"{tmp_path}/state", f"{tmp_path}/{check}").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.inbox_id, r.change, r["name"]) for r in streams.changes_so_far(spark, f"{tmp_path}/sink", f"{tmp_path}/state").collect())


def test_changes_with_a_new_checkpoint(spark, tmp_path):
    """The second stream counts from batch 0 again; it neither loses nor repeats what the first one found."""
    add(spark, tmp_path / "one", [(1, 1, "f", "a", None), (2, 1, "f", "x", None)], SNAPSHOT)
    first = run_changes(spark, tmp_path, tmp_path / "one", "check-1")
    add(spark, tmp_path / "one", [(1, 2, "f", "b", None)], SNAPSHOT)
    second = run_changes(spark, tmp_path, tmp_path / "one", "check-1")
    assert second == sorted([*first, (1, "added", "b"), (1, "removed", "a")])
    add(spark, tmp_path / "two", [(3, 1, "f", "c", None), (1, 3, "f", "b", None)], SNAPSHOT)
    third = run_changes(spark, tmp_path, tmp_path / "two", "check-2")
    assert third == sorted([*second, (3, "added", "c")])
    add(spark, tmp_path / "one", [(2, 9, "f", "y", None)], SNAPSHOT)
    fourth = run_changes(spark, tmp_path, tmp_path / "one", "check-1")  # the old stream goes on
    assert fourth == sorted([*third, (2, "added", "y"), (2, "removed", "x")])
    assert streams.logged(spark, f"{tmp_path}/state")[0] == 3


def test_an_interrupted_run_does_not_count(spark, tmp_path, monkeypatch):
    sink, state = f"{tmp_path}/sink", f"{tmp_path}/state"
    rows = [spark.createDataFrame([(1, i, "f", n, None)], SNAPSHOT) for i, n in enumerate("abc")]
    streams.accept(rows[0], 0, sink, state, "s1")
    with monkeypatch.context() as m:
        m.setattr(streams, "latest_state", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            streams.accept(rows[1], 1, sink, state, "s1")
    # one that wrote its changes and state but no log entry
    rows[1].select(*streams.KEYS).withColumns({"change": F.lit("added"), "batch_id": F.lit(1).cast("long")}).write.parquet(f"{sink}/run=1")
    rows[1].select(*streams.KEYS).write.parquet(f"{state}/run=1")
    assert [r["name"] for r in streams.changes_so_far(spark, sink, state).collect()] == ["a"]
    streams.accept(rows[2], 0, sink, state, "s2")
    got = sorted((r.change, r["name"]) for r in streams.changes_so_far(spark, sink, state).collect())
    assert got == [("added", "a"), ("added", "c"), ("removed", "a")]
    streams.accept(rows[1], 1, sink, state, "s1")
    assert streams.logged(spark, state) == (2, {"s1": 1, "s2": 0})


def test_old_runs_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "COMPACT", 2)
    for i in range(9):
        streams.accept(spark.createDataFrame([(1, i, "f", f"v{i}", None)], SNAPSHOT).coalesce(1), i, f"{tmp_path}/sink", f"{tmp_path}/state", "s")
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["run=6", "run=7", "run=8"]
    assert streams.changes_so_far(spark, f"{tmp_path}/sink", f"{tmp_path}/state").count() == 17


def run_slots(spark, tmp_path, source, check, computed):
    def compute(df):
        computed.extend(sorted(r.content_key or "" for r in df.collect()))
        return df.withColumn("result", F.upper("payload"))

    stream = spark.readStream.schema(SLOT).parquet(str(source))
    streams.incremental_slots(stream, f"{tmp_path}/results", f"{tmp_path}/{check}", compute).trigger(availableNow=True).start().awaitTermination()
    return sorted((r.content_key or "", r.slot_id, r.result) for r in spark.read.parquet(f"{tmp_path}/results").collect())


def test_slots_with_a_new_checkpoint(spark, tmp_path):
    computed = []
    add(spark, tmp_path / "one", [("a", 5, "x"), ("a", 3, "y"), ("b", 1, None), (None, 7, "z")], SLOT)
    assert run_slots(spark, tmp_path, tmp_path / "one", "c1", computed) == [("", 7, "Z"), ("a", 3, "Y"), ("b", 1, None)]
    add(spark, tmp_path / "one", [("a", 1, "late"), ("c", 9, "w")], SLOT)
    run_slots(spark, tmp_path, tmp_path / "one", "c1", computed)
    add(spark, tmp_path / "two", [("b", 2, "again"), ("d", 4, "v"), ("c", 1, "q")], SLOT)
    got = run_slots(spark, tmp_path, tmp_path / "two", "c2", computed)
    assert got == [("", 7, "Z"), ("a", 3, "Y"), ("b", 1, None), ("c", 9, "W"), ("d", 4, "V")]
    assert computed == ["", "a", "b", "c", "d"]


def test_bytes_read_stay_flat(spark, tmp_path):
    """A batch of a running stream reads no earlier result of its own, however many batches came before."""
    plans = []

    def compute(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    for i in range(20):
        add(spark, tmp_path / "in", [(f"k{i}", i, "p"), ("k0", i, "p")], SLOT)
    stream = spark.readStream.schema(SLOT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        streams.incremental_slots(stream, f"{tmp_path}/results", f"{tmp_path}/c", compute).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    results = spark.read.parquet(f"{tmp_path}/results")
    assert results.count() == 20
    own = results.select("stream").distinct().collect()
    assert len(own) == 1 and len(plans) == 20
    read = [plan.split("PartitionFilters: [")[1].split("]")[0] for plan in plans if "PartitionFilters: [" in plan]
    assert len(read) >= 19 and all(f"= {own[0].stream})" in x and "NOT (stream" in x for x in read)
