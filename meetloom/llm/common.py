"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BATCH_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def ascii_lower(c: Column | str) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")), UPPER, LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it with that as its source.

    The cluster names the folder in spark.checkpoint.dir. Only a local master, as in
    tests, gets a folder of its own when that is unset.
    """
    shared_folder(df.sparkSession)
    bounded_batches(df.sparkSession)
    return df.checkpoint()


def tasks_for(spark: SparkSession) -> int:
    """Partitions for a stage that is CPU bound in Python."""
    return max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the key as text leaves 2 modulo 4."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def bounded_batches(spark: SparkSession) -> None:
    """Python workers get whole documents in batches of BATCH_ROWS rows at most (and of Spark's own bound of bytes).

    This sets the session's Arrow batch size for good: plans that are returned run later.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def stage_table(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again; with so many rows a file at most, where rows are large."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_table(table: DataFrame) -> None:
    """Deletes the files of a stage's table, which nothing reads any more."""
    spark = table.sparkSession
    paths = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
