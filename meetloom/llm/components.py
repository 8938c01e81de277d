"""Connected components of a table of links.

Tasks of up to TASK_LINKS links contract them to spanning stars; what spans several tasks
goes on by alternating large and small stars. Links that one task holds are done at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


TASK_LINKS = 10_000


def _neighbours(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    near = _neighbours(links)
    least = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return near.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a != b")


def _small_star(links: DataFrame) -> DataFrame:
    # a < b in every link, so b's smaller neighbours are its a
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    inner = links.join(least, "b").select(F.col("m"), F.col("a").alias("v")).where("m != v")
    return inner.unionByName(least.select("m", F.col("b").alias("v"))).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning star of every component among a partition's links."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.get(i, i)) != i:
            root[i] = i = root.get(up, up)
        return i

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    ids = [i for i in root if find(i) != i]
    yield pa.RecordBatch.from_arrays([pa.array([find(i) for i in ids], pa.int64()), pa.array(ids, pa.int64())], names=["a", "b"])


def _is_done(links: DataFrame) -> bool:
    """Whether links are stars: every id either has links as the smaller one, or a single link."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(links.select(F.col("b").alias("id"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    return not ends.groupBy("id").agg(F.max("x").alias("x"), F.sum("y").alias("y")).where("y > 1 OR (x = 1 AND y = 1)").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id in links (a, b) other than a component's smallest, that smallest id."""
    links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b"))
    while True:
        tasks = max(1, -(-links.count() // TASK_LINKS))
        near = links.repartition(tasks).mapInArrow(_contract, "a long, b long")
        links = cut(near if tasks == 1 else _small_star(_large_star(near)))
        if tasks == 1 or _is_done(links):
            return links.select(F.col("b").alias("id"), F.col("a").alias("component"))
