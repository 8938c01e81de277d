"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's target repetition rate is its target share of the mixed corpus over its rows.
Each document draws a number of copies by inverting the Poisson distribution with that mean
at a point hashed from seed, identifier and text; it is exploded by that count, and all
copies are shuffled globally into the order of a hashed key.

Defined cases: a null source is a source of its own; null text counts as empty for the
draw and stays null; fully repeated rows draw the same count; a source missing from given
weights has weight 0 and leaves; an empty table gives an empty result; further columns are
carried, and where one of them has the name of a column that mixing adds, the added one is
called `mix_` and that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stage_table

POINT_BITS = 52
SEED = "mix-1"


def _point(*parts) -> F.Column:
    """A point in (0, 1) hashed from the parts."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(2**POINT_BITS)


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temper: float = 0.5, growth: float = 1.0, source: str = "source") -> DataFrame:
    """A row per source: rows, rate and the Poisson distribution's cumulated terms.

    weights are relative target shares; without them a source weighs its row count to the
    power `temper`. `growth` is the size of the mix over that of the input. Terms go on
    until mean + 12 deviations + 30, beyond which no 52-bit point lies.
    """
    counts = docs.groupBy(F.col(source).alias("__source")).agg(F.count("*").alias("n_rows"))
    if weights is None:
        share = F.pow(F.col("n_rows").cast("double"), F.lit(temper))
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("__source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(share)
    shares = counts.withColumn("__share", share)
    total = shares.agg(F.sum("__share").alias("all"), F.sum("n_rows").alias("rows")).first()  # one row
    scale = (total["rows"] or 0) * growth / (total["all"] or 1.0)
    rates = shares.withColumn("rate", F.col("__share") * F.lit(float(scale)) / F.col("n_rows"))
    start = F.struct((-F.col("rate")).alias("log"), F.exp(-F.col("rate")).alias("sum"), F.array(F.exp(-F.col("rate"))).alias("all"))

    def step(acc, k):
        log = acc["log"] + F.log(F.col("rate")) - F.log(k.cast("double"))
        now = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), now.alias("sum"), F.concat(acc["all"], F.array(now)).alias("all"))

    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    terms = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(1), last), start, step)["all"])
    return rates.select("__source", "n_rows", "rate", terms.alias("__terms"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, temper: float = 0.5, growth: float = 1.0, seed: str = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs replicated to target weights: all columns, copy_no from 1, rate and order_key.

    The result is shuffled globally: partition i holds the i-th part of the range of
    order_key, sorted by it.
    """
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    own = docs.toDF(*names.values())  # columns may have any name
    # a table whose size Spark knows is broadcast only if it is small
    rates = stage_table(source_rates(own, weights, temper, growth, names[source]), "rates")
    doc_id, content = F.col(names[key]), F.col(names[text])
    parts = [F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(content, F.lit("")).cast("binary"))]
    copies = F.when(F.col("rate") > 0, F.size(F.filter("__terms", lambda c: c < F.col("__point")))).otherwise(0)
    drawn = (
        own.withColumn("__point", _point(*parts))
        .join(rates, F.col(names[source]).eqNullSafe(F.col("__source")))
        .withColumn("__copies", copies)
        .where("__copies > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    )
    n = shuffle_partitions(docs.sparkSession)
    digest = F.md5(F.concat_ws(":", F.lit("order"), *parts, F.col("copy_no").cast("string")).cast("binary"))
    keyed = drawn.withColumn("order_key", F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"))
    part = F.floor(F.col("order_key") / float(2**POINT_BITS) * n).cast("int")
    added = ("copy_no", "rate", "order_key")
    mixed = keyed.select(*names.values(), *added).repartitionById(n, part).sortWithinPartitions("order_key", names[key], "copy_no")
    return mixed.select(*[F.col(n).alias(c) for c, n in names.items()], *[F.col(c).alias(f"mix_{c}" if c in names else c) for c in added])
