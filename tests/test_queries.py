"""Every query with oracle SQL against DuckDB on the smallest tables."""

import datetime
import math
import os

import pytest

import __spark_entry__ as entry
from meetloom.plans import queries as own
from meetloom.plans.adapters import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_matches_oracle(spark, con, name):
    df = own.QUERIES[name](spark, DATA)
    order = sorted(df.columns)
    ours = sorted([tuple(plain(r[c]) for c in order) for r in df.collect()], key=str)
    rel = con.sql(own.ORACLE_SQL[name])
    assert sorted(rel.columns) == order
    at = [rel.columns.index(c) for c in order]
    theirs = sorted([tuple(plain(r[i]) for i in at) for r in rel.fetchall()], key=str)
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry():
    names = set(entry.queries())
    assert set(own.QUERIES) <= names
    assert set(entry.oracle_sql()) <= names


def test_result_does_not_depend_on_partitions(spark):
    from meetloom.operators import catalog
    from meetloom.plans.adapters import view

    listing = view(spark, DATA, "listing")
    a, b = (set(catalog.latest_schedule(listing.repartition(n)).collect()) for n in (1, 9))
    assert a == b
