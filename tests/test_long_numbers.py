"""Numbers of any length in file, meeting and other names."""

import datetime

import pytest
from pyspark.sql import functions as F

from meetloom.functions import text as T
from meetloom.operators import catalog

LISTING = "inbox_id long, folder string, list_pos int, name string, url string, uploaded_at timestamp"


@pytest.mark.parametrize(("names", "want"), [
    (["RAN1#124 schedule - v02.docx", "RAN1#99999999999 Schedule v02.docx"], 1),
    (["RAN1#124 schedule - v202401151230.docx", "RAN1#124 schedule - v07.docx"], 0),
    (["RAN1#124 schedule - v20240115123059.docx", "RAN1#124 schedule - v20240115123100.docx"], 1),
    (["RAN1#124 schedule - v0000000000000000007.docx", "RAN1#124 schedule - v06.docx"], 0),
    (["RAN99999999999#1 schedule.docx", "RAN1#124bis schedule.docx"], 0),
    ([f"RAN1#124 schedule - v{'9' * 60}.docx", f"RAN1#124 schedule - v1{'0' * 60}.docx"], 1),
])
def test_latest_with_long_numbers(spark, names, want):
    rows = spark.createDataFrame([(1, "f", i, n, "u", datetime.datetime(2026, 1, 1)) for i, n in enumerate(names)], LISTING)
    assert [r.list_pos for r in catalog.latest_schedule(rows).collect()] == [want]
    assert catalog.dedup_listing(rows).count() == 1
    assert catalog.latest_chair_notes(rows.withColumn("name", F.regexp_replace("name", "(?i)schedule", "chair notes"))).first().list_pos == want
    assert catalog.discover_sources(rows.withColumn("folder", F.lit("Chair_notes"))).first().list_pos == want


def test_natural_order_of_long_numbers(spark):
    long = "1234567890" * 4
    values = [f"a{long}1", f"a{long}", "a2", "a10", f"a0{long}0", "a000", long, "7"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r.v for r in rows.orderBy(T.natural_key(F.col("v")), "v").collect()]
    assert got == ["7", long, "a000", "a2", "a10", f"a{long}", f"a0{long}0", f"a{long}1"]
