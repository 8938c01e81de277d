"""How often the longer queries shuffle and scan."""

import os

import pytest

from meetloom.plans import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize(
    ("name", "shuffles", "scans"),
    [("w2_p8_assign_rooms", 2, 1), ("a3_actual_rooms_per_day", 2, 1), ("w7_table_column_colors", 2, 1), ("j12_match_rooms_by_color", 4, 2), ("w8_generic_room_names", 6, 4), ("u7_discover_sources", 2, 1), ("j4_j6_merge_slots", 4, 2), ("f18_slot_payload", 5, 2), ("j9_fill_group_by_substring", 4, 2), ("j10_room_columns", 7, 3), ("s5_text_box_labels", 4, 1), ("u2_dedup_sources", 1, 1)],
)
def test_shuffles(spark, name, shuffles, scans):
    """One of the grid's shuffles makes the cells themselves from the given table."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [x.strip(" :+-*(0123456789)") for x in plan.split("\n")]
    assert sum(x.startswith("Exchange") for x in lines) <= shuffles, plan
    assert sum("Scan parquet" in x for x in lines) <= scans, plan
