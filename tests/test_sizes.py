"""Work that must not grow with a batch, a partition or a table's number of files."""

import os

import pyarrow as pa
import pytest

from meetloom.plans import queries, source_queries
from meetloom.sources import documents

DATA = "/root/testdata/sf0.001"


class Frame:
    """Stands for a DataFrame, of which mapInArrow gives the function that tasks run."""

    def select(self, *_):
        return self

    repartition = sortWithinPartitions = select

    def mapInArrow(self, run, _):
        return run


def cell(doc_id, row, text="x"):
    return {"doc_id": doc_id, "table_idx": 0, "row_idx": row, "tc_idx": 1, "grid_span": 1, "v_merge": None, "fill": None, "text": text}


def test_documents_are_opened_one_at_a_time(monkeypatch):
    monkeypatch.setattr(documents, "ROWS_AT_ONCE", 10)
    content = source_queries.build_document([cell(1, r) for r in range(25)])
    opened = []
    read = documents.document_rows
    monkeypatch.setattr(documents, "document_rows", lambda c: opened.append(1) or read(c))
    run = documents.extract_tables(Frame())
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i}" for i in range(8)]), pa.array([content] * 8, pa.binary())], names=["path", "content"])
    out = run(iter([batch]))
    assert next(out).num_rows == 10 and len(opened) == 1
    assert 10 + sum(b.num_rows for b in out) == 8 * 27 and len(opened) == 8


def test_documents_are_built_one_at_a_time():
    taken = []

    def batches():
        for k in range(4):
            taken.append(k)
            yield pa.RecordBatch.from_pylist([cell(k, r) for r in range(5)] + [cell(k + 1, 5)])

    out = source_queries._files(Frame())(batches())
    first = next(out)
    assert first["path"].to_pylist() == ["0.docx"] and taken == [0]
    rest = [p for b in out for p in b["path"].to_pylist()]
    assert rest == ["1.docx", "2.docx", "3.docx", "4.docx"]


def test_archives_are_packed_one_at_a_time():
    batch = pa.RecordBatch.from_pylist([{"path": "2.docx", "content": b"a"}, {"path": "3.docx", "content": b"b"}])
    assert [b["path"].to_pylist() for b in source_queries._zipped(iter([batch]))] == [["2.zip"], ["3.docx"]]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_tables_in_part_files_are_one_document(spark, tmp_path):
    tables = tmp_path / "a b.parquet" / "in"
    spark.range(10).repartition(3).write.parquet(str(tables / "orders.parquet"))
    spark.range(1).write.parquet(str(tables / "part.parquet"))
    for given in (str(tables), f"file://{tables}/"):
        found = queries.QUERIES["s3_read_documents"](spark, given).collect()
        assert sorted(map(tuple, found)) == [("orders.parquet", True), ("part.parquet", True)]


def plan_of(spark, name):
    return queries.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_room_metadata_keeps_a_row_a_document(spark):
    plan = plan_of(spark, "a11_room_metadata")
    assert "Generate" not in plan and "Window" not in plan


def test_room_metadata_of_odd_texts(spark):
    from meetloom.operators import grid

    texts = ["Meeting Rooms", "meeting rooms\n\n a \nMEETING ROOMS\nMeeting rooms\nOff (x, y)\nb", "first\nmeeting rooms off\nc (d) (e)\nmeeting rooms\nf"]
    cells = spark.createDataFrame([(i, 0, 0, 0, t) for i, t in enumerate(texts)], "doc_id int, table_idx int, row_idx int, tc_idx int, text string")
    assert sorted(map(tuple, grid.room_metadata(cells).collect())) == [(1, ["a"], ["x", "b"]), (2, ["f"], None)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_room_columns_keep_a_row_a_cell(spark):
    assert "min(CASE" not in plan_of(spark, "j11_cell_room_columns")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["j13_rooms_from_context", "j14_resolve_generic_rooms"])
def test_rooms_of_contexts_keep_a_row_a_context(spark, name):
    plan = plan_of(spark, name)
    assert not any("Window" in line and "context_id" in line for line in plan.split("\n"))
    assert not any("Aggregate" in line and "context_id" in line for line in plan.split("\n"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_merged_slots_are_sorted_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = queries.QUERIES["j4_j6_merge_slots"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [x.strip(" :+-*(0123456789)") for x in plan.split("\n")]
    assert sum(x.startswith("Sort [meeting_id") and " tb#" in x for x in lines) == 1, plan
    assert sum(x.startswith("Exchange") for x in lines) <= 4, plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_layout_reads_times_once(spark):
    """Else the filter repeats them below, in code that is too long for Java to compile."""
    filters = [line for line in plan_of(spark, "f19_f20_layout").split("\n") if "Filter" in line]
    assert not any("split" in line for line in filters)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_labels_are_not_compared_with_all_of_their_meeting(spark):
    assert "collect_list" not in plan_of(spark, "f26_label_election")
    plan = plan_of(spark, "f26_j7_simplified_groups")
    assert not any(kind in plan for kind in ("LeftOuter", "LeftSemi"))


def test_mapping_of_odd_meetings(spark):
    """A meeting without a key, one with one group, a mapping of no group and one that maps to nothing."""
    from meetloom.operators import timeline

    sessions = spark.createDataFrame([(None, 1, "A"), (None, 2, "B"), (1, 3, "A"), (1, 4, ""), (2, 5, "A"), (2, 6, "B"), (2, 7, None), (2, 8, "C")], "meeting_id long, ord long, group_header string")
    rows = [(m, o, g, s) for m in (None, 1, 2) for o, g, s in ((1, "A", "x"), (2, "A", "y"), (3, None, "z"), (4, "C", None), (5, "D", "d"))]
    got = timeline.apply_group_mapping(sessions, spark.createDataFrame(rows, "meeting_id long, ord long, original string, simplified string"))
    assert got.columns == sessions.columns
    assert {r.ord: r.group_header for r in got.collect()} == {1: "A", 2: "B", 3: "A", 4: "", 5: "y", 6: "B", 7: None, 8: "C"}


def test_meetings_of_a_schedule_share_files(spark, tmp_path):
    from meetloom.sources import state

    path = str(tmp_path / "schedule")
    state.write_schedule(spark.range(500).selectExpr("id % 300 AS meeting_id", "id AS ord").unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS meeting_id, 500L AS ord")), path)
    assert sum(f.endswith(".parquet") for _, _, files in os.walk(path) for f in files) <= 10
    assert sorted(r.ord for r in state.read_schedule(spark, path).collect()) == list(range(501))
    state.write_schedule(spark.sql("SELECT * FROM VALUES (7L, 1000L), (CAST(NULL AS LONG), 1001L) AS t(meeting_id, ord)"), path)
    assert sorted(r.ord for r in state.read_schedule(spark, path).collect()) == [*(i for i in range(500) if i % 300 != 7), 1000, 1001]


def test_versions_do_not_pile_up(spark, tmp_path, monkeypatch):
    from meetloom.sources import state

    monkeypatch.setattr(state, "COMPACT", 2)
    path = str(tmp_path / "p")
    for n in range(5):
        other = spark.range(3).selectExpr("id AS meeting_id", f"{n} AS w").where("false" if n == 4 else f"meeting_id <= {n}")
        state.publish({"one": spark.range(3).selectExpr("id AS meeting_id", f"{n} AS v").where(f"meeting_id % 3 = {n % 3}"), "two": other}, path)
    assert sorted(map(tuple, state.read_published(spark, path, "one").collect())) == [(0, 3), (1, 4)]
    assert sorted(map(tuple, state.read_published(spark, path, "two").collect())) == [(0, 3), (2, 3)]
    assert len(os.listdir(f"{path}/one")) <= 5


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_published_tables_are_made_of_sessions_made_once(spark, monkeypatch):
    given = []
    publish = source_queries.state.publish
    monkeypatch.setattr(source_queries.state, "publish", lambda tables, path: given.extend(tables.values()) or publish(tables, path))
    queries.QUERIES["s8_publish_together"](spark, DATA)
    assert len(given) == 6 and not any(DATA in file for table in given for file in table.inputFiles())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_facet_tree_deals_sessions_once(spark):
    assert exchanges(spark, "a4_facet_tree") == 4  # three of them of the view: items, and its join's two sides


def exchanges(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return sum(x.strip(" :+-*(0123456789)").startswith("Exchange") for x in plan.split("\n"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["p11_expanded_choice", "p11_apply_facets"])
def test_facets_are_windows_over_sessions(spark, name):
    assert exchanges(spark, name) == 4 and plan_of(spark, name).count("Join") == 1  # of items with their parts


def test_different_sessions_of_one_key(spark):
    """Both are "a|b|c": what one has without an item is chosen by the key, so is the other's."""
    from meetloom.operators import layout

    rows = [(1, "a|b", None, "c"), (1, "a", "9.1", "b|c"), (1, "a", None, "b|c"), (None, "a|b", None, "c"), (1, None, None, "c")]
    sessions = spark.createDataFrame(rows, "meeting_id long, name string, agenda_item string, group_header string")
    got = layout.apply_facets(sessions, [], [], [], groups=["c"]).collect()
    assert sorted((r["name"], r.agenda_item or "") for r in got) == [("a", ""), ("a", "9.1"), ("a|b", "")]
