"""Literal cases of names, picking, state, grid, timeline, grammar, documents and streams."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from meetloom.functions import names as N
from meetloom.functions import text as T
from meetloom.operators import catalog, changes, grid, layout, slots, timeline
from meetloom.operators.grammar import parse_cell
from meetloom.plans.source_queries import build_document
from meetloom.sources import documents, listing, state
from meetloom.streaming import changes as streams

LISTING = "inbox_id long, folder string, list_pos int, name string, url string, uploaded_at timestamp"


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return rows.select(column.alias("v")).first().v


def at(text):
    return datetime.datetime.strptime(text, "%Y-%m-%d %H:%M") if text else None


@pytest.mark.parametrize(("name", "want"), [
    ("RAN1#124 online and offline schedules - v02.docx", "ran1#124"),
    ("RAN1#124bis schedule_v07.docx", "ran1#124bis"),
    ("RAN1#124-bis schedule - v01.docx", "ran1#124bis"),
    ("ran1#124BIS schedule - v01.docx", "ran1#124bis"),
    ("RAN1#120-e online schedules - v03.docx", "ran1#120e"),
    ("RAN1#120 adhoc schedule_v01.docx", "ran1#120adhoc"),
    ("RAN2#99 online schedules - v01.docx", "ran2#99"),
    ("Draft RAN1#124bis online and offline schedules - v01.docx", "ran1#124bis"),
    ("custom schedule name.docx", None),
])
def test_meeting_id(spark, name, want):
    assert one(spark, N.meeting_id(F.col("n")), n=name) == want


@pytest.mark.parametrize(("files", "want"), [
    ([("RAN1#124bis schedule - v02.docx", "2026-04-14 08:00"), ("Draft RAN1#124bis schedule - v01.docx", "2026-04-14 13:00")], 0),
    ([("RAN1#123 schedule - v09.docx", "2026-01-15 10:00"), ("RAN1#124bis schedule - v01.docx", "2026-04-14 08:00")], 1),
    ([("schedule - v01.docx", "2026-04-14 08:00"), ("schedule - v02.docx", "2026-04-14 07:00")], 1),
    ([("RAN1#124 schedule - v05.docx", "2026-04-14 08:00"), ("RAN1#124bis schedule - v01.docx", "2026-04-13 08:00")], 1),
    ([("RAN1#124bis schedule - v01.docx", None), ("RAN1#124bis schedule - v03.docx", None)], 1),
    ([("schedule.docx", None), ("another schedule.docx", None)], 0),
    ([("schedule v9.docx", None), ("old schedule.docx", "2026-01-01 00:00")], 1),
    ([("agenda_v01.docx", "2026-04-14 08:00")], None),
    ([], None),
])
def test_latest_schedule(spark, files, want):
    rows = spark.createDataFrame([(1, "f", i, n, "u", at(t)) for i, (n, t) in enumerate(files)], LISTING)
    got = catalog.latest_schedule(rows).collect()
    assert [r.list_pos for r in got] == ([] if want is None else [want])


def test_preferred_meeting(spark):
    rows = spark.createDataFrame([(1, "f", 0, "RAN1#124 schedule v01.docx", "u", at("2026-01-01 00:00"), "ran1#124"), (1, "f", 1, "RAN1#125 schedule v01.docx", "u", at("2026-02-01 00:00"), "ran1#124")], LISTING + ", pin string")
    assert catalog.latest_schedule(rows, preferred="pin").first().list_pos == 0


def test_latest_chair_notes(spark):
    rows = [(1, "a", 0, "RAN1#124 chair notes v02.docx", "u", at("2026-03-01 00:00")), (1, "a", 1, "RAN1#125 chairman notes v01.docx", "u", at("2026-02-01 00:00")), (1, "b", 2, "RAN1#125 chair_notes v03.docx", "u", at("2026-01-01 00:00"))]
    assert catalog.latest_chair_notes(spark.createDataFrame(rows, LISTING)).first().list_pos == 2


def test_dedup_sources(spark):
    schema = "meeting_id long, ord long, folder string, person string, is_main boolean, url string, uploaded_at timestamp"
    rows = [(1, 0, "A", None, True, "", at("2026-01-01 00:00")), (1, 1, "B", None, True, "", at("2026-02-01 00:00")), (1, 2, "C", "Ana", False, "", None), (1, 3, "D", "Ana", False, "", at("2026-01-01 00:00"))]
    got = {(r.ord, r.kind, r.is_main) for r in catalog.dedup_sources(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 0, True), (0, 2, False), (3, 1, False)}


ENTRIES = "inbox_id long, folder string, name string, uploaded_at timestamp"


@pytest.mark.parametrize(("cached", "remote", "want"), [
    ([("f", "a", "2026-01-01 00:00")], [("f", "a", "2026-01-01 00:00")], False),
    ([("f", "a", None), ("f", "b", None)], [("f", "a", None)], False),
    ([("f", "a", "2026-01-01 00:00")], [("f", "a", "2026-01-02 00:00")], True),
    ([], [("f", "a", None)], True),
    ([("f", "a", None)], [], False),
])
def test_snapshot_changed(spark, cached, remote, want):
    frames = [spark.createDataFrame([(1, f, n, at(t)) for f, n, t in rows], ENTRIES) for rows in (remote, cached)]
    assert changes.snapshot_changed(*frames).first().changed is want
    assert changes.snapshot_diff(frames[0], frames[0]).count() == 0


@pytest.mark.parametrize(("text", "files", "meeting"), [
    ("not json", None, None),
    (None, None, None),
    ('[{"folder":"Chair_notes","name":"sched.docx","uploaded_at":"2026-01-01T00:00:00"}]', [("Chair_notes", "sched.docx", "2026-01-01T00:00:00")], None),
    ('{"files":[{"folder":"F","name":"s","uploaded_at":null}],"meeting_id":"ran1#124bis","timezone":"Europe/Malta"}', [("F", "s", None)], "ran1#124bis"),
    ('{"files":{"name":"s","uploaded_at":"x"}}', [(None, "s", "x")], None),
])
def test_state(spark, text, files, meeting):
    got = state.parse_state(spark.createDataFrame([(1, text)], "inbox_id long, state string")).first()
    assert (None if got.files is None else [tuple(f) for f in got.files]) == files
    assert got.meeting_id == meeting


@pytest.mark.parametrize(("runs", "want"), [
    ([(0, "hello", False), (0, " world", False)], "hello world"),
    ([(0, "Kim (150) 6GR ", False), (0, ".10.5.1.2 (30)", True), (0, " .10.5.1.3 (60)", False)], "Kim (150) 6GR ~~.10.5.1.2 (30)~~ .10.5.1.3 (60)"),
    ([(0, "line1", False), (1, "line2", False)], "line1\nline2"),
    ([(0, "keep", False), (0, "remove", True), (0, "also keep", False)], "keep~~remove~~also keep"),
    ([], ""),
])
def test_strike_markup(spark, runs, want):
    rows = spark.createDataFrame([(runs,)], "runs array<struct<para:int,text:string,strike:boolean>>")
    assert rows.select(T.strike_markup(F.col("runs"))).first()[0] == want


@pytest.mark.parametrize(("label", "want"), [("08:30\n~\n10:30\n\n(120 min)", 0), ("09:00\n~\n10:30\n\n(90 min)", 0), ("9:00", 0), ("10:30\n~\n11:00\n\n(30 min)", None), ("lunch", None)])
def test_time_block(spark, label, want):
    assert one(spark, grid.time_block(F.col("t")), t=label) == want


@pytest.mark.parametrize(("cells", "width", "n", "want"), [
    ([(0, 2), (2, 3), (3, 4)], 4, 3, [(0, 0), (1, 1), (2, 2)]),
    ([(0, 4)], 4, 3, [(0, 2)]),
    ([(0, 2), (2, 4)], 4, 3, [(0, 1), (2, 2)]),
])
def test_assign_rooms(spark, cells, width, n, want):
    rows = [(1, 0, 1, i, "Monday", 0, 0, width, a, b, "x") for i, (a, b) in enumerate(cells)]
    rows += [(1, 0, 2, i, "Monday", 0, 0, width, i, i + 1, "x") for i in range(n)]  # the day's rooms
    in_day = spark.createDataFrame(rows, "doc_id long, table_idx int, row_idx int, tc_idx int, day string, tb int, day_start int, day_end int, col_start int, col_end int, text string")
    assert [(r.room_from, r.room_to) for r in grid.assign_rooms(in_day).where("row_idx = 1").orderBy("tc_idx").collect()] == want


ITEMS = "slot long, room_name string, ord int, duration_minutes int, specified_start_time string, block_start string, name string, agenda_item string, group_header string"


@pytest.mark.parametrize(("block", "items", "want"), [
    ("08:30", [(60, None), (0, None), (40, None)], [("08:30", "09:30"), ("09:30", "10:10")]),
    ("14:30", [(30, None), (60, "14:00"), (20, None)], [("14:30", "15:00"), ("14:00", "15:00"), ("15:00", "15:20")]),
    ("14:30", [(30, "x"), (20, "soon")], [("14:30", "15:00"), ("15:00", "15:20")]),
])
def test_timeline(spark, block, items, want):
    rows = [(1, "F1", i, d, s, block, "n", None, "") for i, (d, s) in enumerate(items)]
    got = timeline.timeline(spark.createDataFrame(rows, ITEMS), ["slot"]).orderBy("ord").collect()
    assert [(r.start_time, r.end_time) for r in got] == want


@pytest.mark.parametrize(("name", "group", "want"), [("AI 9.1.1 Waveform", "", ("9.1.1", "Waveform")), (".10.5.4.1", "", ("10.5.4.1", ".10.5.4.1")), ("Misc", "AI 9.1. X", ("9.1", "Misc")), ("Misc", "", (None, "Misc"))])
def test_agenda(spark, name, group, want):
    rows = spark.createDataFrame([(name, None, group)], "n string, i string, g string")
    assert tuple(rows.select(T.agenda_item(F.col("n"), F.col("i"), F.col("g")), T.session_name(F.col("n"), F.col("i"))).first()) == want


def test_fill_groups(spark):
    rows = [(1, 0, "NTN", "R20"), (1, 1, "NTN", ""), (1, 2, "R20 NTN-IoT", ""), (1, 3, "x", "NTN-IoT"), (1, 4, "y", None), (2, 0, "NTN", "")]
    got = timeline.fill_groups(spark.createDataFrame(rows, "meeting_id long, ord int, name string, group_header string")).collect()
    assert {(r.meeting_id, r.ord): r.group_header for r in got} == {(1, 0): "R20", (1, 1): "R20", (1, 2): "NTN-IoT", (1, 3): "NTN-IoT", (1, 4): "", (2, 0): ""}


def test_room_aliases(spark):
    rows = [(1, "Monday", 0, 0, "F1"), (1, "Monday", 0, 1, "A1"), (1, "Monday", 1, 2, "J1")]
    rooms = spark.createDataFrame(rows, "meeting_id long, day string, table_index int, pos int, name string")
    got = {r.alias: r["name"] for r in slots.room_aliases(rooms, ["meeting_id", "day"]).collect()}
    assert got == {"RAN1_main": "F1", "RAN1_brk1": "A1", "RAN1_off1": "J1", "ALL_ONLINE": "F1 + A1", "ALL_ROOMS": "F1 + A1 + J1"}


def test_aliases_of_repeated_rooms(spark):
    """A room in two tables, and an eleventh room: of a name's aliases the last counts, ALL_ROOMS names it once."""
    rows = [(1, "Monday", 0, i, f"R{i}") for i in range(12)] + [(1, "Monday", 1, 20, "R10"), (1, "Monday", 1, 21, "J1")]
    rooms = spark.createDataFrame(rows, "meeting_id long, day string, table_index int, pos int, name string")
    aliases = slots.room_aliases(rooms, ["meeting_id", "day"])
    got = {r.alias: r["name"] for r in aliases.collect()}
    assert (got["RAN1_brk10"], got["RAN1_off1"], got["RAN1_off2"]) == ("R10", "R10", "J1")
    assert got["ALL_ROOMS"] == " + ".join([*(f"R{i}" for i in range(12)), "J1"])
    assert got["ALL_ONLINE"] == " + ".join(f"R{i}" for i in range(12))
    names = slots.alias_map(aliases, ["meeting_id", "day"]).first().aliases
    assert (names["R10"], names["R11"], names["R0"], names["J1"]) == ("RAN1_off1", "RAN1_brk11", "RAN1_main", "RAN1_off2")


def test_contexts_of_two_meetings(spark):
    """Equal context ids in two meetings don't mix their rooms."""
    rooms = spark.createDataFrame([(m, "Monday", 0, i, f"{n}{i}") for m, n in ((1, "F"), (2, "G")) for i in range(3)], "meeting_id long, day string, table_index int, room_idx int, name string")
    contexts = spark.createDataFrame([(m, 7, "online sessions", 2) for m in (1, 2)], "meeting_id long, context_id long, context string, n_rooms int")
    got = {r.meeting_id: r.rooms for r in slots.rooms_from_context(contexts, slots.room_hints(rooms)).collect()}
    assert got == {1: ["F0", "F1"], 2: ["G0", "G1"]}
    tables = contexts.drop("n_rooms").withColumn("rooms", F.array(F.lit("Room A"), F.lit("Room B"), F.lit("Room C")))
    assert {r.meeting_id: r.rooms for r in slots.resolve_generic_rooms(tables, slots.room_hints(rooms)).collect()} == {1: ["F0", "F1", "F2"], 2: ["G0", "G1", "G2"]}


def test_natural_sort(spark):
    rows = spark.createDataFrame([(v,) for v in ("10.1", "9.10", "9.2")], "v string")
    assert [r.v for r in rows.orderBy(T.natural_key(F.col("v"))).collect()] == ["9.2", "9.10", "10.1"]


def test_colors_match(spark):
    match = T.colors_match(F.col("a"), F.col("b"))
    assert one(spark, match, a="D9D9D9", b="D8D8D8") is True
    assert one(spark, match, a="FFFFFF", b="F0F0F0") is False


def test_layout(spark):
    schema = "start_time string, end_time string, duration_minutes int, room_col_start int, room_col_end int, rooms array<string>, chair string, agenda_item string"
    rows = [("08:30", "08:33", 3, 2, 3, ["a", "b", "c"], "X", "1.2"), ("10:00", "11:30", 90, 7, 9, ["a", "b", "c"], "X", "1.2"), ("10:00", "10:00", 0, 2, 3, ["a"], None, None)]
    got = layout.layout_block(spark.createDataFrame(rows, schema)).orderBy("start_time").collect()
    assert [(r.row_start, r.row_end, r.is_tiny, r.is_long, r.col_start, r.col_end) for r in got] == [(2, 3, True, False, 2, 3), (20, 38, False, True, 2, 3)]


@pytest.mark.parametrize(("text", "want"), [
    ("Kim (120)\n6GR\n.10.6.x (60)\n.10.5.4.1 (40)\n.10.5.4.3 (20)", [("10.6.x", 60, "Kim", "6GR"), ("10.5.4.1", 40, "Kim", "6GR"), ("10.5.4.3", 20, "Kim", "6GR")]),
    ("R20 (80)\nNTN-NR (40)\nNTN-IoT (40)\n6GR (40)\n.10.7.1 NTN (40)", [("NTN-NR", 40, None, "R20"), ("NTN-IoT", 40, None, "R20"), ("10.7.1 NTN", 40, None, "6GR")]),
    ("R20 A-IoT (120)", [("R20 A-IoT", 120, None, "")]),
    ("Ann (120)\nR20\nA-IoT (120)", [("A-IoT", 120, "Ann", "R20")]),
    ("a (30)\n~~b (20)~~", [("a", 30, None, "")]),
    (None, []),
])
def test_cell_grammar(text, want):
    got = parse_cell(text, frozenset({"Kim", "Ann"}))
    assert [(x["name"], x["duration_minutes"], x["chair"], x["group_header"]) for x in got] == want


def test_cell_grammar_times():
    got = parse_cell("14:00 ~ 15:00\nOpen issues\n. reports\n15:00 ~ 17:00\nJoint session")
    assert [(x["name"], x["duration_minutes"], x["specified_start_time"]) for x in got] == [("Open issues", 60, "14:00"), ("Joint session", 120, "15:00")]


PAGE = """<table><tr><th>x</th></tr><tr><td></td><td></td><td><a href="/in/RAN1%23124%20a+b.DOCX">n</a></td><td> 2026/2/8 9:05 </td></tr>
<tr><td></td><td></td><td><a href="https://other/Chair_notes/">d</a></td><td>never</td></tr><tr><td></td><td><a href="a.docx">short</a></td></tr></table>"""


def test_listing_page(spark):
    pages = spark.createDataFrame([(1, "f", "https://h/x", PAGE), (2, "f", "u", "Service Unavailable " + PAGE), (3, "f", "u", None)], "inbox_id long, folder string, url string, html string")
    files = listing.read_listing(pages).collect()
    assert [(r.inbox_id, r["name"], r.url, r.uploaded_at) for r in files] == [(1, "RAN1#124 a+b.DOCX", "https://h/x//in/RAN1%23124%20a+b.DOCX", datetime.datetime(2026, 2, 8, 9, 5))]
    folders = listing.read_folders(pages).collect()
    assert [(r["name"], r.url, r.uploaded_at) for r in folders] == [("Chair_notes", "https://other/Chair_notes/", None)]


def test_documents_from_files(spark, tmp_path):
    cells = [{"table_idx": 0, "row_idx": r, "tc_idx": c, "grid_span": 1 + c, "v_merge": None, "fill": "D9D9D9", "text": f"r{r}\nc{c}"} for r in range(2) for c in range(2)]
    content = build_document(cells)
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        for name, data in (("__MACOSX/x.docx", b""), ("a.pdf", b"p"), ("s/b.docx", content), ("c.docx", b"")):
            z.writestr(name, data)
    (tmp_path / "one.docx").write_bytes(content)
    (tmp_path / "two.zip").write_bytes(archive.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    (tmp_path / "gone.docx").write_bytes(b"Service unavailable")
    files = documents.resolve_archives(documents.read_documents(spark, str(tmp_path)))
    assert {r["name"] for r in files.collect()} == {"one.docx", "b.docx"}
    rows = documents.extract_tables(files)
    texts = documents.table_cells(rows).where("doc_id LIKE '%two.zip'").orderBy("row_idx", "tc_idx").collect()
    assert [(r.text, r.grid_span, r.fill) for r in texts] == [("r0\nc0", 1, "D9D9D9"), ("r0\nc1", 2, "D9D9D9"), ("r1\nc0", 1, "D9D9D9"), ("r1\nc1", 2, "D9D9D9")]
    contexts = grid.table_context(documents.body_blocks(rows)).collect()
    assert {r.context for r in contexts} == {"Table 0"}


def test_damaged_files_give_no_row(spark, tmp_path):
    cells = [{"table_idx": 0, "row_idx": r, "tc_idx": 0, "grid_span": 1, "v_merge": None, "fill": None, "text": f"some text {r} " * 40} for r in range(30)]
    content = build_document(cells)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.docx", content)
    good = packed.getvalue()
    broken = bytearray(good)
    broken[60:90] = b"\xff" * 30  # inside the deflated member
    locked = bytearray(good)
    for mark in (b"PK\x03\x04", b"PK\x01\x02"):
        locked[locked.index(mark) + (6 if mark == b"PK\x03\x04" else 8)] |= 1  # the flag of encryption
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").replace(b'<w:gridSpan w:val="1"/>', b'<w:gridSpan w:val="x"/>', 1))
    torn = bytearray(content)
    torn[len(torn) // 3 : len(torn) // 3 + 9] = b"\0" * 9
    for name, data in (("good.zip", good), ("broken.zip", broken), ("locked.zip", locked), ("span.docx", bad.getvalue()), ("torn.docx", torn), ("fine.docx", content)):
        (tmp_path / name).write_bytes(bytes(data))
    files = documents.resolve_archives(documents.read_documents(spark, str(tmp_path)))
    assert {r["path"].rsplit("/", 1)[-1] for r in files.collect()} == {"good.zip", "span.docx", "torn.docx", "fine.docx"}
    rows = documents.extract_tables(files).groupBy("path").count().collect()
    assert {r["path"].rsplit("/", 1)[-1]: r["count"] for r in rows} == {"good.zip": 32, "fine.docx": 32}


def test_lengths_need_no_content(spark, tmp_path):
    """Of large files only the listing is read."""
    (tmp_path / "large.docx").write_bytes(b"x" * 100_000)
    (tmp_path / "small.docx").write_bytes(b"x")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 5000)
    try:
        assert documents.read_documents(spark, str(tmp_path)).select("path", "length").count() == 2
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_change_stream(spark, tmp_path):
    schema = "inbox_id long, snapshot_id long, folder string, name string, uploaded_at timestamp"
    source = tmp_path / "in"
    snapshots = [
        [(1, 1, "f", "a", None), (1, 1, "f", "b", None)],
        [(1, 2, "f", "a", None)],  # partial outage
        [(1, 3, None, None, None)],  # failed
        [(1, 4, "f", "a", at("2026-01-01 00:00")), (1, 4, "f", "b", None)],
    ]
    seen = []
    for rows in snapshots:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        streams.change_stream(stream, f"{tmp_path}/sink", f"{tmp_path}/state", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/sink").collect()
        seen.append(sorted((r.change, r["name"], r.uploaded_at is not None) for r in got))
    assert seen[0] == seen[1] == seen[2] == [("added", "a", False), ("added", "b", False)]
    assert seen[3] == sorted([*seen[0], ("added", "a", True), ("removed", "a", False)])


def test_batch_run_again_is_harmless(spark, tmp_path):
    schema = "inbox_id long, snapshot_id long, folder string, name string, uploaded_at timestamp"
    first = spark.createDataFrame([(1, 1, "f", "a", None)], schema)
    second = spark.createDataFrame([(1, 2, "f", "b", None)], schema)
    for df, i in ((first, 0), (second, 1), (second, 1)):
        streams.accept(df, i, f"{tmp_path}/sink", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/sink").select("batch_id", "change", "name").collect()
    assert sorted(map(tuple, got)) == [(0, "added", "a"), (1, "added", "b"), (1, "removed", "a")]


def test_state_read_does_not_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "COMPACT", 4)
    schema = "inbox_id long, snapshot_id long, folder string, name string, uploaded_at timestamp"
    quiet = [(9, 0, "f", "old", None)]  # listed once, and then never again
    for i in range(11):
        batch = spark.createDataFrame((quiet if i == 0 else []) + [(1, i, "f", f"v{i}", None)], schema).coalesce(1)
        streams.accept(batch, i, f"{tmp_path}/sink", f"{tmp_path}/state")
        state = streams.latest_state(spark, f"{tmp_path}/state", i + 1, batch.select(*streams.KEYS))
        assert {(r.inbox_id, r.name) for r in state.collect()} == {(1, f"v{i}"), (9, "old")}
        runs = {f.rsplit("run=", 1)[1].split("/")[0] for f in state.inputFiles()}
        assert len([r for r in runs if i - i % 4 <= int(r) <= i]) == i % 4 + 1
        plan = state._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(run" in plan


def test_other_faults_of_state_are_raised(spark, tmp_path):
    like = spark.createDataFrame([], "inbox_id long")
    assert streams._table(spark, f"{tmp_path}/none", like).count() == 0
    (tmp_path / "state").mkdir()
    (tmp_path / "state" / "x.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        streams._table(spark, f"{tmp_path}/state", like).count()


def test_known_slots_are_not_computed(spark, tmp_path):
    """Three batches, the last of which runs again: only new keys reach the computation."""
    computed = []

    def compute(df):
        computed.append(sorted(r.content_key for r in df.collect()))
        return df.withColumn("result", F.upper("content_key"))

    batches = [[("a", 1), ("b", 2), ("a", 0)], [("b", 3), ("c", 4)], [("a", 5), ("d", 6), ("d", 7)]]
    for i, rows in [*enumerate(batches), (2, batches[2])]:
        streams.process_new_slots(spark.createDataFrame(rows, "content_key string, slot_id long"), i, f"{tmp_path}/results", compute)
    assert computed == [["a", "b"], ["c"], ["d"], ["d"]]
    got = spark.read.parquet(f"{tmp_path}/results").select("content_key", "slot_id", "result").collect()
    assert sorted(map(tuple, got)) == [("a", 0, "A"), ("b", 2, "B"), ("c", 4, "C"), ("d", 6, "D")]


def test_apply_facets(spark):
    rows = [(1, "A", "9.1, 9.2", "G"), (1, "A", None, "G"), (1, "B", "9.2", ""), (1, "C", None, "")]
    sessions = spark.createDataFrame(rows, "meeting_id long, name string, agenda_item string, group_header string")

    def kept(*choice):
        return sorted((r["name"], r.agenda_item or "") for r in layout.apply_facets(sessions, *choice).collect())

    assert len(kept([], [], [])) == 4
    assert kept(["9.1"], [], []) == [("A", "9.1, 9.2")]
    assert kept(["9.1", "9.2"], [], []) == [("A", "9.1, 9.2"), ("B", "9.2")]
    assert kept(["9.1", "9.2"], [], ["A|G"]) == [("A", ""), ("A", "9.1, 9.2"), ("B", "9.2")]
    assert kept([], ["C|"], []) == [("C", "")]


def test_facet_tree(spark):
    import json

    rows = [(1, "s10", "9.10, 9.2", "B"), (1, "s10", None, "B"), (1, "s9", "9.2", "a"), (1, "x", None, None)]
    tree = layout.facet_tree(spark.createDataFrame(rows, "meeting_id long, name string, agenda_item string, group_header string")).first()
    assert json.loads(tree.facets) == {
        "groups": [
            {"name": "a", "key": "a", "sessions": [{"name": "s9", "key": "s9|a", "ais": ["9.2"]}]},
            {"name": "B", "key": "B", "sessions": [{"name": "s10", "key": "s10|B", "ais": ["9.2", "9.10"], "hasNoAI": True}]},
            {"name": "Other", "key": "__other__", "sessions": [{"name": "x", "key": "x|", "ais": []}]},
        ],
        "allAIs": ["9.2", "9.10"],
    }
