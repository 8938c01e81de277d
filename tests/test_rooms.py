"""Room names by colour, room columns and text boxes."""

from pyspark.sql import functions as F

from meetloom.operators import grid, timeline

CELLS = "doc_id string, table_idx int, row_idx int, tc_idx int, grid_span int, v_merge string, fill string, text string"


def schedule(rooms_by_day: list[list[str | None]], doc: str = "d") -> list[tuple]:
    """A table of one time row; a day's cells have the fills given."""
    width = max(map(len, rooms_by_day))
    days = ["Monday", "Tuesday", "Wednesday"]
    rows = [(doc, 0, 0, 0, 1, None, None, "")] + [(doc, 0, 0, i + 1, width, None, None, days[i]) for i in range(len(rooms_by_day))]
    row = [(1, None, "08:30 ~ 10:30")]
    for fills in rooms_by_day:
        spans = [1] * (len(fills) - 1) + [width - len(fills) + 1]
        row += [(s, f, "x") for s, f in zip(spans, fills, strict=True)]
    return rows + [(doc, 0, 1, i, s, None, f, t) for i, (s, f, t) in enumerate(row)]


def names_by_color(spark, rooms_by_day, labels):
    cells = grid.grid_positions(spark.createDataFrame(schedule(rooms_by_day), CELLS))
    rows = spark.createDataFrame([("d", i, n, c) for i, (n, c) in enumerate(labels)], "doc_id string, ord int, name string, color string")
    found = grid.match_rooms_by_color(grid.table_column_colors(cells), rows).collect()
    return found[0].names if found else None


LABELS = [("R1", "AA0000"), ("R2", "00AA00"), ("R3", "0000AA")]


def test_first_day_says_how_many_rooms(spark):
    """The reference's count is that of the first day, not the largest."""
    assert names_by_color(spark, [["AA0000", "00AA00"], ["AA0000", "00AA00", "0000AA"]], LABELS) == ["R1", "R2"]
    # colours come from the first day whose cells are as many as its rooms and all different
    assert names_by_color(spark, [["AA0000", "AA0000"], ["AA0000", "00AA00", "0000AA"]], LABELS) is None
    assert names_by_color(spark, [["AA0000", "AA0000"], ["AA0000", "00AA00"]], LABELS) == ["R1", "R2"]
    assert names_by_color(spark, [["AA0000", "00AA00", "777777"]], LABELS) is None


def test_room_columns_with_repeated_and_null_aliases(spark):
    sessions = spark.createDataFrame([(1, "X"), (2, "Y"), (3, "Hall"), (4, "X + Y")], "ord int, room_name string").withColumn("day", F.lit("Monday"))
    rooms = spark.createDataFrame([("Monday", 0, "Hall"), ("Monday", 1, "Foyer"), ("Monday", 2, "Attic")], "day string, pos int, name string")
    aliases = spark.createDataFrame([("Monday", "X", "Attic", 1), ("Monday", "X", "Foyer", 2), ("Monday", None, "Hall", 3), ("Monday", "Y", "Hall", 4), ("Monday", "Y", "Hall", 4)], "day string, alias string, name string, place int")
    got = timeline.room_columns(sessions, rooms, aliases, ["day"]).collect()
    assert {r.ord: (r.room_col_start, r.room_col_end) for r in got} == {1: (3, 4), 2: (2, 3), 3: (2, 3), 4: (2, 4)}
    by_name = timeline.room_columns(sessions, rooms, aliases.drop("place"), ["day"]).where("ord = 1").first()
    assert by_name.room_col_start == 3


def boxed(spark, *shapes: str):
    """Labels of a document with the given text boxes."""
    from meetloom.plans.source_queries import build_document
    from meetloom.sources import documents

    cell = {"table_idx": 0, "row_idx": 0, "tc_idx": 0, "grid_span": 1, "v_merge": None, "fill": None, "text": "cell"}
    files = spark.createDataFrame([("a.docx", bytearray(build_document([cell], "".join(shapes))))], "path string, content binary")
    rows = documents.extract_tables(files)
    assert documents.table_cells(rows).count() == 1
    return [(r.name, r.color) for r in documents.box_labels(rows).orderBy("ord").collect()]


def test_text_boxes(spark):
    from meetloom.plans.source_queries import text_box

    both, drawn = text_box("J1", "0000AA", "#ffd966 [1943]"), text_box("F1/2/3", "d8d8d8", "auto")
    assert boxed(spark, both, drawn) == [("J1", "FFD966"), ("F1/2/3", "D8D8D8")]
    assert boxed(spark, text_box("A1", None, None), text_box("  ", "123456", None), text_box("B", "red", "#12")) == [("A1", None), ("B", None)]
    # the first resolved shape that names a fill counts, and of drawn ones the first that is a colour
    twice = drawn.replace("<wps:spPr>", "<wps:spPr><a:ln><a:solidFill><a:schemeClr/></a:solidFill></a:ln>").replace("<v:shape", '<v:shape/><v:shape fillcolor=""/><v:shape')
    assert boxed(spark, twice) == [("F1/2/3", "D8D8D8")]
    one_alternative = both.replace("<mc:Fallback>", "<mc:Fallback><!--").replace("</mc:Fallback>", "--></mc:Fallback>")
    assert boxed(spark, one_alternative) == [("J1", "0000AA")]
    assert boxed(spark) == []


def test_boxes_name_the_rooms_of_a_table(spark):
    from meetloom.plans.source_queries import build_document, text_box
    from meetloom.sources import documents

    cells = [dict(zip(("table_idx", "row_idx", "tc_idx", "grid_span", "v_merge", "fill", "text"), r[1:], strict=True)) for r in schedule([["AA0000", "00AA00"], ["AA0000", "00AA00", "0000AA"]])]
    boxes = text_box("Hall", None, "#aa0000 [3]") + text_box("Foyer", "02A802", None)
    rows = documents.extract_tables(spark.createDataFrame([("d", bytearray(build_document(cells, boxes)))], "path string, content binary"))
    colors = grid.table_column_colors(grid.grid_positions(documents.table_cells(rows)))
    assert grid.match_rooms_by_color(colors, documents.box_labels(rows)).first().names == ["Hall", "Foyer"]
