"""Queries on document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import grid
from .registry import query

W1 = """g AS (
  SELECT doc_id, table_idx, row_idx, tc_idx, grid_span, v_merge, fill, CASE WHEN v_merge IS NOT NULL AND v_merge <> 'restart' THEN '' ELSE text END AS text,
    coalesce(sum(grid_span) OVER (PARTITION BY doc_id, table_idx, row_idx ORDER BY tc_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS col_start FROM cells),
gg AS (SELECT *, col_start + grid_span AS col_end FROM g)"""
P6 = """rc AS (
  SELECT doc_id, table_idx, row_idx, n_cells, CASE WHEN n_cells > 3 THEN 'data' WHEN regexp_matches(t, 'break|coffee|lunch') THEN 'break' WHEN regexp_matches(t, 'all sessions end|no exceptions') THEN 'footer'
    WHEN contains(t, 'meeting rooms') THEN 'metadata' ELSE 'data' END AS kind
  FROM (SELECT doc_id, table_idx, row_idx, count(*) AS n_cells, lower(string_agg(text, ' ' ORDER BY tc_idx)) AS t FROM gg GROUP BY 1, 2, 3))"""
DAY = "CASE " + " ".join(f"WHEN contains(lower(text), '{d.lower()}') THEN '{d}'" for d in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")) + " END"
F14 = f"""dc AS (
  SELECT doc_id, table_idx, day, arg_min(col_start, tc_idx) AS day_start, arg_min(col_end, tc_idx) AS day_end
  FROM (SELECT *, {DAY} AS day FROM gg WHERE row_idx = 0) WHERE day IS NOT NULL GROUP BY 1, 2, 3)"""
TB = "CASE WHEN m >= 510 AND m < 630 THEN 0 WHEN m >= 660 AND m < 780 THEN 1 WHEN m >= 870 AND m < 990 THEN 2 WHEN m >= 1020 AND m < 1170 THEN 3 END"
J1 = f"""fc AS (SELECT doc_id, table_idx, row_idx, min(tc_idx) AS tc_idx, arg_min(text, tc_idx) AS text FROM gg GROUP BY 1, 2, 3),
tr AS (SELECT doc_id, table_idx, row_idx, tc_idx, {TB} AS tb FROM (SELECT fc.*, try_cast(split_part(x, ':', 1) AS INTEGER) * 60 + try_cast(split_part(x, ':', 2) AS INTEGER) AS m
    FROM (SELECT *, regexp_extract(text, '(\\d{{1,2}}:\\d{{2}})', 1) AS x FROM fc WHERE row_idx > 0) fc) JOIN rc USING (doc_id, table_idx, row_idx) WHERE kind = 'data')"""
J2 = """ind AS (
  SELECT gg.*, tr.tb, dc.day, day_start, day_end FROM gg JOIN tr ON gg.doc_id = tr.doc_id AND gg.table_idx = tr.table_idx AND gg.row_idx = tr.row_idx AND tr.tb IS NOT NULL AND gg.tc_idx <> tr.tc_idx
  JOIN dc ON dc.doc_id = gg.doc_id AND dc.table_idx = gg.table_idx AND col_start >= day_start AND col_end <= day_end)"""
A3 = """ar AS (
  SELECT dc.doc_id, dc.table_idx, dc.day, greatest(1, coalesce(max(n), 1))::INTEGER AS n_rooms FROM dc LEFT JOIN (SELECT doc_id, table_idx, row_idx, day, count(*) AS n FROM ind GROUP BY 1, 2, 3, 4) c
    ON c.doc_id = dc.doc_id AND c.table_idx = dc.table_idx AND c.day = dc.day GROUP BY 1, 2, 3)"""
GRID = f"WITH {W1}, {P6}, {F14}, {J1}, {J2}, {A3}"
P7 = f"""st AS (
  SELECT doc_id, table_idx, max(col_end) AS width FROM gg GROUP BY 1, 2
  HAVING max(row_idx) >= 4 AND bool_or(row_idx = 0 AND ({DAY}) IS NOT NULL))"""


@query("w1_grid_positions", "cells", oracle=f"{GRID} SELECT doc_id, table_idx, row_idx, tc_idx, text, col_start, col_end FROM gg")
def w1(cells):
    return grid.grid_positions(cells).select("doc_id", "table_idx", "row_idx", "tc_idx", "text", "col_start", "col_end")


@query("p6_row_class", "cells", oracle=f"{GRID} SELECT * FROM rc")
def p6(cells):
    return grid.row_class(grid.grid_positions(cells))


@query("p7_k5_schedule_tables", "cells", oracle=f"""{GRID}, {P7},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY width DESC, table_idx) AS n FROM st)
SELECT doc_id, table_idx, width::INTEGER AS width, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY table_idx) - 1 AS INTEGER) AS table_no FROM r WHERE n <= 2""")
def p7(cells):
    return grid.largest_tables(grid.schedule_tables(grid.grid_positions(cells)))


@query("f14_day_columns", "cells", oracle=f"{GRID} SELECT * FROM dc")
def f14(cells):
    return grid.day_columns(grid.grid_positions(cells))


@query("j1_time_block_of", "cells", oracle=f"{GRID} SELECT doc_id, table_idx, row_idx, tb FROM tr WHERE tb IS NOT NULL")
def j1(cells):
    return grid.time_rows(grid.grid_positions(cells))


@query("j2_cells_in_day", "cells", oracle=f"{GRID} SELECT doc_id, table_idx, row_idx, tc_idx, day, tb, col_start, col_end FROM ind")
def j2(cells):
    return grid.cells_in_day(grid.grid_positions(cells)).select("doc_id", "table_idx", "row_idx", "tc_idx", "day", "tb", "col_start", "col_end")


@query("a3_actual_rooms_per_day", "cells", oracle=f"{GRID} SELECT * FROM ar")
def a3(cells):
    return grid.actual_rooms(grid.grid_positions(cells))


# the fold of W2 as a recursion over the cells of a row
W2 = f"""WITH RECURSIVE {GRID[5:]},
c AS (SELECT i.*, n_rooms, day_end - day_start AS w, row_number() OVER r AS k, count(*) OVER (PARTITION BY i.doc_id, i.table_idx, i.row_idx, i.day) AS n
  FROM ind i JOIN ar ON ar.doc_id = i.doc_id AND ar.table_idx = i.table_idx AND ar.day = i.day WINDOW r AS (PARTITION BY i.doc_id, i.table_idx, i.row_idx, i.day ORDER BY col_start)),
p AS (SELECT *, CASE WHEN grid_span >= w THEN 2 WHEN n = n_rooms THEN 1 ELSE 0 END AS how, round_even(grid_span * n_rooms / w, 0)::INTEGER AS share FROM c),
f AS (
  SELECT doc_id, table_idx, row_idx, day, k, tc_idx, text, tb, 0 AS a, CASE how WHEN 2 THEN n_rooms WHEN 1 THEN 1 ELSE least(greatest(1, share), greatest(1, n_rooms)) END AS b FROM p WHERE k = 1
  UNION ALL
  SELECT p.doc_id, p.table_idx, p.row_idx, p.day, p.k, p.tc_idx, p.text, p.tb, CASE p.how WHEN 2 THEN 0 ELSE f.b END, CASE p.how WHEN 2 THEN p.n_rooms WHEN 1 THEN f.b + 1 ELSE f.b + least(greatest(1, share), greatest(1, n_rooms - f.b)) END
  FROM f JOIN p ON p.doc_id = f.doc_id AND p.table_idx = f.table_idx AND p.row_idx = f.row_idx AND p.day = f.day AND p.k = f.k + 1)
SELECT doc_id, table_idx, row_idx, tc_idx, day, tb, a AS room_from, b - 1 AS room_to, text FROM f WHERE trim(text) <> ''"""


@query("w2_p8_assign_rooms", "cells", oracle=W2)
def w2(cells):
    out = grid.assign_rooms(grid.cells_in_day(grid.grid_positions(cells)))
    return out.select("doc_id", "table_idx", "row_idx", "tc_idx", "day", "tb", "room_from", "room_to", "text")


@query("w3_room_positions", "rooms", oracle="SELECT meeting_id, day, name, CAST(row_number() OVER (PARTITION BY meeting_id, day ORDER BY table_index, room_idx) - 1 AS INTEGER) AS pos FROM rooms")
def w3(rooms):
    return grid.room_positions(rooms.drop("pos"), ["meeting_id", "day"]).select("meeting_id", "day", "name", "pos")


@query("j11_cell_room_columns", "slot_cells", "rooms", oracle="""
SELECT ord, coalesce(min(pos) + 2, 2)::INTEGER AS col_from, coalesce(max(pos) + 3, 3)::INTEGER AS col_to FROM slot_cells c
LEFT JOIN rooms r ON r.meeting_id = c.meeting_id AND r.day = c.day AND r.table_index = c.table_index AND room_idx BETWEEN room_from AND room_to GROUP BY ord""")
def j11(cells, rooms):
    own = cells.select("meeting_id", "day", "ord", "table_index", "room_from", "room_to")
    return grid.cell_room_columns(own, rooms, ["meeting_id", "day"]).select("ord", F.col("col_from").cast("int"), F.col("col_to").cast("int"))


NORM = "CASE WHEN lower(c) <> 'auto' AND length(ltrim(split_part(c, ' ', 1), '#')) = 6 THEN upper(ltrim(split_part(c, ' ', 1), '#')) END"


@query("f12_color_norm", "cells", oracle=f"SELECT DISTINCT c AS fill, {NORM} AS color FROM (SELECT fill AS c FROM cells)")
def f12(cells):
    return cells.select("fill", T.color_norm(F.col("fill")).alias("color")).distinct()


@query("f13_undouble", "items", oracle="""
SELECT ord, CASE WHEN length(s) % 2 = 0 AND s[1 : length(s) // 2] = s[length(s) // 2 + 1 :] THEN s[1 : length(s) // 2] ELSE s END AS text
FROM (SELECT ord, CASE WHEN ord % 2 = 0 THEN concat(name, name) ELSE name END AS s FROM items)""")
def f13(items):
    s = F.when(F.col("ord") % 2 == 0, F.concat("name", "name")).otherwise(F.col("name"))
    return items.select("ord", T.undouble(s).alias("text"))


_CH = "CAST(('0x' || substr({0}, {1}, 2)) AS INTEGER)"
CLOSE = "({0} = {1} OR (" + " AND ".join(f"abs({_CH.format('{0}', i)} - {_CH.format('{1}', i)}) <= 8" for i in (1, 3, 5)) + "))"
W7 = f"""{GRID},
n AS (SELECT gg.*, day, day_start, coalesce({NORM.replace("c,", "fill,").replace("lower(c)", "lower(fill)")}, 'FFFFFF') AS f FROM gg JOIN dc USING (doc_id, table_idx) WHERE row_idx > 0 AND col_start > 0 AND col_start >= day_start AND col_end <= day_end),
bad AS (SELECT DISTINCT a.doc_id, a.table_idx, a.row_idx, a.day FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.table_idx = b.table_idx AND a.row_idx = b.row_idx AND a.day = b.day AND a.tc_idx < b.tc_idx AND {CLOSE.format("a.f", "b.f")}),
r AS (SELECT doc_id, table_idx, row_idx, day, min(day_start) AS ds, string_agg(f, ',' ORDER BY col_start) AS colors, count(*) AS k FROM n GROUP BY 1, 2, 3, 4),
ok AS (SELECT r.* FROM r JOIN ar USING (doc_id, table_idx, day) WHERE k = n_rooms AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.doc_id = r.doc_id AND bad.table_idx = r.table_idx AND bad.row_idx = r.row_idx AND bad.day = r.day)),
w7 AS (SELECT doc_id, table_idx, arg_min(colors, row_idx * 1000 + ds) AS colors FROM ok GROUP BY 1, 2)"""


@query("w7_table_column_colors", "cells", oracle=f"{W7} SELECT * FROM w7")
def w7(cells):
    colors = grid.table_column_colors(grid.grid_positions(cells))
    return colors.select("doc_id", "table_idx", F.array_join("colors", ",").alias("colors"))


J12 = f"""{W7},
lab AS (SELECT doc_id, i::INTEGER AS ord, concat('Room', doc_id % 9, '-', i) AS name, CASE i WHEN 0 THEN 'D5D5D5' WHEN 1 THEN 'FFD066' WHEN 2 THEN NULL ELSE 'FFFFFF' END AS color FROM (SELECT DISTINCT doc_id FROM cells), range(0, 5) t(i)),
e AS (SELECT doc_id, table_idx, unnest(string_split(colors, ',')) AS f, generate_subscripts(string_split(colors, ','), 1) AS i FROM w7),
h AS (SELECT e.doc_id, table_idx, i, arg_min(name, ord) AS name FROM e JOIN lab ON lab.doc_id = e.doc_id AND color IS NOT NULL AND {CLOSE.format("f", "color")} GROUP BY 1, 2, 3),
nm AS (SELECT doc_id, table_idx, string_agg(name, ',' ORDER BY i) AS names, count(*) AS k FROM h GROUP BY 1, 2),
need AS (SELECT doc_id, table_idx, arg_min(n_rooms, day_start) AS n_rooms FROM ar JOIN dc USING (doc_id, table_idx, day) GROUP BY 1, 2),
j12 AS (SELECT doc_id, table_idx, names, k FROM nm JOIN need USING (doc_id, table_idx) WHERE k = n_rooms)"""


def _labels(cells: DataFrame) -> DataFrame:
    i = F.explode(F.sequence(F.lit(0), F.lit(4)))
    color = F.when(F.col("ord") == 0, "D5D5D5").when(F.col("ord") == 1, "FFD066").when(F.col("ord") > 2, "FFFFFF")
    name = F.concat(F.lit("Room"), (F.col("doc_id") % 9).cast("string"), F.lit("-"), F.col("ord").cast("string"))
    return cells.select("doc_id").distinct().withColumn("ord", i).select("doc_id", "ord", name.alias("name"), color.alias("color"))


def _matched(cells: DataFrame) -> DataFrame:
    return grid.match_rooms_by_color(grid.table_column_colors(grid.grid_positions(cells)), _labels(cells))


@query("j12_match_rooms_by_color", "cells", oracle=f"{J12} SELECT doc_id, table_idx, names FROM j12")
def j12(cells):
    return _matched(cells).withColumn("names", F.array_join("names", ","))


@query("w8_generic_room_names", "cells", oracle=f"""{J12}
SELECT ar.doc_id, ar.table_idx, day, n_rooms, CASE WHEN k >= n_rooms THEN array_to_string(string_split(names, ',')[1:n_rooms], ',')
  WHEN ar.table_idx = 0 AND ar.doc_id % 2 = 0 AND n_rooms <= 2 THEN array_to_string(['F1', 'A1'][1:n_rooms], ',') WHEN ar.table_idx > 0 AND ar.doc_id % 3 = 0 AND n_rooms <= 1 THEN 'J1'
  ELSE array_to_string(list_transform(range(0, n_rooms), lambda i: CASE WHEN ar.table_idx = 0 THEN 'Room ' ELSE 'Offline ' END || chr(65 + i::INTEGER)), ',') END AS room_names
FROM ar LEFT JOIN j12 USING (doc_id, table_idx)""")
def w8(cells):
    rooms = grid.actual_rooms(grid.grid_positions(cells))
    online = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("F1"), F.lit("A1")))
    offline = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("J1")))
    metadata = cells.select("doc_id").distinct().select("doc_id", online.alias("online"), offline.alias("offline"))
    out = grid.generic_room_names(rooms.withColumn("table_no", F.col("table_idx")), _matched(cells), metadata)
    return out.select("doc_id", "table_idx", "day", "n_rooms", F.array_join("room_names", ",").alias("room_names"))


A10 = """
WITH b AS (SELECT conv_id AS doc_id, turn AS pos, text, (conv_id + turn) % 4 = 0 AS is_table FROM conversations),
m AS (SELECT *, coalesce(sum(is_table::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS table_idx FROM b)
SELECT doc_id, table_idx, coalesce(string_agg(trim(text, chr(10) || chr(13) || chr(9) || ' '), chr(10) ORDER BY pos) FILTER (NOT is_table AND trim(text) <> ''), '') AS context FROM m GROUP BY 1, 2 HAVING bool_or(is_table)"""


@query("a10_table_context", "conversations", oracle=A10)
def a10(conversations):
    return grid.table_context(conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text", ((F.col("conv_id") + F.col("turn")) % 4 == 0).alias("is_table")))


A11 = """
WITH t AS (SELECT ord AS doc_id, concat('Meeting Rooms', chr(10), name, ' (F1/2/3, Level 2)', chr(10), chr(10), group_header, ' x', chr(10), 'Offline MEETING ROOMS', chr(10), CASE WHEN ord % 3 = 0 THEN 'Off#1 (J1)' ELSE 'Hall' END, chr(10), 'Foyer (a)(B2)') AS text FROM items),
l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t),
b AS (SELECT *, contains(lower(line), 'meeting rooms') AS hd, sum(contains(lower(line), 'meeting rooms')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM l WHERE line <> ''),
k AS (SELECT doc_id, block, bool_or(contains(lower(line), 'off')) AS off, string_agg(CASE WHEN regexp_matches(line, '\\([^)]+\\)') THEN trim(split_part(list_last(regexp_extract_all(line, '\\(([^)]+)\\)', 1)), ',', 1)) ELSE line END, '|' ORDER BY i) AS names FROM b WHERE NOT hd GROUP BY 1, 2)
SELECT doc_id, arg_max(names, block) FILTER (NOT off) AS online, arg_max(names, block) FILTER (off) AS offline FROM k GROUP BY 1"""


@query("a11_room_metadata", "items", oracle=A11)
def a11(items):
    last = F.when(F.col("ord") % 3 == 0, "Off#1 (J1)").otherwise("Hall")
    text = F.concat(F.lit("Meeting Rooms\n"), "name", F.lit(" (F1/2/3, Level 2)\n\n"), "group_header", F.lit(" x\nOffline MEETING ROOMS\n"), last, F.lit("\nFoyer (a)(B2)"))
    cells = items.select(F.col("ord").alias("doc_id"), F.lit(0).alias("table_idx"), F.lit(0).alias("row_idx"), F.lit(0).alias("tc_idx"), text.alias("text"))
    out = grid.room_metadata(cells)
    return out.select("doc_id", F.array_join("online", "|").alias("online"), F.array_join("offline", "|").alias("offline"))


@query("p10_find_location_line", "items", oracle="""
WITH p AS (SELECT meeting_id AS doc_id, ord % 40 AS pos, ord, CASE WHEN ord % 9 = 0 THEN concat('St. Julian, ', CASE WHEN ord % 2 = 0 THEN 'Malta' ELSE 'malta' END, ', Apr. ', ord % 28, 'th') ELSE name END AS text FROM items),
m AS (SELECT doc_id, pos, text FROM p WHERE pos < 30 AND regexp_matches(text, '^[A-Z][A-Za-z .''-]+,\\s*[A-Z][A-Za-z .''-]+,\\s*[A-Za-z]+\\.?\\s+\\d'))
SELECT doc_id, min(text) AS location FROM m x WHERE pos = (SELECT min(pos) FROM m y WHERE y.doc_id = x.doc_id) GROUP BY 1""")
def p10(items):
    place = F.concat(F.lit("St. Julian, "), F.when(F.col("ord") % 2 == 0, "Malta").otherwise("malta"), F.lit(", Apr. "), (F.col("ord") % 28).cast("string"), F.lit("th"))
    text = F.when(F.col("ord") % 9 == 0, place).otherwise(F.col("name"))
    # several lines share a place here: they are put in order
    rows = items.select(F.col("meeting_id").alias("doc_id"), (F.col("ord") % 40).alias("pos"), text.alias("text")).where("pos < 30")
    apart = rows.groupBy("doc_id", "pos").agg(F.array_sort(F.collect_set("text")).alias("t")).select("doc_id", "pos", F.posexplode("t").alias("k", "text"))
    return grid.location_line(apart.withColumn("pos", F.col("pos") + F.col("k") / 1000.0))


@query("f11_strike_markup", "items", oracle="""
SELECT ord, trim(concat(CASE WHEN ord % 2 = 0 THEN concat('~~', name, '~~') ELSE name END, coalesce(nullif(group_header, ''), ''), chr(10), CASE WHEN ord % 3 = 0 THEN '~~x~~' ELSE 'x' END)) AS text FROM items""")
def f11(items):
    run = [(0, F.col("name"), F.col("ord") % 2 == 0), (0, F.col("group_header"), F.lit(False)), (1, F.lit("x"), F.col("ord") % 3 == 0)]
    runs = F.array(*[F.struct(F.lit(p).alias("para"), t.alias("text"), s.alias("strike")) for p, t, s in run])
    return items.select("ord", T.strike_markup(runs).alias("text"))
