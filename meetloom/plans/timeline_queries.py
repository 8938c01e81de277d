"""Queries on slot results, sessions, layout and facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout, timeline
from .catalog_queries import NUMBER
from .registry import query

SLOT = ["meeting_id", "day", "tb"]
MIN = "(try_cast(split_part({0}, ':', 1) AS INTEGER) * 60 + try_cast(split_part({0}, ':', 2) AS INTEGER))"
HHMM = "concat(lpad(CAST(({0}) // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(({0}) % 60 AS VARCHAR), 2, '0'))"
ITEM_RE = "'^(?:AI\\s+)?\\.?\\s*(\\d+\\.\\d[\\d.xX]*)\\s*(.*)'"
F9_ITEM = f"CASE WHEN coalesce(agenda_item, '') <> '' THEN agenda_item WHEN regexp_extract(name, {ITEM_RE}, 1) <> '' THEN trim(regexp_extract(name, {ITEM_RE}, 1), '.') ELSE nullif(trim(regexp_extract(group_header, '^AI\\s+(\\d[\\d.]*)', 1), '.'), '') END"
F9_NAME = f"CASE WHEN coalesce(agenda_item, '') = '' AND trim(regexp_extract(name, {ITEM_RE}, 2)) <> '' THEN trim(regexp_extract(name, {ITEM_RE}, 2)) ELSE name END"
W6 = f"""
WITH k AS (SELECT *, {MIN.format("specified_start_time")} AS x FROM items WHERE duration_minutes > 0),
s AS (SELECT *, count(x) OVER (PARTITION BY meeting_id, day, tb, room_name ORDER BY ord) AS seg FROM k),
t AS (SELECT *, coalesce(first_value(x) OVER w, {MIN.format("block_start")}) + coalesce(sum(duration_minutes) OVER (PARTITION BY meeting_id, day, tb, room_name, seg ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m
  FROM s WINDOW w AS (PARTITION BY meeting_id, day, tb, room_name, seg ORDER BY ord))
SELECT meeting_id, day, tb, ord, room_name, duration_minutes, {HHMM.format("m::BIGINT")} AS start_time, {HHMM.format("(m + duration_minutes)::BIGINT")} AS end_time,
  {F9_ITEM} AS agenda_item, {F9_NAME} AS name FROM t"""


@query("w6_timeline", "items", oracle=W6)
def w6(items):
    return timeline.timeline(items, SLOT).select(*SLOT, "ord", "room_name", "duration_minutes", "start_time", "end_time", "agenda_item", "name")


@query("p9_drop_nonpositive_duration", "items", oracle="SELECT ord, duration_minutes FROM items WHERE duration_minutes > 0")
def p9(items):
    return items.where("duration_minutes > 0").select("ord", "duration_minutes")


@query("f9_agenda_from_name", "items", oracle=f"SELECT ord, {F9_ITEM} AS item, {F9_NAME} AS short FROM items")
def f9(items):
    name, item = F.col("name"), F.col("agenda_item")
    return items.select("ord", T.agenda_item(name, item, F.col("group_header")).alias("item"), T.session_name(name, item).alias("short"))


@query("f7_f8_times", "sessions", oracle=f"""
SELECT ord, {MIN.format("start_time")} AS m, {HHMM.format(MIN.format("start_time"))} AS t, CAST(floor(({MIN.format("start_time")} - 510) / 5.0) + 2 AS INTEGER) AS grid_row FROM sessions""")
def f7(sessions):
    m = T.minutes(F.col("start_time"))
    return sessions.select("ord", m.alias("m"), T.hhmm(m).alias("t"), T.grid_row(F.col("start_time")).alias("grid_row"))


AIS = "list_filter(list_transform(string_split(coalesce(agenda_item, ''), ','), lambda x: trim(x)), lambda x: x <> '')"


@query("f10_agenda_list", "items", oracle=f"SELECT ord, array_to_string({AIS}, '|') AS ais FROM items")
def f10(items):
    return items.select("ord", F.array_join(F.coalesce(T.agenda_list(F.col("agenda_item")), F.array()), "|").alias("ais"))


J7 = """
WITH maps AS (SELECT meeting_id, group_header AS original, CASE WHEN group_header LIKE 'AI%' THEN 'Agenda' ELSE concat(group_header, ' short') END AS simplified, ord FROM items WHERE ord % 3 = 0),
last AS (SELECT meeting_id, original, arg_max(simplified, ord) AS simplified FROM maps GROUP BY 1, 2),
several AS (SELECT meeting_id FROM items WHERE group_header <> '' GROUP BY 1 HAVING count(DISTINCT group_header) > 1)
SELECT ord, coalesce(simplified, group_header) AS group_header FROM items i
LEFT JOIN (SELECT * FROM last JOIN several USING (meeting_id)) m ON m.meeting_id = i.meeting_id AND m.original = i.group_header"""


@query("j7_apply_group_mapping", "items", oracle=J7)
def j7(items):
    simple = F.when(F.col("group_header").startswith("AI"), "Agenda").otherwise(F.concat("group_header", F.lit(" short")))
    mappings = items.where("ord % 3 = 0").select("meeting_id", "ord", F.col("group_header").alias("original"), simple.alias("simplified"))
    return timeline.apply_group_mapping(items, mappings).select("ord", "group_header")


FILL = """
WITH first AS (SELECT meeting_id, name, arg_min(group_header, ord) AS g FROM items WHERE group_header <> '' GROUP BY 1, 2),
one AS (SELECT i.meeting_id, i.ord, i.name, CASE WHEN group_header = '' THEN coalesce(g, '') ELSE group_header END AS group_header FROM items i LEFT JOIN first USING (meeting_id, name)),
known AS (SELECT DISTINCT meeting_id, group_header AS g FROM one WHERE group_header <> ''),
two AS (SELECT o.meeting_id, o.ord, CASE WHEN o.group_header <> '' THEN o.group_header ELSE coalesce((SELECT g FROM known k WHERE k.meeting_id = o.meeting_id AND contains(lower(o.name), lower(g)) ORDER BY length(g) DESC, g LIMIT 1), '') END AS group_header FROM one o)
"""


@query("j8_fill_group_by_name", "items", oracle=FILL + "SELECT ord, group_header FROM one")
def j8(items):
    return timeline.fill_groups_by_name(items).select("ord", "group_header")


@query("j9_fill_group_by_substring", "items", oracle=FILL + "SELECT ord, group_header FROM two")
def j9(items):
    return timeline.fill_groups(items).select("ord", "group_header")


@query("a7_group_fill_stats", "items", oracle=FILL + """, s AS (SELECT i.meeting_id, i.group_header = '' AS m0, one.group_header = '' AS m1, two.group_header = '' AS m2 FROM items i JOIN one USING (ord) JOIN two USING (ord))
SELECT meeting_id, count(*) FILTER (m0) - count(*) FILTER (m1) AS by_name, count(*) FILTER (m1) - count(*) FILTER (m2) AS by_substring, count(*) FILTER (m2) AS still_empty FROM s GROUP BY 1""")
def a7(items):
    by_name = timeline.fill_groups_by_name(items)
    return timeline.group_fill_stats(items, by_name, timeline.fill_groups_by_substring(by_name))


@query("a8_block_capacity_check", "items", oracle="""
SELECT meeting_id, day, tb, room_name, block_minutes, sum(duration_minutes)::BIGINT AS total_minutes FROM items i
WHERE duration_minutes > 0 AND NOT EXISTS (SELECT 1 FROM items x WHERE x.meeting_id = i.meeting_id AND x.day = i.day AND x.tb = i.tb AND x.specified_start_time IS NOT NULL AND x.ord % 50 = 0)
GROUP BY ALL HAVING sum(duration_minutes) > block_minutes""")
def a8(items):
    rare = F.when(F.col("ord") % 50 == 0, F.col("specified_start_time"))
    return timeline.block_capacity_check(items.withColumn("specified_start_time", rare), SLOT)


@query("j10_room_columns", "items", "rooms", oracle="""
WITH al AS (SELECT meeting_id, day, 'RAN1_main' AS alias, name FROM rooms WHERE pos = 0
  UNION ALL SELECT meeting_id, day, 'a1', max(name) FROM rooms WHERE pos BETWEEN 1 AND 2 GROUP BY 1, 2
  UNION ALL SELECT meeting_id, day, 'ALL_ONLINE', string_agg(name, ' + ' ORDER BY pos) FROM rooms WHERE table_index = 0 GROUP BY 1, 2 HAVING count(*) > 1),
l AS (SELECT DISTINCT i.meeting_id, i.day, i.room_name, coalesce(al.name, i.room_name) AS r FROM items i LEFT JOIN al ON al.meeting_id = i.meeting_id AND al.day = i.day AND al.alias = i.room_name),
p AS (SELECT *, unnest(string_split(r, ' + ')) AS part FROM l WHERE contains(r, ' + ')),
q AS (SELECT p.meeting_id, p.day, room_name, CASE WHEN r = room_name THEN coalesce(al.name, part) ELSE part END AS part FROM p LEFT JOIN al ON al.meeting_id = p.meeting_id AND al.day = p.day AND al.alias = p.part),
span AS (SELECT q.meeting_id, q.day, room_name, min(pos) AS lo, max(pos) AS hi FROM q JOIN rooms o ON o.meeting_id = q.meeting_id AND o.day = q.day AND o.name = q.part GROUP BY 1, 2, 3),
one AS (SELECT l.meeting_id, l.day, room_name, arg_min(pos, CASE WHEN o.name = r THEN 0 ELSE 100 END + pos) AS lo FROM l JOIN rooms o ON o.meeting_id = l.meeting_id AND o.day = l.day
  AND (contains(lower(o.name), lower(r)) OR contains(lower(r), lower(o.name))) WHERE NOT contains(r, ' + ') GROUP BY 1, 2, 3),
f AS (SELECT * FROM span UNION ALL SELECT meeting_id, day, room_name, lo, lo FROM one)
SELECT ord, coalesce(lo + 2, 2) AS room_col_start, coalesce(hi + 3, 3) AS room_col_end FROM items LEFT JOIN f USING (meeting_id, day, room_name)""")
def j10(items, rooms):
    keys = ["meeting_id", "day"]
    days = rooms.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "table_index", "name"))).alias("r"))

    def alias(name, value):
        return F.struct(name.alias("alias"), value.alias("name"))

    main = F.transform(F.filter("r", lambda x: x["pos"] == 0), lambda x: alias(F.lit("RAN1_main"), x["name"]))
    online = F.filter("r", lambda x: x["table_index"] == 0)
    every = F.when(F.size(online) > 1, F.array(alias(F.lit("ALL_ONLINE"), F.array_join(F.transform(online, lambda x: x["name"]), " + "))))
    # an alias of several names, the last of which counts, and rooms without an alias
    twice = F.transform(F.filter("r", lambda x: x["pos"].between(1, 2)), lambda x: alias(F.lit("a1"), x["name"]))
    none = F.transform("r", lambda x: alias(F.lit(None).cast("string"), x["name"]))
    aliases = days.select(*keys, F.inline(F.concat(main, F.coalesce(every, F.array()), twice, none)))
    return timeline.room_columns(items, rooms, aliases, keys).select("ord", "room_col_start", "room_col_end")


@query("w5_group_colors", "items", oracle="""
SELECT meeting_id, group_header, CAST((dense_rank() OVER (PARTITION BY meeting_id ORDER BY group_header) - 1) % 16 AS INTEGER) AS color FROM (SELECT DISTINCT meeting_id, group_header FROM items WHERE group_header <> '')""")
def w5(items):
    return layout.group_colors(items)


_S, _E = MIN.format("start_time"), MIN.format("end_time")
F19 = f"""
WITH a AS (SELECT *, CAST(floor(({_S} - 510) / 5.0) + 2 AS INTEGER) AS rs, CAST(floor(({_E} - 510) / 5.0) + 2 AS INTEGER) AS re0, list_transform(range(1, n_rooms + 1), lambda i: 'R' || i) AS rooms FROM sessions),
b AS (SELECT *, CASE WHEN re0 <= rs AND duration_minutes > 0 THEN rs + 1 ELSE re0 END AS re, greatest(room_col_start, 2) AS lo, least(room_col_end, n_rooms + 2) AS hi FROM a),
c AS (SELECT *, CASE WHEN lo >= hi THEN 2 ELSE lo END AS cs, CASE WHEN lo >= hi THEN 3 ELSE hi END AS ce FROM b WHERE re > rs)
SELECT ord, rs AS row_start, re AS row_end, cs AS col_start, ce AS col_end, re - rs AS slots, re - rs <= 2 AS is_short, re - rs <= 1 AS is_tiny,
  re - rs >= 3 AND coalesce(chair, '') <> '' AS show_chair, re - rs >= 4 AS show_time, re - rs >= 6 AND coalesce(agenda_item, '') <> '' AS show_agenda,
  NOT (({_S} >= 510 AND {_E} <= 630) OR ({_S} >= 660 AND {_E} <= 780) OR ({_S} >= 870 AND {_E} <= 990) OR ({_S} >= 1020 AND {_E} <= 1170)) AS is_long,
  coalesce(array_to_string(rooms[cs - 1 : least(ce - 2, n_rooms)], ', '), '') AS room_names, array_to_string({AIS}, '|') AS data_ai FROM c"""


@query("f19_f20_layout", "sessions", oracle=F19)
def f19(sessions):
    rooms = F.when(F.col("n_rooms") > 0, F.transform(F.sequence(F.lit(1), F.greatest("n_rooms", F.lit(1))), lambda i: F.concat(F.lit("R"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    out = layout.layout_block(sessions.withColumn("rooms", rooms))
    return out.select("ord", "row_start", "row_end", "col_start", "col_end", "slots", "is_short", "is_tiny", "show_chair", "show_time", "show_agenda", "is_long", "room_names", "data_ai")


@query("f21_compact_label", "sessions", oracle="""
SELECT ord, CASE WHEN coalesce(agenda_item, '') <> '' THEN concat('AI ', agenda_item) WHEN length(n) > 22 THEN concat(n[1:21], '…') ELSE n END AS label
FROM (SELECT *, trim(regexp_replace(concat(name, '  with  more ', group_header), '\\s+', ' ', 'g')) AS n FROM sessions)""")
def f21(sessions):
    name = F.concat("name", F.lit("  with  more "), "group_header")
    return sessions.select("ord", T.compact_label(name, F.col("agenda_item")).alias("label"))


@query("f22_detail_lines", "sessions", oracle="""
SELECT ord, concat_ws(chr(10), name, 'Group: ' || nullif(group_header, ''), 'Chair: ' || nullif(chair, ''), 'AI: ' || nullif(agenda_item, ''),
  'Time: ' || start_time || ' - ' || end_time || ' (' || duration_minutes || ' min)', 'Room: ' || nullif(room_name, '')) AS details FROM sessions""")
def f22(sessions):
    c = F.col
    lines = T.detail_lines(c("name"), c("group_header"), c("chair"), c("agenda_item"), c("start_time"), c("end_time"), c("duration_minutes"), c("room_name"))
    return sessions.select("ord", F.array_join(lines, "\n").alias("details"))


@query("f23_f24_local_time", "events", oracle="""
SELECT event_id, CASE WHEN m BETWEEN 510 AND 1185 THEN dayname(l) END AS day, CASE WHEN m BETWEEN 510 AND 1185 THEN CAST(floor((m - 510) / 5.0) + 2 AS INTEGER) END AS grid_row, strftime(l, '%Y-%m-%d %H:%M') AS generated_at
FROM (SELECT *, hour(l) * 60 + minute(l) AS m FROM (SELECT event_id, ts + CASE event_id % 2 WHEN 0 THEN INTERVAL 9 HOUR ELSE INTERVAL 0 HOUR END AS l FROM events))""")
def f23(events):
    zone = F.when(F.col("event_id") % 2 == 0, "Asia/Tokyo").otherwise("UTC")
    slot = T.now_slot(F.col("ts"), zone)
    return events.select("event_id", slot["day"].alias("day"), slot["row"].alias("grid_row"), T.local_generated_at(F.col("ts"), zone).alias("generated_at"))


# natural order in the oracle: digit runs with their lengths in front, the rest in lower case
NAT = "(CASE WHEN regexp_matches({0}, '^[0-9]') THEN [''] ELSE [] END || list_transform(regexp_extract_all(lower({0}), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN " + NUMBER.format("p") + " ELSE p END))"
A4 = f"""
WITH r AS (SELECT meeting_id, coalesce(group_header, '') AS grp, name, {AIS} AS l, coalesce(agenda_item, '') = '' AS bare FROM items),
a AS (SELECT DISTINCT meeting_id, grp, name, unnest(l) AS ai FROM r),
o AS (SELECT meeting_id, grp, name, string_agg(ai, '|' ORDER BY {NAT.format("ai")}) AS ais FROM a GROUP BY 1, 2, 3),
s AS (SELECT meeting_id, grp, name, bool_or(bare) AS bare FROM r GROUP BY 1, 2, 3)
SELECT meeting_id, grp, name, coalesce(ais, '') AS ais, bare AND ais IS NOT NULL AS has_no_ai FROM s LEFT JOIN o USING (meeting_id, grp, name)"""


@query("a4_facet_rows", "items", oracle=A4)
def a4(items):
    return layout.facet_rows(items).withColumn("ais", F.array_join("ais", "|"))


TREE = "WITH f AS (" + A4 + f"""),
s AS (SELECT meeting_id, grp, string_agg('{{"name":' || to_json(name)::VARCHAR || ',"key":' || to_json(name || '|' || grp)::VARCHAR || ',"ais":' || to_json(CASE WHEN ais = '' THEN []::VARCHAR[] ELSE string_split(ais, '|') END)::VARCHAR
    || CASE WHEN has_no_ai THEN ',"hasNoAI":true' ELSE '' END || '}}', ',' ORDER BY {NAT.format("name")}, name) AS sessions FROM f GROUP BY 1, 2),
g AS (SELECT meeting_id, string_agg('{{"name":' || to_json(CASE grp WHEN '' THEN 'Other' ELSE grp END)::VARCHAR || ',"key":' || to_json(CASE grp WHEN '' THEN '__other__' ELSE grp END)::VARCHAR || ',"sessions":[' || sessions || ']}}', ',' ORDER BY grp = '', lower(grp), grp) AS groups FROM s GROUP BY 1),
d AS (SELECT meeting_id, string_agg(to_json(ai)::VARCHAR, ',' ORDER BY {NAT.format("ai")}, ai) AS items FROM (SELECT DISTINCT meeting_id, unnest(string_split(ais, '|')) AS ai FROM f WHERE ais <> '') GROUP BY 1)
SELECT meeting_id, '{{"groups":[' || groups || '],"allAIs":[' || coalesce(items, '') || ']}}' AS facets FROM g LEFT JOIN d USING (meeting_id)"""


@query("a4_facet_tree", "items", oracle=TREE)
def a4_tree(items):
    return layout.facet_tree(items)


@query("a5_distinct_ais", "items", oracle=f"""
SELECT meeting_id, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY {NAT.format("ai")}) - 1 AS INTEGER) AS place, ai FROM (SELECT DISTINCT meeting_id, unnest({AIS}) AS ai FROM items)""")
def a5(items):
    return layout.distinct_ais(items)


@query("o3_natural_sort", "items", oracle=f"""
SELECT meeting_id, name, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY {NAT.format("name")}, name) AS INTEGER) AS place
FROM (SELECT DISTINCT meeting_id, CASE ord % 3 WHEN 0 THEN concat(name, ' 01234567890123456789012345678901234567', CAST(ord % 1000 AS VARCHAR)) ELSE name END AS name FROM items)""")
def o3(items):
    from pyspark.sql import Window

    long = F.concat("name", F.lit(" 01234567890123456789012345678901234567"), (F.col("ord") % 1000).cast("string"))
    names = items.select("meeting_id", F.when(F.col("ord") % 3 == 0, long).otherwise(F.col("name")).alias("name")).distinct()
    return names.withColumn("place", F.row_number().over(Window.partitionBy("meeting_id").orderBy(T.natural_key(F.col("name")), "name")))


@query("p11_apply_facets", "items", oracle="WITH f AS (" + A4.replace("WITH r AS", "WITH r AS", 1) + f"""),
c AS (SELECT i.*, f.ais AS all_ais, has_no_ai, {AIS} AS l, concat(i.name, '|', coalesce(group_header, '')) AS k FROM items i JOIN f ON f.meeting_id = i.meeting_id AND f.name = i.name AND f.grp = coalesce(group_header, ''))
SELECT ord FROM c WHERE k = 'small ring|Brand#2' OR (all_ais <> '' AND len(list_filter(string_split(all_ais, '|'), lambda a: a NOT IN ('9.2', '8.3'))) = 0 AND NOT has_no_ai)
  OR list_has_any(l, ['9.2', '8.3']) OR (len(l) = 0 AND k = 'red widget|Brand#17')""")
def p11(items):
    return layout.apply_facets(items, ["9.2", "8.3"], ["small ring|Brand#2"], ["red widget|Brand#17"]).select("ord")


@query("a9_day_schedule", "items", "rooms", oracle=f"""
WITH t AS ({W6}),
o AS (SELECT meeting_id, day, string_agg(name, ',' ORDER BY pos) AS rooms, count(*) AS n FROM rooms WHERE day <> 'Saturday' GROUP BY 1, 2),
s AS (SELECT meeting_id, day, string_agg(start_time || ' ' || name, ',' ORDER BY ord) AS sessions FROM t GROUP BY 1, 2)
SELECT meeting_id, list_position(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday'], day) AS day_no, day, rooms, coalesce(sessions, '') AS sessions FROM o LEFT JOIN s USING (meeting_id, day)""")
def a9(items, rooms):
    days = layout.day_schedule(timeline.timeline(items, SLOT), rooms)
    lines = F.transform("sessions", lambda s: F.concat(s["start_time"], F.lit(" "), s["name"]))
    return days.select("meeting_id", "day_no", "day", F.array_join("rooms", ",").alias("rooms"), F.array_join(lines, ",").alias("sessions"))


@query("f26_group_label_rules", "items", oracle="""
SELECT ord, CASE WHEN regexp_matches(h, '(?i)^to be assigned by') THEN 'TBD' ELSE string_split(h, ' / ')[1] END AS label
FROM (SELECT ord, CASE ord % 3 WHEN 0 THEN concat(group_header, ' / ', name, ' / x') WHEN 1 THEN 'To be assigned by chair' ELSE group_header END AS h FROM items)""")
def f26(items):
    h = F.when(F.col("ord") % 3 == 0, F.concat("group_header", F.lit(" / "), "name", F.lit(" / x"))).when(F.col("ord") % 3 == 1, "To be assigned by chair").otherwise(F.col("group_header"))
    return items.select("ord", T.group_label(h).alias("label"))


_ELECT = """
WITH h AS (SELECT meeting_id, ord, CASE WHEN group_header = '' THEN '' ELSE CASE ord % 6 WHEN 0 THEN concat(group_header, ' / x', CAST(ord % 4 AS VARCHAR)) WHEN 1 THEN concat('NTN / ', group_header) WHEN 2 THEN 'To be assigned by Kim' WHEN 3 THEN lower(group_header)
    WHEN 4 THEN concat('Top', CAST(ord % 5 AS VARCHAR), ' / y') ELSE group_header END END AS g FROM items),
lab AS (SELECT meeting_id, g, min(ord) AS ord FROM h WHERE g <> '' GROUP BY 1, 2),
parts AS (SELECT meeting_id, g, unnest(string_split(g, ' / ')) AS p, generate_subscripts(string_split(g, ' / '), 1) AS i FROM lab),
tops AS (SELECT meeting_id, lower(string_split(g, ' / ')[1]) AS t, count(*) AS n FROM lab GROUP BY 1, 2),
ex AS (SELECT meeting_id, lower(g) AS k, min(g) AS spelled FROM lab GROUP BY 1, 2),
known AS (SELECT parts.*, spelled, coalesce(n, 0) AS n FROM parts LEFT JOIN ex ON ex.meeting_id = parts.meeting_id AND ex.k = lower(p) LEFT JOIN tops ON tops.meeting_id = parts.meeting_id AND tops.t = lower(p)),
pick AS (SELECT meeting_id, g, arg_min(coalesce(spelled, p), CASE WHEN i = 1 AND (spelled IS NOT NULL OR n > 1) THEN 0 WHEN i > 1 AND (spelled IS NOT NULL OR n > 0) THEN i WHEN i = 1 THEN 1000 ELSE 2000 + i END) AS s FROM known GROUP BY 1, 2),
elected AS (SELECT meeting_id, g, ord, CASE WHEN regexp_matches(g, '(?i)^to be assigned by') THEN 'TBD' ELSE s END AS s FROM pick JOIN lab USING (meeting_id, g))"""


def _headed(items):
    g, m = F.col("group_header"), F.col("ord") % 6
    some = F.when(m == 0, F.concat(g, F.lit(" / x"), (F.col("ord") % 4).cast("string"))).when(m == 1, F.concat(F.lit("NTN / "), g)).when(m == 2, "To be assigned by Kim").when(m == 3, F.lower(g))
    some = some.when(m == 4, F.concat(F.lit("Top"), (F.col("ord") % 5).cast("string"), F.lit(" / y"))).otherwise(g)
    return items.withColumn("group_header", F.when(g == "", "").otherwise(some))


@query("f26_label_election", "items", oracle=_ELECT + " SELECT meeting_id, ord, g AS original, s AS simplified FROM elected")
def f26_election(items):
    return timeline.elect_groups(_headed(items))


@query("f26_j7_simplified_groups", "items", oracle=_ELECT + """,
several AS (SELECT meeting_id FROM h WHERE g <> '' GROUP BY 1 HAVING count(DISTINCT g) > 1)
SELECT h.meeting_id, h.ord, coalesce(s, h.g) AS group_header FROM h LEFT JOIN (SELECT elected.* FROM elected JOIN several USING (meeting_id)) e ON e.meeting_id = h.meeting_id AND e.g = h.g""")
def f26_j7(items):
    headed = _headed(items)
    return timeline.apply_group_mapping(headed, timeline.elect_groups(headed)).select("meeting_id", "ord", "group_header")


@query("p11_expanded_choice", "items", oracle="WITH f AS (" + A4 + f"""),
p AS (SELECT *, grp = 'Brand#17' OR grp = '' OR (name || '|' || grp) IN ('small ring|Brand#2', 'red widget|Brand#12') AS picked FROM f),
a AS (SELECT DISTINCT meeting_id, unnest(string_split(ais, '|')) AS ai FROM p WHERE picked AND ais <> '' UNION SELECT DISTINCT meeting_id, '8.3' FROM p),
la AS (SELECT meeting_id, list(ai) AS act FROM a GROUP BY 1),
c AS (SELECT i.*, f.ais AS all_ais, f.has_no_ai, p.picked, act, {AIS} AS l FROM items i JOIN f ON f.meeting_id = i.meeting_id AND f.name = i.name AND f.grp = coalesce(group_header, '') JOIN p ON p.meeting_id = i.meeting_id AND p.name = i.name AND p.grp = f.grp JOIN la ON la.meeting_id = i.meeting_id)
SELECT ord FROM c WHERE (picked AND all_ais = '') OR (all_ais <> '' AND len(list_filter(string_split(all_ais, '|'), lambda x: NOT list_contains(act, x))) = 0 AND (NOT has_no_ai OR picked))
  OR list_has_any(l, act) OR (len(l) = 0 AND picked AND has_no_ai)""")
def p11_expanded(items):
    return layout.apply_facets(items, ["8.3"], [], [], groups=["Brand#17", "__other__"], session_keys=["small ring|Brand#2", "red widget|Brand#12"]).select("ord")
