"""Queries on merged slots, room names and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import changes, grid, slots
from .registry import query

# rooms of every source: details call their first table's rooms as the main schedule does
ROOMS = """sr AS (SELECT meeting_id, s::INTEGER AS source, day, table_index, room_idx, pos, CASE WHEN s > 0 AND pos > 1 THEN concat(name, '-', s) ELSE name END AS name FROM rooms, range(0, 3) t(s))"""
IDX = "list_transform(range(room_from, room_to + 1), lambda i: i::VARCHAR)"
J3 = f"""{ROOMS},
lab AS (SELECT c.ord, string_agg(name, ' + ' ORDER BY pos) FILTER (r.table_index = c.table_index AND room_idx BETWEEN room_from AND room_to) AS names, count(pos) AS known
  FROM slot_cells c LEFT JOIN sr r ON r.meeting_id = c.meeting_id AND r.source = c.source AND r.day = c.day GROUP BY c.ord),
l AS (SELECT c.*, CASE WHEN known = 0 THEN concat('Room [', array_to_string({IDX}, ', '), ']') WHEN names IS NULL THEN concat('Table ', table_index, ' Room [', array_to_string({IDX}, ', '), ']') ELSE names END AS room_label,
    trim(text, ' ' || chr(10)) AS t FROM slot_cells c JOIN lab USING (ord))"""
MERGED = f"""{J3},
e AS (SELECT ord, meeting_id, day, tb, source, 'Main Schedule' AS source_label, room_label, text FROM l WHERE source = 0
  UNION ALL
  SELECT ord, meeting_id, day, tb, source, concat(person, '''s schedule'), CASE WHEN EXISTS (SELECT 1 FROM sr WHERE sr.source = 0 AND sr.meeting_id = d.meeting_id AND sr.day = d.day AND sr.name = d.room_label) THEN concat(person, ': ', room_label) ELSE room_label END, text
  FROM l d WHERE source > 0 AND EXISTS (SELECT 1 FROM l m WHERE m.source = 0 AND m.meeting_id = d.meeting_id AND m.day = d.day AND m.tb = d.tb)
    AND NOT EXISTS (SELECT 1 FROM l m WHERE m.source = 0 AND m.meeting_id = d.meeting_id AND m.day = d.day AND m.tb = d.tb AND m.t = d.t))"""


def _source_rooms(rooms: DataFrame) -> DataFrame:
    named = rooms.withColumn("source", F.explode(F.sequence(F.lit(0), F.lit(2))))
    other = F.concat("name", F.lit("-"), F.col("source").cast("string"))
    return named.withColumn("name", F.when((F.col("source") > 0) & (F.col("pos") > 1), other).otherwise(F.col("name")))


def _merged(cells: DataFrame, rooms: DataFrame) -> DataFrame:
    own = _source_rooms(rooms)
    return slots.merge_slots(slots.room_labels(cells, own))


@query("j3_room_label_of_cell", "slot_cells", "rooms", oracle=f"WITH {J3} SELECT ord, room_label FROM l")
def j3(cells, rooms):
    return slots.room_labels(cells, _source_rooms(rooms)).select("ord", "room_label")


@query("j4_j6_merge_slots", "slot_cells", "rooms", oracle=f"WITH {MERGED} SELECT * FROM e")
def j4(cells, rooms):
    return _merged(cells, rooms).select("ord", "meeting_id", "day", "tb", "source", "source_label", "room_label", "text")


A1 = f"""WITH {MERGED},
s AS (SELECT meeting_id, day, tb, source, source_label, string_agg(room_label || '=' || text, ';' ORDER BY ord) AS es, count(*) AS n FROM e GROUP BY 1, 2, 3, 4, 5),
sl AS (SELECT meeting_id, day, tb, string_agg(source_label || ':' || es, '|' ORDER BY source) AS sources, count(*) AS k, sum(n) AS n FROM s GROUP BY 1, 2, 3)"""


@query("a1_k6_slots", "slot_cells", "rooms", oracle=f"""{A1}
SELECT meeting_id, day, tb, sources, coalesce(nullif(list_position(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday'], day), 0), 99)::INTEGER AS day_order FROM sl""")
def a1(cells, rooms):
    entry = lambda s: F.array_join(F.transform(s["entries"], lambda e: F.concat(e["room_label"], F.lit("="), e["text"])), ";")
    flat = F.array_join(F.transform("sources", lambda s: F.concat(s["source_label"], F.lit(":"), entry(s))), "|")
    return slots.slots(_merged(cells, rooms)).select("meeting_id", "day", "tb", flat.alias("sources"), "day_order")


@query("a6_slot_stats", "slot_cells", "rooms", oracle=f"""{A1}
SELECT meeting_id, count(*) AS n_slots, count(*) FILTER (k > 1) AS n_several, sum(n)::BIGINT AS n_entries FROM sl GROUP BY 1""")
def a6(cells, rooms):
    return slots.slot_stats(slots.slots(_merged(cells, rooms)))


A2 = """h AS (
  SELECT meeting_id, name, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY p, name) AS INTEGER) AS place, p // 100 = min(p // 100) OVER (PARTITION BY meeting_id) AS online
  FROM (SELECT meeting_id, name, min(table_index * 100 + room_idx) AS p FROM rooms GROUP BY 1, 2)),
hints AS (SELECT meeting_id, name, place, CASE WHEN NOT online THEN 'offline' WHEN place = 1 THEN 'main' ELSE 'breakout' END AS role FROM h)"""


@query("a2_room_hints", "rooms", oracle=f"WITH {A2} SELECT * FROM hints")
def a2(rooms):
    return slots.room_hints(rooms)


_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
A2_DAYS = f"""{A2},
hr AS (SELECT meeting_id, list(name ORDER BY place) AS al, list(name ORDER BY place) FILTER (role <> 'offline') AS onl, list(name ORDER BY place) FILTER (role = 'offline') AS offl, min(name) FILTER (role = 'main') AS main, list(name ORDER BY place) FILTER (role = 'breakout') AS brk FROM hints GROUP BY 1),
h2 AS (SELECT meeting_id, CASE meeting_id % 5 WHEN 3 THEN []::VARCHAR[] ELSE al END AS al, CASE meeting_id % 5 WHEN 1 THEN []::VARCHAR[] ELSE coalesce(onl, []) || ['ghost', 'A1', 'A1'] END AS onl, coalesce(offl, []) || ['nowhere'] AS offl,
  CASE meeting_id % 5 WHEN 2 THEN 'ghost' WHEN 4 THEN 'J2' ELSE main END AS main, CASE meeting_id % 5 WHEN 3 THEN []::VARCHAR[] ELSE coalesce(brk, []) END AS brk FROM hr WHERE meeting_id % 7 > 0),
d AS (SELECT meeting_id, day, list(name ORDER BY pos) AS av FROM rooms GROUP BY 1, 2),
e1 AS (SELECT d.*, onl, offl, main, brk, coalesce(al, []) || av AS al0 FROM d LEFT JOIN h2 USING (meeting_id)),
e2 AS (SELECT *, {_FIRST.format("al0")} AS every FROM e1),
e3 AS (SELECT *, CASE WHEN len(coalesce(onl, [])) > 0 THEN list_filter({_FIRST.format("onl")}, lambda r: list_contains(every, r)) ELSE every END AS online, list_filter({_FIRST.format("coalesce(offl, [])")}, lambda r: list_contains(every, r)) AS offline FROM e2),
e4 AS (SELECT *, CASE WHEN list_contains(every, main) THEN main WHEN len(online) > 0 THEN online[1] ELSE every[1] END AS m FROM e3),
e5 AS (SELECT *, list_filter({_FIRST.format("coalesce(brk, [])")}, lambda r: list_contains(every, r) AND r <> m) AS b FROM e4)
SELECT meeting_id, day, array_to_string(every, ',') AS all_rooms, array_to_string(online, ',') AS online_rooms, array_to_string(offline, ',') AS offline_rooms, m AS main_room, array_to_string(CASE WHEN len(b) > 0 THEN b ELSE list_filter(online, lambda r: r <> m) END, ',') AS breakout_rooms FROM e5"""


@query("a2_merge_room_hints", "rooms", oracle=f"WITH {A2_DAYS}")
def a2_days(rooms):
    """Hints with unknown, missing and repeated rooms; every seventh meeting has none."""
    m, none = F.col("meeting_id") % 5, F.array().cast("array<string>")
    hints = slots.hints_of_roles(slots.room_hints(rooms)).where("meeting_id % 7 > 0").withColumns({
        "all_rooms": F.when(m == 3, none).otherwise(F.col("all_rooms")),
        "online_rooms": F.when(m == 1, none).otherwise(F.concat("online_rooms", F.array(F.lit("ghost"), F.lit("A1"), F.lit("A1")))),
        "offline_rooms": F.concat("offline_rooms", F.array(F.lit("nowhere"))),
        "main_room": F.when(m == 2, "ghost").when(m == 4, "J2").otherwise(F.col("main_room")),
        "breakout_rooms": F.when(m == 3, none).otherwise(F.col("breakout_rooms")),
    })
    days = rooms.groupBy("meeting_id", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda r: r["name"]).alias("available"))
    out = slots.merge_room_hints(days, hints)
    lists = ("all_rooms", "online_rooms", "offline_rooms", "breakout_rooms")
    return out.select("meeting_id", "day", "main_room", *[F.array_join(c, ",").alias(c) for c in lists])


# every third meeting has its first room in the last table too, every fourth ten more breakouts
REPEATED = """rr AS (
  SELECT meeting_id, day, table_index, pos, name FROM rooms
  UNION ALL SELECT DISTINCT meeting_id, day, 9, 90, 'F1+F2' FROM rooms WHERE meeting_id % 3 = 0
  UNION ALL SELECT meeting_id, day, 0, CAST(10 + k AS INTEGER), concat('B', k) FROM (SELECT DISTINCT meeting_id, day FROM rooms WHERE meeting_id % 4 = 0), range(0, 11) t(k)
  UNION ALL SELECT DISTINCT meeting_id, day, 8, 80, 'B9' FROM rooms WHERE meeting_id % 4 = 0)"""
W4 = f"""{REPEATED},
ra AS (
  SELECT meeting_id, day, rn, pos, table_index, name, CASE WHEN table_index > first THEN concat('RAN1_off', rn - online) WHEN rn = 1 THEN 'RAN1_main' ELSE concat('RAN1_brk', rn - 1) END AS alias, table_index = first AS on_
  FROM (SELECT *, row_number() OVER w AS rn, min(table_index) OVER d AS first, count(*) FILTER (table_index = f0) OVER d AS online FROM (SELECT *, min(table_index) OVER (PARTITION BY meeting_id, day) AS f0 FROM rr) WINDOW w AS (PARTITION BY meeting_id, day ORDER BY table_index, pos), d AS (PARTITION BY meeting_id, day))),
na AS (SELECT meeting_id, day, name, arg_max(alias, rn) AS alias, min(rn) AS rn FROM ra GROUP BY 1, 2, 3)"""


def _repeated(rooms: DataFrame) -> DataFrame:
    columns = ["table_index", "pos", "name"]
    kind = "array<struct<table_index:int,pos:int,name:string>>"

    def room(table: int, pos, name) -> F.Column:
        return F.struct(F.lit(table).alias("table_index"), pos.alias("pos"), name.alias("name"))

    many = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: room(0, k + 10, F.concat(F.lit("B"), k.cast("string"))))
    more = F.concat(
        F.when(F.col("meeting_id") % 4 == 0, F.concat(many, F.array(room(8, F.lit(80), F.lit("B9"))))).otherwise(F.array().cast(kind)),
        F.when(F.col("meeting_id") % 3 == 0, F.array(room(9, F.lit(90), F.lit("F1+F2")))).otherwise(F.array().cast(kind)),
    )
    days = rooms.groupBy("meeting_id", "day").agg(F.collect_list(F.struct(*columns)).alias("r"))
    return days.select("meeting_id", "day", F.inline(F.concat("r", more)))


@query("w4_room_aliases", "rooms", oracle=f"""WITH {W4}
SELECT meeting_id, day, alias, name, CAST(rn AS INTEGER) AS place FROM ra
UNION ALL SELECT meeting_id, day, 'ALL_ONLINE', string_agg(name, ' + ' ORDER BY rn), NULL FROM ra WHERE on_ GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT meeting_id, day, 'ALL_ROOMS', string_agg(name, ' + ' ORDER BY rn), NULL FROM na GROUP BY 1, 2 HAVING count(*) > 1""")
def w4(rooms):
    return slots.room_aliases(_repeated(rooms), ["meeting_id", "day"])


@query("f15_room_alias_tokens", "items", oracle="""
SELECT DISTINCT room, array_to_string(list_sort(CASE WHEN contains(room, '+') THEN [room, replace(room, '+', ' + '), replace(room, '+', '/'), concat('F', a, '/', b)] ELSE [room] END), '|') AS tokens, regexp_replace(lower(room), '[^a-z0-9]+', '', 'g') AS norm
FROM (SELECT *, CASE WHEN ord % 2 = 0 THEN concat('F', a, '+F', b) ELSE concat('Room-', a) END AS room FROM (SELECT ord, ord % 10 AS a, ord % 7 + 11 AS b FROM items))""")
def f15(items):
    a, b = (F.col("ord") % 10).cast("string"), (F.col("ord") % 7 + 11).cast("string")
    room = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("F"), a, F.lit("+F"), b)).otherwise(F.concat(F.lit("Room-"), a))
    rows = items.select(room.alias("room")).distinct()
    return rows.select("room", F.array_join(F.array_sort(T.room_alias_tokens(F.col("room"))), "|").alias("tokens"), T.token_norm(F.col("room")).alias("norm"))


@query("f16_alias_label", "slot_cells", "rooms", oracle=f"""WITH {MERGED}, {W4},
p AS (SELECT e.ord, e.meeting_id, e.day, CASE WHEN contains(room_label, ': ') THEN split_part(room_label, ': ', 1) || ': ' ELSE '' END AS pre, CASE WHEN contains(room_label, ': ') THEN split_part(room_label, ': ', 2) ELSE room_label END AS rest FROM e),
q AS (SELECT ord, meeting_id, day, pre, unnest(string_split(rest, ' + ')) AS part, generate_subscripts(string_split(rest, ' + '), 1) AS i FROM p)
SELECT q.ord, q.pre || string_agg(coalesce(ra.alias, part), ' + ' ORDER BY i) AS label FROM q LEFT JOIN na AS ra ON ra.meeting_id = q.meeting_id AND ra.day = q.day AND ra.name = q.part GROUP BY q.ord, q.pre""")
def f16(cells, rooms):
    keys = ["meeting_id", "day"]
    maps = slots.alias_map(slots.room_aliases(_repeated(rooms), keys), keys)
    out = _merged(cells, rooms).join(maps, keys, "left")
    empty = F.create_map().cast("map<string,string>")
    return out.select("ord", T.alias_label(F.col("room_label"), F.coalesce("aliases", empty)).alias("label"))


def _payload(cells: DataFrame, rooms: DataFrame) -> DataFrame:
    days = slots.day_rooms(_repeated(rooms), ["meeting_id", "day"])
    return slots.slot_payload(slots.slots(_merged(cells, rooms)), days)


F18 = f"""WITH {MERGED}, {W4},
p AS (SELECT e.*, CASE WHEN contains(room_label, ': ') THEN split_part(room_label, ': ', 1) || ': ' ELSE '' END AS pre, CASE WHEN contains(room_label, ': ') THEN split_part(room_label, ': ', 2) ELSE room_label END AS rest FROM e),
q AS (SELECT ord, meeting_id, day, unnest(string_split(rest, ' + ')) AS part, generate_subscripts(string_split(rest, ' + '), 1) AS i FROM p),
al AS (SELECT q.ord, string_agg(coalesce(ra.alias, part), ' + ' ORDER BY i) AS rest FROM q LEFT JOIN na AS ra ON ra.meeting_id = q.meeting_id AND ra.day = q.day AND ra.name = q.part GROUP BY q.ord),
n AS (SELECT p.*, p.pre || al.rest AS label FROM p JOIN al USING (ord)),
b AS (SELECT meeting_id, day, tb, string_agg(chr(10) || '[' || label || ']' || chr(10) || text, chr(10) ORDER BY source, ord) FILTER (source = 0) AS m,
    string_agg(chr(10) || '[' || source_label || ' — ' || label || ']' || chr(10) || text, chr(10) ORDER BY source, ord) FILTER (source > 0) AS d FROM n GROUP BY 1, 2, 3),
lg AS (SELECT ra.meeting_id, ra.day, string_agg('  ' || na.alias || '  (= ' || ra.name || ')', chr(10) ORDER BY ra.pos) AS legend FROM ra JOIN na ON na.meeting_id = ra.meeting_id AND na.day = ra.day AND na.name = ra.name GROUP BY 1, 2)
SELECT meeting_id, day, tb, 'Day: ' || day || ', Time Block: ' || ['08:30-10:30 (120', '11:00-13:00 (120', '14:30-16:30 (120', '17:00-19:30 (150'][tb + 1] || ' min)' || chr(10) || chr(10) || 'TARGET ROOMS:' || chr(10) || coalesce(legend, '')
  || chr(10) || chr(10) || '## Main Schedule' || chr(10) || m || coalesce(chr(10) || chr(10) || '## Detail' || chr(10) || d, '') AS payload
FROM b LEFT JOIN lg USING (meeting_id, day)"""


@query("f18_slot_payload", "slot_cells", "rooms", oracle=F18)
def f18(cells, rooms):
    return _payload(cells, rooms).drop("content_key")


@query("f17_content_key", "slot_cells", oracle="""
SELECT ord, substr(sha256('{"ord":' || ord || ',"day":"' || day || '","t":"' || trim(text, ' ' || chr(10)) || '"}'), 1, 16) AS content_key FROM slot_cells""")
def f17(cells):
    return cells.select("ord", T.content_key(F.struct("ord", "day", T.strip(F.col("text")).alias("t"))).alias("content_key"))


@query("j16_cache_misses", "slot_cells", oracle="""
WITH k AS (SELECT DISTINCT day, tb, sha256(day || tb || trim(text, ' ' || chr(10))) AS content_key, trim(text, ' ' || chr(10)) AS t FROM slot_cells)
SELECT content_key, day, tb FROM k WHERE content_key NOT IN (SELECT content_key FROM k WHERE tb = 1 OR t = 'topic 2')""")
def j16(cells):
    t = T.strip(F.col("text"))
    keys = cells.select("day", "tb", F.sha2(F.concat("day", F.col("tb").cast("string"), t), 256).alias("content_key"), t.alias("t")).distinct()
    return changes.cache_misses(keys, keys.where("tb = 1 OR t = 'topic 2'")).select("content_key", "day", "tb")


# contexts are numbered within their meeting
CONTEXTS = """ctx AS (
  SELECT ord - 2400 * meeting_id AS context_id, meeting_id, CAST(1 + ord % 3 AS INTEGER) AS n_rooms, CASE ord % 7 WHEN 0 THEN 'Offline session schedule' WHEN 1 THEN 'online sessions' WHEN 2 THEN 'Break-out #2 and brk 1' WHEN 3 THEN 'Schedule of F1/2 and J1' WHEN 4 THEN 'The Main Session' WHEN 5 THEN 'a1 room' ELSE 'other' END AS context FROM items)"""
J13 = f"""{A2}, {CONTEXTS},
x AS (SELECT c.meeting_id, c.context_id, n_rooms, h.name, h.place, h.role, lower(context) AS low, regexp_replace(lower(context), '[^a-z0-9]+', '', 'g') AS plain, row_number() OVER (PARTITION BY c.meeting_id, context_id, role ORDER BY place) AS nth,
    list_transform(regexp_extract_all(lower(context), '(?:brk|break\\s*[-_ ]?out)\\s*#?\\s*(\\d+)', 1), lambda s: s::BIGINT) AS nums FROM ctx c JOIN hints h USING (meeting_id)),
r AS (SELECT *, CASE
    WHEN contains(plain, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g')) OR (name = 'F1+F2' AND contains(plain, 'f12')) THEN 1
    WHEN role = 'breakout' AND list_contains(nums, nth) THEN 2
    WHEN role = 'offline' AND contains(low, 'offline') THEN 3
    WHEN role <> 'offline' AND regexp_matches(low, '\\bonline\\b') AND (n_rooms > 1 OR role = 'main') THEN 4
    WHEN role = 'main' AND contains(low, 'main session') THEN 5 END AS rule FROM x),
k AS (SELECT *, CASE rule WHEN 2 THEN list_position(nums, nth) ELSE place END AS k FROM r WHERE rule = (SELECT min(rule) FROM r b WHERE b.meeting_id = r.meeting_id AND b.context_id = r.context_id)),
j13 AS (SELECT meeting_id, context_id, array_to_string(list(name ORDER BY k)[1:any_value(n_rooms)], ',') AS rooms FROM k GROUP BY 1, 2)"""


def _contexts(items: DataFrame) -> DataFrame:
    m = F.col("ord") % 7
    text = F.when(m == 0, "Offline session schedule").when(m == 1, "online sessions").when(m == 2, "Break-out #2 and brk 1").when(m == 3, "Schedule of F1/2 and J1").when(m == 4, "The Main Session").when(m == 5, "a1 room").otherwise("other")
    return items.select((F.col("ord") - 2400 * F.col("meeting_id")).alias("context_id"), "meeting_id", (1 + F.col("ord") % 3).cast("int").alias("n_rooms"), text.alias("context"))


@query("j13_rooms_from_context", "items", "rooms", oracle=f"WITH {J13} SELECT * FROM j13")
def j13(items, rooms):
    return slots.rooms_from_context(_contexts(items), slots.room_hints(rooms)).select("meeting_id", "context_id", F.array_join("rooms", ",").alias("rooms"))


@query("j14_resolve_generic_rooms", "items", "rooms", oracle=f"""WITH {J13},
t AS (SELECT meeting_id, context_id, CASE WHEN context_id % 5 = 0 THEN ['F1', 'A1'] ELSE list_transform(range(0, 1 + context_id % 3), lambda i: 'Room ' || chr(65 + i::INTEGER)) END AS own, CASE WHEN context_id % 11 = 0 THEN '' ELSE context END AS c FROM ctx)
SELECT meeting_id, context_id, array_to_string(CASE WHEN context_id % 5 = 0 OR c = '' OR j13.rooms IS NULL THEN own ELSE (string_split(j13.rooms, ',') || own[len(string_split(j13.rooms, ',')) + 1 :])[1:len(own)] END, ',') AS rooms FROM t LEFT JOIN j13 USING (meeting_id, context_id)""")
def j14(items, rooms):
    lettered = F.transform(F.sequence(F.lit(0), (F.col("context_id") % 3).cast("int")), lambda i: F.concat(F.lit("Room "), F.chr(i + 65)))
    own = F.when(F.col("context_id") % 5 == 0, F.array(F.lit("F1"), F.lit("A1"))).otherwise(lettered)
    tables = _contexts(items).drop("n_rooms").withColumns({"rooms": own, "context": F.when(F.col("context_id") % 11 == 0, "").otherwise(F.col("context"))})
    return slots.resolve_generic_rooms(tables, slots.room_hints(rooms)).select("meeting_id", "context_id", F.array_join("rooms", ",").alias("rooms"))


@query("j15_reuse_meeting_timezone", "listing", oracle="""
WITH m AS (SELECT DISTINCT inbox_id, concat('ran1#', inbox_id % 7) AS meeting_id, CASE inbox_id % 4 WHEN 0 THEN 'St. Julian, Malta' WHEN 1 THEN 'Dallas, USA' WHEN 2 THEN 'Nowhere' END AS location FROM listing),
s AS (SELECT inbox_id, concat('ran1#', inbox_id % 6) AS meeting_id, CASE WHEN inbox_id % 5 > 0 THEN 'Asia/Tokyo' END AS timezone FROM m),
p AS (SELECT * FROM (VALUES ('St. Julian, Malta', 'Europe/Malta'), ('Dallas, USA', 'America/Chicago')) t(location, timezone))
SELECT m.inbox_id, m.meeting_id, coalesce(s.timezone, p.timezone, 'UTC') AS timezone FROM m LEFT JOIN s ON s.inbox_id = m.inbox_id AND s.meeting_id = m.meeting_id LEFT JOIN p ON p.location = m.location""")
def j15(listing):
    i = F.col("inbox_id")
    place = F.when(i % 4 == 0, "St. Julian, Malta").when(i % 4 == 1, "Dallas, USA").when(i % 4 == 2, "Nowhere")
    meetings = listing.select("inbox_id").distinct().withColumns({"meeting_id": F.concat(F.lit("ran1#"), (i % 7).cast("string")), "location": place})
    state = meetings.select("inbox_id", F.concat(F.lit("ran1#"), (i % 6).cast("string")).alias("meeting_id"), F.when(i % 5 > 0, "Asia/Tokyo").alias("timezone"))
    places = meetings.sparkSession.createDataFrame([("St. Julian, Malta", "Europe/Malta"), ("Dallas, USA", "America/Chicago")], "location string, timezone string")
    return slots.reuse_timezone(meetings, state, places)


_LINE = "CASE c_custkey % 5 WHEN 0 THEN concat('Port ', n, ' East, ', n, ', May 3rd') WHEN 1 THEN concat('Great Port-', n, ' east Bay, ', n, ', Aug. 14 ~ 18') WHEN 2 THEN concat('Port ', n, ', ', n, '., Oct. 1') WHEN 3 THEN concat('Elsewhere, ', n, ', May 3') ELSE concat('no place of ', n) END"


@query("j15_location_timezone", "customer", "nation", oracle=f"""
WITH p AS (SELECT c_custkey, n_nationkey, {_LINE} AS line FROM (SELECT c_custkey, n_nationkey, upper(w[1:1]) || lower(w[2:]) AS n FROM customer JOIN (SELECT *, translate(n_name, '0123456789_', 'abcdefghij ') AS w FROM nation) ON c_nationkey = n_nationkey) x)
SELECT c_custkey AS inbox_id, CASE WHEN c_custkey % 11 = 0 THEN 'Asia/Tokyo' WHEN c_custkey % 5 < 2 THEN concat('East/', n_nationkey) WHEN c_custkey % 5 = 2 THEN concat('Port/', n_nationkey) ELSE 'UTC' END AS timezone FROM p""")
def j15_zones(customer, nation):
    """Lines out of documents' paragraphs (P10), their places' zones, and those stored for the same meeting."""
    nation = nation.withColumn("n_name", F.translate("n_name", "0123456789_", "abcdefghij "))
    n = F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.expr("substring(n_name, 2)")))
    lines = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", n.alias("n"))
    lines = lines.withColumn("line", F.expr(_LINE))
    paragraphs = lines.select(F.col("c_custkey").alias("doc_id"), F.inline(F.array(F.struct(F.lit(0).alias("pos"), F.lit("A title, and more").alias("text")), F.struct(F.lit(1).alias("pos"), F.concat(F.lit(" "), "line").alias("text")))))
    found = grid.location_line(paragraphs)
    place = nation.select(n.alias("n"), "n_name", F.col("n_nationkey").cast("string").alias("k"))
    port = place.select(F.concat(F.lit("PORT "), "n").alias("city"), F.col("n_name").alias("country"), F.concat(F.lit("Port/"), "k").alias("timezone"))
    east = place.select(F.concat(F.lit("Port "), "n", F.lit(", East")).alias("city"), F.col("n_name").alias("country"), F.concat(F.lit("East/"), "k").alias("timezone"))
    zones = slots.location_zones(found, port.unionByName(east))
    meetings = lines.select(F.col("c_custkey").alias("inbox_id"), F.lit("ran1#124").alias("meeting_id")).join(found.withColumnRenamed("doc_id", "inbox_id"), "inbox_id", "left")
    state = meetings.where("inbox_id % 11 = 0").select("inbox_id", "meeting_id", F.lit("Asia/Tokyo").alias("timezone"))
    return slots.reuse_timezone(meetings, state, zones).select("inbox_id", "timezone")


J17 = """
WITH m AS (SELECT * FROM items WHERE ord % 4 = 0), d AS (SELECT *, ord % 2 AS source, concat(name, CASE WHEN ord % 3 = 0 THEN ' (detail)' ELSE '' END) AS dn FROM items WHERE ord % 4 <> 0),
h AS (SELECT m.ord, d.ord AS do_, d.dn, d.agenda_item AS di, d.chair AS dc, d.source FROM m JOIN d ON d.meeting_id = m.meeting_id AND d.day = m.day AND d.tb = m.tb AND d.duration_minutes = m.duration_minutes
  AND regexp_replace(lower(m.name), '[^a-z0-9]+', '', 'g') <> '' AND contains(regexp_replace(lower(d.dn), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(m.name), '[^a-z0-9]+', '', 'g'))),
it AS (SELECT ord, do_, i, x FROM (SELECT ord, do_, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT ord, do_, list_transform(string_split(di, ','), lambda z: trim(z)) AS l FROM h WHERE di IS NOT NULL))),
ia AS (SELECT ord, string_agg(x, ', ' ORDER BY f) AS items FROM (SELECT ord, x, min(do_ * 100 + i) AS f FROM it GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT ord, arg_max(dn, length(dn) * 10000000000 - do_) AS dn, CASE WHEN count(DISTINCT source) = 1 THEN arg_min(dc, do_) FILTER (dc IS NOT NULL) END AS dc FROM h GROUP BY 1)
SELECT m.ord, coalesce(a.dn, name) AS name, coalesce(nullif(agenda_item, ''), ia.items) AS agenda_item, coalesce(nullif(chair, ''), a.dc) AS chair, room_name FROM m LEFT JOIN a USING (ord) LEFT JOIN ia USING (ord)"""


@query("j17_enrich_main_with_detail", "items", oracle=J17)
def j17(items):
    detail = items.where("ord % 4 != 0").withColumns({"source": F.col("ord") % 2, "name": F.concat("name", F.when(F.col("ord") % 3 == 0, " (detail)").otherwise(""))})
    return slots.enrich_main_with_detail(items.where("ord % 4 = 0"), detail).select("ord", "name", "agenda_item", "chair", "room_name")


@query("f27_multi_room_label", "rooms", oracle="""
WITH r AS (SELECT meeting_id, day, list(name ORDER BY pos) AS every, list(name ORDER BY pos) FILTER (table_index = 0) AS online_, list(name ORDER BY pos) FILTER (pos <= meeting_id % 3) AS own FROM rooms GROUP BY 1, 2)
SELECT meeting_id, day, CASE WHEN len(every) > 1 AND list_has_all(own, every) THEN 'ALL_ROOMS' WHEN len(coalesce(online_, [])) > 1 AND list_has_all(own, online_) THEN 'ALL_ONLINE' ELSE coalesce(array_to_string(own, ' + '), '') END AS label FROM r""")
def f27(rooms):
    def names(condition):
        listed = F.array_sort(F.collect_list(F.when(condition, F.struct("pos", "name"))))
        return F.transform(listed, lambda r: r["name"])

    sets = rooms.groupBy("meeting_id", "day").agg(names(F.lit(True)).alias("every"), names(F.col("table_index") == 0).alias("online"), names(F.col("pos") <= F.col("meeting_id") % 3).alias("own"))
    return sets.select("meeting_id", "day", slots.multi_room_label(F.col("own"), F.col("online"), F.col("every")).alias("label"))
