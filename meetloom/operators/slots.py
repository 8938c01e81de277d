"""Merging the main schedule with detail schedules by slot, and room names.

Cells have (meeting_id, source, person, day, tb, ord, table_index, room_from, room_to, text);
source 0, without a person, is the main schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DAYS, TIME_BLOCKS
from ..functions import text as T

DAY = ["meeting_id", "day"]
SLOT = [*DAY, "tb"]


def _indices() -> Column:
    return F.array_join(F.transform(F.sequence("room_from", "room_to"), lambda i: i.cast("string")), ", ")


def room_labels(cells: DataFrame, rooms: DataFrame) -> DataFrame:
    """cells with room_label (J3): their rooms' names in order; by index where no room is known; and the names of the day's main rooms (main_rooms).

    rooms has (meeting_id, source, day, table_index, room_idx, pos, name). Those of a day are
    few and come to its cells as one array, so cells are dealt by meeting and day, as later
    steps take them.
    """
    listed = rooms.groupBy(*DAY).agg(F.array_sort(F.collect_list(F.struct("pos", "table_index", "room_idx", "name", "source"))).alias("__rooms"))
    here = F.filter("__rooms", lambda r: r["source"] == F.col("source"))
    own = F.filter(here, lambda r: (r["table_index"] == F.col("table_index")) & r["room_idx"].between(F.col("room_from"), F.col("room_to")))
    names = F.array_join(F.transform(own, lambda r: r["name"]), " + ")
    none = F.concat(F.lit("Room ["), _indices(), F.lit("]"))
    unknown = F.concat(F.lit("Table "), F.col("table_index").cast("string"), F.lit(" "), none)
    label = F.when(F.col("__rooms").isNull() | (F.size(here) == 0), none).when(F.size(own) == 0, unknown).otherwise(names)
    main = F.transform(F.filter("__rooms", lambda r: r["source"] == 0), lambda r: r["name"])
    return cells.join(listed, DAY, "left").select(*cells.columns, label.alias("room_label"), main.alias("main_rooms"))


def merge_slots(labelled: DataFrame) -> DataFrame:
    """Entries of every slot that the main schedule has, in order (J4, J5, J6), of cells with room_label and main_rooms.

    Detail cells whose text the main schedule has in the slot are dropped; a detail label that
    is one of the day's main rooms gets the person in front.
    """
    text, is_main = T.strip(F.col("text")), F.col("source") == 0
    slot, same = Window.partitionBy(*SLOT), Window.partitionBy(*SLOT, "__text")
    marked = labelled.withColumn("__text", text).withColumn("__known", F.bool_or(is_main).over(same) & F.col("__text").isNotNull())
    marked = marked.withColumn("__slot", F.bool_or(is_main).over(slot))  # after the narrower window, whose order serves it
    kept = marked.where(is_main | (F.col("__slot") & ~F.col("__known")))
    prefixed = ~is_main & F.coalesce(F.array_contains("main_rooms", F.col("room_label")), F.lit(False))
    kept = kept.withColumn("room_label", F.when(prefixed, F.concat("person", F.lit(": "), "room_label")).otherwise(F.col("room_label")))
    label = F.when(is_main, "Main Schedule").otherwise(F.concat("person", F.lit("'s schedule")))
    return kept.select(*[c for c in labelled.columns if c != "main_rooms"], label.alias("source_label"))


def slots(entries: DataFrame) -> DataFrame:
    """A row per slot with nested, ordered sources (A1), by weekday and block (K6)."""
    per = entries.groupBy(*SLOT, "source", "source_label").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "room_label", "text"))), lambda e: F.struct(e["room_label"], e["text"])).alias("entries"))
    out = per.groupBy(*SLOT).agg(F.array_sort(F.collect_list(F.struct("source", "source_label", "entries"))).alias("sources"))
    number = F.nullif(F.array_position(F.array(*[F.lit(d) for d in DAYS]), F.col("day")), F.lit(0))
    return out.withColumn("day_order", F.coalesce(number.cast("int"), F.lit(99)))


def slot_stats(slotted: DataFrame) -> DataFrame:
    """Slots, slots with several sources, and entries of a meeting."""
    entries = F.aggregate("sources", F.lit(0), lambda a, s: a + F.size(s["entries"]))
    return slotted.groupBy("meeting_id").agg(F.count("*").alias("n_slots"), F.count_if(F.size("sources") > 1).alias("n_several"), F.sum(entries).alias("n_entries"))


def room_hints(rooms: DataFrame) -> DataFrame:
    """(meeting_id, name, place, role): rooms in order of their best place over days (A2).

    Rooms of the smallest table are online, the first of them main, the others breakouts; the
    rest is offline.
    """
    best = rooms.groupBy("meeting_id", "name").agg(F.min(F.struct("table_index", "room_idx")).alias("p"))
    order = Window.partitionBy("meeting_id").orderBy("p", "name")
    first = F.min("p.table_index").over(Window.partitionBy("meeting_id"))
    placed = best.withColumns({"place": F.row_number().over(order), "online": F.col("p.table_index") == first})
    role = F.when(~F.col("online"), "offline").when(F.col("place") == 1, "main").otherwise("breakout")
    return placed.select("meeting_id", "name", "place", role.alias("role"))


def merge_room_hints(days: DataFrame, hints: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A day's rooms with what a meeting's hints say of them (A2).

    days has (meeting_id, day, available), hints (meeting_id, all_rooms, online_rooms,
    offline_rooms, main_room, breakout_rooms), of which anything may be missing. Hinted rooms
    come before the others. Without online rooms all are online; online, offline and breakout
    rooms that aren't among all go; the main room is then the first online one, else the first;
    without breakout rooms all online ones but the main are.
    """
    keys = keys or ["meeting_id"]
    none = F.array().cast("array<string>")
    told = days.join(hints, keys, "left")

    def unique(name: str) -> Column:
        return F.array_distinct(F.coalesce(name, none))

    every = F.array_distinct(F.concat(F.coalesce("all_rooms", none), F.coalesce("available", none)))
    told = told.withColumn("__all", every)

    def known(rooms: Column) -> Column:
        return F.filter(rooms, lambda r: F.array_contains("__all", r))

    online = known(F.when(F.size(unique("online_rooms")) > 0, unique("online_rooms")).otherwise(F.col("__all")))
    told = told.withColumns({"__online": online, "__offline": known(unique("offline_rooms"))})
    first = F.coalesce(F.try_element_at("__online", F.lit(1)), F.try_element_at("__all", F.lit(1)))
    told = told.withColumn("__main", F.when(F.array_contains("__all", F.col("main_room")), F.col("main_room")).otherwise(first))
    breakouts = F.filter(known(unique("breakout_rooms")), lambda r: r != F.col("__main"))
    others = F.filter("__online", lambda r: r != F.col("__main"))
    return told.select(
        *keys, *[c for c in days.columns if c not in (*keys, "available")], F.col("__all").alias("all_rooms"), F.col("__online").alias("online_rooms"), F.col("__offline").alias("offline_rooms"),
        F.col("__main").alias("main_room"), F.when(F.size(breakouts) > 0, breakouts).otherwise(others).alias("breakout_rooms"),
    )


def hints_of_roles(hints: DataFrame) -> DataFrame:
    """The hints of `room_hints`, a row per meeting as `merge_room_hints` takes them."""

    def names(condition: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("place", "name")))), lambda r: r["name"])

    role = F.col("role")
    return hints.groupBy("meeting_id").agg(
        names(F.lit(True)).alias("all_rooms"), names(role != "offline").alias("online_rooms"), names(role == "offline").alias("offline_rooms"),
        F.min_by("name", F.when(role == "main", F.col("place"))).alias("main_room"), names(role == "breakout").alias("breakout_rooms"),
    )


def room_aliases(rooms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, alias, name, place) of a day's rooms (W4), with the aliases of several rooms, whose place is null.

    A name that stands in several places has an alias for each; ALL_ROOMS names it once.
    """
    day = Window.partitionBy(*keys)
    ranked = rooms.withColumns({"t": F.dense_rank().over(day.orderBy("table_index")), "i": F.row_number().over(day.orderBy("table_index", "pos"))})
    n_online = F.count_if(F.col("t") == 1).over(day)
    alias = F.when(F.col("t") > 1, F.concat(F.lit("RAN1_off"), (F.col("i") - n_online).cast("string"))).when(F.col("i") == 1, "RAN1_main").otherwise(F.concat(F.lit("RAN1_brk"), (F.col("i") - 1).cast("string")))
    single = ranked.select(*keys, alias.alias("alias"), "name", "t", F.col("i").alias("place"))

    def joined(df: DataFrame, name: str) -> DataFrame:
        listed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("r")).where(F.size("r") > 1)
        return listed.select(*keys, F.lit(name).alias("alias"), F.array_join(F.col("r.name"), " + ").alias("name"), F.lit(None).cast("int").alias("place"))

    once = single.groupBy(*keys, "name").agg(F.min("place").alias("place"))
    return single.drop("t").unionByName(joined(single.where("t = 1"), "ALL_ONLINE")).unionByName(joined(once, "ALL_ROOMS"))


def alias_map(aliases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, aliases): each day's map of room names to aliases; of a name's several aliases that of its last place counts."""
    last = aliases.where("place IS NOT NULL").groupBy(*keys, "name").agg(F.max_by("alias", "place").alias("alias"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("name", "alias"))).alias("aliases"))


def day_rooms(rooms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rooms, aliases): each day's room names in order of pos, and its map of names to aliases, of one pass over the rooms.

    The aliases are those of W4 as `alias_map` has them; a day's rooms are few.
    """
    days = rooms.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("table_index", "pos", "name"))).alias("r"))
    n_online = F.size(F.filter("r", lambda x: x["table_index"] == F.col("r")[0]["table_index"]))

    def alias(x: Column, i: Column) -> Column:
        number = F.when(i >= n_online, F.concat(F.lit("RAN1_off"), (i - n_online + 1).cast("string")))
        return F.struct(x["name"].alias("name"), number.when(i == 0, "RAN1_main").otherwise(F.concat(F.lit("RAN1_brk"), i.cast("string"))).alias("alias"))

    days = days.withColumn("a", F.transform("r", alias))
    last = F.filter("a", lambda x, i: ~F.exists(F.slice("a", i + 2, F.size("a")), lambda y: y["name"] == x["name"]))
    in_order = F.transform(F.array_sort(F.transform("r", lambda x: F.struct(x["pos"], x["name"]))), lambda x: x["name"])
    return days.select(*keys, in_order.alias("rooms"), F.map_from_entries(last).alias("aliases"))


def multi_room_label(room_names: Column, online: Column, all_rooms: Column) -> Column:
    """Label of a cell's rooms (F27): every room, all online ones, or their names."""
    every = (F.size(all_rooms) > 1) & (F.size(F.array_except(all_rooms, room_names)) == 0)
    on = (F.size(online) > 1) & (F.size(F.array_except(online, room_names)) == 0)
    return F.when(every, "ALL_ROOMS").when(on, "ALL_ONLINE").otherwise(F.array_join(room_names, " + "))


def slot_payload(slotted: DataFrame, main_rooms: DataFrame) -> DataFrame:
    """Slots with their text (F18) and content key.

    main_rooms has (meeting_id, day, rooms, aliases): names in order, and the map of aliases.
    """
    block = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for _, a, b in TIME_BLOCKS])[F.col("tb")]
    minutes = T.minutes(block["b"]) - T.minutes(block["a"])
    header = F.format_string("Day: %s, Time Block: %s-%s (%d min)", "day", block["a"], block["b"], minutes)
    rooms, aliases = F.coalesce("rooms", F.array().cast("array<string>")), F.coalesce("aliases", F.create_map().cast("map<string,string>"))
    legend = F.array_join(F.transform(rooms, lambda r: F.concat(F.lit("  "), F.coalesce(F.try_element_at(aliases, r), r), F.lit("  (= "), r, F.lit(")"))), "\n")
    main = F.filter("sources", lambda s: s["source"] == 0)
    detail = F.filter("sources", lambda s: s["source"] > 0)

    def lines(sources: Column, titled: bool) -> Column:
        def entry(s, e):
            label = T.alias_label(e["room_label"], aliases)
            head = F.concat(s["source_label"], F.lit(" — "), label) if titled else label
            return F.concat(F.lit("\n["), head, F.lit("]\n"), e["text"])

        return F.flatten(F.transform(sources, lambda s: F.transform(s["entries"], lambda e: entry(s, e))))

    parts = F.concat(
        F.array(header, F.concat(F.lit("\nTARGET ROOMS:\n"), legend), F.lit("\n## Main Schedule")),
        lines(main, False),
        F.when(F.size(detail) > 0, F.concat(F.array(F.lit("\n## Detail")), lines(detail, True))).otherwise(F.array().cast("array<string>")),
    )
    key = T.content_key(F.struct(F.lit(1).alias("v"), "day", "tb", rooms.alias("rooms"), "sources"))
    return slotted.join(main_rooms, ["meeting_id", "day"], "left").select(*SLOT, F.array_join(parts, "\n").alias("payload"), key.alias("content_key"))


def rooms_from_context(contexts: DataFrame, hints: DataFrame, needed: str = "n_rooms") -> DataFrame:
    """Rooms that headings speak of (J13): (meeting_id, context_id, rooms), the first rule with a hit, n_rooms at most.

    contexts has (meeting_id, context_id, context, n_rooms). Rules: a room's label or a way
    to write it; numbered breakouts; "offline"; "online"; "main session".
    """
    told = _with_hints(contexts, hints, "inner").withColumn("rooms", _spoken_of(F.col(needed)))
    return told.where(F.size("rooms") > 0).select("meeting_id", "context_id", "rooms")


def _with_hints(contexts: DataFrame, hints: DataFrame, how: str) -> DataFrame:
    """contexts with what their text has (__plain, __numbers, __offline, __online, __main) and their meeting's rooms (__hints), which are few and come as one array."""
    nth = F.row_number().over(Window.partitionBy("meeting_id", "role").orderBy("place"))
    tokens = F.filter(F.transform(T.room_alias_tokens(F.col("name")), T.token_norm), lambda t: F.length(t) >= 2)
    told = hints.select("meeting_id", "place", "name", "role", nth.alias("nth"), tokens.alias("tokens"))
    rooms = told.groupBy("meeting_id").agg(F.collect_list(F.struct("place", "name", "role", "nth", "tokens")).alias("__hints"))
    low = F.lower("context")
    marks = {
        "__plain": T.token_norm(F.col("context")),
        "__numbers": F.transform(F.regexp_extract_all(low, F.lit(r"(?:brk|break\s*[-_ ]?out)\s*#?\s*(\d+)"), F.lit(1)), lambda x: x.try_cast("int")),
        "__offline": low.rlike(r"\boffline\b|offline session schedule"),
        "__online": low.rlike(r"\bonline\b|online session schedule"),
        "__main": low.contains("main session"),
    }
    return contexts.withColumns(marks).join(rooms, "meeting_id", how)


def _spoken_of(needed: Column) -> Column:
    """Names of the rooms in __hints that a text's marks speak of, by the first rule with a hit."""

    def hit(r: Column) -> Column:
        named = F.exists(r["tokens"], lambda t: F.col("__plain").contains(t))
        at = F.array_position("__numbers", F.when(r["role"] == "breakout", r["nth"]))
        online = r["role"].isin("main", "breakout") & F.col("__online") & ((needed > 1) | (r["role"] == "main"))

        def by(rule: int, k: Column) -> Column:
            return F.struct(F.lit(rule).alias("rule"), k.alias("k"), r["name"].alias("name"))

        return (
            F.when(named, by(1, r["place"]))
            .when(at > 0, by(2, at.cast("int")))
            .when((r["role"] == "offline") & F.col("__offline"), by(3, r["place"]))
            .when(online, by(4, r["place"]))
            .when((r["role"] == "main") & F.col("__main"), by(5, r["place"]))
        )

    found = F.array_sort(F.filter(F.transform("__hints", hit), lambda x: x.isNotNull()))
    best = F.transform(F.array(found), lambda all_: F.transform(F.filter(all_, lambda x: x["rule"] == all_[0]["rule"]), lambda x: x["name"]))[0]  # sorted, so the first has the best rule
    return F.slice(best, 1, F.greatest(needed, F.lit(1)))


def resolve_generic_rooms(tables: DataFrame, hints: DataFrame) -> DataFrame:
    """Detail tables with their rooms' real names.

    tables has (meeting_id, context_id, context, rooms). Tables with a room named "Room .." or
    "Offline .." and a context get the rooms the context speaks of, filled up by their own.
    """
    generic = F.exists("rooms", lambda r: r.startswith("Room ") | r.startswith("Offline "))
    asked = generic & (T.strip(F.coalesce("context", F.lit(""))) != "")
    n = F.size("rooms")
    told = _with_hints(tables.withColumn("__asked", asked), hints, "left").withColumn("__found", F.when(F.col("__asked"), _spoken_of(n)))
    more = F.when(F.size("__found") < n, F.slice("rooms", F.size("__found") + 1, n)).otherwise(F.array().cast("array<string>"))
    filled = F.when(F.size("__found") > 0, F.slice(F.concat("__found", more), 1, n))
    return told.select(*[F.coalesce(filled, "rooms").alias("rooms") if c == "rooms" else F.col(c) for c in tables.columns])


def reuse_timezone(meetings: DataFrame, state: DataFrame, places: DataFrame) -> DataFrame:
    """(inbox_id, meeting_id, timezone): that stored for the same meeting, else the location's, else UTC."""
    stored = state.select("inbox_id", "meeting_id", F.col("timezone").alias("__stored"))
    known = places.select("location", F.col("timezone").alias("__place"))
    out = meetings.join(stored, ["inbox_id", "meeting_id"], "left").join(known, "location", "left")
    return out.select("inbox_id", "meeting_id", F.coalesce("__stored", "__place", F.lit("UTC")).alias("timezone"))


def location_zones(locations: DataFrame, places: DataFrame) -> DataFrame:
    """(location, timezone) of the lines "City, Country, Month 1" (P10) that a table of places (city, country, timezone) knows.

    City and country are compared by their words, in lower case and without punctuation. A
    place's city may be any words in a row of the line's; the longest counts, of equal ones
    the first by name. Countries have to be equal; a place may be listed under several names.
    """

    def words(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "['’]", ""), r"[^\p{L}\p{N}]+", " "))

    parts = F.split("location", ",")
    lines = locations.select("location").where("location IS NOT NULL").distinct()
    lines = lines.select("location", words(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))).alias("country"), F.split(words(parts[0]), " ").alias("w"))
    n = F.size("w")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice("w", i, j - i + 1), " "))))
    asked = lines.select("location", "country", F.explode(F.array_distinct(runs)).alias("city"))
    known = places.select(words(F.col("country")).alias("country"), words(F.col("city")).alias("city"), "timezone")
    hits = asked.join(known, ["country", "city"])
    return hits.groupBy("location").agg(F.min_by("timezone", F.struct(-F.length("city"), "city", "timezone")).alias("timezone"))


def enrich_main_with_detail(main: DataFrame, detail: DataFrame) -> DataFrame:
    """Main items with what detail items of their slot add.

    main has (slot, ord, room_name, name, duration_minutes, agenda_item, chair), detail the same with source.
    A detail item matches by equal duration and topic (its name contains the main item's, both
    without anything but letters and digits). The most specific name and all agenda items are taken; a main chair stays, else that of a single
    source; rooms always stay.
    """
    left = main.select(*SLOT, "ord", "duration_minutes", T.token_norm(F.col("name")).alias("__topic"))
    right = detail.select(*SLOT, F.col("ord").alias("__ord"), "duration_minutes", T.token_norm(F.col("name")).alias("__other"), F.col("source").alias("__source"), F.col("name").alias("__name"), F.col("agenda_item").alias("__items"), F.col("chair").alias("__chair"))
    hits = left.join(right, [*SLOT, "duration_minutes"]).where((F.col("__topic") != "") & F.col("__other").contains(F.col("__topic")))
    items = F.transform(F.array_sort(F.collect_list(F.when(F.col("__items").isNotNull(), F.struct("__ord", "__items")))), lambda x: x["__items"])
    added = hits.groupBy(*SLOT, "ord").agg(
        F.max_by("__name", F.struct(F.length("__name"), -F.col("__ord"))).alias("__name"),
        F.array_join(F.array_distinct(F.flatten(F.transform(items, T.agenda_list))), ", ").alias("__items"),
        F.when(F.count_distinct("__source") == 1, F.min_by("__chair", F.when(F.col("__chair").isNotNull(), F.col("__ord")))).alias("__chair"),
    )
    out = main.join(added, [*SLOT, "ord"], "left")
    item = F.coalesce(F.nullif("agenda_item", F.lit("")), F.nullif("__items", F.lit("")))
    return out.withColumns({"name": F.coalesce("__name", "name"), "agenda_item": item, "chair": F.coalesce(F.nullif("chair", F.lit("")), "__chair")}).drop("__name", "__items", "__chair")
