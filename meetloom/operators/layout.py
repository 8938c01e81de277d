"""Sessions on the grid, and filter facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DAYS, PALETTE_SIZE
from ..functions import text as T


def group_colors(sessions: DataFrame, key: str = "meeting_id") -> DataFrame:
    """Palette index of every group (W5): rank among the meeting's different groups, modulo the palette."""
    groups = sessions.where("group_header != ''").groupBy(key).agg(F.array_sort(F.collect_set("group_header")).alias("g"))
    return groups.select(key, F.posexplode("g").alias("rank", "group_header")).select(key, "group_header", (F.col("rank") % PALETTE_SIZE).alias("color"))


def layout_block(sessions: DataFrame) -> DataFrame:
    """Grid rows, columns and what a block has room to show.

    sessions has start_time, end_time, duration_minutes, room_col_start, room_col_end and
    rooms (the day's names in order).
    """
    n = F.size("rooms")
    # read once, by a generator: as plain columns the filter would repeat them below, in code too long to be compiled
    times = F.struct(T.minutes(F.col("start_time")).alias("__from"), T.minutes(F.col("end_time")).alias("__to"))
    rows = sessions.select("*", F.inline(F.array(times)))
    rows = rows.withColumns({"row_start": T.row_of(F.col("__from")), "row_end": T.row_of(F.col("__to"))})
    rows = rows.withColumn("row_end", F.when((F.col("row_end") <= F.col("row_start")) & (F.col("duration_minutes") > 0), F.col("row_start") + 1).otherwise(F.col("row_end")))
    rows = rows.where(F.col("row_end") > F.col("row_start"))
    low, high = F.greatest("room_col_start", F.lit(2)), F.least("room_col_end", n + 2)
    empty = low >= high
    rows = rows.withColumns({"col_start": F.when(empty, 2).otherwise(low), "col_end": F.when(empty, 3).otherwise(high), "slots": F.col("row_end") - F.col("row_start")})
    span = F.when(n > 0, F.slice("rooms", F.col("col_start") - 1, F.greatest(F.least(F.col("col_end") - 2, n) - (F.col("col_start") - 2), F.lit(0))))
    item, chair = F.coalesce("agenda_item", F.lit("")), F.coalesce("chair", F.lit(""))
    return rows.withColumns(
        {
            "is_short": F.col("slots") <= 2,
            "is_tiny": F.col("slots") <= 1,
            "show_chair": (F.col("slots") >= 3) & (chair != ""),
            "show_time": F.col("slots") >= 4,
            "show_agenda": (F.col("slots") >= 6) & (item != ""),
            "is_long": T.crosses_block(F.col("__from"), F.col("__to")),
            "room_names": F.coalesce(F.array_join(span, ", "), F.lit("")),
            "data_ai": F.array_join(F.coalesce(T.agenda_list(F.col("agenda_item")), F.array()), "|"),
        }
    ).drop("__from", "__to")


def facet_rows(sessions: DataFrame, key: str = "meeting_id") -> DataFrame:
    """(key, grp, name, ais, has_no_ai): the facet tree's sessions (A4) as rows, ais in natural order."""
    group = F.coalesce("group_header", F.lit(""))
    items = sessions.select(key, group.alias("grp"), "name", F.coalesce(F.nullif("agenda_item", F.lit("")), F.lit("")).alias("item"))
    sets = items.groupBy(key, "grp", "name").agg(F.collect_set("item").alias("l"))
    sets = sets.select(key, "grp", "name", F.array_distinct(F.flatten(F.transform("l", T.agenda_list))).alias("ais"), F.array_contains("l", "").alias("none"))
    return sets.select(key, "grp", "name", natural_sorted(F.col("ais")).alias("ais"), (F.col("none") & (F.size("ais") > 0)).alias("has_no_ai"))


def natural_sorted(values: F.Column) -> F.Column:
    keyed = F.transform(values, lambda v: F.struct(T.natural_key(v).alias("k"), v.alias("v")))
    return F.when(F.size(values) < 2, values).otherwise(F.transform(F.array_sort(keyed), lambda x: x["v"]))


def facet_tree(sessions: DataFrame, key: str = "meeting_id") -> DataFrame:
    """The facet tree as one JSON text per meeting (A4, A5). Sessions are dealt by meeting once, for all its levels."""
    rows = facet_rows(sessions.repartition(key), key)
    entry = F.struct("name", F.concat_ws("|", "name", "grp").alias("key"), "ais", F.when(F.col("has_no_ai"), True).alias("hasNoAI"))
    session = F.struct(T.natural_key(F.col("name")).alias("k"), F.col("name").alias("n"), entry.alias("v"))
    named = F.when(F.col("grp") == "", "Other").otherwise(F.col("grp"))
    keyed = F.when(F.col("grp") == "", "__other__").otherwise(F.col("grp"))
    groups = rows.groupBy(key, "grp").agg(F.transform(F.array_sort(F.collect_list(session)), lambda x: x["v"]).alias("sessions"), F.flatten(F.collect_list("ais")).alias("ais"))
    group = F.struct((F.col("grp") == "").alias("last"), F.lower("grp").alias("k"), F.col("grp").alias("g"), F.struct(named.alias("name"), keyed.alias("key"), "sessions").alias("v"))
    tree = groups.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(group)), lambda x: x["v"]).alias("groups"), F.array_distinct(F.flatten(F.collect_list("ais"))).alias("ais"))
    return tree.select(key, F.to_json(F.struct("groups", natural_sorted(F.col("ais")).alias("allAIs"))).alias("facets"))


def distinct_ais(sessions: DataFrame, key: str = "meeting_id") -> DataFrame:
    """All different agenda items of a meeting with their place in natural order (A5)."""
    items = sessions.select(key, F.explode(T.agenda_list(F.col("agenda_item"))).alias("ai")).distinct()
    sets = items.groupBy(key).agg(F.collect_list("ai").alias("ais"))
    return sets.select(key, F.posexplode(natural_sorted(F.col("ais"))).alias("place", "ai"))


def apply_facets(sessions: DataFrame, ais: list[str], keys: list[str], no_ai_keys: list[str], key: str = "meeting_id", groups: list[str] | None = None, session_keys: list[str] | None = None) -> DataFrame:
    """Sessions that chosen facets let through (P11); choices are lists a user made, nothing chosen keeps all.

    Groups (by name, or __other__) and sessions (session_keys) choose what the tree has under
    them, meeting by meeting: a group its sessions, a session its agenda items, and what it has
    without one; or itself, if it has none. Of a meeting without any of the chosen nothing is
    kept. Sessions are dealt by meeting once; the tree's rows are windows over them, and only a
    meeting's chosen agenda items come to each.
    """
    if not (ais or keys or no_ai_keys or groups or session_keys):
        return sessions
    group = F.coalesce("group_header", F.lit(""))
    items = F.coalesce(T.agenda_list(F.col("agenda_item")), F.array().cast("array<string>"))
    known = sessions.where(F.col(key).isNotNull() & F.col("name").isNotNull())
    rows = known.withColumns({"__grp": group, "__own": F.concat_ws("|", "name", group), "__items": items, "__none": F.coalesce("agenda_item", F.lit("")) == ""}).repartition(key)
    # from the finest on, so that one order serves all; different sessions may have one key
    meeting, same, facet = (Window.partitionBy(key, *more) for more in ((), ("__own",), ("__own", "__grp", "name")))
    rows = rows.withColumns({"__ais": F.flatten(F.collect_set("__items").over(facet)), "__bare": F.bool_or("__none").over(facet)})
    own, has = F.col("__own"), F.size("__ais") > 0
    picked = own.isin(session_keys or []) | F.when(F.col("__grp") == "", "__other__").otherwise(F.col("__grp")).isin(groups or [])
    rows = rows.withColumns({"__wanted": own.isin(keys) | F.bool_or(picked & ~has).over(same), "__without": own.isin(no_ai_keys) | F.bool_or(picked & has & F.col("__bare")).over(same)})
    given = F.array(*[F.lit(x) for x in ais]).cast("array<string>")
    rows = rows.withColumn("__chosen", F.array_union(given, F.flatten(F.collect_set(F.when(picked, F.col("__items"))).over(meeting))))
    chosen, wanted, without = F.col("__chosen"), F.col("__wanted"), F.col("__without")
    derived = has & (F.size(F.array_except("__ais", chosen)) == 0) & (~F.col("__bare") | without)
    return rows.where(wanted | derived | F.arrays_overlap("__items", chosen) | ((F.size("__items") == 0) & without)).select(*sessions.columns)


def day_schedule(sessions: DataFrame, rooms: DataFrame, key: str = "meeting_id", order: str = "ord") -> DataFrame:
    """Per meeting and weekday with rooms: its rooms and sessions in order."""
    number = F.array_position(F.array(*[F.lit(d) for d in DAYS]), F.col("day")).cast("int")
    of_day = rooms.where(number > 0).groupBy(key, "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda r: r["name"]).alias("rooms"))
    items = sessions.groupBy(key, "day").agg(F.array_sort(F.collect_list(F.struct(order, "name", "start_time", "end_time"))).alias("sessions"))
    return of_day.join(items, [key, "day"], "left").select(key, number.alias("day_no"), "day", "rooms", F.coalesce("sessions", F.array()).alias("sessions"))
