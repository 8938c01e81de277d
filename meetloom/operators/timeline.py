"""Slot results to timed sessions with groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def timeline(items: DataFrame, slot: list[str], room: str = "room_name", order: str = "ord") -> DataFrame:
    """Start and end of every item.

    items has slot columns, room, order, duration_minutes, specified_start_time, block_start,
    name, agenda_item and group_header. Within a slot and room durations run on from the
    block's start; a valid explicit start sets the clock anew. Items without a positive
    duration go, their explicit start too. Items of equal order stand by name, then length.
    """
    kept = items.where(F.coalesce(F.col("duration_minutes"), F.lit(0)) > 0)
    own = Window.partitionBy(*slot, room).orderBy(order, "name", "duration_minutes")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    explicit = T.minutes(F.col("specified_start_time"))
    segment = Window.partitionBy(*slot, room, "__segment").orderBy(order, "name", "duration_minutes")
    before = F.coalesce(F.sum("duration_minutes").over(segment.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.first("__explicit").over(segment.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    timed = (
        kept.withColumn("__explicit", explicit)
        .withColumn("__segment", F.count("__explicit").over(upto))
        .withColumn("__start", F.coalesce(first, T.minutes(F.col("block_start"))) + before)
    )
    item = T.agenda_item(F.col("name"), F.col("agenda_item"), F.col("group_header"))
    named = T.session_name(F.col("name"), F.col("agenda_item"))
    timed = timed.withColumns({"__item": item, "__name": named})
    return timed.withColumns(
        {"start_time": T.hhmm(F.col("__start")), "end_time": T.hhmm(F.col("__start") + F.col("duration_minutes")), "agenda_item": F.col("__item"), "name": F.col("__name")}
    ).drop("__explicit", "__segment", "__start", "__item", "__name")


def apply_group_mapping(sessions: DataFrame, mappings: DataFrame, key: str = "meeting_id") -> DataFrame:
    """Simplified groups (J7); mappings has (key, ord, original, simplified), of duplicates the last counts.

    A meeting with one different group at most stays as it is.
    """
    its = Window.partitionBy(key, "group_header")
    group = F.when(F.col("__place").isNull() & (F.col("group_header") != ""), F.col("group_header"))
    told = mappings.where("original IS NOT NULL").select(key, F.struct("ord", "simplified").alias("__place"), F.col("original").alias("group_header"))
    dealt = sessions.withColumn("__place", F.lit(None).cast(told.schema["__place"].dataType)).unionByName(told, allowMissingColumns=True).repartition(key)
    seen = dealt.withColumns({"__simple": F.max_by("__place.simplified", "__place.ord").over(its), "__least": F.min(group).over(its)})
    all_ = Window.partitionBy(key)
    several = F.col(key).isNotNull() & (F.min("__least").over(all_) != F.max("__least").over(all_))
    mapped = seen.withColumn("__several", several).where("__place IS NULL").withColumn("group_header", F.when(F.col("__several"), F.coalesce("__simple", "group_header")).otherwise(F.col("group_header")))
    return mapped.select(*sessions.columns)


def elect_groups(sessions: DataFrame, key: str = "meeting_id", order: str = "ord") -> DataFrame:
    """(key, ord, original, simplified): each of a meeting's group labels once, with the short one it goes under (F26), as J7 takes them.

    Of "X / Y / Z" that is X, if X is a label itself or begins several labels; else the first
    other part that is a label or begins one; else X. A label that exists is preferred to
    another spelling of it (of several spellings the first). What is yet to be assigned is TBD.
    What a label's parts meet, other labels and their first parts, is told by windows over equal
    words, so the work grows with the labels and not with their square.
    """
    labels = sessions.where(_group() != "").repartition(key).groupBy(key, F.col("group_header").alias("original")).agg(F.min(order).alias(order))
    parts = F.transform(F.split("original", " / "), lambda p, i: F.struct(i.alias("place"), p.alias("part"), F.lower(p).alias("word"), F.lit(None).cast("string").alias("label")))
    itself = F.struct(F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("part"), F.lower("original").alias("word"), F.col("original").alias("label"))
    same = Window.partitionBy(key, "word")
    words = labels.select(key, order, "original", F.inline(F.concat(parts, F.array(itself))))
    words = words.withColumns({"spelled": F.min("label").over(same), "begun": F.count_if(F.col("place") == 0).over(same)}).where("place IS NOT NULL")
    first, known = F.col("place") == 0, F.col("spelled").isNotNull()
    other = F.when(~first & (known | (F.col("begun") > 0)), F.col("place"))
    rank = F.when(first, F.when(known | (F.col("begun") > 1), 0).otherwise(2**31 - 1)).otherwise(other)
    best = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.coalesce("spelled", "part").alias("s"))))["s"]
    elected = words.groupBy(key, "original").agg(F.min(order).alias(order), best.alias("best"))
    return elected.select(key, order, "original", F.when(T.group_label(F.col("original")) == "TBD", "TBD").otherwise(F.col("best")).alias("simplified"))


def _group() -> Column:
    return F.coalesce("group_header", F.lit(""))


def fill_groups_by_name(sessions: DataFrame, key: str = "meeting_id", order: str = "ord") -> DataFrame:
    """Missing groups from the first session of the same name that has one (J8). Sessions are dealt by meeting, as J9 takes them."""
    same = Window.partitionBy(key, "name")
    first = F.min_by("group_header", F.when(_group() != "", F.col(order))).over(same)
    return sessions.repartition(key).withColumn("group_header", F.when(_group() == "", F.coalesce(first, F.lit(""))).otherwise(F.col("group_header")))


def fill_groups_by_substring(sessions: DataFrame, key: str = "meeting_id") -> DataFrame:
    """Groups still missing from the longest known one that the name contains (J9); of equal lengths the first by name.

    A meeting's different groups are few and come to its sessions as one array.
    """
    known = sessions.withColumn("__groups", F.collect_set(F.when(_group() != "", F.col("group_header"))).over(Window.partitionBy(key)))
    inside = F.filter("__groups", lambda g: F.lower("name").contains(F.lower(g)))
    best = F.array_min(F.transform(inside, lambda g: F.struct((-F.length(g)).alias("l"), g.alias("g"))))["g"]
    return known.withColumn("group_header", F.when(_group() == "", F.coalesce(best, F.lit(""))).otherwise(F.col("group_header"))).drop("__groups")


def fill_groups(sessions: DataFrame, key: str = "meeting_id", order: str = "ord") -> DataFrame:
    return fill_groups_by_substring(fill_groups_by_name(sessions, key, order), key)


def group_fill_stats(before: DataFrame, by_name: DataFrame, by_substring: DataFrame, key: str = "meeting_id") -> DataFrame:
    """How many groups each pass filled, and how many are missing."""

    def missing(df: DataFrame, alias: str) -> DataFrame:
        return df.groupBy(key).agg(F.count_if(F.coalesce(F.col("group_header"), F.lit("")) == "").alias(alias))

    all_ = missing(before, "m0").join(missing(by_name, "m1"), key).join(missing(by_substring, "m2"), key)
    return all_.select(key, (F.col("m0") - F.col("m1")).alias("by_name"), (F.col("m1") - F.col("m2")).alias("by_substring"), F.col("m2").alias("still_empty"))


def block_capacity_check(items: DataFrame, slot: list[str], room: str = "room_name") -> DataFrame:
    """Rooms whose durations exceed their slot's block (A8); slots with any explicit time are exempt."""
    exempt = items.where("specified_start_time IS NOT NULL").select(*slot).distinct()
    sums = items.where("duration_minutes > 0").groupBy(*slot, room, "block_minutes").agg(F.sum("duration_minutes").alias("total_minutes"))
    return sums.where("total_minutes > block_minutes").join(exempt, slot, "left_anti")


def room_columns(sessions: DataFrame, rooms: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """Grid columns of sessions' rooms.

    rooms has (keys, pos from 0, name), aliases (keys, alias, name and perhaps place). An alias
    is resolved first, to the name of its last place, or without places the last by name; labels joined by " + " span their parts' exact matches; else the first exact
    match, else the first that contains or is contained, counts; else columns 2 to 3.
    A day's rooms and aliases are few and come to its sessions as an array and a map.
    """
    order = [F.col(c) if c in aliases.columns else F.lit(None).cast("int").alias(c) for c in ("place", "name", "alias")]
    both = rooms.select(*keys, F.struct("pos", "name").alias("room")).unionByName(aliases.where("alias IS NOT NULL").select(*keys, F.struct(*order).alias("a")), allowMissingColumns=True)
    days = both.groupBy(*keys).agg(F.collect_list("room").alias("__rooms"), F.array_sort(F.collect_list("a")).alias("a"))
    last = F.filter("a", lambda x, i: ~F.exists(F.slice("a", i + 2, F.size("a")), lambda y: y["alias"] == x["alias"]))
    named = F.map_from_entries(F.transform(last, lambda x: F.struct(x["alias"], x["name"]))).alias("__aliases")
    told = sessions.join(days.select(*keys, "__rooms", named), keys, "left")
    label = F.col("room_name")

    def resolved(c: Column) -> Column:
        return F.coalesce(F.try_element_at("__aliases", c), c)

    real = resolved(label)
    parts = F.transform(F.split(real, r" \+ "), T.strip)
    parts = F.when(real == label, F.transform(parts, resolved)).otherwise(parts)  # those of a resolved alias are names already
    places = F.transform(parts, lambda p: F.array_min(F.transform(F.filter("__rooms", lambda r: r["name"] == p), lambda r: r["pos"])))
    low = F.lower(real)
    near = F.filter("__rooms", lambda r: (r["name"] == real) | F.lower(r["name"]).contains(low) | low.contains(F.lower(r["name"])))
    best = F.array_min(F.transform(near, lambda r: F.struct((r["name"] != real).alias("other"), r["pos"].alias("pos"))))["pos"]
    many = real.contains(" + ")
    first, last = F.when(many, F.array_min(places)).otherwise(best), F.when(many, F.array_max(places)).otherwise(best)
    return told.select(*sessions.columns, F.coalesce(first + 2, F.lit(2)).alias("room_col_start"), F.coalesce(last + 3, F.lit(3)).alias("room_col_end"))
