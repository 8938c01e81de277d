"""Document tables to cells by day, time block and room.

cells has a row per raw table cell: (doc_id, table_idx, row_idx, tc_idx, grid_span, v_merge,
fill, text). `grid_positions` deals cells out by document; what rows, tables and days say is
then told to their cells by windows and summed up by groups, all of which keep doc_id among
their keys. So that one shuffle serves the chain up to rooms and colours, and only small
tables are joined, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DAYS, TIME_BLOCKS
from ..functions import text as T

TABLE = ["doc_id", "table_idx"]
ROW = [*TABLE, "row_idx"]


def grid_positions(cells: DataFrame) -> DataFrame:
    """Column range of each cell, empty text where a vertical merge goes on."""
    before = Window.partitionBy(*ROW).orderBy("tc_idx").rowsBetween(Window.unboundedPreceding, -1)
    goes_on = F.col("v_merge").isNotNull() & (F.col("v_merge") != "restart")
    start = F.coalesce(F.sum("grid_span").over(before), F.lit(0)).cast("int")
    dealt = cells.repartition("doc_id")
    return dealt.withColumns({"col_start": start, "text": F.when(goes_on, "").otherwise(F.col("text"))}).withColumn("col_end", F.col("col_start") + F.col("grid_span"))


def _row_kind(n_cells: Column, cells: Column) -> Column:
    text = F.lower(F.array_join(F.transform(F.array_sort(cells), lambda c: c["text"]), " "))

    def has(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | text.contains(w)
        return (n_cells <= 3) & out

    return F.when(has("break", "coffee", "lunch"), "break").when(has("all sessions end", "no exceptions"), "footer").when(has("meeting rooms"), "metadata").otherwise("data")


def row_class(cells: DataFrame) -> DataFrame:
    """break, footer, metadata or data per row (P6); only rows of three cells at most are looked at."""
    rows = cells.groupBy(*ROW).agg(F.count("*").alias("n_cells"), F.collect_list(F.struct("tc_idx", "text")).alias("__cells"))
    return rows.select(*ROW, "n_cells", _row_kind(F.col("n_cells"), F.col("__cells")).alias("kind"))


def schedule_tables(cells: DataFrame) -> DataFrame:
    """Tables of five rows or more whose first row names a weekday (P7), with their widths."""
    named = F.lit(False)
    for d in DAYS:
        named = named | F.lower("text").contains(d.lower())
    tables = cells.groupBy(*TABLE).agg(F.max("row_idx").alias("last"), F.bool_or((F.col("row_idx") == 0) & named).alias("named"), F.max("col_end").alias("width"))
    return tables.where("last >= 4 AND named").select(*TABLE, "width")


def largest_tables(tables: DataFrame, most: int | None = 2) -> DataFrame:
    """The widest tables, earlier ones first among equals (K5), numbered anew in document order; most None keeps all."""
    by_width = Window.partitionBy("doc_id").orderBy(F.col("width").desc(), "table_idx")
    kept = tables if most is None else tables.withColumn("__n", F.row_number().over(by_width)).where(F.col("__n") <= most).drop("__n")
    return kept.withColumn("table_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("table_idx")) - 1)


def day_columns(cells: DataFrame) -> DataFrame:
    """(table, day, day_start, day_end) of header rows (F14): of cells that name a day, the first counts."""
    named = cells.where("row_idx = 0").withColumn("day", T.day_of(F.col("text"))).where("day IS NOT NULL")
    first = named.groupBy(*TABLE, "day").agg(F.min_by(F.struct("col_start", "col_end"), "tc_idx").alias("c"))
    return first.select(*TABLE, "day", F.col("c.col_start").alias("day_start"), F.col("c.col_end").alias("day_end"))


def time_block(label: Column) -> Column:
    """Block of a time label (J1): that in which its first time lies."""
    m = T.minutes(F.nullif(F.regexp_extract(label, r"(\d{1,2}:\d{2})", 1), F.lit("")))
    out = F.lit(None).cast("int")
    for i, a, b in TIME_BLOCKS:
        out = F.when((m >= T.minutes(F.lit(a))) & (m < T.minutes(F.lit(b))), i).otherwise(out)
    return out


def _in_table(cells: DataFrame) -> DataFrame:
    """cells with their row's first cell (__first) and block (tb, null unless a time row), and their table's days (__days)."""
    row, table = Window.partitionBy(*ROW), Window.partitionBy(*TABLE)
    cell = F.struct("tc_idx", "text")
    kind = _row_kind(F.count("*").over(row), F.collect_list(F.when(F.col("__short"), cell)).over(row))
    block = F.when((F.col("row_idx") > 0) & (kind == "data"), time_block(F.col("__head.text")))
    day = F.when(F.col("row_idx") == 0, T.day_of(F.col("text")))
    named = F.array_sort(F.collect_list(F.when(day.isNotNull(), F.struct("tc_idx", day.alias("day"), F.col("col_start").alias("day_start"), F.col("col_end").alias("day_end")))).over(table))
    first = F.filter("__named", lambda d, i: ~F.exists(F.slice("__named", 1, i), lambda e: e["day"] == d["day"]))
    marked = cells.withColumns({"__head": F.min_by(cell, "tc_idx").over(row), "__short": F.count("*").over(row) <= 3})
    marked = marked.withColumns({"tb": block, "__named": named, "__first": F.col("__head.tc_idx")})
    return marked.withColumn("__days", F.transform(first, lambda d: d.dropFields("tc_idx"))).drop("__head", "__short", "__named")


def _days_of() -> Column:
    """The days in whose columns a cell is."""
    return F.filter("__days", lambda d: (F.col("col_start") >= d["day_start"]) & (F.col("col_end") <= d["day_end"]))


def _is_inner() -> Column:
    """A cell of a time row, other than its first."""
    return F.col("tb").isNotNull() & (F.col("tc_idx") != F.col("__first"))


def time_rows(cells: DataFrame) -> DataFrame:
    """(row, tb) of data rows below the header whose first cell is a time in a block."""
    return _in_table(cells).where("tb IS NOT NULL AND tc_idx = __first").select(*ROW, "tb")


def cells_in_day(cells: DataFrame) -> DataFrame:
    """Cells of time rows within a day's columns, the row's first cell left out."""
    inner = _in_table(cells).where(_is_inner()).withColumn("__day", F.explode(_days_of()))
    return inner.select(*cells.columns, "tb", "__day.*")


def actual_rooms(cells: DataFrame) -> DataFrame:
    """Rooms of a table's day: the most cells of any of its rows, one at least (A3)."""
    found = F.when(_is_inner(), F.transform(_days_of(), lambda d: d["day"]))
    each = _in_table(cells).select(*ROW, "__days", F.explode_outer(found).alias("day"))
    rows = each.groupBy(*ROW, "day").agg(F.count("day").alias("n"), F.first("__days").alias("__days"))
    tables = rows.groupBy(*TABLE).agg(F.first("__days").alias("__days"), F.collect_list(F.struct("day", "n")).alias("__counts"))
    days = tables.select(*TABLE, "__counts", F.explode("__days.day").alias("day"))
    most = F.array_max(F.transform(F.filter("__counts", lambda c: c["day"] == F.col("day")), lambda c: c["n"]))
    return days.select(*TABLE, "day", F.greatest(F.lit(1), F.coalesce(most, F.lit(1))).cast("int").alias("n_rooms"))


def assign_rooms(in_day: DataFrame) -> DataFrame:
    """First and last room of every cell (W2), cells without text dropped afterwards.

    A day has as many rooms as its row with the most cells. From left to right: a cell as wide
    as the day takes all rooms; as many cells as rooms take one each; else a cell takes its
    share of the width, one room at least, and no more than are left (but one).
    """
    keys = [*ROW, "day"]
    cell = F.struct("col_start", "col_end", "tc_idx", "text")
    rows = in_day.groupBy(*keys, "tb", "day_start", "day_end").agg(F.array_sort(F.collect_list(cell)).alias("row"))
    rows = rows.withColumn("n_rooms", F.max(F.size("row")).over(Window.partitionBy(*TABLE, "day")))
    width, n = F.col("day_end") - F.col("day_start"), F.col("n_rooms")

    def step(acc, c):
        at, span = acc["at"], c["col_end"] - c["col_start"]
        share = F.least(F.greatest(F.lit(1), F.bround(span * n / width).cast("int")), F.greatest(F.lit(1), n - at))
        full, single = span >= width, F.size("row") == n
        first = F.when(full, 0).otherwise(at)
        count = F.when(full, n).when(single, 1).otherwise(share)
        placed = F.struct(c["tc_idx"].alias("tc_idx"), c["text"].alias("text"), first.alias("room_from"), (first + count - 1).alias("room_to"))
        return F.struct(F.when(full, n).otherwise(at + count).alias("at"), F.concat(acc["out"], F.array(placed)).alias("out"))

    kind = "array<struct<tc_idx:int,text:string,room_from:int,room_to:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    placed = rows.select(*keys, "tb", "n_rooms", F.inline(F.aggregate("row", start, step)["out"]))
    return placed.where(T.strip(F.col("text")) != "")


def room_positions(rooms: DataFrame, keys: list[str]) -> DataFrame:
    """Rooms of a day in table order with their positions from 0."""
    order = Window.partitionBy(*keys).orderBy("table_index", "room_idx")
    return rooms.withColumn("pos", F.row_number().over(order) - 1)


def cell_room_columns(cells: DataFrame, rooms: DataFrame, keys: list[str]) -> DataFrame:
    """Grid columns of cells with room_from and room_to (J11); 2 to 3 where no room is known.

    A day's rooms are few and come to its cells as one array.
    """
    days = rooms.groupBy(*keys).agg(F.collect_list(F.struct("table_index", "room_idx", "pos")).alias("__rooms"))
    own = F.filter("__rooms", lambda r: (r["table_index"] == F.col("table_index")) & r["room_idx"].between(F.col("room_from"), F.col("room_to")))
    spans = cells.join(days, keys, "left").withColumn("__pos", F.transform(own, lambda r: r["pos"]))
    return spans.select(*cells.columns, F.coalesce(F.array_min("__pos") + 2, F.lit(2)).alias("col_from"), F.coalesce(F.array_max("__pos") + 3, F.lit(3)).alias("col_to"))


def table_column_colors(cells: DataFrame) -> DataFrame:
    """Ordered colours of a table's rooms (W7), and the rooms of its first day: those of the first row and day with as many cells as rooms, all different.

    Missing fills are white; column 0 is left out; colours within tolerance count as equal.
    """
    fill = F.coalesce(T.color_norm(F.col("fill")), F.lit("FFFFFF"))
    inside = _in_table(cells).where("row_idx > 0").withColumns({"__inner": _is_inner(), "__day1": F.col("__days")[0]["day"], "d": F.explode(_days_of())})
    colored = F.when(F.col("col_start") > 0, F.struct("col_start", fill.alias("f")))
    rows = inside.groupBy(*ROW, "d.day", "d.day_start", "__day1").agg(F.transform(F.array_sort(F.collect_list(colored)), lambda c: c["f"]).alias("colors"), F.count_if("__inner").alias("n"))
    read = F.transform("colors", lambda c, i: F.struct(c.alias("c"), i.alias("i"), F.array(*[T.channel(c, k) for k in range(3)]).alias("rgb")))  # once a colour, not once a pair
    same = F.transform(F.array(read), lambda n: F.exists(n, lambda x: F.exists(n, lambda y: (y["i"] > x["i"]) & T.channels_match(x, y))))[0]
    rows = rows.withColumns({"n_rooms": F.greatest(F.lit(1), F.max("n").over(Window.partitionBy(*TABLE, "day"))), "first": F.greatest(F.lit(1), F.max(F.when(F.col("day") == F.col("__day1"), F.col("n"))).over(Window.partitionBy(*TABLE)))})
    full = rows.where((F.size("colors") == F.col("n_rooms")) & ~same)
    return full.groupBy(*TABLE).agg(F.min_by("colors", F.struct("row_idx", "day_start")).alias("colors"), F.first("first").cast("int").alias("n_rooms"))


def match_rooms_by_color(colors: DataFrame, labels: DataFrame) -> DataFrame:
    """Room names of tables (colors, n_rooms) by the colours of their columns (J12), where as many found one as the first day has rooms.

    labels has (doc_id, ord, name, color); the first label close to a colour counts.
    """
    each = colors.select(*TABLE, "n_rooms", F.posexplode("colors").alias("i", "c"))
    hits = each.join(labels.where("color IS NOT NULL"), "doc_id").where(T.colors_match(F.col("c"), F.col("color")))
    first = hits.groupBy(*TABLE, "i").agg(F.min_by("name", "ord").alias("name"), F.first("n_rooms").alias("n_rooms"))
    names = first.groupBy(*TABLE).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda r: r["name"]).alias("names"), F.first("n_rooms").alias("n_rooms"))
    return names.where(F.size("names") == F.col("n_rooms")).select(*TABLE, "names")


def generic_room_names(rooms: DataFrame, by_color: DataFrame, metadata: DataFrame) -> DataFrame:
    """Names of each day's rooms (W8): matched by colour, else from metadata (online for table 0), else lettered.

    rooms has (doc_id, table_idx, table_no, day, n_rooms), metadata (doc_id, online, offline).
    """
    matched = by_color.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("table_idx", "names"))).alias("__names"))  # a document's tables are few
    all_ = rooms.join(matched, "doc_id", "left").join(metadata, "doc_id", "left").withColumn("names", F.try_element_at("__names", "table_idx"))
    given = F.when(F.col("table_no") == 0, F.col("online")).otherwise(F.col("offline"))
    prefix = F.when(F.col("table_no") == 0, "Room ").otherwise("Offline ")
    lettered = F.transform(F.sequence(F.lit(0), F.col("n_rooms") - 1), lambda i: F.concat(prefix, F.chr(i + 65)))

    def enough(names: Column) -> Column:
        return F.when(F.size(names) >= F.col("n_rooms"), F.slice(names, 1, F.col("n_rooms")))

    return all_.select(*TABLE, "table_no", "day", "n_rooms", F.coalesce(enough(F.col("names")), enough(given), lettered).alias("room_names"))


def table_context(blocks: DataFrame) -> DataFrame:
    """Text between tables (A10). blocks has (doc_id, pos, is_table, text); a row per table, in order."""
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    marked = blocks.withColumn("table_idx", F.coalesce(F.sum(F.col("is_table").cast("int")).over(upto), F.lit(0)))
    text = T.strip(F.col("text"))
    line = F.when(~F.col("is_table") & (text != ""), F.struct("pos", text.alias("t")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n")
    return marked.groupBy("doc_id", "table_idx").agg(joined.alias("context"), F.bool_or("is_table").alias("ends")).where("ends").drop("ends")


def room_metadata(cells: DataFrame) -> DataFrame:
    """Online and offline room names of a document (A11), from its first cell about meeting rooms.

    Lines after each heading line form blocks; a block with "off" in any line is the offline
    one; the last block of a kind counts. A line's name is what its last parentheses hold up
    to a comma, else the line.
    """
    first = cells.where(F.lower("text").contains("meeting rooms")).groupBy("doc_id").agg(F.min_by("text", F.struct(*ROW[1:], "tc_idx")).alias("text"))
    kind = "array<string>"
    none = F.lit(None).cast(kind)

    def block(names: Column, off: Column, online: Column, offline: Column) -> Column:
        return F.struct(names.alias("names"), off.alias("off"), online.alias("online"), offline.alias("offline"))

    def ended(acc: Column) -> Column:
        full = F.size(acc["names"]) > 0
        return block(F.array().cast(kind), F.lit(False), F.when(full & ~acc["off"], acc["names"]).otherwise(acc["online"]), F.when(full & acc["off"], acc["names"]).otherwise(acc["offline"]))

    def step(acc: Column, line: Column) -> Column:
        inside = F.regexp_extract(line, r".*\(([^)]+)\)", 1)
        name = F.when(inside != "", T.strip(F.split(inside, ",")[0])).otherwise(line)
        more = block(F.concat(acc["names"], F.array(name)), acc["off"] | F.lower(line).contains("off"), acc["online"], acc["offline"])
        return F.when(F.lower(line).contains("meeting rooms"), ended(acc)).otherwise(more)

    lines = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: x != "")
    blocks = F.aggregate(lines, block(F.array().cast(kind), F.lit(False), none, none), step, ended)
    return first.select("doc_id", blocks.alias("b")).select("doc_id", "b.online", "b.offline").where("online IS NOT NULL OR offline IS NOT NULL")


def location_line(paragraphs: DataFrame) -> DataFrame:
    """First line among a document's first 30 paragraphs that looks like "City, Country, Month 1" (P10)."""
    pattern = r"^[A-Z][A-Za-z .'-]+,\s*[A-Z][A-Za-z .'-]+,\s*[A-Za-z]+\.?\s+\d"
    text = T.strip(F.col("text"))
    return paragraphs.where((F.col("pos") < 30) & text.rlike(pattern)).groupBy("doc_id").agg(F.min_by(text, "pos").alias("location"))
