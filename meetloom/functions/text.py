"""Times, colours, labels and other text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import COLOR_TOLERANCE, DAY_END, DAY_START, DAYS, ERROR_PAGE_BYTES, ERROR_PHRASES, ROW_MINUTES, TIME_BLOCKS

WHITE = " \t\n\x0b\f\r"


def strip(s: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(s, F.lit(WHITE))


def number_key(digits: Column) -> Column:
    """A text that orders as the number that digits write, of any length: its length, then itself without leading zeros."""
    bare = F.ltrim(digits, F.lit("0"))
    return F.concat(F.lpad(F.length(bare).cast("string"), 10, "0"), F.lit(":"), bare)


def minutes(t: Column) -> Column:
    """Minutes of an "HH:MM" text (F7), null where it isn't one."""
    hours, rest = (F.split_part(t, F.lit(":"), F.lit(i)).try_cast("int") for i in (1, 2))
    return hours * 60 + rest


def hhmm(m: Column) -> Column:
    """"HH:MM" of minutes (F7), hours going on past 24."""
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), F.pmod(m, F.lit(60)).cast("int"))


def grid_row(t: Column) -> Column:
    """Layout row of a time (F8)."""
    return row_of(minutes(t))


def row_of(m: Column) -> Column:
    """Layout row of minutes."""
    return (F.floor((m - DAY_START) / ROW_MINUTES) + 2).cast("int")


_ITEM = r"^(?:AI\s+)?\.?\s*(\d+\.\d[\d.xX]*)\s*([^\n]*)"


def agenda_item(name: Column, item: Column, group: Column) -> Column:
    """The agenda item, else that at the start of the name, else that of the group."""
    own = F.trim(F.regexp_extract(name, _ITEM, 1), F.lit("."))
    of_group = F.trim(F.regexp_extract(group, r"^AI\s+(\d[\d.]*)", 1), F.lit("."))
    found = F.when(own != "", own).otherwise(F.nullif(of_group, F.lit("")))
    return F.when(F.coalesce(item, F.lit("")) != "", item).otherwise(found)


def session_name(name: Column, item: Column) -> Column:
    """The name without the agenda item that F9 takes from it, if anything is left."""
    rest = strip(F.regexp_extract(name, _ITEM, 2))
    return F.when((F.coalesce(item, F.lit("")) == "") & (rest != ""), rest).otherwise(name)


def agenda_list(items: Column) -> Column:
    """Comma-separated agenda items as an array."""
    return F.filter(F.transform(F.split(items, ","), strip), lambda x: x != "")


def strike_markup(runs: Column) -> Column:
    """Text of runs (para, text, strike) with struck ones between ~~."""
    marked = F.transform(runs, lambda r: F.struct(r["para"].alias("para"), F.when(r["strike"] & (r["text"] != ""), F.concat(F.lit("~~"), r["text"], F.lit("~~"))).otherwise(r["text"]).alias("text")))
    paragraphs = F.sequence(F.lit(0), F.coalesce(F.array_max(F.transform(runs, lambda r: r["para"])), F.lit(0)))
    lines = F.transform(paragraphs, lambda p: F.array_join(F.transform(F.filter(marked, lambda r: r["para"] == p), lambda r: r["text"]), ""))
    return strip(F.array_join(lines, "\n"))


def color_norm(c: Column) -> Column:
    """Six upper-case hex digits, null for others and for auto (F12); what follows a space is left out."""
    bare = F.upper(F.regexp_replace(F.split(c, " ")[0], "^#+", ""))
    return F.when((F.lower(c) != "auto") & (F.length(bare) == 6), bare)


def channel(c: Column, i: int) -> Column:
    return F.conv(F.substring(c, 2 * i + 1, 2), 16, 10).cast("int")


def colors_match(a: Column, b: Column) -> Column:
    close = [F.abs(channel(a, i) - channel(b, i)) <= COLOR_TOLERANCE for i in range(3)]
    return (a == b) | (close[0] & close[1] & close[2])


def channels_match(a: Column, b: Column) -> Column:
    """`colors_match` of colours (c) whose channels are known (rgb)."""
    close = [F.abs(a["rgb"][i] - b["rgb"][i]) <= COLOR_TOLERANCE for i in range(3)]
    return (a["c"] == b["c"]) | (close[0] & close[1] & close[2])


def undouble(s: Column) -> Column:
    """One half of a text whose halves are equal."""
    half = (F.length(s) / 2).cast("int")
    return F.when((F.length(s) % 2 == 0) & (s.substr(F.lit(1), half) == s.substr(half + 1, half)), s.substr(F.lit(1), half)).otherwise(s)


def day_of(text: Column) -> Column:
    """First weekday, Monday to Friday, that a header cell contains."""
    return F.coalesce(*[F.when(F.lower(text).contains(d.lower()), F.lit(d)) for d in DAYS])


def token_norm(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^a-z0-9]+", "")


def room_alias_tokens(room: Column) -> Column:
    """Ways to write a room label."""
    parts = F.filter(F.transform(F.split(room, r"\+"), strip), lambda p: p != "")
    prefixes = F.array_distinct(F.transform(parts, lambda p: F.regexp_extract(p, r"^([A-Za-z]+)(\d+)$", 1)))
    numbers = F.transform(parts, lambda p: F.regexp_extract(p, r"^([A-Za-z]+)(\d+)$", 2))
    compact = F.when((F.size(prefixes) == 1) & (prefixes[0] != ""), F.concat(prefixes[0], F.array_join(numbers, "/")))
    several = F.array(room, F.array_join(parts, " + "), F.array_join(parts, "/"), compact)
    return F.when(F.size(parts) > 1, F.array_distinct(F.array_compact(several))).otherwise(F.array(room))


def alias_label(label: Column, aliases: Column) -> Column:
    """A room label with known parts replaced by their aliases, a "person: " prefix kept (F16)."""
    at = F.instr(label, ": ")
    prefix = F.when(at > 0, label.substr(F.lit(1), at + 1)).otherwise("")
    rest = F.when(at > 0, label.substr(at + 2, F.length(label))).otherwise(label)
    parts = F.transform(F.split(rest, r" \+ "), strip)
    return F.concat(prefix, F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(aliases, p), p)), " + "))


def content_key(value: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a value's JSON."""
    return F.substring(F.sha2(F.to_json(value), 256), 1, 16)


def crosses_block(start: Column, end: Column) -> Column:
    """Not inside one time block (F20), by minutes."""
    inside = F.lit(False)
    for _, a, b in TIME_BLOCKS:
        inside = inside | ((start >= minutes(F.lit(a))) & (end <= minutes(F.lit(b))))
    return ~inside


def compact_label(name: Column, item: Column) -> Column:
    """Short label of a session."""
    short = strip(F.regexp_replace(name, r"\s+", " "))
    cut = F.when(F.length(short) > 22, F.concat(F.substring(short, 1, 21), F.lit("…"))).otherwise(short)
    return F.when(F.coalesce(item, F.lit("")) != "", F.concat(F.lit("AI "), item)).otherwise(cut)


def detail_lines(name: Column, group: Column, chair: Column, item: Column, start: Column, end: Column, duration: Column, room: Column) -> Column:
    """Lines of a session's details, absent ones left out."""

    def line(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))

    times = F.concat(start, F.lit(" - "), end, F.lit(" ("), duration.cast("string"), F.lit(" min)"))
    return F.array_compact(F.array(name, line("Group", group), line("Chair", chair), line("AI", item), line("Time", times), line("Room", room)))


def now_slot(instant: Column, zone: Column) -> Column:
    """Weekday and layout row of an instant in a zone (F23), null outside the grid's hours."""
    local = F.from_utc_timestamp(instant, zone)
    m = F.hour(local) * 60 + F.minute(local)
    row = row_of(m)
    return F.when((m >= DAY_START) & (m <= DAY_END), F.struct(F.date_format(local, "EEEE").alias("day"), row.alias("row")))


def local_generated_at(instant: Column, zone: Column) -> Column:
    """An instant in a zone to the minute."""
    return F.date_format(F.from_utc_timestamp(instant, zone), "yyyy-MM-dd HH:mm")


def group_label(header: Column) -> Column:
    """Short group of a header (F26): what stands before " / "; TBD for what is yet to be assigned."""
    return F.when(header.rlike("(?i)^to be assigned by"), F.lit("TBD")).otherwise(F.split(header, " / ")[0])


def is_error_page(content: Column, length: Column, listing: Column | bool = False) -> Column:
    """An error page instead of content (P5); listings are looked at whatever their size."""
    told = F.lit(False)
    for phrase in ERROR_PHRASES:
        told = told | F.lower(content).contains(phrase)
    small = (length <= ERROR_PAGE_BYTES) | (listing if isinstance(listing, Column) else F.lit(listing))
    return small & F.coalesce(told, F.lit(False))


def natural_key(s: Column) -> Column:
    """A sort key with digit runs of any length compared as numbers, the rest in lower case (O3)."""
    low = F.lower(s)
    parts = F.regexp_extract_all(low, F.lit(r"(\d+|\D+)"), F.lit(1))
    keys = F.transform(parts, lambda p: F.when(_digit_first(p), number_key(p)).otherwise(p))
    keys = F.when(_digit_first(low), F.concat(F.array(F.lit("")), keys)).otherwise(keys)
    return F.when(~low.rlike(r"\d") & (low != ""), F.array(low)).otherwise(keys)


def _digit_first(s: Column) -> Column:
    return (s >= "0") & (s < ":")  # the character after 9
