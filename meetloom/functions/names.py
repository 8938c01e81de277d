"""What file, folder and meeting names say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BLACKLISTED_FOLDERS
from .text import number_key


def _found(name: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(name, pattern, group), F.lit(""))


def meeting_id(name: Column) -> Column:
    """Normalised meeting identifier in a file name (F1), null without one."""
    pattern = r"(?i)(RAN\d+#\d+)(?:[- ]?(bis|e|adhoc))?"
    return F.lower(F.concat(_found(name, pattern), F.regexp_extract(name, pattern, 2)))


def meeting_rank(meeting: Column) -> Column:
    """(series, number, 0 or 1) of a regular meeting (F2), else null; structs compare in that order, whatever the length of the numbers."""
    pattern = r"(?i)^ran(\d+)#(\d+)(bis)?$"
    parts = [number_key(_found(meeting, pattern, g)) for g in (1, 2)]
    late = (F.regexp_extract(meeting, pattern, 3) != "").cast("int")
    return F.when(parts[0].isNotNull(), F.struct(parts[0].alias("series"), parts[1].alias("number"), late.alias("late")))


def file_version(name: Column) -> Column:
    """Trailing version number (F3) as a key that orders as the number, of any length; empty without one."""
    return F.coalesce(number_key(_found(name, r"(?i)v(\d+)\.(?:docx|pptx|pdf|zip)$")), F.lit(""))


def meeting_name(file: Column) -> Column:
    """Meeting name in a file's stem, else the stem."""
    stem = F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")
    return F.coalesce(_found(stem, r"(?U)(RAN\d+#\d+\w*)"), stem)


def person_of_folder(folder: Column) -> Column:
    """Person whose folder it is (F5): the name before _notes, _sessions or _session, never for a chair's."""
    own = F.regexp_extract(folder, r"(?is)^(.*)_(?:notes|sessions|session)$", 1)
    return F.when(folder.rlike(r"(?is)^(?!.*chair).*_(?:notes|sessions|session)$"), own)


def person_of_file(name: Column) -> Column:
    """Person named in a schedule file's name."""
    return F.coalesce(_found(name, r"(?iU)schedule\s+for\s+(\w+)"), _found(name, r"(?iU)schedules?\s*-\s*(\w+)\s+sessions?"))


def is_schedule_file(name: Column) -> Column:
    return F.lower(name).contains("schedule")


def is_chair_notes_file(name: Column) -> Column:
    return name.rlike(r"(?i)chair(man)?[ _]note")


def supported_document(name: Column, archives: bool = True) -> Column:
    return F.lower(name).rlike(r"\.(docx|pptx|pdf|zip)$" if archives else r"\.(docx|pptx|pdf)$")


def is_listed_folder(folder: Column, local: bool = False) -> Column:
    """Not blacklisted (P4); a local scan also leaves hidden and private folders out."""
    kept = ~folder.isin(*BLACKLISTED_FOLDERS)
    return kept & ~folder.startswith(".") & ~folder.startswith("__") if local else kept
