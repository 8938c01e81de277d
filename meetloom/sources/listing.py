"""Crawled directory pages to file and folder rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T

_ROW = r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"
_CELL = r"(?is)<td\b[^>]*>(.*?)</td\s*>"
_HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""


def _rows(pages: DataFrame) -> DataFrame:
    """A row per table row with four cells or more: its link and the text of its fourth cell."""
    bodies = pages.where(~T.is_error_page(F.col("html"), F.length("html"), True))
    rows = bodies.select("inbox_id", "folder", "url", F.posexplode(F.regexp_extract_all("html", F.lit(_ROW), F.lit(1))).alias("list_pos", "row"))
    cells = rows.withColumn("cells", F.regexp_extract_all("row", F.lit(_CELL), F.lit(1))).where(F.size("cells") >= 4)
    linked = cells.withColumn("href", F.regexp_extract(F.col("cells")[2], _HREF, 1)).where("href != ''")
    date = T.strip(F.regexp_replace(F.col("cells")[3], "<[^>]*>", ""))
    return linked.withColumn("uploaded_at", F.try_to_timestamp(date, F.lit("yyyy/M/d H:m")))


def _last_part(href: F.Column) -> F.Column:
    """Percent-decoded last part of a path; a plus sign stays one."""
    return F.coalesce(F.try_url_decode(F.replace(F.element_at(F.split(href, "/"), -1), F.lit("+"), F.lit("%2B"))), F.element_at(F.split(href, "/"), -1))


def _absolute(href: F.Column) -> F.Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.col("url"), F.lit("/"), href))


def read_listing(pages: DataFrame) -> DataFrame:
    """Files of crawled pages (inbox_id, folder, url, html) as a listing (S1): links to documents and archives."""
    href = F.col("href")
    files = _rows(pages).where(N.supported_document(href))
    return files.select("inbox_id", "folder", "list_pos", _last_part(href).alias("name"), _absolute(href).alias("url"), "uploaded_at")


def read_folders(pages: DataFrame) -> DataFrame:
    """Subfolders of crawled pages (S2): links whose last part has no dot."""
    href = F.regexp_replace("href", "/+$", "")
    folders = _rows(pages).withColumn("name", _last_part(href)).where("name != '' AND NOT contains(name, '.')")
    return folders.select("inbox_id", "folder", "list_pos", "name", _absolute(F.col("href")).alias("url"), "uploaded_at")
