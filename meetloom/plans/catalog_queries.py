"""Queries on listings, sources and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import catalog, changes
from .registry import query

MEETING = "nullif(lower(concat(nullif(regexp_extract({0}, '(?i)(RAN[0-9]+#[0-9]+)', 1), ''), regexp_extract({0}, '(?i)RAN[0-9]+#[0-9]+[- ]?(bis|e|adhoc)', 1))), '')"
# digits as a text that orders as their number: the length, then the digits without leading zeros
NUMBER = "lpad(length(ltrim({0}, '0'))::VARCHAR, 10, '0') || ':' || ltrim({0}, '0')"
VERSION = "coalesce(" + NUMBER.format("nullif(regexp_extract({0}, '(?i)v([0-9]+)\\.(docx|pptx|pdf|zip)$', 1), '')") + ", '')"
SCHEDULE = "contains(lower(name), 'schedule')"
CHAIR = "regexp_matches(name, '(?i)chair(man)?[ _]note')"
LISTED = "folder NOT IN ('Agenda', 'drafts', 'Tdoc_list', 'Welcome_speech')"


def _rank(m: str) -> str:
    regular = f"regexp_matches({m}, '^ran[0-9]+#[0-9]+(bis)?$')"
    series, number = NUMBER.format(f"regexp_extract({m}, '^ran([0-9]+)', 1)"), NUMBER.format(f"regexp_extract({m}, '#([0-9]+)', 1)")
    return f"CASE WHEN {regular} THEN {series} || '#' || {number} || CASE WHEN {m} LIKE '%bis' THEN '#1' ELSE '#0' END END"


def latest_sql(source: str, keys: str, where: str, wish: str = "NULL") -> str:
    """The current file a key, told by windows."""
    on = " AND ".join(f"f.{k.strip()} = d.{k.strip()}" for k in keys.split(","))
    return f"""
SELECT * EXCLUDE (m, dated, v, g_new, g_first, rk, rn, wish_) FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY dated DESC, (m IS NOT NULL AND m IS NOT DISTINCT FROM wish_) DESC, rk IS NOT NULL DESC, rk DESC NULLS LAST,
      CASE WHEN rk IS NULL THEN g_new END DESC NULLS LAST, CASE WHEN dated THEN g_first END, v DESC, uploaded_at DESC NULLS LAST, CASE WHEN dated THEN lower(name) ELSE '' END DESC, list_pos) AS rn
  FROM (SELECT *, max(uploaded_at) OVER (PARTITION BY {keys}, dated, m) AS g_new, min(list_pos) OVER (PARTITION BY {keys}, dated, m) AS g_first, {_rank("m")} AS rk
    FROM (SELECT *, uploaded_at IS NOT NULL AS dated, CASE WHEN uploaded_at IS NOT NULL THEN {MEETING.format("name")} END AS m, {VERSION.format("name")} AS v, {wish} AS wish_ FROM {source} WHERE {where}) a) b) c
WHERE rn = 1"""


@query("k1_latest_schedule", "listing", oracle=latest_sql("listing", "inbox_id, folder", SCHEDULE))
def k1(listing):
    return catalog.latest_schedule(listing)


@query("k2_latest_chair_notes", "listing", oracle=f"WITH per AS ({latest_sql('listing', 'inbox_id, folder', CHAIR)}) {latest_sql('per', 'inbox_id', 'true')}")
def k2(listing):
    return catalog.latest_chair_notes(listing)


@query("k3_latest_agenda", "listing", oracle="""
SELECT inbox_id, folder, list_pos, name, url, uploaded_at FROM (
  SELECT *, row_number() OVER (PARTITION BY inbox_id ORDER BY uploaded_at DESC NULLS LAST, list_pos) AS rn FROM listing WHERE regexp_matches(lower(name), '\\.(docx|pptx|pdf|zip)$'))
WHERE rn = 1""")
def k3(listing):
    return catalog.latest_agenda(listing)


@query("k4_latest_by_mtime", "listing", oracle=f"""
SELECT inbox_id, folder, max_by(name, {{'m': uploaded_at, 'p': name}}) AS path, max(uploaded_at) AS modified
FROM listing WHERE {SCHEDULE} AND uploaded_at IS NOT NULL AND regexp_matches(lower(name), '\\.(docx|pptx|pdf)$') GROUP BY 1, 2""")
def k4(listing):
    files = listing.where("uploaded_at IS NOT NULL").withColumnsRenamed({"name": "path", "uploaded_at": "modified"})
    accepted = N.is_schedule_file(F.col("path")) & N.supported_document(F.col("path"), archives=False)
    return catalog.latest_by_mtime(files, ["inbox_id", "folder"], accepted)


@query("f1_f3_file_names", "listing", oracle=f"""
SELECT list_pos, {MEETING.format("name")} AS meeting_id, {_rank(MEETING.format("name"))} AS rank, {VERSION.format("name")} AS version FROM listing""")
def f1(listing):
    rank = N.meeting_rank(N.meeting_id(F.col("name")))
    number = F.concat(rank["series"], F.lit("#"), rank["number"], F.lit("#"), rank["late"].cast("string"))
    return listing.select("list_pos", N.meeting_id(F.col("name")).alias("meeting_id"), number.alias("rank"), N.file_version(F.col("name")).alias("version"))


@query("f4_meeting_name", "listing", oracle="""
SELECT list_pos, coalesce(nullif(regexp_extract(stem, '(RAN[0-9]+#[0-9]+\\w*)', 1), ''), stem) AS meeting_name
FROM (SELECT list_pos, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM listing)""")
def f4(listing):
    return listing.select("list_pos", N.meeting_name(F.col("name")).alias("meeting_name"))


PERSON_FILE = "coalesce(nullif(regexp_extract(name, '(?i)schedule\\s+for\\s+(\\w+)', 1), ''), nullif(regexp_extract(name, '(?i)schedules?\\s*-\\s*(\\w+)\\s+sessions?', 1), ''))"
PERSON_FOLDER = "CASE WHEN NOT contains(lower(folder), 'chair') THEN nullif(regexp_extract(folder, '(?i)^(.*)_(notes|sessions|session)$', 1), '') END"


@query("f5_f6_persons", "listing", oracle=f"SELECT list_pos, {PERSON_FOLDER} AS of_folder, {PERSON_FILE} AS of_file FROM listing")
def f5(listing):
    return listing.select("list_pos", N.person_of_folder(F.col("folder")).alias("of_folder"), N.person_of_file(F.col("name")).alias("of_file"))


@query("p1_p4_file_predicates", "listing", oracle=f"""
SELECT list_pos, {SCHEDULE} AS schedule, {CHAIR} AS chair_notes, regexp_matches(lower(name), '\\.(docx|pptx|pdf|zip)$') AS supported, {LISTED} AS listed FROM listing""")
def p1(listing):
    return listing.select(
        "list_pos",
        N.is_schedule_file(F.col("name")).alias("schedule"),
        N.is_chair_notes_file(F.col("name")).alias("chair_notes"),
        N.supported_document(F.col("name")).alias("supported"),
        N.is_listed_folder(F.col("folder")).alias("listed"),
    )


U7 = f"""
WITH f AS (SELECT * FROM listing WHERE folder <> 'Inbox' AND {LISTED}),
chair AS (SELECT inbox_id, min(folder) AS folder FROM f WHERE contains(lower(folder), 'chair') GROUP BY 1),
main AS ({latest_sql("(SELECT f.* FROM f JOIN chair USING (inbox_id, folder)) q", "inbox_id", SCHEDULE)}),
pins AS (SELECT inbox_id, folder AS main_folder, {MEETING.format("name")} AS pin FROM main),
others AS (SELECT f.*, pin FROM f LEFT JOIN pins USING (inbox_id) WHERE main_folder IS NULL OR folder <> main_folder),
picked AS ({latest_sql("others", "inbox_id, folder", SCHEDULE, "pin")}),
found AS (
  SELECT inbox_id, folder, list_pos, name, NULL AS person, true AS is_main FROM main
  UNION ALL SELECT inbox_id, folder, list_pos, name, {PERSON_FOLDER}, contains(lower(folder), 'chair') FROM picked),
strays AS (SELECT l.inbox_id, folder, list_pos, name, {PERSON_FILE} AS person, {_rank(MEETING.format("name"))} AS rk, {_rank("pin")} AS pin_rk
  FROM listing l LEFT JOIN pins USING (inbox_id) WHERE folder = 'Inbox' AND {SCHEDULE})
SELECT * FROM found
UNION ALL
SELECT inbox_id, folder, list_pos, name, person, false FROM (
  SELECT *, row_number() OVER (PARTITION BY inbox_id, person ORDER BY list_pos) AS rn FROM strays s
  WHERE person IS NOT NULL AND NOT coalesce(rk < pin_rk, false) AND NOT EXISTS (SELECT 1 FROM found x WHERE x.inbox_id = s.inbox_id AND x.person = s.person)) WHERE rn = 1"""


@query("u7_discover_sources", "listing", oracle=U7)
def u7(listing):
    return catalog.discover_sources(listing).select("inbox_id", "folder", "list_pos", "name", "person", "is_main")


@query("u1_union_sources", "sources", oracle="""
SELECT meeting_id, ord, folder, CASE WHEN ord % 8 < 5 THEN 0 ELSE 1 END AS part FROM sources""")
def u1(sources):
    return catalog.union_sources(sources.where("ord % 8 < 5"), sources.where("ord % 8 >= 5")).select("meeting_id", "ord", "folder", "part")


U2 = """
WITH m AS (SELECT *, is_main AND row_number() OVER (PARTITION BY meeting_id, is_main ORDER BY uploaded_at DESC NULLS LAST, ord) = 1 AS wins FROM sources),
k AS (SELECT *, CASE WHEN wins THEN 0 WHEN NOT is_main AND person <> '' THEN 1 ELSE 2 END AS kind FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, kind, CASE kind WHEN 0 THEN '' WHEN 1 THEN person ELSE folder END ORDER BY uploaded_at DESC NULLS LAST, ord) AS rn FROM k)
SELECT meeting_id, kind, ord, folder, person, wins AS is_main, url, uploaded_at FROM r WHERE rn = 1"""


@query("u2_dedup_sources", "sources", oracle=U2)
def u2(sources):
    return catalog.dedup_sources(sources)


@query("u3_dedup_listing", "listing", oracle=f"""
WITH cur AS ({latest_sql("listing", "inbox_id, folder", f"{SCHEDULE} AND {LISTED}")})
SELECT folder, name, max(uploaded_at) AS uploaded_at, arg_max(url, {{'d': uploaded_at IS NOT NULL, 'u': coalesce(uploaded_at, TIMESTAMP '1900-01-01'), 'p': -list_pos}}) AS url FROM cur GROUP BY folder, name""")
def u3(listing):
    return catalog.dedup_listing(listing)


@query("u4_snapshot_diff", "remote", "cached", oracle="""
SELECT *, 'added' AS change FROM (SELECT * FROM remote EXCEPT SELECT * FROM cached)
UNION ALL SELECT *, 'removed' FROM (SELECT * FROM cached EXCEPT SELECT * FROM remote)""")
def u4(remote, cached):
    return changes.snapshot_diff(remote, cached)


@query("u5_snapshot_changed", "remote", "cached", oracle="""
WITH b AS (SELECT *, 1 AS r, 0 AS c FROM remote UNION ALL SELECT *, 0, 1 FROM cached),
e AS (SELECT inbox_id, folder, name, uploaded_at, sum(r) AS r, sum(c) AS c FROM b GROUP BY ALL),
s AS (SELECT inbox_id, sum(r) AS n_remote, sum(c) AS n_cached, count(*) FILTER (c = 0) AS n_new, count(*) FILTER (r = 0) AS n_gone FROM e GROUP BY inbox_id)
SELECT inbox_id, n_remote::BIGINT AS n_remote, n_cached::BIGINT AS n_cached, n_new, n_gone,
  CASE WHEN n_remote = 0 THEN false WHEN n_cached = 0 THEN true WHEN n_new = 0 AND (n_gone = 0 OR n_remote < n_cached) THEN false ELSE true END AS changed FROM s""")
def u5(remote, cached):
    return changes.snapshot_changed(remote, cached)


@query("u6_ordered_distinct", "conversations", oracle="SELECT role, lower(text) AS v, min(conv_id * 1000 + turn) AS ord FROM conversations GROUP BY 1, 2")
def u6(conversations):
    rows = conversations.select("role", F.lower("text").alias("v"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    return changes.ordered_distinct(rows, "role", "v", "ord")


@query("u8_split_main_and_detail", "sources", oracle="""
SELECT meeting_id, is_main, CASE WHEN is_main THEN '' ELSE person END AS person, arg_max(url, ord) AS url
FROM sources WHERE is_main OR person <> '' GROUP BY 1, 2, 3""")
def u8(sources):
    return catalog.split_main_and_detail(sources)
