"""Queries on sources, sinks and streams, over data derived from the given tables."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from itertools import groupby
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import grammar, grid, layout
from ..sources import documents, listing, state
from ..streaming import changes as streams
from .adapters import TABLES, VIEWS, view
from .grid_queries import J12
from .registry import ORACLE_SQL, QUERIES, query, with_views
from .timeline_queries import F19, TREE


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; only a local master falls back to its own disk."""
    base = spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


# real pages' links as rows of a directory listing
LINK = r'<li><a href="/([^"]*)">'
TO_ROW = r'<tr><td>x</td><td></td><td><a class="f" href="/in/\1%20+v01.DOCX">n</a></td><td> 2024/1/5 9:07 </td></tr><tr><td></td><td></td><td><a href="https://other.example/\1/">d</a></td><td>soon</td></tr>'
LINKS = r"""l AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="/([^"]*)">', 1)) AS x, generate_subscripts(regexp_extract_all(html, '<li><a href="/([^"]*)">', 1), 1) AS i FROM pages)"""


def _pages(pages: DataFrame) -> DataFrame:
    html = F.regexp_replace("html", LINK, TO_ROW.replace("\\1", "$1"))
    return pages.select(F.col("page_id").alias("inbox_id"), F.lit("f").alias("folder"), "url", html.alias("html"))


@query("s1_read_listing", "pages", oracle=f"""WITH {LINKS}
SELECT page_id AS inbox_id, 'f' AS folder, (2 * i - 2)::INTEGER AS list_pos, x || ' +v01.DOCX' AS name, url || '//in/' || x || '%20+v01.DOCX' AS url, TIMESTAMP '2024-01-05 09:07:00' AS uploaded_at FROM l JOIN pages USING (page_id) WHERE NOT contains(x, '/')""")
def s1(pages):
    return listing.read_listing(_pages(pages)).where("NOT startswith(name, '/')")


@query("s2_read_folders", "pages", oracle=f"""WITH {LINKS}
SELECT page_id AS inbox_id, (2 * i - 1)::INTEGER AS list_pos, x AS name, 'https://other.example/' || x || '/' AS url FROM l WHERE x <> '' AND NOT contains(x, '.')""")
def s2(pages):
    return listing.read_folders(_pages(pages)).select("inbox_id", "list_pos", "name", F.concat("url", F.lit("")).alias("url"))


@query("p5_drop_error_pages", "pages", oracle="""
SELECT page_id FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'The Service Unavailable page' WHEN 1 THEN html || 'service unavailable' ELSE html END AS h, page_id % 2 = 0 AS listing FROM pages)
WHERE NOT ((length(h) <= 4096 OR listing) AND (contains(lower(h), 'service unavailable') OR contains(lower(h), 'our services aren''t available right now') OR contains(lower(h), 'we''re working to restore all services')))""")
def p5(pages):
    m = F.col("page_id") % 5
    h = F.when(m == 0, "The Service Unavailable page").when(m == 1, F.concat("html", F.lit("service unavailable"))).otherwise(F.col("html"))
    rows = pages.select("page_id", h.alias("h"), (F.col("page_id") % 2 == 0).alias("listing"))
    return rows.where(~T.is_error_page(F.col("h"), F.length("h"), F.col("listing"))).select("page_id")


def text_box(name: str, drawn: str | None, resolved: str | None) -> str:
    """A paragraph with a text box, its text in both alternatives."""
    text = f"<w:txbxContent><w:p><w:r><w:t>{escape(name)}</w:t></w:r></w:p></w:txbxContent>"
    fill = "" if drawn is None else f"<a:solidFill><a:srgbClr val={quoteattr(drawn)}/></a:solidFill>"
    shape = "" if resolved is None else f" fillcolor={quoteattr(resolved)}"
    choice = f"<w:drawing><wps:wsp><wps:spPr>{fill}</wps:spPr><wps:txbx>{text}</wps:txbx></wps:wsp></w:drawing>"
    fallback = f"<w:pict><v:shape{shape}><v:textbox>{text}</v:textbox></v:shape></w:pict>"
    return f"<w:p><w:r><mc:AlternateContent><mc:Choice>{choice}</mc:Choice><mc:Fallback>{fallback}</mc:Fallback></mc:AlternateContent></w:r></w:p>"


def build_document(cells: list[dict], boxes: str = "") -> bytes:
    """A small document with text boxes, and tables of cells (table_idx, row_idx, tc_idx, grid_span, v_merge, fill, text)."""
    rows: dict[tuple[int, int], list[str]] = {}
    for c in sorted(cells, key=lambda c: (c["table_idx"], c["row_idx"], c["tc_idx"])):
        merge = "" if c["v_merge"] is None else f"<w:vMerge w:val={quoteattr(c['v_merge'])}/>"
        fill = "" if c["fill"] is None else f"<w:shd w:fill={quoteattr(c['fill'])}/>"
        paragraphs = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in c["text"].split("\n"))
        rows.setdefault((c["table_idx"], c["row_idx"]), []).append(f'<w:tc><w:tcPr><w:gridSpan w:val="{c["grid_span"]}"/>{merge}{fill}</w:tcPr>{paragraphs}</w:tc>')
    body = boxes
    for t in sorted({t for t, _ in rows}):
        body += f"<w:p><w:r><w:t>Table {t}</w:t></w:r></w:p><w:tbl>" + "".join(f"<w:tr>{''.join(c)}</w:tr>" for (tt, _), c in rows.items() if tt == t) + "</w:tbl>"
    spaces = " ".join(f'xmlns:{k}="{v[1:-1]}"' for k, v in (("w", documents.W), ("mc", documents.MC), ("a", documents.A), ("v", documents.V), ("wps", documents.WPS)))
    xml = f'<w:document {spaces}><w:body>{body}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", xml)
    return out.getvalue()


def _files(cells: DataFrame, boxes: Callable[[int], str] | None = None) -> DataFrame:
    """Documents of cells, perhaps with text boxes, one at a time: cells come by document, so a task holds those of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for doc_id, own in groupby(rows, key=lambda row: row["doc_id"]):
            content = build_document(list(own), boxes(doc_id) if boxes else "")
            yield pa.RecordBatch.from_arrays([pa.array([f"{doc_id}.docx"]), pa.array([content], pa.binary())], names=["path", "content"])

    return cells.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, "path string, content binary")


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files with every second document inside an archive, one at a time."""
    for batch in batches:
        for path, content in zip(*batch.columns, strict=True):
            name, data = path.as_py(), content.as_py()
            if int(name.split(".")[0]) % 2 == 0:
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as archive:
                    for inner, bytes_ in (("__MACOSX/a.docx", b"x"), ("b.pdf", b"pdf"), ("sub/", b""), ("sub/c.DOCX", data), ("d.docx", b"later")):
                        archive.writestr(inner, bytes_)
                name, data = name.replace(".docx", ".zip"), out.getvalue()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], names=["path", "content"])


# rows are numbered anew in a document, as are tables
NUMBERED = """
SELECT concat(doc_id, '.docx') AS doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY table_idx) - 1 AS INTEGER) AS table_idx, CAST(dense_rank() OVER (PARTITION BY doc_id, table_idx ORDER BY row_idx) - 1 AS INTEGER) AS row_idx,
  CAST(row_number() OVER (PARTITION BY doc_id, table_idx, row_idx ORDER BY tc_idx) - 1 AS INTEGER) AS tc_idx, grid_span, v_merge, fill, trim(text) AS text FROM cells"""


@query("s5_extract_tables", "cells", oracle=NUMBERED)
def s5(cells):
    return documents.table_cells(documents.extract_tables(_files(cells)))


def _boxes(n: int) -> str:
    """A document's five labels: by the resolved fill, by the drawn one beside a resolved one that is none, without any, and doubles."""
    name = f"Room{n % 9}-"
    return "".join((text_box(name + "0", "123456", "#d5d5d5 [1943]"), text_box(name + "1", "ffd066", "auto"), text_box(name + "2", None, None), text_box(name + "3", "FFFFFF", None), text_box(name + "4", "000000", "#FFFFFF")))


_BOXED = J12.replace("FROM cells", "FROM docs").replace("doc_id % 9", "CAST(replace(doc_id, '.docx', '') AS BIGINT) % 9")


@query("s5_text_box_labels", "cells", oracle=_BOXED.replace("WITH g AS", f"WITH docs AS ({NUMBERED}), g AS", 1) + " SELECT doc_id, table_idx, names FROM j12")
def s5_boxes(cells):
    rows = documents.extract_tables(_files(cells, _boxes))
    colors = grid.table_column_colors(grid.grid_positions(documents.table_cells(rows)))
    return grid.match_rooms_by_color(colors, documents.box_labels(rows)).withColumn("names", F.array_join("names", ","))


@query("s4_resolve_archives", "cells", oracle="SELECT path, name FROM (SELECT DISTINCT concat(doc_id, CASE WHEN doc_id % 2 = 0 THEN '.zip' ELSE '.docx' END) AS path, CASE WHEN doc_id % 2 = 0 THEN 'c.DOCX' ELSE concat(doc_id, '.docx') END AS name FROM cells)")
def s4(cells):
    return documents.resolve_archives(_files(cells).mapInArrow(_zipped, "path string, content binary")).select("path", "name")


@query("s6_state_io", "cached", oracle="SELECT inbox_id, folder, name, uploaded_at FROM cached")
def s6(cached):
    meta = cached.select("inbox_id").distinct().select("inbox_id", F.lit("ran1#124bis").alias("meeting_id"), F.lit("Europe/Malta").alias("timezone"))
    return state.state_files(state.parse_state(state.write_state(cached, meta)))


@query("s7_read_slot_results", "items", oracle="""
SELECT meeting_id, day, tb, CAST(row_number() OVER (PARTITION BY meeting_id, day, tb ORDER BY ord) - 1 AS INTEGER) AS ord, room_name, name, duration_minutes, specified_start_time, chair, group_header, agenda_item FROM items""")
def s7(items):
    fields = ["ord", "room_name", "name", "duration_minutes", "specified_start_time", "chair", "group_header", "agenda_item"]
    listed = items.groupBy("meeting_id", "day", "tb").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("sessions"))
    return state.read_slot_results(listed.select("meeting_id", "day", "tb", F.to_json(F.struct("sessions")).alias("result")))


def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = view(spark, sf_dir, "sessions").select("meeting_id", "ord", "name", "start_time", "end_time")
    path = shared_path(spark, "schedule")
    state.write_schedule(sessions, path)
    return state.read_schedule(spark, path).select(F.col("meeting_id").cast("int").alias("meeting_id"), "ord", "name", "start_time", "end_time")


QUERIES["s8_write_schedule"] = s8
ORACLE_SQL["s8_write_schedule"] = with_views("SELECT CAST(meeting_id AS INTEGER) AS meeting_id, ord, name, start_time, end_time FROM sessions")


def s8_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, their layout and the facets of all meetings, then of every third one again, shorter."""
    path, made = shared_path(spark, "published"), shared_path(spark, "sessions")
    view(spark, sf_dir, "sessions").write.parquet(made)  # once, as six tables are made of them
    sessions = spark.read.parquet(made).withColumn("rooms", F.array(F.lit("R1"), F.lit("R2")))

    def tables(some: DataFrame) -> dict[str, DataFrame]:
        laid = layout.layout_block(some).select("meeting_id", "ord", "row_start", "row_end", "col_start", "col_end")
        return {"sessions": some.select("meeting_id", "ord", "name", "start_time", "end_time"), "layout": laid, "facets": layout.facet_tree(some)}

    state.publish(tables(sessions), path)
    state.publish(tables(sessions.where("meeting_id % 3 = 0 AND tb < 2")), path)
    read = {name: state.read_published(spark, path, name) for name in ("sessions", "layout", "facets")}
    counts = read["sessions"].groupBy("meeting_id").agg(F.count("*").alias("n_sessions"))
    laid = read["layout"].groupBy("meeting_id").agg(F.count("*").alias("n_laid"), F.sum("row_start").alias("rows"))
    return counts.join(laid, "meeting_id", "left").join(read["facets"], "meeting_id").select("meeting_id", "n_sessions", "n_laid", "rows", "facets")


QUERIES["s8_publish_together"] = s8_together
ORACLE_SQL["s8_publish_together"] = with_views(f"""WITH cur AS (SELECT * FROM sessions WHERE meeting_id % 3 <> 0 OR tb < 2), tree AS ({TREE.replace("FROM items", "FROM cur")}),
lay AS (SELECT meeting_id, l.ord, row_start FROM ({F19}) l JOIN cur USING (ord)),
n AS (SELECT meeting_id, count(*) AS n_sessions FROM cur GROUP BY 1), m AS (SELECT meeting_id, count(*) AS n_laid, sum(row_start)::BIGINT AS rows FROM lay GROUP BY 1)
SELECT meeting_id, n_sessions, n_laid, rows, facets FROM n LEFT JOIN m USING (meeting_id) JOIN tree USING (meeting_id)""")


# a person's header over a category with sub-items and nested headers, a struck-out line, and a time range after it
@query("f25_parse_cell_grammar", "items", oracle="""
WITH k AS (SELECT * FROM items WHERE duration_minutes > 0)
SELECT meeting_id, day, tb, room_name, concat('item ', ord) AS name, duration_minutes, 'Kim' AS chair, '6GR' AS group_header, NULL AS specified_start_time FROM k WHERE ord % 3 > 0
UNION ALL SELECT meeting_id, day, tb, room_name, concat('first of ', ord), duration_minutes, 'Kim', concat('Topic ', ord), NULL FROM k WHERE ord % 3 = 0
UNION ALL SELECT meeting_id, day, tb, room_name, concat('second of ', ord), 10, 'Kim', concat('Topic ', ord), NULL FROM k WHERE ord % 3 = 0
UNION ALL SELECT DISTINCT meeting_id, day, tb, room_name, 'late one', 90, NULL, '', '13:00' FROM k""")
def f25(items):
    ord_, minutes = F.col("ord").cast("string"), F.col("duration_minutes")
    nested = F.concat(F.lit("Topic "), ord_, F.lit(" ("), minutes + 10, F.lit(")\n.first of "), ord_, F.lit(" ("), minutes, F.lit(")\n.second of "), ord_, F.lit(" (10)"))
    line = F.when(F.col("ord") % 3 == 0, nested).otherwise(F.concat(F.lit(".item "), ord_, F.lit(" ("), minutes, F.lit(")")))
    total = F.sum(minutes + F.when(F.col("ord") % 3 == 0, 10).otherwise(0))
    kept = items.where("duration_minutes > 0").groupBy("meeting_id", "day", "tb", "room_name").agg(total.alias("n"), F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))).alias("l"))
    text = F.concat(F.lit("Kim ("), "n", F.lit(")\n6GR\n"), F.array_join(F.col("l.l"), "\n"), F.lit("\n~~gone (30)~~\n13:00 ~ 14:30\nlate one"))
    out = grammar.parse_cells(kept.withColumn("text", text), ["Kim"])
    return out.select("meeting_id", "day", "tb", "room_name", "name", "duration_minutes", "chair", "group_header", "specified_start_time")


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    like = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.readStream.schema(like.schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is listed now arrives as a stream over the state that the stored listing left."""
    base = shared_path(spark, "changes")
    sink, state_dir = f"{base}/sink", f"{base}/state"
    streams.accept(view(spark, sf_dir, "cached").withColumn("snapshot_id", F.lit(1)), 0, f"{base}/first", state_dir)  # a run before the stream's first
    sql = VIEWS["remote"].replace("FROM events", "FROM {events}")
    remote = spark.sql(sql, events=_stream(spark, sf_dir, "events")).withColumn("snapshot_id", F.lit(2))
    streams.change_stream(remote, sink, state_dir, f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).select("inbox_id", "folder", "name", "uploaded_at", "change")


QUERIES["t1_change_stream"] = t1
ORACLE_SQL["t1_change_stream"] = with_views("""
WITH a AS (SELECT *, 'added' AS change FROM (SELECT * FROM remote EXCEPT SELECT * FROM cached)),
g AS (SELECT *, 'removed' AS change FROM (SELECT * FROM cached EXCEPT SELECT * FROM remote)),
n AS (SELECT inbox_id, (SELECT count(*) FROM remote r WHERE r.inbox_id = i.inbox_id) AS nr, (SELECT count(*) FROM cached c WHERE c.inbox_id = i.inbox_id) AS nc FROM (SELECT DISTINCT inbox_id FROM remote) i),
ch AS (SELECT inbox_id FROM n WHERE nc = 0 OR EXISTS (SELECT 1 FROM a WHERE a.inbox_id = n.inbox_id) OR (nr >= nc AND EXISTS (SELECT 1 FROM g WHERE g.inbox_id = n.inbox_id)))
SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM g) WHERE inbox_id IN (SELECT inbox_id FROM ch)""")


def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots arrive as a stream; those of a known content key are not computed again."""
    base = shared_path(spark, "slots")
    lines = _stream(spark, sf_dir, "lineitem")
    slot = lines.select(F.col("l_orderkey").alias("slot_id"), F.concat_ws("|", F.col("l_partkey") % 50, "l_returnflag", "l_linestatus").alias("content"))
    keyed = slot.withColumn("content_key", F.substring(F.sha2("content", 256), 1, 16))

    def compute(df: DataFrame) -> DataFrame:
        return df.select("content_key", "slot_id", F.upper("content").alias("result"))

    streams.incremental_slots(keyed, f"{base}/results", f"{base}/checkpoint", compute).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/results").select("content_key", "slot_id", "result")


QUERIES["t2_incremental_slots"] = t2
ORACLE_SQL["t2_incremental_slots"] = """
SELECT substr(sha256(content), 1, 16) AS content_key, min(l_orderkey) AS slot_id, upper(content) AS result
FROM (SELECT l_orderkey, concat_ws('|', l_partkey % 50, l_returnflag, l_linestatus) AS content FROM lineitem) GROUP BY content"""


def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables as documents, be they a file or a folder of part files: names, and whether they have any bytes."""
    below = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", sf_dir).rstrip("/")
    files = documents.read_documents(spark, sf_dir)
    name = F.split(F.split("path", rf"\Q{below}/\E", 2)[1], "/")[0]
    return files.groupBy(name.alias("name")).agg(F.bool_or(F.col("length") > 0).alias("filled"))


QUERIES["s3_read_documents"] = s3
ORACLE_SQL["s3_read_documents"] = "SELECT name || '.parquet' AS name, true AS filled FROM (VALUES " + ", ".join(f"('{t}')" for t in TABLES) + ") t(name)"
