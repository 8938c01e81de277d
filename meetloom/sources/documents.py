"""Document files, archives and their tables.

Only opening archives and document XML runs in Python, one file at a time in the tasks.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DOCUMENT_EXTENSIONS, ERROR_PAGE_BYTES
from ..functions import text as T

#: What opening a damaged or encrypted file raises.
BROKEN = (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, KeyError, ValueError, EOFError, OSError, RuntimeError, NotImplementedError)

#: Rows of a document that leave a task together.
ROWS_AT_ONCE = 4096

# The namespaces of the document format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
V = "{urn:schemas-microsoft-com:vml}"
WPS = "{http://schemas.microsoft.com/office/word/2010/wordprocessingShape}"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files below path (S3): path, modificationTime, length, content; error pages left out (P5).

    Only files of up to ERROR_PAGE_BYTES can be error pages, so of others no content is read
    unless it is asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small, large = files.where(F.col("length") <= ERROR_PAGE_BYTES), files.where(F.col("length") > ERROR_PAGE_BYTES)
    text = F.decode("content", "ISO-8859-1")
    return large.unionByName(small.where(~T.is_error_page(text, F.col("length"))))


def _opened(read, *of):
    """What read makes of a file; None if that is damaged or encrypted."""
    try:
        return read(*of)
    except BROKEN:
        return None


def resolve_archives(files: DataFrame) -> DataFrame:
    """Each archive's document (S4): path, name, content.

    Folders and resource forks are skipped; the first entry of the best extension counts and
    is the only one that is read; an archive that is broken or encrypted there, or has no
    document, gives no row. Other files pass as they are.
    """

    def chosen(path: str, content: bytes) -> tuple[str, bytes] | None:
        if not path.lower().endswith(".zip"):
            return path, content
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            ranked = []
            for i, name in enumerate(archive.namelist()):
                rank = next((k for k, e in enumerate(DOCUMENT_EXTENSIONS) if name.lower().endswith(e)), None)
                if rank is not None and not name.startswith("__MACOSX") and not name.endswith("/"):
                    ranked.append((rank, i, name))
            return (min(ranked)[2], archive.read(min(ranked)[2])) if ranked else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):  # a file at a time, they may be large
                if found := _opened(chosen, path.as_py(), content.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([found[0].rsplit("/", 1)[-1]]), pa.array([found[1]], pa.binary())], names=["path", "name", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, name string, content binary")


def _runs(cell: ElementTree.Element) -> list[dict]:
    """Texts of a cell's paragraphs, those of tables inside it too; any strike mark of a run counts, whatever its value."""
    runs = []
    for i, paragraph in enumerate(cell.iter(f"{W}p")):
        for run in paragraph.iter(f"{W}r"):
            marks = run.find(f"{W}rPr")
            struck = marks is not None and any(marks.find(W + name) is not None for name in ("strike", "dstrike"))
            runs += [{"para": i, "text": t.text, "strike": struck} for t in run.findall(f"{W}t") if t.text]
    return runs


def _value(parent: ElementTree.Element | None, name: str, attribute: str) -> str | None:
    mark = None if parent is None else parent.find(W + name)
    return None if mark is None else mark.get(W + attribute, "")


def _shape_fills(box: ElementTree.Element) -> list[str]:
    """Fills that a text box gives, in order of trust: the first of its resolved shapes, then the first of each drawn one."""
    resolved = (shape.get("fillcolor") for shape in box.iter(f"{V}shape"))
    drawn = (next((c.get("val", "") for s in p.iter(f"{A}solidFill") if (c := s.find(f"{A}srgbClr")) is not None), "") for p in box.iter(f"{WPS}spPr"))
    return [f for f in (next(filter(None, resolved), ""), *drawn) if f]


def document_rows(content: bytes) -> list[tuple]:
    """(kind, table_idx, row_idx, tc_idx, grid_span, v_merge, fill, text, runs, fills) of a document's body in order, then its text boxes."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{W}body")
    table, rows = 0, []
    for pos, block in enumerate([] if body is None else body):
        if block.tag == f"{W}p":
            rows.append(("paragraph", pos, None, None, None, None, None, "".join(t.text or "" for t in block.iter(f"{W}t")).strip(), [], []))
        elif block.tag == f"{W}tbl":
            rows.append(("table", pos, None, None, None, None, None, "", [], []))
            for r, row in enumerate(block.findall(f"{W}tr")):
                for c, cell in enumerate(row.findall(f"{W}tc")):
                    own = cell.find(f"{W}tcPr")
                    span = _value(own, "gridSpan", "val")
                    rows.append(("cell", table, r, c, int(span or 1), _value(own, "vMerge", "val"), _value(own, "shd", "fill"), "", _runs(cell), []))
            table += 1
    for i, box in enumerate([] if body is None else body.iter(f"{MC}AlternateContent")):
        text = "".join(t.text or "" for t in box.iter(f"{W}t")).strip()
        if text:
            rows.append(("box", i, None, None, None, None, None, text, [], _shape_fills(box)))
    return rows


_ROWS = "path string, kind string, table_idx int, row_idx int, tc_idx int, grid_span int, v_merge string, fill string, text string, runs array<struct<para:int,text:string,strike:boolean>>, fills array<string>"


def extract_tables(documents: DataFrame) -> DataFrame:
    """Rows of the documents' bodies (S5): cells with their runs, paragraphs and tables in order (table_idx is their position), and text boxes.

    A file that is damaged, encrypted or no document gives no row.
    """
    runs = pa.list_(pa.struct([("para", pa.int32()), ("text", pa.string()), ("strike", pa.bool_())]))
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), runs, pa.list_(pa.string()))
    names = [c.split()[0] for c in _ROWS.split(", ")]

    def batch_of(path: str, rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), kinds[0]), *(pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):  # a document at a time: its rows take many times its bytes
                rows = _opened(document_rows, content.as_py()) or []
                for i in range(0, len(rows), ROWS_AT_ONCE):
                    yield batch_of(path.as_py(), rows[i : i + ROWS_AT_ONCE])

    return documents.select("path", "content").mapInArrow(run, _ROWS)


def table_cells(rows: DataFrame) -> DataFrame:
    """Cells of extracted rows with their marked-up text (F11), as the grid operators take them."""
    text = T.strike_markup(F.col("runs"))
    return rows.where("kind = 'cell'").select(F.col("path").alias("doc_id"), "table_idx", "row_idx", "tc_idx", "grid_span", "v_merge", "fill", text.alias("text"))


def body_blocks(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, is_table, text) of extracted rows, for the texts between tables."""
    return rows.where("kind IN ('paragraph', 'table')").select(F.col("path").alias("doc_id"), F.col("table_idx").alias("pos"), (F.col("kind") == "table").alias("is_table"), "text")


def box_labels(rows: DataFrame) -> DataFrame:
    """(doc_id, ord, name, color) of the text boxes of extracted rows, as room colours are matched with.

    A box's two alternatives hold its text twice, of which one half is taken (F13); its colour
    is the first fill that is one.
    """
    colors = F.filter(F.transform("fills", T.color_norm), lambda c: c.isNotNull())
    return rows.where("kind = 'box'").select(F.col("path").alias("doc_id"), F.col("table_idx").alias("ord"), T.undouble(F.col("text")).alias("name"), F.try_element_at(colors, F.lit(1)).alias("color"))
