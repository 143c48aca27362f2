"""Documents by their file names: workbooks and HTML pages as cells.

A workbook is a ZIP of XML parts. Its sheets are streamed cell by cell with the standard XML reader; a task holds one
workbook's bytes, its shared strings, and a block of cells. Files are dealt over the cluster one by one.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import CELL, PAGE_BYTES, VALUES, ValueBlocks, add_values, header_finder, html_cells, html_tables

WORKBOOKS, PAGES = ("xlsx", "xlsm"), ("htm", "html")
#: Cells that go on to Spark at once.
BLOCK = 50_000
_REF = re.compile(r"([A-Z]+)([0-9]+)")
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _text(element: ElementTree.Element) -> str:
    """The text of a string item: its runs, without the phonetic ones."""
    if any(_tag(x) == "r" for x in element):
        return "".join(t.text or "" for r in element if _tag(r) == "r" for t in r if _tag(t) == "t")
    return "".join(t.text or "" for t in element if _tag(t) == "t")


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def _strings(book: zipfile.ZipFile, name: str) -> list[str]:
    if name not in book.namelist():
        return []
    out = []
    with book.open(name) as f:
        for _, e in ElementTree.iterparse(f):
            if _tag(e) == "si":
                out.append(_text(e))
                e.clear()
    return out


def _sheets(book: zipfile.ZipFile) -> list[str]:
    """The parts of a workbook's sheets, in the workbook's order."""
    relations = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target", "") for r in relations}
    main = ElementTree.fromstring(book.read("xl/workbook.xml"))
    at = [target[e.get(_REL)] for e in main.iter() if _tag(e) == "sheet" and e.get(_REL) in target]
    return [t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join("xl", t)) for t in at]


def _number(text: str) -> str:
    """A stored number as it is read by a person: no exponent for whole numbers, no trailing zero part."""
    x = float(text)
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _value(cell: ElementTree.Element, strings: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return next((_text(e) for e in cell if _tag(e) == "is"), None)
    raw = next((e.text for e in cell if _tag(e) == "v"), None)
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(raw)] if raw.isdigit() and int(raw) < len(strings) else None
    return {"1": "TRUE", "0": "FALSE"}.get(raw, raw) if kind == "b" else raw if kind in ("str", "d") else _number(raw)


def workbook_cells(content: bytes) -> Iterator[tuple[int, int, int, str]]:
    """(sheet, row, column, text) of every cell with a value; sheets without any are not counted."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings = _strings(book, "xl/sharedStrings.xml")
        place = 0
        for part in _sheets(book):
            if part not in book.namelist():
                continue
            row, some = -1, False
            with book.open(part) as f:
                for _, e in ElementTree.iterparse(f):
                    if not e.tag.endswith("row") or _tag(e) != "row":
                        continue
                    row, column = int(e.get("r", row + 2)) - 1, -1
                    # A row's cells at once: an event for each would cost more than its value.
                    for x in e.iter(e.tag.removesuffix("row") + "c"):
                        found = _REF.match(x.get("r", ""))
                        column = _column(found[1]) if found else column + 1
                        value = _value(x, strings)
                        if value is not None and value != "":
                            some = True
                            yield place, row, column, value
                    e.clear()
            place += some


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["doc_id", "table_idx", "row_idx", "col_idx", "text"]
    held: list[tuple] = []
    for b in batches:
        for doc, content in zip(b["path"], b["content"], strict=True):
            try:
                for cell in workbook_cells(content):
                    held.append((doc, *cell))
                    if len(held) >= BLOCK:
                        yield pd.DataFrame(held, columns=names)
                        held = []
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
                raise _known(doc, e) from e
    yield pd.DataFrame(held, columns=names)


def _known(doc: str, error: Exception) -> ValueError:
    return ValueError(f"{doc} is no workbook: {error}")


def workbook_tables(content: bytes) -> list[list[list[str | None]]]:
    """The rows of a workbook's sheets."""
    out: list[list[list]] = []
    for place, r, c, text in workbook_cells(content):
        if place == len(out):
            out.append([])
        rows = out[place]
        while len(rows) <= r:
            rows.append([])
        row = rows[r]
        row += [None] * (c + 1 - len(row))
        row[c] = text
    return out


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, find = ValueBlocks(), header_finder()
    for b in batches:
        for path, kind, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if content is None:
                continue
            try:
                tables = workbook_tables(content) if kind in WORKBOOKS else html_tables(content.decode("UTF-8"))
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
                raise _known(path, e) from e
            add_values(out, path, tables, find)
            if out.full():
                yield out.batch()
    yield out.batch()


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """path, content of files; one row each."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")


def _kinds(files: DataFrame) -> DataFrame:
    kind = extension(F.col("path"))
    known = kind.isin(*WORKBOOKS, *PAGES)
    refused = F.raise_error(F.concat(F.lit("no reader for "), F.col("path"), F.lit(": xlsx, xlsm, htm and html are read"))).cast("string")
    return files.select("path", "content", F.when(known, kind).otherwise(refused).alias("kind"))


def document_cells(files: DataFrame, dealt: int | None = None) -> DataFrame:
    """The cells of files (path, content) by their extensions: doc_id (the path), table_idx, row_idx, col_idx, text.

    A file of another kind, or a workbook that can't be read, stops the job with its name. Null contents are empty
    documents. `dealt` is the number of partitions that files are dealt into, if not the session's.
    """
    rows = _kinds(files)
    rows = rows.repartition(dealt, "path") if dealt else rows.repartition("path")
    books = rows.where(F.col("kind").isin(*WORKBOOKS) & F.col("content").isNotNull()).select("path", "content").mapInPandas(_read, CELL)
    # The kind is asked of every file, so that one of another kind is not passed over.
    pages = rows.where(~F.col("kind").isin(*WORKBOOKS)).select("path", F.decode("content", "UTF-8").alias("html"))
    return books.unionByName(html_cells(pages, "path", "html"))


def document_values(files: DataFrame) -> DataFrame:
    """The tables with headers of files (path, content) at once (VALUES), where the files are; those of document_cells in all else."""
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PAGE_BYTES))
    return _kinds(files).select("path", "kind", "content").mapInArrow(_values, VALUES)
