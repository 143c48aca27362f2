"""From disclosure tables to observations: cells, header rows, column mapping, typed values.

A document is a set of cells (doc_id, table_idx, row_idx, col_idx, text). Everything is keyed by document and
table, so tables of any number spread over the cluster; the assignment of a table's columns is a fold over its few
dozen candidates.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import METRICS
from ..functions.parsing import confidence, is_aggregate_label, numeric_cell, parse_value

HEADER_ROWS = 30
LEAST_MATCHES = 4
LEAST_OBSERVATIONS = 3
DECAY = 0.08
MOST_COLSPAN = 50
#: Distinct headers that a Python worker keeps its findings for.
KNOWN_HEADERS = 10_000
TABLE = ["doc_id", "table_idx"]

#: Metric, unit, header patterns from the most to the least certain, pattern that excludes. Order breaks ties.
SPECS = tuple((m.key, m.unit, m.patterns, "|".join(f"(?:{x})" for x in m.exclude) or None) for m in METRICS)


class _Tables(HTMLParser):
    """Rows of the outermost open table's cells; a colspan leaves nulls behind its cell."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.open, self.cell, self.span = [], [], None, 1

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.open.append(self.tables[-1])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open and self.open[-1]:
            self._close()
            wide = dict(attrs).get("colspan") or ""
            self.cell, self.span = [], min(MOST_COLSPAN, max(1, int(wide))) if wide.isdigit() else 1
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def _close(self):
        if self.cell is not None and self.open and self.open[-1]:
            self.open[-1][-1] += [" ".join("".join(self.cell).split()) or None, *[None] * (self.span - 1)]
        self.cell = None

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()
        if tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


#: A cell without tags; or any tag, with plain attributes, and the text behind it.
_TOKEN = re.compile(r'<t[dh]>([^<]*)</t[dh]>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][a-zA-Z-]*="[^"<>&]*")*)[ \t\n]*(/?)>([^<]*)')
_COLSPAN = re.compile(r'[ \t\n]colspan="([^"]*)"', re.IGNORECASE)
#: Elements whose content is no markup.
_VERBATIM = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"))


def _clean(text: str) -> str | None:
    return " ".join((unescape(text) if "&" in text else text).split()) or None


def _tokenised(html: str) -> list | None:
    """The tables that _Tables finds, some ten times as fast; None where a document has more than plain tags."""
    tables, open_, cell, span, tags = [], [], None, 1, 0
    for text, slash, name, attrs, shut, after in _TOKEN.findall(html):
        rows = open_[-1] if open_ else None
        if not name:
            tags += 2
            if rows:
                if cell is not None:
                    rows[-1] += [_clean("".join(cell)), *[None] * (span - 1)]
                rows[-1].append(_clean(text))
            cell = None
            continue
        tags, name = tags + 1, name.lower()
        if name in _VERBATIM or slash and (attrs or shut):
            return None
        if not slash:
            if name == "table":
                tables.append([])
                open_.append(tables[-1])
            elif name == "tr" and open_:
                rows.append([])
            elif name in ("td", "th") and rows:
                if cell is not None:
                    rows[-1] += [_clean("".join(cell)), *[None] * (span - 1)]
                wide = _COLSPAN.findall(attrs)[-1:] or [""]
                cell, span = [], min(MOST_COLSPAN, max(1, int(wide[0]))) if wide[0].isdigit() else 1
            elif name == "br" and cell is not None:
                cell.append(" ")
        if slash or shut:
            if name in ("td", "th", "tr", "table"):
                rows = open_[-1] if open_ else None
                if cell is not None and rows:
                    rows[-1] += [_clean("".join(cell)), *[None] * (span - 1)]
                cell = None
            if name == "table" and open_:
                open_.pop()
        if cell is not None:
            cell.append(after)
    return tables if tags == html.count("<") else None


def html_tables(html: str | None) -> list[list[list[str | None]]]:
    """Rows of texts of every table of two or more columns."""
    tables = _tokenised(html or "")
    if tables is None:
        found = _Tables()
        found.feed(html or "")
        tables = found.tables
    return [t for t in tables if max(map(len, t), default=0) > 1]


CELL = "doc_id string, table_idx int, row_idx int, col_idx int, text string"


#: Bytes of documents that a Python worker is sent at once (a longer document comes alone), and cells that it gives back at once.
PAGE_BYTES, BLOCK = 16 << 20, 20_000


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """However many documents a batch has, the cells of one document and a block are held."""
    names = ["doc_id", "table_idx", "row_idx", "col_idx", "text"]
    held: list[tuple] = []
    for b in batches:
        for doc, html in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True):
            held += [(doc, t, r, c, x) for t, table in enumerate(html_tables(html)) for r, row in enumerate(table) for c, x in enumerate(row) if x is not None]
            for at in range(0, len(held) - len(held) % BLOCK, BLOCK):
                yield pd.DataFrame(held[at : at + BLOCK], columns=names)
            held = held[len(held) - len(held) % BLOCK :]
    yield pd.DataFrame(held, columns=names)


def html_cells(pages: DataFrame, doc_id: str, html: str) -> DataFrame:
    """Cells with text of every table of two or more columns; layout tables of one column are left out."""
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PAGE_BYTES))
    return pages.select(F.col(doc_id).cast("string"), F.col(html)).mapInPandas(_cells, CELL)


ROW = "doc_id string, table_idx int, row_idx int, cells map<int,string>"
_ROW = pa.schema([("doc_id", pa.string()), ("table_idx", pa.int32()), ("row_idx", pa.int32()), ("cells", pa.map_(pa.int32(), pa.string()))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their filled cells from left to right; a document's and a block's cells are held, as in _cells."""
    docs, tables, places, ends, columns, texts = [], [], [], [0], [], []

    def block() -> pa.RecordBatch:
        cells = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(columns, pa.int32()), pa.array(texts, pa.string()))
        out = pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(tables, pa.int32()), pa.array(places, pa.int32()), cells], schema=_ROW)
        for x in (docs, tables, places, columns, texts):
            x.clear()
        ends[:] = [0]
        return out

    for b in batches:
        for doc, html in zip(b.column(0), b.column(1), strict=True):
            for t, table in enumerate(html_tables(html.as_py())):
                for r, row in enumerate(table):
                    filled = [c for c, x in enumerate(row) if x is not None]
                    if filled:
                        docs.append(doc.as_py())
                        tables.append(t)
                        places.append(r)
                        columns += filled
                        texts += [row[c] for c in filled]
                        ends.append(len(columns))
                    if len(columns) >= BLOCK:
                        yield block()
    yield block()


def html_rows(pages: DataFrame, doc_id: str, html: str) -> DataFrame:
    """The same tables as html_cells gives, a row at a time: its cells need not be sent over the network to be put together again."""
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PAGE_BYTES))
    return pages.select(F.col(doc_id).cast("string"), F.col(html)).mapInArrow(_rows, ROW)


_MATCH = "array<struct<spec:int,metric_key:string,unit:string,score:double>>"


@lru_cache
def _finder(specs: tuple):
    """What a header stands for; worked out once in a Python worker for every distinct text."""
    compiled = [(key, unit, [re.compile(p, re.ASCII) for p in patterns], exclude and re.compile(exclude, re.ASCII)) for key, unit, patterns, exclude in specs]

    @lru_cache(KNOWN_HEADERS)
    def find(t: str | None) -> list:
        out = []
        for place, (key, unit, patterns, exclude) in enumerate(compiled if t else ()):
            hit = next((i for i, p in enumerate(patterns) if p.search(t)), None)
            if hit is not None and not (exclude and exclude.search(t)):
                out.append({"spec": place, "metric_key": key, "unit": unit, "score": 1 - DECAY * hit})
        return out

    return find


def _matcher(specs: tuple):
    """A vectorised function of headers."""

    @F.pandas_udf(_MATCH)
    def match(headers: pd.Series) -> pd.Series:
        return headers.map(_finder(specs), na_action=None)

    return match


def header_matches(text: Column, specs: tuple = SPECS) -> Column:
    """Array of (spec, metric_key, unit, score) that a header may stand for; empty for null.

    Most cells are no header: one pattern made of all shows that in the JVM before the metrics are asked one by one.
    """
    t = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    any_header = "|".join(f"(?:{p})" for _, _, patterns, _ in specs for p in patterns)
    return _matcher(specs)(F.when(t.rlike(any_header), t))


_CANDIDATE = "array<struct<rank:double,col_idx:int,spec:int,metric_key:string,unit:string,header:string>>"


def _assigned(candidates: Column) -> Column:
    """The candidates of one row that are taken: each in its order, if neither its column nor its metric is taken yet."""

    def step(taken: Column, x: Column) -> Column:
        used = F.exists(taken, lambda y: (y["col_idx"] == x["col_idx"]) | (y["metric_key"] == x["metric_key"]))
        return F.when(used, taken).otherwise(F.concat(taken, F.array(x)))

    return F.aggregate(F.array_sort(candidates), F.array().cast(_CANDIDATE), step)


def _candidates(text: str, specs: tuple) -> Column:
    """Sorted, these stand in the order of assignment: the best scores, then columns from the left, then the specs' order."""
    one = lambda m: F.struct((-m["score"]).alias("rank"), F.col("col_idx").alias("col_idx"), m["spec"].alias("spec"), m["metric_key"].alias("metric_key"), m["unit"].alias("unit"), F.col(text).alias("header"))
    return F.transform(header_matches(F.col(text), specs), one)


def header_rows(cells: DataFrame, specs: tuple = SPECS) -> DataFrame:
    """doc_id, table_idx, header_row: the first of the rows that give most columns a metric."""
    top = cells.where((F.col("row_idx") < HEADER_ROWS) & (F.trim("text") != "")).withColumn("m", _candidates("text", specs))
    rows = top.groupBy(*TABLE, "row_idx").agg(F.count(F.lit(1)).alias("filled"), F.count_if(F.size("m") > 0).alias("named"), F.flatten(F.collect_list("m")).alias("xs"))
    rows = rows.where((F.col("filled") >= LEAST_MATCHES) & (F.col("named") >= LEAST_MATCHES)).withColumn("matches", F.size(_assigned(F.col("xs"))))
    return rows.where(F.col("matches") >= LEAST_MATCHES).groupBy(*TABLE).agg(F.max_by("row_idx", F.struct("matches", -F.col("row_idx"))).alias("header_row"))


def map_columns(cells: DataFrame, headers: DataFrame, specs: tuple = SPECS) -> DataFrame:
    """One metric for a column and one column for a metric; a table's candidates, a few dozen, are folded in their order."""
    named = cells.join(headers, TABLE).where("row_idx = header_row").withColumn("m", _candidates("text", specs)).where(F.size("m") > 0)
    lists = named.groupBy(*TABLE, "header_row").agg(F.flatten(F.collect_list("m")).alias("xs"))
    out = lists.select(*TABLE, "header_row", F.inline(_assigned(F.col("xs"))))
    return out.select(*TABLE, "header_row", "col_idx", "header", "spec", "metric_key", "unit", (-F.col("rank")).alias("score"))


def observations(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows below the header, unpivoted: doc_id, table_idx, row_idx, metric_key, value, raw_value, confidence, source_header, source_column.

    Rows of totals, and rows with fewer than LEAST_OBSERVATIONS values, are left out.
    """
    m = mapping.select(*TABLE, "header_row", "col_idx", "header", "metric_key", "unit", "score")
    body = cells.join(m, [*TABLE, "col_idx"]).where("row_idx > header_row").withColumn("value", parse_value("text", F.col("unit")))
    row = Window.partitionBy(*TABLE, "row_idx")
    body = body.withColumn("total", F.bool_or((F.col("unit") == "text") & is_aggregate_label("text")).over(row)).withColumn("n", F.count("value").over(row))
    body = body.where(~F.col("total") & (F.col("n") >= LEAST_OBSERVATIONS) & F.col("value").isNotNull())
    return body.select(*TABLE, "row_idx", "metric_key", "value", F.col("text").alias("raw_value"), confidence(F.col("score")).alias("confidence"), F.col("header").alias("source_header"), F.col("col_idx").alias("source_column"))


def unmapped_cells(cells: DataFrame, headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Numbers of columns that no metric took."""
    below = cells.join(headers, TABLE).where("row_idx > header_row").join(mapping.select(*TABLE, "col_idx"), [*TABLE, "col_idx"], "left_anti")
    name = cells.join(headers, TABLE).where("row_idx = header_row").select(*TABLE, "col_idx", F.col("text").alias("header"))
    return below.withColumn("value", numeric_cell("text")).where(F.col("value").isNotNull()).join(name, [*TABLE, "col_idx"]).select(*TABLE, "row_idx", "col_idx", "header", "value")


#: Two letters in a row are needed by every pattern of a header.
_WORD = re.compile("[a-z]{2}")
#: Tables as they are read at once: what their columns stand for, and the texts of these columns by rows (ref: a row's own name, null for none).
VALUES = "doc_id string, table_idx int, mapping array<struct<col_idx:int,header:string,metric_key:string,unit:string,score:double>>, rows array<struct<row_idx:int,ref:string,texts:array<string>>>"
_MAPPED = pa.struct([("col_idx", pa.int32()), ("header", pa.string()), ("metric_key", pa.string()), ("unit", pa.string()), ("score", pa.float64())])


@lru_cache
def header_finder(specs: tuple = SPECS) -> Callable[[str], list]:
    """What a cell may stand for, as header_matches says it; a worker keeps its findings for words only."""
    known = _finder(specs)
    any_header = re.compile("|".join(f"(?:{p})" for _, _, patterns, _ in specs for p in patterns), re.ASCII)

    @lru_cache(KNOWN_HEADERS)
    def search(t: str) -> list:
        return known(t) if any_header.search(t) else []

    def find(text: str) -> list:
        t = text.lower()
        return search(re.sub(r"\s+", " ", t, flags=re.ASCII).strip(" ")) if _WORD.search(t) else []

    return find


def assigned(row: list, find: Callable) -> list[tuple]:
    """The columns of a row that get a metric: col_idx, header, metric_key, unit, score, in the order of _assigned."""
    out, columns, metrics = [], set(), set()
    for rank, c, _, key, unit in sorted((-m["score"], c, m["spec"], m["metric_key"], m["unit"]) for c, x in enumerate(row) if x for m in find(x)):
        if c not in columns and key not in metrics:
            columns.add(c)
            metrics.add(key)
            out.append((c, row[c], key, unit, -rank))
    return out


def header_place(rows: list[tuple[int, list]], find: Callable) -> int | None:
    """header_rows of one table: rows with their numbers."""
    best, most = None, LEAST_MATCHES - 1
    for r, row in rows:
        if r >= HEADER_ROWS:
            break
        if sum(1 for x in row if x and find(x)) > most and len(taken := assigned(row, find)) > most:
            best, most = r, len(taken)
    return best


class ValueBlocks:
    """Tables of a worker's documents on their way to Spark, in blocks of some BLOCK cells."""

    def __init__(self):
        self._clear()

    def _clear(self):
        self.docs, self.tables, self.mappings, self.ends, self.places, self.refs, self.widths, self.texts = [], [], [], [0], [], [], [0], []

    def add(self, doc: str, table: int, mapping: list[tuple], rows: list[tuple[int, list]], refs: list[str | None] | None = None) -> None:
        columns = [m[0] for m in mapping]
        for r, row in rows:
            n = len(row)
            self.texts += [row[c] if c < n else None for c in columns]
            self.widths.append(len(self.texts))
            self.places.append(r)
        self.refs += refs or [None] * len(rows)
        self.docs.append(doc)
        self.tables.append(table)
        self.mappings.append([dict(zip(("col_idx", "header", "metric_key", "unit", "score"), m, strict=True)) for m in mapping])
        self.ends.append(len(self.places))

    def full(self) -> bool:
        return len(self.texts) >= BLOCK

    def batch(self) -> pa.RecordBatch:
        texts = pa.ListArray.from_arrays(pa.array(self.widths, pa.int32()), pa.array(self.texts, pa.string()))
        rows = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.StructArray.from_arrays([pa.array(self.places, pa.int32()), pa.array(self.refs, pa.string()), texts], ["row_idx", "ref", "texts"]))
        out = pa.RecordBatch.from_arrays([pa.array(self.docs, pa.string()), pa.array(self.tables, pa.int32()), pa.array(self.mappings, pa.list_(_MAPPED)), rows], ["doc_id", "table_idx", "mapping", "rows"])
        self._clear()
        return out


def add_values(out: ValueBlocks, doc: str, tables: list[list[list]], find: Callable) -> None:
    """The tables of a document that have a header, as header_rows and map_columns find it."""
    for t, table in enumerate(tables):
        rows = [(r, row) for r, row in enumerate(table) if any(x is not None for x in row)]
        head = header_place(rows, find)
        if head is not None:
            out.add(doc, t, assigned(table[head], find), [x for x in rows if x[0] > head])


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, find = ValueBlocks(), header_finder()
    for b in batches:
        for doc, html in zip(b.column(0), b.column(1), strict=True):
            add_values(out, doc.as_py(), html_tables(html.as_py()), find)
            if out.full():
                yield out.batch()
    yield out.batch()


def html_values(pages: DataFrame, doc_id: str, html: str) -> DataFrame:
    """Tables with headers, a row each (VALUES): cells are neither written nor sent to meet their headers."""
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PAGE_BYTES))
    return pages.select(F.col(doc_id).cast("string"), F.col(html)).mapInArrow(_values, VALUES)


def observed_rows(values: DataFrame, routed: Callable[[Column], Column] = lambda seen: seen, every: bool = False) -> DataFrame:
    """Rows of tables (VALUES) with what observations() has of each: doc_id, table_idx, row_idx, ref, seen; others are left out, or with `every` have null.

    A row's cells stay together, so nothing is shuffled.
    """
    rows = values.select(*TABLE, "mapping", F.inline("rows"))
    # Parsed once and bound to a name: an alias would be worked out again by each filter.
    read = F.zip_with("mapping", "texts", lambda m, t: F.struct(m["metric_key"].alias("metric_key"), m["unit"].alias("unit"), parse_value(t, m["unit"]).alias("value"), t.alias("raw_value"), m["score"].alias("score"), m["header"].alias("source_header"), m["col_idx"].alias("source_column")))
    good = lambda xs: F.filter(xs, lambda x: x["value"].isNotNull())
    total = lambda xs: F.exists(xs, lambda x: (x["unit"] == "text") & is_aggregate_label(x["raw_value"]))
    kept = F.transform(F.array(read), lambda xs: F.when(~total(xs), good(xs)))
    enough = lambda xs: F.size(xs) >= LEAST_OBSERVATIONS
    kept = F.transform(kept, lambda xs: F.when(enough(xs), xs)) if every else F.filter(kept, enough)
    return rows.select(*TABLE, "row_idx", "ref", F.explode(kept).alias("kept")).select(*TABLE, "row_idx", "ref", routed(F.col("kept")).alias("seen"))


def unfolded(rows: DataFrame) -> DataFrame:
    """observed_rows as observations() gives them, a value each."""
    out = rows.select(*TABLE, "row_idx", F.inline("seen"))
    return out.select(*TABLE, "row_idx", "metric_key", "value", "raw_value", confidence(F.col("score")).alias("confidence"), "source_header", "source_column")
