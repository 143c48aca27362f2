"""The phases of operators/annex.py on one document at a time, where a task reads it.

A document is read whole in any case, so its tables are put together where they are: no cell is written between phases or
shuffled to meet its header. What follows (values, checks, counts) are Spark columns on whole rows. The phases on DataFrames
say what each step is, and a test holds the two against each other.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import staged
from .annex import AREA_MEASURES, FRACTION, GROWTH, LEAF, MOST_ID, NUMERIC, OVERLAP, PHANTOM, SCAN, _adopt
from .extract import BLOCK, CELL, PAGE_BYTES, VALUES, ValueBlocks, assigned, header_finder, header_place, html_tables, observed_rows, unfolded

#: What a text must look like to be cast to a double.
_DOUBLE = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[dDfF]?")
_NO_NUMBER = {"inf": math.inf, "+inf": math.inf, "infinity": math.inf, "+infinity": math.inf, "-inf": -math.inf, "-infinity": -math.inf, "nan": math.nan}
_SIGNS, _LETTER, _DIGIT, _PROPERTY = re.compile(r"[$,%()\s]", re.ASCII), re.compile("[a-zA-Z]"), re.compile("[0-9]"), re.compile(r"[0-9]+\.[0-9]+")
Rows = list[tuple[int, list]]


def number(text: str | None) -> float | None:
    """try_cast(text as double)."""
    if text is None:
        return None
    if _DOUBLE.fullmatch(t := text.strip()):
        return float(t.rstrip("dDfF"))
    return _NO_NUMBER.get(t.lower())


def _cell(row: list, c: int | None) -> str | None:
    return row[c] if c is not None and c < len(row) else None


def _column(mapping: list[tuple], key: str) -> int | None:
    return next((m[0] for m in mapping if m[2] == key), None)


def _merged(rows: Rows, find: Callable) -> Rows:
    """merge_headers of one table."""
    top = {}
    for r, row in rows:
        if r > SCAN:
            break
        filled = [x for x in row if x is not None]
        top[r] = len(filled), sum(number(_SIGNS.sub("", x)) is not None for x in filled) / len(filled)
    leads = [r for r in top if r < SCAN and r + 1 in top and top[r + 1][0] > GROWTH * top[r][0] and max(top[r][1], top[r + 1][1]) <= NUMERIC]
    if not leads:
        return rows
    until = max(leads) + 1
    head = [(r, row) for r, row in rows if r <= until]
    merged = []
    for c in range(max(len(row) for _, row in head)):
        leaf = next((_cell(row, c) for r, row in head if r == until), None)
        texts = dict.fromkeys(x for _, row in head if (x := _cell(row, c)) is not None)
        merged.append(leaf if leaf is not None and any(m["score"] >= LEAF for m in find(leaf)) else " ".join(texts) or None)
    return [(until, merged), *[x for x in rows if x[0] > until]]


def _attached(tables: dict[int, Rows], find: Callable) -> dict[int, Rows]:
    """attach_continuations: rows by the table that they belong to."""
    known, summaries, column = {}, [], None
    for t, rows in tables.items():
        head = header_place(rows, find)
        mapping = [] if head is None else assigned(next(row for r, row in rows if r == head), find)
        known[t] = [x for x in rows if head is None or x[0] > head]
        loan_col = _column(mapping, "loan_id")
        # A table is asked for the numbers of its own loan column, or of that of the table that it may continue.
        column = column if head is None else loan_col
        ids = [n for _, row in known[t] if (n := number(_cell(row, column))) is not None and 0 < n < MOST_ID]
        widths: dict[int, list] = {}
        for r, row in known[t]:
            found = widths.setdefault(sum(x is not None for x in row), [0, -r])
            found[0] += 1
        width = max(((n, first, w) for w, (n, first) in widths.items()), default=(0, 0, 0))[2]
        summaries.append({"doc_id": "", "table_idx": t, "header": head is not None, "loan_col": loan_col, "width": width, "ids": [{"col_idx": column, "lo": min(ids), "hi": max(ids)}] if ids else []})
    out: dict[int, Rows] = defaultdict(list)
    offset: Counter = Counter()
    for _, t, owner in _adopt(pd.DataFrame(summaries)).itertuples(index=False) if summaries else ():
        out[owner] += [(r + offset[owner], row) for r, row in tables[t]]
        offset[owner] += tables[t][-1][0] + 1
    return out


def _stacked(tables: dict[int, Rows], find: Callable) -> list[tuple[int, int, Rows]]:
    """stack_pages: table, header row and rows of what is left."""
    out: dict[str, tuple[int, int, Rows]] = {}
    offset: Counter = Counter()
    for t, rows in sorted(tables.items()):
        head = header_place(rows, find)
        if head is None:
            continue
        signature = "|".join(x.lower() for x in next(row for r, row in rows if r == head) if x is not None)
        _, _, page = out.setdefault(signature, (t, head, []))
        page += [(r + offset[signature], row) for r, row in rows if not page or r > head]
        offset[signature] += rows[-1][0] + 1
    return list(out.values())


def _kinds(head: int, rows: Rows, mapping: list[tuple]) -> dict[int, str]:
    """split_rows of one table: the kinds of the rows below the header."""
    name, amount, ident, flag = (_column(mapping, k) for k in ("property_name", "loan_amount", "loan_id", "loan_property_flag"))
    body = [x for x in rows if x[0] > head]
    named = lambda row: _cell(row, name) is not None or _DIGIT.search(_cell(row, amount) or "")
    real = [bool(named(row)) and any(x is not None and _LETTER.search(x) for x in row) for _, row in body]
    few = (name is not None or amount is not None) and bool(body) and real.count(False) / len(body) <= PHANTOM

    def kind(row: list) -> str:
        if flag is not None:
            word = (_cell(row, flag) or "").lower()
            return word if word in ("loan", "property") else "unknown"
        n = number(_cell(row, ident))
        if n is None:
            return "unknown"
        return "loan" if math.isfinite(n) and abs(n - math.floor(n + 0.5)) <= FRACTION else "property"

    return {r: "phantom" if few and not ok else kind(row) for (r, row), ok in zip(body, real, strict=True)}


def _key(text: str | None) -> float | str | None:
    """loan_key: what makes two loan numbers the same."""
    n = number(text)
    return n if n is not None and n == n else "NaN" if n is not None else text and text.lower()


def _joined(tables: list[tuple[int, int, Rows, list[tuple]]]) -> tuple[list, Rows] | None:
    """join_tables: the header and the rows of a document's one table; rows keep their numbers."""
    scored = [(t, head, rows, mapping, _column(mapping, "loan_id")) for t, head, rows, mapping in tables if mapping and rows[-1][0] > head]
    several = sum(x[4] is not None for x in scored) >= 2
    scored.sort(key=lambda x: (-(several and x[4] is not None), -len(x[3]), x[0]))
    scored = [x for i, x in enumerate(scored) if i == 0 or several and x[4] is not None]
    if not scored:
        return None
    body = [[y for y in rows if y[0] > head] for _, head, rows, _, _ in scored]
    base = {k: r for r, row in body[0] if scored[0][4] is not None and (k := _key(_cell(row, scored[0][4]))) is not None}
    header, taken, columns, last = [], set(), [], []
    for i, (_, head, rows, _, loan_col) in enumerate(scored):
        met = [(base[k], row) for _, row in body[i] if i and (k := _key(_cell(row, loan_col))) in base]
        if i and (not met or len(met) < OVERLAP * min(len(body[i]), len(body[0]))):
            continue
        top = [(c, x, x.lower()) for c, x in enumerate(next((row for r, row in rows if r == head), [])) if x is not None]
        mine = [(c, x) for c, x, low in top if low not in taken]
        taken |= {low for _, _, low in top}
        columns.append([(c, len(header) + j) for j, (c, _) in enumerate(mine)])
        header += [x for _, x in mine]
        # Of several rows of one loan the last one counts.
        last.append(dict(met))
    out = []
    for r, row in body[0]:
        whole = [None] * len(header)
        for i, places in enumerate(columns):
            source = row if i == 0 else last[i].get(r)
            for c, new in places if source is not None else ():
                whole[new] = _cell(source, c)
        if any(x is not None for x in whole):
            out.append((r, whole))
    return header, out


class Document:
    """The phases of one document, each when it is asked for."""

    def __init__(self, html: str | None, find: Callable):
        self.find = find
        tables = {t: [(r, row) for r, row in enumerate(table) if any(x is not None for x in row)] for t, table in enumerate(html_tables(html))}
        attached = _attached({t: _merged(rows, find) for t, rows in tables.items() if rows}, find)
        self.tables = [(t, head, rows, assigned(next(row for r, row in rows if r == head), find)) for t, head, rows in _stacked(attached, find)]
        self.kinds = [_kinds(head, rows, mapping) for _, head, rows, mapping in self.tables]

    @cached_property
    def joined(self) -> tuple[list, Rows] | None:
        """Without properties and phantoms."""
        return _joined([(t, head, [x for x in rows if x[0] <= head or kinds[x[0]] in ("loan", "unknown")], mapping) for (t, head, rows, mapping), kinds in zip(self.tables, self.kinds, strict=True)])

    def add_kinds(self, doc: str, out: list) -> None:
        out += [(doc, t, r, kind) for (t, *_), kinds in zip(self.tables, self.kinds, strict=True) for r, kind in kinds.items()]

    def add_joined(self, doc: str, out: list) -> None:
        if self.joined:
            header, rows = self.joined
            out += [(doc, 0, r, c, x) for r, row in [(0, header), *[(r + 1, row) for r, row in rows]] for c, x in enumerate(row) if x is not None]

    def add_columns(self, doc: str, out: list) -> None:
        """The joined table's header with what its columns stand for."""
        if self.joined:
            metric = {m[0]: m[2] for m in assigned(self.joined[0], self.find)}
            out += [(doc, 0, 0, c, x, metric.get(c)) for c, x in enumerate(self.joined[0])]

    def add_values(self, doc: str, out: ValueBlocks) -> None:
        mapping = assigned(self.joined[0], self.find) if self.joined else []
        if mapping:
            out.add(doc, 0, mapping, [(r + 1, row) for r, row in self.joined[1]])

    def add_properties(self, doc: str, out: ValueBlocks) -> None:
        """Rows of properties, with their numbers from the column that has such numbers in more than half of them."""
        for (t, _, rows, mapping), kinds in zip(self.tables, self.kinds, strict=True):
            own = [(r, row) for r, row in rows if kinds.get(r) == "property"]
            looks = Counter(c for _, row in own for c, x in enumerate(row) if x is not None and _PROPERTY.fullmatch(x))
            most = max(((n, -c) for c, n in looks.items() if n > len(own) / 2), default=None)
            if own:
                out.add(doc, t, mapping, own, [None if most is None or not (x := _cell(row, -most[1])) else x for _, row in own])


def _read(pages: DataFrame, what: str, schema: str) -> DataFrame:
    """Rows that Document.add_<what> gives for each page (doc_id, html); a document's tables and a block's rows are held."""
    fields = None if schema == VALUES else pages.sparkSession.createDataFrame([], schema).columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = header_finder(), ValueBlocks() if fields is None else []
        types = {"table_idx": pa.int32(), "row_idx": pa.int32(), "col_idx": pa.int32()}

        def batch() -> pa.RecordBatch:
            if fields is None:
                return held.batch()
            columns = list(zip(*held, strict=True)) or [()] * len(fields)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, types.get(f, pa.string())) for f, x in zip(fields, columns, strict=True)], fields)

        for b in batches:
            for doc, html in zip(b.column(0), b.column(1), strict=True):
                getattr(Document(html.as_py(), find), f"add_{what}")(doc.as_py(), held)
                if held.full() if fields is None else len(held) >= BLOCK:
                    yield batch()
        yield batch()

    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PAGE_BYTES))
    return pages.select(F.col("doc_id").cast("string"), "html").mapInArrow(read, schema)


def routed_units(seen: Column) -> Column:
    """route_units of a row's observations."""
    is_ = lambda x, k: x["metric_key"] == k
    area = F.exists(seen, lambda x: is_(x, "unit_of_measure") & F.trim(x["value"]).rlike(AREA_MEASURES))
    own = F.exists(seen, lambda x: is_(x, "square_feet"))
    kept = F.filter(seen, lambda x: ~(is_(x, "units") & area & own))
    return F.transform(kept, lambda x: F.when(is_(x, "units") & area, x.withField("metric_key", F.lit("square_feet"))).otherwise(x))


def value_of(seen: Column | str, key: str) -> Column:
    """A row's value of a metric, null for none."""
    return F.get(F.filter(seen, lambda x: x["metric_key"] == key), F.lit(0))["value"]


class PageHarvest:
    """What Harvest gives, from pages (doc_id, html); each result is one reading of them, with nothing shuffled."""

    def __init__(self, pages: DataFrame):
        self.pages = pages

    @property
    def kinds(self) -> DataFrame:
        return _read(self.pages, "kinds", "doc_id string, table_idx int, row_idx int, kind string")

    @property
    def joined(self) -> DataFrame:
        return _read(self.pages, "joined", CELL)

    @cached_property
    def columns(self) -> DataFrame:
        """The cells of the joined tables' headers, and metric_key; a few dozen for a document, written once."""
        return staged(_read(self.pages, "columns", f"{CELL}, metric_key string"), "annex-columns")

    @property
    def headers(self) -> DataFrame:
        return self.columns.select("doc_id", "table_idx", F.col("row_idx").alias("header_row")).distinct()

    @property
    def mapping(self) -> DataFrame:
        return self.columns.where("metric_key is not null")

    @property
    def rows(self) -> DataFrame:
        """The joined tables' rows with what is observed in each: doc_id, table_idx, row_idx, seen."""
        return observed_rows(_read(self.pages, "values", VALUES), routed_units).drop("ref")

    @property
    def observations(self) -> DataFrame:
        return unfolded(self.rows)

    @property
    def properties(self) -> DataFrame:
        rows = observed_rows(_read(self.pages, "properties", VALUES), routed_units, every=True)
        whole = F.col("ref").try_cast("double")
        keys = ("property_name", "address", "city", "state", "zip", "property_type")
        return rows.select("doc_id", "table_idx", "row_idx", F.col("ref").alias("property_ref"), *[value_of("seen", k).alias(k) for k in keys], F.when(whole.isNotNull(), F.floor(whole).cast("string")).alias("loan_ref"))
