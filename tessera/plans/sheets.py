"""Annexes as files, every other one a workbook, read back by their extensions."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extract
from ..operators.documents import value_of
from ..operators.sheets import document_values
from ..sources.bridge import Corpus
from ..sources.stage import staged
from .registry import query
from .reports import _table, _tr

HEAD = ("Loan ID", "Property Name", "Cut-off Date Balance ($)", "Cut-off Date LTV (%)", "Interest Rate (%)")
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def _cell(row: int, column: int, value: str | None) -> str:
    at = f"{chr(65 + column)}{row}"
    if value is None:
        return ""
    if row == 1:
        return f'<c r="{at}" t="s"><v>{column}</v></c>'
    try:
        float(value)
        return f'<c r="{at}"><v>{value}</v></c>'
    except ValueError:
        return f'<c r="{at}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'


def workbook(rows: list[list[str | None]]) -> bytes:
    """A workbook of an empty sheet, a sheet of rows whose first one is the header, and nothing else."""
    body = "".join(f'<row r="{r}">{"".join(_cell(r, c, x) for c, x in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
    strings = "".join(f"<si><r><t>{escape(x or '')[:4]}</t></r><r><t>{escape(x or '')[4:]}</t></r></si>" for x in rows[0])
    links = "".join(f'<Relationship Id="rId{i}" Type="sheet" Target="worksheets/sheet{i}.xml"/>' for i in (1, 2))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {_MAIN}><sheets><sheet name="Empty" sheetId="1" r:id="rId2"/><sheet name="Loans" sheetId="2" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", _RELS.format(links))
        z.writestr("xl/sharedStrings.xml", f"<sst {_MAIN}>{strings}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_MAIN}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {_MAIN}><sheetData/></worksheet>")
    return out.getvalue()


def _books(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"path": b["path"], "content": [workbook([list(HEAD), *[list(r) for r in rows]]) for rows in b["rows"]]})


def printed_files(c: Corpus) -> DataFrame:
    """path, content: each document's loans as a workbook, or as HTML."""
    share = lambda x: (F.floor(F.col(x) * 10000 + 0.5) / 10000).cast("decimal(10,4)").cast("string")
    cells = [F.col("pos").cast("string"), F.concat(F.lit("N & "), F.col("pos").cast("string")), F.col("amount").cast("string"), share("ltv"), share("rate")]
    loans = c.by_document("annex_loans").select("doc_id", "nat", F.struct("pos", F.array(*cells).alias("cells")).alias("x"))
    docs = loans.groupBy("doc_id", "nat").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["cells"]).alias("rows"))
    books = docs.where(F.col("nat") % 2 == 0).select(F.concat("doc_id", F.lit(".XLSX")).alias("path"), "rows").mapInPandas(_books, "path string, content binary")
    body = F.array_join(F.transform("rows", lambda r: _tr(*[F.replace(F.get(r, F.lit(i)), F.lit("&"), F.lit("&amp;")) for i in range(len(HEAD))])), "")
    pages = docs.where(F.col("nat") % 2 == 1).select(F.concat("doc_id", F.lit(".html")).alias("path"), F.encode(_table(_tr(*HEAD), body), "UTF-8").alias("content"))
    return books.unionByName(pages)


@query("""with p as (select concat(doc_id, case when nat % 2 = 0 then '.XLSX' else '.html' end) as doc_id, pos, amount, floor(ltv * 10000 + 0.5) / 10000.0e0 as ltv, floor(rate * 10000 + 0.5) / 10000.0e0 as rate from annex_loans)
    select doc_id, pos as row_idx, 'loan_amount' as metric_key, amount * 1.0e0 as value, 'N & ' || pos as name from p
    union all select doc_id, pos, 'ltv', ltv, 'N & ' || pos from p where ltv is not null union all select doc_id, pos, 'interest_rate', rate, 'N & ' || pos from p where rate is not null""")
def sheet_observations(c: Corpus) -> DataFrame:
    """The numbers of workbooks and pages alike, with the names of their rows."""
    # Files are read once; what follows reads their tables, each with its mapping.
    seen = extract.observed_rows(staged(document_values(printed_files(c)), "file-mapping"))
    named = F.filter("seen", lambda x: F.col("name").isNotNull() & x["metric_key"].isin("loan_amount", "ltv", "interest_rate"))
    numbers = seen.withColumn("name", value_of("seen", "property_name")).select("doc_id", "row_idx", "name", F.inline(named))
    return numbers.select("doc_id", "row_idx", "metric_key", F.col("value").cast("double").alias("value"), "name")
