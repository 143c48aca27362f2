"""Workbooks of every kind of cell, and files told apart by their names."""

import io
import zipfile

import pytest

from tessera.operators import sheets
from tessera.plans.sheets import workbook

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(sheet, strings=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="a" r:id="x"/><sheet name="gone" r:id="y"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="r"><Relationship Id="x" Target="/xl/deep/one.xml"/><Relationship Id="y" Target="worksheets/two.xml"/></Relationships>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{strings}</sst>")
        z.writestr("xl/deep/one.xml", f"<worksheet {MAIN}><sheetData>{sheet}</sheetData></worksheet>")
    return out.getvalue()


def test_cells_of_every_kind():
    sheet = (
        '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>1.50</v></c><c r="AB2"><v>3</v></c><c r="AC2"><v>1E+3</v></c></row>'
        '<row><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><f>A1</f><v>made</v></c><c t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c><c/><c t="s"><v>9</v></c></row>'
    )
    strings = '<si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r><rPh><t>x</t></rPh></si>'
    got = list(sheets.workbook_cells(book(sheet, strings)))
    assert got == [(0, 1, 0, "one"), (0, 1, 2, "1.5"), (0, 1, 27, "3"), (0, 1, 28, "1000"), (0, 2, 0, "TRUE"), (0, 2, 2, "made"), (0, 2, 3, "inline")]
    assert list(sheets.workbook_cells(book(""))) == []


def test_empty_sheets_are_not_counted_and_large_ones_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sheets, "BLOCK", 7)
    content = workbook([["a", "b"], *[[str(i), f"x{i}"] for i in range(50)]])
    assert {c[0] for c in sheets.workbook_cells(content)} == {0}
    rows = [("d/one.xlsx", content), ("d/two.XLSM", content), ("three.htm", b"<table><tr><td>p</td><td>q</td></tr></table>"), ("none.html", None)]
    got = sheets.document_cells(spark.createDataFrame(rows, "path string, content binary"), 3).collect()
    per = {p: sorted((c.row_idx, c.col_idx, c.text) for c in got if c.doc_id == p) for p, _ in rows}
    assert per["d/one.xlsx"] == per["d/two.XLSM"] and len(per["d/one.xlsx"]) == 102 and per["d/one.xlsx"][:3] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "0")]
    assert per["three.htm"] == [(0, 0, "p"), (0, 1, "q")] and per["none.html"] == []


def test_files_are_read_and_others_refused(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["h", "i"], ["1", "2"]]))
    (tmp_path / "b.html").write_bytes("<table><tr><td>é</td><td>2</td></tr></table>".encode())
    files = sheets.read_documents(spark, f"file://{tmp_path}/*")
    assert sorted(c.text for c in sheets.document_cells(files).collect()) == ["1", "2", "2", "h", "i", "é"]
    for name, content, words in (("c.xls", b"x", "no reader for"), ("c.xlsx", b"not a zip", "is no workbook"), ("noext", b"", "no reader for")):
        with pytest.raises(Exception, match=words):
            sheets.document_cells(spark.createDataFrame([(name, content)], "path string, content binary")).collect()
