"""Tables read at once give what cells, headers and mappings give: the fast reader, the columns, the values of rows."""

import random
import re._constants as kinds
import re._parser as parser

import pytest

from tessera.functions.parsing import parse_value
from tessera.operators import extract as op
from tessera.operators.sheets import document_cells, document_values
from tessera.plans import sheets, styles
from tessera.sources.bridge import Corpus

SF = "/root/testdata/sf0.001"
PIECES = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<TD>", "<th>x</th>", "<td>1</td>", "<td> a &amp; b\n</td>", '<td colspan="3">', '<td class="q" COLSPAN="2">w', "<td colspan=2>", "<br>", "<br/>", "<td/>", "<p>", "<b>t</b>", " y ", "&nbsp;", "<!-- <td>c</td> -->", "a < b", "<script>if (a<b) '<td>'</script>", '<a href="x>y">', "<table><tr><td>1</td><td>2</td></tr>"]
HEAD = ["Loan ID", "Property Name", "Cut-off Date Balance ($)", "Balance", "UW NOI ($)", "Occupancy (%)", "Year  Built", "Underwritten NOI", "DSCR"]
WORDS = ["1", "One & Co", "$1,000", "(20)", "(5%)", "95.5%", "0.95", "1.5x", "2 X", "x", "N/A", "--", "Various", "1 234", "1999", "1699.5", "Total", "Grand Total", "average", "-0", "1e3", "1.2.3", "", "(x)", "$", "0.000001"]


def test_fast_reader_finds_the_same_tables():
    rng, fast = random.Random(4), 0
    for _ in range(6000):
        html = "".join(rng.choices(PIECES, k=rng.randrange(1, 25)))
        slow = op._Tables()
        slow.feed(html)
        quick = op._tokenised(html)
        fast += quick is not None
        assert quick is None or quick == slow.tables, html
        assert op.html_tables(html) == [t for t in slow.tables if max(map(len, t), default=0) > 1]
    assert fast > 1000


def _needs_word(tree) -> bool:
    """Whether what matches has two letters in a row: a literal pair in the sequence, or an element that needs one."""
    before = False
    for kind, at in tree:
        letter = kind is kinds.LITERAL and chr(at).isalpha()
        if before and letter or kind is kinds.SUBPATTERN and _needs_word(at[3]) or kind is kinds.BRANCH and all(map(_needs_word, at[1])) or kind is kinds.MAX_REPEAT and at[0] > 0 and _needs_word(at[2]):
            return True
        before = letter
    return False


def test_every_header_has_two_letters_in_a_row():
    assert [p for m in op.METRICS for p in m.patterns if not _needs_word(parser.parse(p))] == []


def test_values_are_the_observations(spark):
    rng, pages = random.Random(5), []
    for d in range(12):
        tables = []
        for _ in range(2):
            head = rng.sample(HEAD, 7)
            rows = [["An annex"], [""], head, *[[rng.choice(WORDS) for _ in range(rng.randrange(1, 8))] for _ in range(12)]]
            tables.append("<table>" + "".join("<tr>" + "".join(f"<td>{x.replace('&', '&amp;')}</td>" for x in r) + "</tr>" for r in rows) + "</table>")
        pages.append((f"d{d}", "<p>".join(tables)))
    pages = spark.createDataFrame([*pages, ("none", None)], "d string, h string")
    cells = op.html_cells(pages, "d", "h").cache()
    headers = op.header_rows(cells).cache()
    want = sorted(map(tuple, op.observations(cells, op.map_columns(cells, headers).cache()).collect()))
    assert sorted(map(tuple, op.unfolded(op.observed_rows(op.html_values(pages, "d", "h"))).collect())) == want and len(want) > 200


def test_numbers_are_printed_as_before(spark):
    df = spark.createDataFrame([(x, u) for x in WORDS for u in ("currency", "percent", "ratio", "count", "years", "text")], "x string, u string")
    got = {(r.x, r.u): r.v for r in df.withColumn("v", parse_value("x", df.u)).collect()}
    assert [got[x, "currency"] for x in ("$1,000", "(20)", "(5%)", "1.5x", "2 X", "1 234", "-0", "1e3", "1.2.3", "$", "0.000001", "x")] == ["1000", "-20", "-5", "1.5", "2", None, "0", "1000", None, None, "0.000001", None]
    assert [got["1699.5", u] for u in ("years", "count", "ratio")] == ["1700", "1700", "1699.5"] and got["(5%)", "percent"] == "-0.05"


def test_styles_shuffle_no_cells(spark):
    """One dealing of loans to their documents; before, cells were written and met their headers by key."""
    text = styles._observations(Corpus(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "MapInArrow" in text and text.index("Exchange") > text.index("MapInArrow")


def test_values_of_files_are_those_of_their_cells(spark):
    rows = [["Annex", None, None, None, None], ["Loan ID", "Property Name", "UW NOI ($)", "Occupancy (%)", " City "], *[[str(i), f"N & {i}", f"{i}00.5", "0.95" if i % 3 else None, " x " if i % 2 else "  "] for i in range(1, 9)]]
    files = [("a.xlsx", sheets.workbook(rows)), ("b.HTML", b"<table><tr><td>Loan ID</td><td>State</td><td>City</td><td>DSCR</td></tr><tr><td>1</td><td>NY</td><td>\xc3\xa9</td><td>1.2x</td></tr></table>"), ("c.htm", None), ("d.xlsm", None)]
    files = spark.createDataFrame(files, "path string, content binary")
    cells = document_cells(files).cache()
    want = sorted(map(repr, op.observations(cells, op.map_columns(cells, op.header_rows(cells).cache()).cache()).collect()))
    assert sorted(map(repr, op.unfolded(op.observed_rows(document_values(files))).collect())) == want and len(want) > 30
    for name, content, words in (("c.xls", b"x", "no reader for"), ("c.xlsx", b"not a zip", "is no workbook")):
        with pytest.raises(Exception, match=words):
            document_values(spark.createDataFrame([(name, content)], "path string, content binary")).collect()


def test_files_shuffle_no_cells(spark, monkeypatch):
    """One dealing of loans to their files; before, cells were dealt by file and met their mapping by key."""
    plans_ = []
    monkeypatch.setattr(sheets, "staged", lambda df, name: plans_.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    sheets.sheet_observations(Corpus(spark, SF))
    assert len(plans_) == 1 and plans_[0].count("REPARTITION_BY_NUM") <= 2 and "REPARTITION_BY_COL" not in plans_[0]
