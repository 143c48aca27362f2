"""Servicer reports of both template families, tranches that agree and that don't, parties, and the choice of reports."""

import datetime as dt

import pytest

from tessera.operators import picking, runs, servicer
from tessera.operators.extract import CELL

FIRST = [
    ["Mortgage Loan Detail (Part 2)"],
    [None],
    ["", "", "Most Recent", "Most Recent", "NOI", "NOI", "Appraisal", "Most Recent"],
    ["", "City", "Fiscal", "", "Start", "End", "Reduction", "Appraisal"],
    ["Pros ID", "", "NOI", "NOI", "Date", "Date", "ASER", "Date"],
    ["1A-1", "x", "1,000.00", "1,200.00", "01/01/25", "12/31/25", "--", "--"],
    ["1A-4", "x", "1,000.00", "1,200.00", "01/01/25", "11/30/25", "--", "--"],
    ["2", "x", "--", "100.00", "01/01/26", "03/31/26", "--", "--"],
    ["3", "x", "--", "0.00", "--", "--", "--", "--"],
    ["4", "x", "--", "(50.00)", "01/01/26", "02/28/26", "--", "--"],
    ["5A", "x", "--", "500.00", "01/01/25", "12/31/25", "--", "--"],
    ["5B", "x", "--", "700.00", "01/01/25", "12/31/25", "--", "--"],
    ["6", "x", "--", "10.00", "02/31/25", "12/31/25", "--", "--"],
    ["Totals", "", "2,000.00", "3,000.00"],
    ["Note", "prose", "", "9.00", "01/01/25", "12/31/25"],
    ["Page 3 of 27", "", "", "Computershare"],
]
SECOND = [
    ["NOI Detail"],
    ["Loan ID", "OMCR", "Property", "Preceding Fiscal Year NOI", "Most Recent NOI", "Most Recent Financial As of Start Date", "Most Recent Financial Asof End Date"],
    ["328061001", "1", "Office", "Not Available", "2,000", "01/01/2025", "12/31/2025"],
    ["328061002", "2", "Retail", "1", "Not Available", "Not Available", "Not Available"],
]
LATE = [
    ["", "", "Paid", "", "Mortgage", "Servicing", "", ""],
    ["", "", "Through", "Months", "Loan", "Transfer", "Foreclosure", ""],
    ["Pros ID", "Loan ID", "Date", "Delinquent", "Status1", "Date", "Date", "REO Date"],
    ["7-A", "30", "01/01/26", "3", "2", "02/02/26", "--", "--"],
    ["1 Mortgage Loan Status", "", "A", "B"],
]
SPECIAL = [
    ["Pros ID", "Loan ID", "Property Type", "State", "Servicing Transfer Date", "Resolution Strategy Code", "Special Servicing Comments"],
    ["7", "30", "OF", "NY", "02/02/26", "8", "late"],
    ["71", "31", "MF", "IL", "12/02/25", "13", "pays"],
    ["72", "32", "MF", "IL", "--", "13", "no date"],
]
NEITHER = [["Class", "CUSIP", "Balance"], ["A-1", "123", "4.00"], ["Pros ID", "Balance", "Rate"], ["1", "2", "3"]]


def grid(doc, table, rows):
    return [(doc, table, r, c, x) for r, row in enumerate(rows) for c, x in enumerate(row) if x is not None]


@pytest.fixture(scope="module")
def read(spark):
    cells = grid("one", 0, FIRST) + grid("one", 1, LATE) + grid("one", 2, SPECIAL) + grid("one", 3, NEITHER) + grid("two", 0, SECOND) + grid("none", 0, NEITHER)
    rows = servicer.table_rows(spark.createDataFrame(cells, CELL)).persist()
    return rows, servicer.locate(rows).persist()


def test_tables_are_located_by_family(read):
    got = {(r.doc_id, r.table_idx, r.kind, r.family, r.header_row): dict(r.columns) for r in read[1].collect()}
    assert got == {
        ("one", 0, "noi", "computershare", 4): {"anchor": 0, "fiscal": 2, "recent": 3, "start": 4, "end": 5},
        ("one", 1, "delinquency", None, 2): {"anchor": 0, "paid_through": 2, "months": 3, "status": 4, "transfer": 5, "foreclosure": 6, "reo": 7},
        ("one", 2, "special", None, 0): {"anchor": 0, "transfer": 4, "resolution": 5, "type": 2, "state": 3},
        ("two", 0, "noi", "citigroup", 1): {"anchor": 1, "fiscal": 3, "recent": 4, "start": 5, "end": 6},
    }


def test_headers_are_described_even_where_no_layout_fits(read):
    got = {(r.doc_id, r.table_idx): (r.family, r.header_row, r.headers) for r in servicer.describe_headers(read[0]).collect()}
    assert set(got) == {("one", 0), ("one", 1), ("one", 2), ("one", 3), ("two", 0), ("none", 0)}
    assert got["one", 0] == ("computershare", 4, ["Pros ID", "City", "Most Recent Fiscal NOI", "Most Recent NOI", "NOI Start Date", "NOI End Date", "Appraisal Reduction ASER", "Most Recent Appraisal Date"])
    assert got["none", 0] == ("computershare", 2, ["Class A-1 Pros ID", "CUSIP 123 Balance", "Balance 4.00 Rate"])


def test_lines_and_tranches(read):
    lines = servicer.noi_lines(*read).where("doc_id = 'one'").persist()
    got = {r.pros_id: (r.loan_ref, r.outcome, r.period_days, r.annualized_noi) for r in lines.collect()}
    assert got == {
        "1A-1": ("1", "used", 365, 1200.0), "1A-4": ("1", "used", 334, 1200.0), "2": ("2", "used", 90, 100 * 365 / 90), "3": ("3", "no dates", None, None), "4": ("4", "short period", 59, None),
        "5A": ("5", "used", 365, 500.0), "5B": ("5", "used", 365, 700.0), "6": ("6", "no dates", None, None), "Note": (None, "no id", 365, None),
    }
    loans, conflicts = servicer.collapse_tranches(lines)
    assert {(r.loan_ref, r.period_days, r.is_full_year, r.tranches, r.noi_end) for r in loans.collect()} == {("1", 365, True, 2, dt.date(2025, 12, 31)), ("2", 90, False, 1, dt.date(2026, 3, 31))}
    assert [(r.loan_ref, r["values"]) for r in conflicts.collect()] == [("5", [500, 700])]


def test_events_and_diagnostics(read):
    late = servicer.delinquency_lines(*read).collect()
    assert [(r.pros_id, r.loan_ref, r.dropped, r.months_delinquent, r.paid_through, r.transfer_date) for r in late if not r.dropped] == [("7-A", "7", False, 3.0, dt.date(2026, 1, 1), dt.date(2026, 2, 2))]
    assert [(r.loan_ref, r.dropped, r.state, r.resolution_code) for r in sorted(servicer.special_lines(*read).collect(), key=lambda r: r.row_idx)] == [("7", False, "NY", "8"), ("71", False, "IL", "13"), ("72", True, "IL", "13")]
    got = {r.doc_id: r.asDict() for r in servicer.diagnostics(*read).collect()}
    one = got["one"]
    assert (one["tables_scanned"], one["tables_matched"], one["families"], one["rows_found"], one["dropped_no_dates"], one["dropped_short_period"], one["dropped_no_id"]) == (4, 1, ["computershare"], 8, 2, 1, 1)
    assert (one["loans"], one["full_year"], one["tranche_conflicts"], one["delinquency_tables"], one["delinquency_data_rows"], one["delinquency_dropped"], one["dropped_samples"]) == (2, 1, 1, 1, 2, 1, ["1 Mortgage Loan Status"])
    assert (one["special_tables"], one["special_data_rows"], one["special_only"], one["full_year_share"], one["issues"]) == (1, 3, 1, 0.5, ["tranches disagree"])
    assert got["none"]["issues"] == ["no table of incomes"] and got["two"]["issues"] == [] and got["two"]["loans"] == 1


def test_parties(spark):
    cover = [
        ["Trustee Fee", "290.00 Trust Company"], ["Master Servicer", "Return Date"], ["nothing", ""], ["Special Servicer", "a@b.com", "LNR Partners"], ["Trustee:", "", "Wilmington  Trust Company, "],
        ["Master Servicer", "Special Servicer"], ["KeyBank National Association", "Rialto Capital"], ["Certificate Administrator – Wells  Fargo Bank"],
    ]
    got = servicer.parties(servicer.table_rows(spark.createDataFrame(grid("d", 0, cover) + grid("d", 1, [["Trustee", "Later Bank"]]), CELL))).collect()
    assert {(r.role, r.name) for r in got} == {("trustee", "Wilmington Trust Company"), ("master servicer", "KeyBank N.A."), ("special servicer", "Rialto Capital Advisors, LLC"), ("certificate administrator", "Wells Fargo Bank, N.A.")}
    assert [r.raw for r in got if r.role == "trustee"] == ["Trustee: | Wilmington Trust Company,"]


def test_first_corpus_loan_of_a_number_and_best_report(spark):
    lines = spark.createDataFrame([("a", "01"), ("a", "2"), ("b", "1")], "accession string, loan_ref string")
    loans = spark.createDataFrame([("a", 10, "1.0", 2), ("a", 11, "1A", 1), ("a", 12, None, 3)], "accession string, loan_id long, loan_ref string, row_index int")
    assert {(r.accession, r.loan_ref, r.loan_id) for r in servicer.match_loans(lines, loans).collect()} == {("a", "1", 11), ("a", "2", None), ("b", "1", None)}
    trials = [("good at once", 1, "r1", 10, 5), ("good at once", 2, "r2", 10, 10), ("later", 1, "r1", 10, 4), ("later", 2, "r2", 10, 4), ("later", 3, "r3", 100, 6), ("none", 1, "r1", 0, 0)]
    got = servicer.best_report(spark.createDataFrame(trials, "accession string, place int, report string, rows_found int, usable int")).collect()
    assert {(r.accession, r.report, r.usable, r.attempts) for r in got} == {("good at once", "r1", 5, 1), ("later", "r3", 6, 3), ("none", "r1", 0, 1)}


#: form, name, description, size, whether it is an annex.
NAMED = [
    ("FWP", "k10_x5-annexa1.htm", "ANNEX A-1", 4_000_000, True), ("FWP", "k10_x3-annex_a.htm", "FWP", 4_400_000, True), ("FWP", "k10_x6-ts.htm", "PRELIMINARY TERM SHEET", 7_900_000, False),
    ("FWP", "k10_x10-ipt.htm", "FWP", 18_000, False), ("FWP", "k10_x19-xalaunch.htm", "FWP", 26_000, False), ("10-D", "k10_10d-annexa.htm", "", 1_700_000, False), ("FWP", "k20_x2-a1.htm", "FWP", 3_700_000, True),
    ("FWP", "k20_x15-xapricing.htm", "FWP", 16_000, False), ("424H", "k20_x5-424h.htm", "424H", 18_000_000, False), ("FWP", "k30-x4_anxa.htm", "FREE WRITING PROSPECTUS", 3_300_000, True), ("FWP", "k30-x6_anx1.htm", "ANNEX A-1", 2_800_000, True),
    ("FWP", "k30_x8-premktts.htm", "", 5_700_000, False), ("FWP", "k40_annexa.htm", "", 20_000, False), ("424B2", None, None, None, False),
]


def test_scores_and_picks(spark):
    rows = [("c", i, f"f{i}", *x[:4]) for i, x in enumerate(NAMED)] + [("p", 0, "p0", "424H", "a.htm", "", 9_000_000), ("p", 1, "p1", "424B5", "b.htm", "", 6_000_000), ("p", 2, "p2", "424B5", "b.htm", "", 7_000_000), ("q", 0, "q0", "424B5", "b.htm", "", 1_000_000)]
    filings = spark.createDataFrame(rows, "cik string, seq int, accession string, form string, document_name string, description string, size_bytes long")
    scores = {r.accession: r.s for r in filings.where("cik = 'c'").select("accession", picking.annex_score().alias("s")).collect()}
    assert [scores[f"f{i}"] >= 0.5 for i in range(len(NAMED))] == [x[4] for x in NAMED]
    got = {(r.cik, r.place): (r.accession, r.score, r.fallback, r.alternatives) for r in picking.pick_annexes(filings).collect()}
    assert {k: v[:3] for k, v in got.items()} == {("c", 1): ("f0", 0.95, False), ("c", 2): ("f10", 0.9, False), ("c", 3): ("f1", 0.75, False), ("p", 1): ("p2", 0.4, True)}
    assert got["c", 1][3] == ["k30-x6_anx1.htm:0.90", "k10_x3-annex_a.htm:0.75", "k30-x4_anxa.htm:0.70", "k20_x2-a1.htm:0.65"] and got["p", 1][3] == ["a.htm:0.20", "b.htm:0.20"]
    assert picking.pick_annexes(filings, fallback=False).where("cik = 'p'").count() == 0


def test_exhibits_and_reports(spark):
    files = [("ab_ex991.htm", 300_000, 0.9), ("ab_ex-99_1.html", 50_000, 0.8), ("ab_ex99-2.htm", 50_000, 0.6), ("ab_10-d.htm", 900_000, 0), ("exh_99.txt", 5_000, 0.05), ("ex991.pdf", 300_000, 0), ("ex9912.htm", 20_000, 0.4)]
    df = spark.createDataFrame([(n, s, float(w)) for n, s, w in files], "document_name string, size_bytes long, want double")
    assert all(r.s == r.want for r in df.select("want", picking.exhibit_score().alias("s")).collect())
    day = lambda *x: dt.date(*x)
    filings = [("a", "1", "10-D", day(2025, 7, 20), day(2025, 7, 10)), ("a", "2", "10-D/A", day(2025, 4, 20), day(2025, 4, 10)), ("a", "3", "10-D", day(2024, 4, 20), None), ("a", "4", "10-K", day(2025, 4, 1), day(2025, 4, 1)), ("a", "5", "10-D", day(2025, 1, 12), day(2025, 1, 12)), ("a", "6", "10-D", day(2025, 1, 2), day(2025, 1, 2))]
    df = spark.createDataFrame(filings, "cik string, accession string, form string, filed_at date, period date")
    places = lambda out: [r.accession for r in sorted(out.collect(), key=lambda r: r.place)]
    assert places(picking.preferred_reports(df)) == ["2", "3", "1", "5", "6"]
    # 2025-07-10 to 2025-01-12 are 179 days, enough for six months less ten days; 2024-04-20 lies 267 days further back.
    assert places(picking.spaced_reports(df, 6)) == ["1", "5", "3"] and places(picking.spaced_reports(df, 1)) == ["1", "2", "5", "3"]
    picked = picking.pick_reports(picking.preferred_reports(df), spark.createDataFrame([("2", 1, "logo.jpg", 1), ("3", 1, "x_ex991.htm", 50_000), ("3", 2, "y_ex991.htm", 60_000), ("5", 1, "z_ex991.htm", 300_000)], "accession string, seq int, document_name string, size_bytes long"), most=2)
    assert [(r.accession, r.document_name, r.place) for r in sorted(picked.collect(), key=lambda r: r.place)] == [("3", "x_ex991.htm", 1), ("5", "z_ex991.htm", 2)]


def test_empty_runs(spark):
    rows = [("a", k) for k in (3, 3, 5, 6, 9, 12)] + [("b", 7), ("b", None), ("c", None)]
    got = {(r.g, r.start, r.length, r.longest) for r in runs.empty_runs(spark.createDataFrame(rows, "g string, k long"), ["g"], "k").collect()}
    assert got == {("a", 4, 1, False), ("a", 7, 2, True), ("a", 10, 2, False)}
