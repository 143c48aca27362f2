"""An annex of two blocks with group headers, a paged and a continued table, properties and a phantom row."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import annex, extract

GROUPS = ["", "", "", "Mortgage Loan Terms", None, None]
FIRST = ["Loan ID", "Loan / Property Flag", "Property Name", "Cut-off Date Balance ($)", "Interest Rate (%)", "Broker"]
SECOND = ["Loan ID", "Property Name", "Cut-off Date LTV (%)", "Occupancy (%)", "UW NOI ($)"]


def grid(doc, table, rows, start=0):
    return [(doc, table, start + r, c, x) for r, row in enumerate(rows) for c, x in enumerate(row) if x is not None]


def document(doc):
    one = [GROUPS, FIRST, ["1", "Loan", "One", "$1,000", "5.1%", "7"], ["2", "Loan", "Two", "$2,000", "5.2%", "8"]]
    more = [["3", "Loan", "Three", "$3,000", "5.3%", "9"], ["3.01", "Property", "Three A", "", "", ""], ["3.02", "Property", "Three B", "", "", ""]]
    page = [FIRST, ["4", "Loan", "Four", "$4,000", "5.4%", "6"], ["5", "Loan", "Five", "$5,000", "5.5%", "5"]]
    other = [SECOND, *[[f"{i}.00", f"N{i}", f"6{i}.5%", f"9{i}%", f"{i}00"] for i in range(1, 6)]]
    note = [["footnote", "text"]]
    return grid(doc, 0, one) + grid(doc, 1, more) + grid(doc, 2, note) + grid(doc, 3, page) + grid(doc, 4, other)


def settled(df):
    """The rows without their history, as after writing a table: every phase reads the one before it several times."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


@pytest.fixture(scope="module")
def built(spark):
    cells = settled(annex.merge_headers(spark.createDataFrame(document("a") + document("b"), extract.CELL)))
    headers = settled(extract.header_rows(cells))
    mapping = settled(extract.map_columns(cells, headers))
    cells = settled(annex.attach_continuations(cells, headers, mapping))
    headers = settled(extract.header_rows(cells))
    cells, headers = map(settled, annex.stack_pages(cells, headers))
    return cells, headers, settled(extract.map_columns(cells, headers))


def test_headers_continuations_and_pages(built):
    cells, headers, mapping = built
    rows = {(r.table_idx, r.row_idx) for r in cells.where("doc_id = 'a'").collect()}
    assert {t for t, _ in rows} == {0, 4}
    first = [r.text for r in cells.where("doc_id = 'a' and table_idx = 0 and col_idx = 2").orderBy("row_idx").collect()]
    assert first == ["Property Name", "One", "Two", "Three", "Three A", "Three B", "Four", "Five"]
    assert {(r.col_idx, r.metric_key) for r in mapping.where("doc_id = 'a' and table_idx = 0").collect()} >= {(0, "loan_id"), (1, "loan_property_flag"), (2, "property_name"), (3, "loan_amount"), (4, "interest_rate")}


def test_loans_properties_and_the_joined_table(spark, built):
    cells, headers, mapping = built
    kinds = settled(annex.split_rows(cells, headers, mapping))
    assert {r.kind: r.n for r in kinds.where("doc_id = 'b'").groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"loan": 10, "property": 2}
    seen = settled(extract.observations(cells, mapping))
    props = annex.properties(annex.route_units(seen), cells, kinds).where("doc_id = 'a'").orderBy("property_ref").collect()
    assert [(p.property_ref, p.loan_ref) for p in props] == [("3.01", "3"), ("3.02", "3")]
    loans = settled(annex.loan_cells(cells, headers, kinds))
    joined, top = map(settled, annex.join_tables(loans, headers, mapping))
    got = settled(extract.observations(joined, settled(extract.map_columns(joined, top))).where("doc_id = 'a'"))
    want = {}
    for i in range(1, 6):
        want |= {(str(i), "loan_amount"): f"{i}000", (str(i), "interest_rate"): f"0.05{i}", (str(i), "ltv"): f"0.6{i}5", (str(i), "occupancy"): f"0.9{i}", (str(i), "noi_underwritten"): f"{i}00"}
    ids = {r.row_idx: r.value for r in got.where("metric_key = 'loan_id'").collect()}
    assert {(ids[r.row_idx], r.metric_key): r.value for r in got.collect() if (ids[r.row_idx], r.metric_key) in want} == want
    with_ids = annex.with_loan(annex.properties(seen, cells, kinds), spark.createDataFrame([("a", 30, "3"), ("a", 31, "3.0")], "doc_id string, loan_id long, loan_ref string"))
    assert {r.loan_id for r in with_ids.where("doc_id = 'a'").collect()} == {30}


def test_phantoms_abstain(spark):
    rows = [["Loan ID", "Property Name", "Cut-off Date Balance ($)", "Interest Rate (%)"]] + [[str(i), f"P{i}", f"${i}00", "5%"] for i in range(1, 11)]
    few, many = rows + [["", "", "", "12"]], rows + [["", "", "", "12"]] * 3
    cells = spark.createDataFrame(grid("few", 0, few) + grid("many", 0, many), extract.CELL)
    headers = settled(extract.header_rows(cells))
    kinds = settled(annex.split_rows(cells, headers, settled(extract.map_columns(cells, headers))))
    assert {(r.doc_id, r.kind): r["count"] for r in kinds.groupBy("doc_id", "kind").count().collect()} == {("few", "loan"): 10, ("few", "phantom"): 1, ("many", "loan"): 10, ("many", "unknown"): 3}


def test_units_and_sanity(spark):
    o = [("d", 0, i, k, v) for i in range(30) for k, v in (("units", "9000"), ("unit_of_measure", "SF"), ("occupancy", "0.9" if i else "95"), ("interest_rate", "0.05"), ("noi_underwritten", str(5000 + i)), ("loan_amount", str(100 + i)), ("ltv", "0.6"))]
    o += [("e", 0, 1, "units", "10"), ("e", 0, 1, "unit_of_measure", "SF"), ("e", 0, 1, "square_feet", "70"), ("e", 0, 2, "units", "5"), ("e", 0, 2, "unit_of_measure", "Rooms")]
    df = spark.createDataFrame(o, "doc_id string, table_idx int, row_idx int, metric_key string, value string")
    routed = settled(annex.route_units(df))
    assert routed.where("doc_id = 'd' and metric_key = 'square_feet'").count() == 30 and routed.where("doc_id = 'd' and metric_key = 'units'").count() == 0
    assert sorted((r.metric_key, r.value) for r in routed.where("doc_id = 'e' and metric_key in ('units', 'square_feet')").collect()) == [("square_feet", "70"), ("units", "5")]
    got = {(r.severity, r.metric): (r.bad, r.n) for r in annex.sanity_issues(df).where("doc_id = 'd'").collect()}
    assert got == {("error", "occupancy"): (1, 30), ("error", "interest_rate"): (30, 30), ("error", "noi_underwritten"): (60, 60), ("warning", "units"): (30, 30)}
