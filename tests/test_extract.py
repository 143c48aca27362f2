"""Tables in HTML become cells, columns get metrics, rows become observations."""

from tessera.operators import extract as op

PAGE = """<table><tr><td>menu</td></tr></table>
<table><tr><th colspan="3">Annex</th></tr>
<tr><td>Loan ID</td><td>Property Name</td><td>Cut-off Date Balance ($)</td><td>Balance</td><td>UW NOI ($)</td><td>Occupancy (%)</td></tr>
<tr><td>1</td><td>One &amp; Co</td><td>$1,000</td><td>7</td><td>(20)</td><td>95.5%</td></tr>
<tr><td>2</td><td>N/A</td><td>--</td><td>8</td><td>Various</td><td></td></tr>
<tr><td></td><td>Total / Average</td><td>$1,000</td><td>15</td><td>1</td><td>90%</td></tr></table>"""


def test_page_to_observations(spark):
    pages = spark.createDataFrame([("a", PAGE), ("b", None), ("c", "<p>no table</p>")], "page string, html string")
    cells = op.html_cells(pages, "page", "html").cache()
    assert {r.doc_id for r in cells.collect()} == {"a"}
    headers = op.header_rows(cells)
    assert [tuple(r) for r in headers.collect()] == [("a", 0, 1)]
    mapping = op.map_columns(cells, headers).cache()
    assert {(r.col_idx, r.metric_key) for r in mapping.collect()} == {(0, "loan_id"), (1, "property_name"), (2, "loan_amount"), (4, "noi_underwritten"), (5, "occupancy")}
    got = {(r.row_idx, r.metric_key): r.value for r in op.observations(cells, mapping).collect()}
    assert got == {(2, "loan_id"): "1", (2, "property_name"): "One & Co", (2, "loan_amount"): "1000", (2, "noi_underwritten"): "-20", (2, "occupancy"): "0.955"}
    assert {(r.row_idx, r.value) for r in op.unmapped_cells(cells, headers, mapping).collect()} == {(2, 7.0), (3, 8.0), (4, 15.0)}
