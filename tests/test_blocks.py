"""Cells of many documents come back in blocks, and headers are looked up once in a worker."""

import pandas as pd

from tessera.operators import extract


def test_cells_come_in_blocks(monkeypatch):
    monkeypatch.setattr(extract, "BLOCK", 50)
    page = "<table>" + "<tr><td>a</td><td>b</td></tr>" * 30 + "</table>"
    got = list(extract._cells(iter([pd.DataFrame({"d": [str(i) for i in range(9)], "h": [page] * 9})])))
    assert max(map(len, got)) <= 50
    whole = pd.concat(got)
    assert [tuple(x) for x in whole.itertuples(index=False)] == [(str(d), 0, r, c, "ab"[c]) for d in range(9) for r in range(30) for c in range(2)]


def test_findings_outlive_a_batch():
    assert extract._finder(extract.SPECS) is extract._finder(extract.SPECS)
    assert [m["metric_key"] for m in extract._finder(extract.SPECS)("uw noi ($)")] == ["noi_underwritten"]
