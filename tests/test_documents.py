"""A document's phases where it is read give what the phases on DataFrames give, also on odd annexes."""

import random

import pytest

from tessera.operators import annex, documents, harvest, servicer
from tessera.operators.extract import html_cells
from tessera.plans import annexes, reports
from tessera.sources.bridge import Corpus
from tessera.sources.stage import staged

SF = "/root/testdata/sf0.001"
COLUMNS = ["Loan ID", "Loan / Property Flag", "Property Name", "Cut-off Date Balance ($)", "Interest Rate (%)", "Cut-off Date LTV (%)", "Occupancy (%)", "UW NOI ($)", "Underwritten NOI ($)", "Number of Units", "Unit of Measure", "Square Feet", "City", "Broker Code", "cut-off date LTV (%)"]
GROUPS = ["Loan", "Collateral", "Mortgage Loan Terms", "UW", ""]


def _text(rng, name, i):
    if rng.random() < 0.08:
        return rng.choice(["", "NAP", "12", "x", "Total", "1e2", "NaN", "--", "5.5d"])
    if name == "Loan ID":
        return rng.choice([str(i), f"{i}.00", f"{i}.0{rng.randrange(1, 3)}", str(i), f"L{i}"] if rng.random() < 0.3 else [str(i)])
    if name == "Loan / Property Flag":
        return rng.choice(["Loan", "Loan", "loan ", "Property", "?"])
    return {"Property Name": f"N{i}", "City": "Town", "Unit of Measure": rng.choice(["SF", "Units", "sq. ft."]), "Interest Rate (%)": "5.25%"}.get(name, f"${rng.randrange(1, 9000):,}")


def _page(rng):
    tables, heads = [], []
    for _ in range(rng.randrange(1, 6)):
        first = rng.randrange(1, 9)
        kind = rng.random()
        head = rng.choice(heads) if heads and kind < 0.55 else rng.sample(COLUMNS, rng.randrange(3, 10))
        if not heads or kind >= 0.55:
            head = ["Loan ID", *[x for x in head if x != "Loan ID"]] if rng.random() < 0.8 else head
        heads.append(head)
        rows = [[_text(rng, x, i) for x in head] for i in range(first, first + rng.randrange(0, 7))]
        if rng.random() < 0.15:
            rows.append(["", "", "12"])
        top = [] if heads[:-1] and kind < 0.3 else [[g for g in rng.choices(GROUPS, k=len(head))]] * rng.randrange(2) + [head]
        tables.append("<table>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x in r) + "</tr>" for r in top + rows) + "</table>")
    return "<p>note</p>".join(tables)


def _rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(11)
    pages = spark.createDataFrame([*[(f"d{i}", _page(rng)) for i in range(150)], ("none", None), ("bare", "<table><tr><td>a</td><td>b</td></tr></table>")], "doc_id string, html string")
    return harvest.harvest(html_cells(pages, "doc_id", "html")), documents.PageHarvest(pages)


@pytest.mark.parametrize("what", ["kinds", "joined", "observations"])
def test_phases_agree(both, what):
    slow, fast = (getattr(x, what) for x in both)
    assert sorted(slow.columns) == sorted(fast.columns)
    want = _rows(slow.select(*fast.columns))
    assert _rows(fast) == want and len(want) > 100


def test_properties_agree(both):
    slow, fast = (x.properties for x in both)
    want = _rows(slow.select(*fast.columns))
    assert _rows(fast) == want and len(want) > 20


def test_joined_columns_agree(both):
    slow, fast = both
    assert _rows(fast.mapping.select("doc_id", "col_idx", "metric_key")) == _rows(slow.joined_mapping.select("doc_id", "col_idx", "metric_key"))
    assert _rows(annex.header_ties(fast.columns, fast.headers)) == _rows(annex.header_ties(slow.joined, slow.joined_headers))


def test_numbers_as_they_are_cast(spark):
    texts = ["1", " 1.5 ", "1.", ".5", "1e3", "1d", "2.5F", "-0", "+7", "NaN", "inf", "-Infinity", "1_0", "", "-", "1,0", "0x1", "１", "1e", "١"]
    got = spark.createDataFrame([(x,) for x in texts], "x string").selectExpr("x", "try_cast(x as double) as n").collect()
    assert {r.x: repr(r.n) for r in got} == {x: repr(documents.number(x)) for x in texts}


def test_annexes_shuffle_loans_only(spark):
    """One dealing of loans to their documents and none of cells; before, thirteen tables of cells were written."""
    text = annexes.annex_observations(Corpus(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and text.index("Exchange") > text.index("MapInArrow")


def test_lines_of_reports_are_parsed_once(spark, monkeypatch):
    """Every kind of line meets its tables once; before, incomes did so three times and arrears too."""
    made = []
    monkeypatch.setattr(servicer, "staged", lambda df, name: made.append(name) or staged(df, name), raising=False)
    servicer.diagnostics(*reports._read(Corpus(spark, SF)))
    assert made == ["report-lines", "report-late"]
