"""What keeps large corpora whole and bounded: one reading of the tables, no shuffle of unfolded rows, blocks of rows, phases on demand."""

import math

import pandas as pd
import pyarrow as pa
import pytest

from tessera.functions.expr import count_if
from tessera.operators import annex, extract, harvest, monitor, promotion, servicer, tiles
from tessera.plans import sheets, standardise, totals
from tessera.sources.bridge import Corpus

SF = "/root/testdata/sf0.001"
PAGE = "<table><tr><td>a</td><td> b  c </td><td></td></tr><tr><td></td></tr><tr><td>1</td><td></td><td>2</td></tr></table><table><tr><td>menu</td></tr></table>"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    """Shuffles by key that an adaptive plan starts from."""
    return plan(df).count("Exchange hashpartitioning")


def test_html_rows_are_the_rows_of_cells(spark, monkeypatch):
    pages = spark.createDataFrame([("x", PAGE), ("y", None), ("z", PAGE)], "d string, h string")
    rows = lambda df: sorted((r.doc_id, r.table_idx, r.row_idx, tuple(sorted(r.cells.items()))) for r in df.collect())
    got = rows(extract.html_rows(pages, "d", "h"))
    assert got == rows(servicer.table_rows(extract.html_cells(pages, "d", "h"))) and len(got) == 4
    monkeypatch.setattr(extract, "BLOCK", 50)
    long = "<table>" + "<tr><td>a</td><td>b</td></tr>" * 30 + "</table>"
    blocks = list(extract._rows(iter([pa.RecordBatch.from_pandas(pd.DataFrame({"d": [str(i) for i in range(9)], "h": [long] * 9}))])))
    assert max(b.num_rows for b in blocks) <= 25 and sum(b.num_rows for b in blocks) == 270


def test_properties_need_no_joined_table(spark, monkeypatch):
    cells = extract.html_cells(spark.createDataFrame([("x", PAGE)], "d string, h string"), "d", "h")
    monkeypatch.setattr(annex, "join_tables", lambda *_: pytest.fail("not asked for"))
    assert harvest.harvest(cells).properties.count() == 0


def test_held_corpus_reads_the_tables_once(spark):
    c = Corpus(spark, SF)
    before = {n: sorted(map(tuple, getattr(c, n).collect())) for n in ("annex_loans", "report_loans", "loans", "facts")}
    c = c.held()
    assert all(sorted(map(tuple, getattr(c, n).collect())) == x for n, x in before.items())
    assert "lineitem" not in plan(c.observations) and "lineitem" not in plan(c.annex_loans)
    assert exchanges(c.annex_loans) == 0


def test_filed_by_keeps_whole_issuances(spark):
    c = Corpus(spark, SF)
    known = c.filings.where("filed_at <= date '2020-06-30'").select("accession")
    mine = sorted(map(tuple, c.loans.join(known, "accession", "left_semi").select("loan_id", "row_index", "accession").collect()))
    assert mine and mine == sorted(map(tuple, c.filed_by("2020-06-30").loans.select("loan_id", "row_index", "accession").collect()))


@pytest.mark.parametrize("op", [promotion.promote_facts, promotion.dedupe_observations])
def test_unfolded_observations_are_not_sent(spark, op):
    """One shuffle, by loan and before the loans are unfolded."""
    text = plan(op(Corpus(spark, SF).held().observations))
    assert text.count("Exchange hashpartitioning") == 1
    assert text.index("Exchange hashpartitioning") > text.index("Generate")


def test_distinct_loans_are_counted_where_they_are(spark):
    c = Corpus(spark, SF).held()
    assert "Expand" not in plan(totals.corpus_stats_metrics(c))
    text = plan(monitor.snapshot(c.filings, c.loans, c.facts, ("ltv", "dscr"), "2020-01-01"))
    assert "hashpartitioning(metric_key#" in text and not any("loan_id" in x for x in text.splitlines() if "hashpartitioning(metric_key#" in x)


def test_ranks_of_one_range_share_a_digest(spark, monkeypatch):
    made = []
    digest = tiles.F.percentile_approx
    monkeypatch.setattr(tiles.F, "percentile_approx", lambda *a: made.append(1) or digest(*a))
    rows = spark.range(5000).selectExpr("id", "cast(id * 7919 % 5000 as double) as x")
    got = tiles.with_tile(rows, "x", "id", 5, "q", few=2000).groupBy("q").agg(count_if(tiles.F.col("x") >= 0).alias("n"), tiles.F.max("x").alias("hi")).collect()
    assert sorted((r.q, r.n, r.hi) for r in got) == [(k, 1000, 1000.0 * k - 1) for k in range(1, 6)]
    assert len(made) == 1


def test_mapping_of_files_is_written_first(spark, monkeypatch):
    names, write = [], sheets.staged
    monkeypatch.setattr(sheets, "staged", lambda df, name: names.append(name) or write(df, name))
    sheets.sheet_observations(Corpus(spark, SF))
    assert "file-mapping" in names


def test_rank_correlation_of_equal_medians(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1.0, 0.5), ("b", 1.0, 0.7), ("c", 1.0, 0.6)], "accession string, dscr double, interest_rate double")
    monkeypatch.setattr(standardise, "base", lambda c: rows)
    (got,) = standardise.predictor_spearman(None).collect()
    assert got.n == 3 and math.isnan(got.rho) and math.isnan(got.t)
