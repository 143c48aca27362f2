"""Which metrics headers stand for: families, exclusions, ties and the choice of the header row."""

from pyspark.sql import functions as F

from tessera.functions.metrics import METRICS
from tessera.operators import extract as op

BEST = {
    "Second Most Recent NOI": "noi_second_most_recent",
    "Third Most Recent Net  Operating Income": "noi_third_most_recent",
    "Most Recent NOI Date": None,
    "Most Recent EGI ($)": "egi_most_recent",
    "Second Most Recent Expenses": "expenses_second_most_recent",
    "OpEx": "expenses_underwritten",
    "Whole Loan Cut-off Date LTV": "ltv_whole_loan",
    "Total Mortgage Debt DSCR": "dscr_total_debt",
    "Debt Yield Total Debt": None,
    "LTV at Maturity / ARD": "ltv_maturity",
    "Cut-off Date Balance per SF": None,
    "Second Most Recent Occupancy": None,
    "Largest Tenant SF": None,
    "Original Balance": "loan_amount",
    "Upfront PIP": "reserve_replacement_upfront",
    "Upfront TI/LC Cap": "reserve_tilc_cap",
    "Monthly Other Reserve": "reserve_other_monthly",
    "B-Note Interest Rate": "interest_rate_subordinate",
    "Non-Trust Pari Passu Companion Loan Cut-off Date Balance": "balance_pari_passu_non_trust",
    "Loan Number": None,
    "": None,
}


def test_best_metric_of_a_header(spark):
    df = spark.createDataFrame([(h,) for h in [*BEST, None]], "h string").withColumn("m", op.header_matches(F.col("h")))
    got = {r.h: max(r.m, key=lambda x: (x.score, -x.spec)).metric_key if r.m else None for r in df.collect()}
    assert got == BEST | {None: None}


def test_every_key_is_there_once():
    assert len({m.key for m in METRICS}) == len(METRICS) == 101
    assert {m.unit for m in METRICS} == {"currency", "percent", "ratio", "count", "years", "text"} and {m.owner for m in METRICS} == {"deal", "property"}


def test_repeated_headers_make_no_header_row(spark):
    rows = [["State"] * 6, ["Loan ID", "City", "State", "Coupon"], ["1", "Here", "TX", "5%"]]
    cells = spark.createDataFrame([("a", 0, r, c, x) for r, row in enumerate(rows) for c, x in enumerate(row)], op.CELL)
    headers = op.header_rows(cells)
    assert [tuple(r) for r in headers.collect()] == [("a", 0, 1)]
    assert {(r.col_idx, r.metric_key) for r in op.map_columns(cells, headers).collect()} == {(0, "loan_id"), (1, "city"), (2, "state"), (3, "interest_rate")}
