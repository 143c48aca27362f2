import datetime

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import expr, parsing
from tessera.functions.random import FACTOR, STEP, lcg_stream
from tessera.operators import promotion


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_number_gates(spark):
    rows = [("1.5",), ("-2",), ("1.2.3",), ("x",), (None,)]
    assert values(spark, rows, "value string", expr.num("value")) == [1.5, -2.0, None, None, None]
    assert values(spark, rows, "value string", expr.num_nonneg("value")) == [1.5, None, None, None, None]


def test_parse_value(spark):
    cases = [("$1,234.50", "currency", "1234.5"), ("(12.5)", "currency", "-12.5"), ("65.4%", "percent", "0.654"), ("65.4", "percent", "0.654"), ("1.2", "percent", "1.2"), ("1.42x", "ratio", "1.42"), ("12.6", "count", "13"),
             ("1985", "years", "1985"), ("85", "years", None), ("NAP", "currency", None), ("--", "ratio", None), ("12 34", "currency", None), ("Various", "text", None), (" a b ", "text", "a b"), ("-2.5", "count", "-2")]
    got = values(spark, [(a, b) for a, b, _ in cases], "x string, u string", parsing.parse_value("x", "u"))
    assert got == [c for *_, c in cases]


def test_cells_money_dates(spark):
    assert values(spark, [("$1,000",), ("(5)",), ("50%",), ("abc",), ("1" * 40,)], "x string", parsing.numeric_cell("x")) == [1000.0, -5.0, 50.0, None, None]
    assert values(spark, [("$1,000.25",), ("(3)",), ("Not Available",)], "x string", parsing.parse_money("x")) == [1000.25, -3.0, None]
    assert values(spark, [("1/31/24",), ("2/30/2024",), ("12/1/85",), ("x",)], "x string", parsing.parse_short_date("x")) == [datetime.date(2024, 1, 31), None, datetime.date(1985, 12, 1), None]
    assert values(spark, [("003A",), ("12-b",), ("x",)], "x string", parsing.loan_prefix("x")) == ["3", "12", None]


def test_states_and_labels(spark):
    assert values(spark, [("ny",), ("New York",), ("ZZ",), (None,)], "x string", parsing.normalize_state("x")) == ["NY", "NY", None, None]
    assert values(spark, [("Total",), ("Subtotal pool",), ("Totally",), (None,)], "x string", parsing.is_aggregate_label("x")) == [True, True, False, False]
    assert values(spark, [("WFCM 2025-C64 (A)",)], "x string", parsing.slug("x")) == ["wfcm-2025-c64-a"]


def test_intervals(spark):
    row = spark.range(1).select(expr.wilson(F.lit(5), F.lit(50), -1), expr.wilson(F.lit(5), F.lit(50), 1), expr.wilson(F.lit(0), F.lit(0), 1), expr.byar(F.lit(0), F.lit(3.0), -1), expr.byar(F.lit(10), F.lit(5.0), 1)).first()
    assert [round(x, 3) for x in row] == [0.043, 0.214, 0.0, 0.0, 3.678]


def test_random_stream():
    s, want = 0xC0FFEE, []
    for _ in range(1000):
        s = (s * FACTOR + STEP) % 2**32
        want.append(s / 2**32)
    assert np.array_equal(lcg_stream(0xC0FFEE, 1000), want)


def test_promotion(spark):
    rows = [(1, "ltv", "0.5", 0.8, "a", 1), (1, "ltv", "0.6", 0.9, "b", 3), (1, "ltv", "0.7", 0.9, "c", 2), (2, "ltv", "1", 0.5, "a", 1)]
    obs = spark.createDataFrame(rows, "loan_id long, metric_key string, value string, confidence double, source_header string, source_column int")
    got = {r["loan_id"]: (r["value"], r["rationale"]) for r in promotion.promote_facts(obs).collect()}
    assert got == {1: ("0.7", "best of 3 at 0.90"), 2: ("1", "only candidate")}


def test_annualise_and_feeds(spark):
    d = datetime.date
    rows = spark.createDataFrame([(1, 100.0, d(2024, 1, 1), d(2024, 12, 31)), (2, 30.0, d(2024, 1, 1), d(2024, 3, 31)), (3, 5.0, d(2024, 1, 1), d(2024, 1, 31)), (4, 5.0, None, d(2024, 1, 31))], "loan_id long, noi double, noi_start date, noi_end date")
    got = {r["loan_id"]: (round(r["annualized_noi"], 3), r["is_full_year"]) for r in promotion.annualise(rows).collect()}
    assert got == {1: (100.0, True), 2: (round(30 * 365 / 91, 3), False)}
    a = spark.createDataFrame([("r", 1, "x"), ("r", 2, None)], "report_accession string, loan_id long, status string")
    b = spark.createDataFrame([("r", 2, "y", 5), ("r", 3, "z", 6)], "report_accession string, loan_id long, status string, code int")
    got = {r["loan_id"]: (r["status"], r["code"], r["source"]) for r in promotion.merge_event_feeds(a, b).collect()}
    assert got == {1: ("x", None, "delinquency"), 2: ("y", 5, "both"), 3: ("z", 6, "special")}
