"""Requests for comparables against a loop over all loans; what is wrong with requests; empty tables."""

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.operators import requests as op

KINDS = ("Office", "Retail")
DIVISIONS = {"North": ("AA", "BB"), "South": ("CC",)}
RAW = "request_id long, " + ", ".join(f"{k} string" for k in op.RAW)
LOAN = "loan_id long, kind string, state string, loan_amount double, filed_at date, ltv double"
NEWEST = dt.date(2024, 6, 30)


def loans():
    out = []
    for i in range(400):
        state = ("AA", "BB", "CC", None)[i % 4] if i % 9 else "ZZ"
        out.append((i, "Office" if i % 3 else "Retail", state, float(2 ** (i % 12)) * (1 + i % 2 / 2) if i % 50 else None, NEWEST - dt.timedelta(days=(i * 37) % 1500), None if i % 13 == 0 else (i % 30) / 12))
    return out + [(1000 + i, "Office", "CC", 100.0, NEWEST, 0.5) for i in range(12)]


REQUESTS = [
    (1, "aa", "Office", "100", None, None, "0.5", None), (2, "CC", "Office", "100", None, "1", "70", None), (3, "DD", "Retail", "64", "3", "240", None, "1"), (4, "DD", "Retail", "64", "3", "240", None, None),
    (5, "BB", "Retail", "1e9", None, None, "0.5", "true"), (6, "AA", "Office", "0.5", "1", "240", None, "1"), (7, "BB", "Office", "300", "0.9", "12", "2", None), (8, "AA", "Office", "ten", None, None, None, None), (9, None, None, None, None, None, None, None),
]


def months_before(n):
    y, m = divmod(NEWEST.year * 12 + NEWEST.month - 1 - n, 12)
    return dt.date(y, m + 1, min(NEWEST.day, 28 if m == 1 and y % 4 else 29 if m == 1 else 30))


def by_hand(r):
    _, state, kind, amount, band, months, ltv, national = r
    state, amount, band, months = state.upper(), float(amount), float(band or 0.5), int(months or 18)
    ltv = None if ltv is None else float(ltv) / 100 if float(ltv) > 2 else float(ltv)
    region = next((x for x in DIVISIONS.values() if state in x), None)

    def pick(band, months):
        return [x for x in loans() if x[1] == kind and x[3] and amount * (1 - band) <= x[3] <= amount * (1 + band) and x[4] >= months_before(months)]

    base = pick(band, months)
    groups = {"state": [x for x in base if x[2] == state], "region": None if region is None else [x for x in base if x[2] in region], "country": base}
    scope = next((k for k in ("state", "region", "country") if groups[k] and len(groups[k]) >= 10 and (k != "country" or national)), None)
    mine = groups[scope or "state"]
    counts = tuple(None if groups[k] is None else len(groups[k]) for k in ("state", "region", "country"))
    asked = (len([x for x in mine if x[5] and 0 < x[5] <= 2 and x[5] >= ltv]), len([x for x in mine if x[5] and 0 < x[5] <= 2])) if scope and ltv else (None, None)
    values = sorted(x[5] for x in mine if x[5] and 0 < x[5] < 2) if scope else []
    return (scope is not None, scope, len(mine), *counts, len(pick(1, months)), len(pick(band, 36)), *asked), values


@pytest.mark.parametrize("salts", [1, 16])
def test_answers_equal_a_loop(spark, monkeypatch, salts):
    monkeypatch.setattr(op, "SALTS", salts)
    checked = op.checked_requests(spark.createDataFrame(REQUESTS, RAW), KINDS)
    told, parts = op.answers(spark.createDataFrame(loans(), LOAN), checked, DIVISIONS, {"ltv": 2})
    got = {r[0]: tuple(r)[1:] for r in told.collect()}
    want = {r[0]: by_hand(r) for r in REQUESTS[:7]}
    assert got == {k: v[0] for k, v in want.items()}
    assert {v[0][1] for v in want.values()} == {"state", "region", "country", None}
    assert {r.request_id: (r.base, round(r.p50, 9)) for r in parts.collect()} == {k: (len(v), round(statistics.median(v), 9)) for k, (_, v) in want.items() if v}


def test_failures(spark):
    raw = [*REQUESTS, (10, " ny ", "Retail", "NaN", "0", "1.5", "101", "yes"), (11, "N1", "retail", "0", "x", "241", "0", None), (12, "NY", "Retail", "Infinity", "3.01", "12", "", None)]
    got = {r.request_id: r.failures for r in op.checked_requests(spark.createDataFrame(raw, RAW), KINDS).collect()}
    assert all(got[i] == [] for i in range(1, 8)) and got[8] == ["invalid_amount"] and got[9] == ["invalid_state", "invalid_type", "invalid_amount"]
    assert got[10] == ["invalid_amount", "invalid_band", "invalid_months", "invalid_ltv"]
    assert got[11] == ["invalid_state", "invalid_type", "invalid_amount", "invalid_band", "invalid_months", "invalid_ltv"]
    assert got[12] == ["invalid_amount", "invalid_band", "invalid_ltv"]


def test_no_loans_and_no_requests(spark):
    none, asked = spark.createDataFrame([], LOAN), op.checked_requests(spark.createDataFrame(REQUESTS, RAW), KINDS)
    told, parts = op.answers(none, asked, DIVISIONS, {"ltv": 2})
    assert told.where(~F.col("sufficient") & (F.col("n_country") == 0)).count() == 7 and parts.count() == 0
    told, parts = op.answers(spark.createDataFrame(loans(), LOAN), asked.limit(0), DIVISIONS, {"ltv": 2})
    assert told.count() == 0 and parts.count() == 0
