"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import math

import duckdb
import pytest

from tessera import plans
from tessera.operators import resample

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return v.isoformat()[:10] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    out = plans.QUERIES[name](spark, SF)
    ref = duck.execute(plans.SQL[name])
    cols = [d[0] for d in ref.description]
    assert sorted(cols) == sorted(out.columns)
    order = [cols.index(c) for c in out.columns]
    mine = sorted((tuple(map(plain, r)) for r in out.collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in ref.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_reruns_alike(spark, name, monkeypatch):
    for draws in ("SIMULATIONS", "RESAMPLES", "REPLICAS", "PERMUTATIONS"):
        monkeypatch.setattr(resample, draws, 60)
    first, second = (sorted(map(repr, plans.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert first == second
