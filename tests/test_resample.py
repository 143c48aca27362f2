"""Resampling in blocks equals plain loops over the stream."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.random import FACTOR, STEP, lcg_stream
from tessera.operators import resample as op


class Stream:
    def __init__(self, seed):
        self.s = seed

    def __call__(self):
        self.s = (self.s * FACTOR + STEP) % 2**32
        return self.s / 2**32


def test_stream_is_entered_anywhere():
    u = Stream(5)
    want = [u() for _ in range(5000)]
    for skip in (0, 1, 17, 4096, 4990):
        assert lcg_stream(5, 10, skip).tolist() == want[skip : skip + 10]


@pytest.mark.parametrize("chunk", [1 << 20, 100, 7])
def test_blocks_equal_loops(monkeypatch, chunk):
    monkeypatch.setattr(op, "CHUNK", chunk)
    cohort, pool = [0.5, 0.3, 0.2], 23
    u, want = Stream(op.SEED), []
    for _ in range(30):
        counts = [0, 0, 0]
        for _ in range(pool):
            r, acc, k = u(), 0.0, 0
            for k, p in enumerate(cohort):  # noqa: B007
                acc += p
                if r < acc:
                    break
            counts[k] += 1
        want.append(0.5 * sum(abs(n / pool - p) for n, p in zip(counts, cohort, strict=True)))
    got = op.mixture_distances(pool, np.array(cohort), 0, 12) + op.mixture_distances(pool, np.array(cohort), 12, 18)
    assert np.allclose(got, want)
    x = sorted(random.Random(1).gauss(0, 1) for _ in range(31))
    u, want = Stream(op.BOOTSTRAP_SEED), []
    for _ in range(20):
        want.append(statistics.median(x[int(u() * 31)] for _ in range(31)))
    got = op.bootstrap_ranks(31, 0, 9) + op.bootstrap_ranks(31, 9, 11)
    assert np.allclose([(x[a] + x[b]) / 2 for a, b in got], want)
    # Entered behind what other groups have taken, with an even number of values.
    u = Stream(op.BOOTSTRAP_SEED)
    for _ in range(77):
        u()
    want = [statistics.median(x[int(u() * 30)] for _ in range(30)) for _ in range(5)]
    assert np.allclose([(x[a] + x[b]) / 2 for a, b in op.bootstrap_ranks(30, 0, 5, 77)], want)
    u, want = Stream(op.SEED), []
    for _ in range(10):
        want.append(op.shift([statistics.median(x[int(u() * 31)] for _ in range(n)) for n in (5, 8, 3)]))
    assert np.allclose(op.resampled_shifts(np.array(x), [5, 8, 3], 0, 4) + op.resampled_shifts(np.array(x), [5, 8, 3], 4, 6), want)
    own, stratum = np.array([i % 3 == 0 for i in range(31)]), np.array([i % 2 for i in range(31)])
    u, want = Stream(op.SEED), []
    for _ in range(10):
        r, parts = [u() for _ in range(31)], []
        for s in (0, 1):
            at = [i for i in range(31) if stratum[i] == s]
            k = sum(bool(own[i]) for i in at)
            order = sorted(at, key=lambda i: r[i])
            parts.append(statistics.median(x[i] for i in order[:k]) - statistics.median(x[i] for i in order[k:]))
        want.append(abs(sum(parts) / 2))
    assert np.allclose(op.permuted_differences(np.array(x), own, stratum, 0, 10), want)


def test_tests_tell_signal_from_chance(spark):
    r = random.Random(2)
    rows = [(k, i, r.gauss(3.0 if k == "far" and i % 2 else 0.0, 1), i % 2 == 1) for k in ("far", "same") for i in range(60)]
    df = spark.createDataFrame(rows, "metric string, id long, x double, own boolean").withColumn("stratum", F.lit(0))
    got = {x["metric"]: x for x in op.permutation_test(df, "metric").collect()}
    assert got["far"]["p_value"] < 0.01 and got["same"]["p_value"] > 0.05 and (got["far"]["n_own"], got["far"]["n_rest"]) == (30, 30)
    side = [[x for k, _, x, o in rows if k == "far" and o is w] for w in (True, False)]
    assert abs(got["far"]["observed"] - abs(statistics.median(side[0]) - statistics.median(side[1]))) < 1e-6
    boot = op.bootstrap(df.where("metric = 'same'").select("metric", "x"), "metric").first()
    assert boot["lo"] < boot["median"] < boot["hi"] and 0.05 < boot["se"] < 0.5


def test_bootstrap_looks_up_ranks_of_any_group(spark, monkeypatch):
    monkeypatch.setattr(op, "RESAMPLES", 40)
    r = random.Random(3)
    groups = {"a": [round(r.gauss(0, 1), 1) for _ in range(90)], "b": [5.0] * 61 + [float(i) for i in range(40)], "few": [1.0, 2.0]}
    rows = spark.createDataFrame([(k, x) for k, xs in groups.items() for x in xs], "g string, x double")
    got = {x["g"]: x for x in op.bootstrap(rows, "g", 30).collect()}
    assert set(got) == {"a", "b"}
    u = Stream(op.BOOTSTRAP_SEED)
    for k in ("a", "b"):
        xs = sorted(groups[k])
        medians = sorted(statistics.median(xs[int(u() * len(xs))] for _ in xs) for _ in range(40))
        assert (got[k]["n"], got[k]["median"], got[k]["lo"], got[k]["hi"]) == (len(xs), round(statistics.median(xs), 6), round(medians[1], 6), round(medians[39], 6))
        assert abs(got[k]["se"] - statistics.stdev(medians)) < 1e-6


def test_small_sides_have_no_test(spark):
    rows = [("few", i, float(i), i < 2, 0) for i in range(9)] + [("thin", i, float(i), i < 4, i) for i in range(9)]
    got = {x["metric"]: x for x in op.permutation_test(spark.createDataFrame(rows, "metric string, id long, x double, own boolean, stratum int"), "metric").collect()}
    assert (got["few"]["n_own"], got["few"]["observed"], got["few"]["null_difference"], got["few"]["p_value"]) == (2, 0.5, None, 1.0)
    assert (got["thin"]["observed"], got["thin"]["p_value"]) == (None, 1.0)


def test_strata_keep_equal_balances_together(spark):
    from tessera.plans.exchange import balance_strata

    balances = [1.0] * 20 + [2.0, 3.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0]
    rows = spark.createDataFrame([("m", i, b) for i, b in enumerate(balances)], "metric string, id long, by_balance double")
    cuts = [sorted(balances)[(i + 1) * 30 // 6] for i in range(5)]
    assert all(r.stratum == sum(c < r.by_balance for c in cuts) for r in balance_strata(rows).collect())


def test_blocks_are_dealt_over_tasks(spark):
    """Rows are few and small, work is not: adaptive execution must not put them into one task."""
    groups = spark.createDataFrame([(str(i), i) for i in range(8)], "g string, n int")
    seen = op.per_draw(groups, "g", 1000, _task).select("value").distinct().count()
    assert seen > 4


def _task(row, first, draws):
    from pyspark import TaskContext

    return [float(TaskContext.get().partitionId())] * draws


def test_shares_are_counted_at_the_edges():
    """Counts of states equal the kinds that each number falls into, also for kinds without a share and pools beyond one part."""
    cohort, pool = np.array([0.5, 0.25, 0.25, 0.0]), 40_000
    u = lcg_stream(op.SEED, 3 * pool).reshape(3, pool)
    kind = np.minimum(np.searchsorted(np.cumsum(cohort), u, side="right"), 3)
    want = [0.5 * np.abs(np.bincount(k, minlength=4) / pool - cohort).sum() for k in kind]
    assert np.allclose(op.mixture_distances(pool, cohort, 0, 3), want)


def test_dealing_needs_no_sorting_of_draws(monkeypatch):
    """Least states by a band equal those of a whole sort, also with ties of values and where the band misses."""
    r = np.random.default_rng(4)
    n = 70_001
    x, own, stratum = np.round(r.normal(size=n), 1), r.random(n) < 0.1, r.integers(0, 3, n)
    u, want = lcg_stream(op.SEED, 3 * n).reshape(3, n), []
    for row in u:
        parts = []
        for s in range(3):
            at = np.flatnonzero(stratum == s)
            dealt, k = x[at][np.argsort(row[at], kind="stable")], int(own[at].sum())
            parts.append(np.median(dealt[:k]) - np.median(dealt[k:]))
        want.append(abs(np.mean(parts)))
    assert np.allclose(op.permuted_differences(x, own, stratum, 0, 3), want)
    assert np.allclose(op.permuted_differences(x, own, stratum, 2, 1), want[2:])
    sizes, pool = [40_000, 30_001], np.sort(x)
    medians = [[np.median(pool[(part * n).astype(int)]) for part in (row[:40_000], row[40_000:])] for row in u]
    assert np.allclose(op.resampled_shifts(pool, sizes, 0, 3), [op.shift(m) for m in medians])
    real = op.bound
    monkeypatch.setattr(op, "bound", lambda v: real(v / 3))
    assert np.allclose(op.permuted_differences(x, own, stratum, 0, 3), want)
    assert np.allclose(op.resampled_shifts(pool, sizes, 0, 3), [op.shift(m) for m in medians])
