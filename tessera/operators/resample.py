"""Resampling with a fixed random stream: simulations, bootstraps and permutations in blocks of draws.

The unit of work is a group and a block of its draws. Blocks are spread over the cluster; the stream is entered where a
block begins, so results don't depend on how draws are dealt. A task holds one group's values and one draw; the values
of a draw come back as rows and are summed up by Spark.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import PART, bound, count_below, lcg_jumps, lcg_state, lcg_states, lcg_stream
from ..sources.stage import staged
from .tiles import _Range, values_at

SIMULATIONS, SEED = 4000, 0xC0FFEE
RESAMPLES, BOOTSTRAP_SEED = 2000, 20260815
REPLICAS, PERMUTATIONS, STRATA = 600, 4000, 6
#: Draws of one block, numbers of the stream that are held at once, and bins in which longer draws are counted.
BLOCK, CHUNK, BINS = 250, 1 << 20, 1 << 16
#: Rows on a side below which there is no permutation test.
LEAST_SIDE = 3


def _draws(seed: int, n: int, first: int, draws: int, skip: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(draws at once, their numbers): whole draws as rows while a draw is short, else parts of one draw. The stream's first `skip` numbers are others'."""
    if n <= CHUNK:
        many = max(1, CHUNK // max(1, n))
        for d in range(first, first + draws, many):
            k = min(many, first + draws - d)
            yield k, lcg_stream(seed, k * n, skip + d * n).reshape(k, n)
    else:
        for d in range(first, first + draws):
            for at in range(0, n, CHUNK):
                yield int(at + CHUNK >= n), lcg_stream(seed, min(CHUNK, n - at), skip + d * n + at)[None]


def mixture_distances(pool: int, cohort: np.ndarray, first: int, draws: int) -> list[float]:
    """Total variation between the cohort's mix and pools drawn from it: draws first, first + 1, ... of the stream.

    A kind's number is the difference of two counts of states below its edges, so nothing is held for a number.
    """
    limits, out = [bound(x) for x in np.cumsum(cohort)[:-1]], []
    for d in range(first, first + draws):
        below = np.zeros(len(cohort) + 1, np.int64)
        below[-1] = pool
        for part in lcg_states(SEED, pool, d * pool):
            below[1:-1] += [count_below(part, x) for x in limits]
        out.append(float(0.5 * np.abs(np.diff(below) / pool - cohort).sum()))
    return out


def _at_rank(seed: int, n: int, draw: int, skip: int, rank: int) -> int:
    """The drawn place of a rank (from 0) in a draw that is not held: counted in wide bins first, then only the bin that has it."""
    width = max(1, n // BINS)
    parts = lambda: ((u[0] * n).astype(np.int64) for _, u in _draws(seed, n, draw, 1, skip))
    below = np.cumsum(sum(np.bincount(p // width, minlength=n // width + 1) for p in parts()))
    bin_ = int(np.searchsorted(below, rank, side="right"))
    held = np.concatenate([p[p // width == bin_] for p in parts()])
    return int(np.partition(held, rank - (int(below[bin_ - 1]) if bin_ else 0))[rank - (int(below[bin_ - 1]) if bin_ else 0)])


def bootstrap_ranks(n: int, first: int, draws: int, skip: int = 0) -> list[tuple[int, int]]:
    """The two middle ones (the same for an odd n) of each draw of n places with replacement, as places in the sorted values."""
    lo, hi = (n - 1) // 2, n // 2
    if n > CHUNK:
        return [(_at_rank(BOOTSTRAP_SEED, n, d, skip, lo), _at_rank(BOOTSTRAP_SEED, n, d, skip, hi)) for d in range(first, first + draws)]
    out: list[tuple[int, int]] = []
    for _, u in _draws(BOOTSTRAP_SEED, n, first, draws, skip):
        part = np.partition((u * n).astype(np.int64), [lo, hi], axis=1)
        out += zip(part[:, lo].tolist(), part[:, hi].tolist(), strict=True)
    return out


def shift(medians: list[float]) -> float:
    """Spread of medians over the absolute upper median."""
    centre = sorted(medians)[len(medians) // 2]
    return (max(medians) - min(medians)) / abs(centre) if centre else 0.0


def _middle_states(n: int, skip: int) -> np.ndarray:
    """The two middle ones (the same for an odd n) of n states after the stream's first `skip`."""
    ranks = np.array([(n - 1) // 2, n // 2])
    spread = 4 / np.sqrt(n) + 64 / n
    for lo, hi in ((bound(0.5 - spread), bound(0.5 + spread)), (0, 1 << 32)):
        below, near = 0, []
        for part in lcg_states(SEED, n, skip):
            below += count_below(part, lo)
            near.append(part[part - np.uint32(lo) <= np.uint32(hi - 1 - lo)])
        held, at = np.concatenate(near), ranks - below
        if at[0] >= 0 and at[1] < len(held):
            break
    return np.partition(held, at)[at]


def resampled_shifts(pool: np.ndarray, sizes: list[int], first: int, draws: int) -> list[float]:
    """Shifts of vintages' medians when all are drawn, with replacement, from one sorted pool.

    Drawn places rise with the states they come from, so the middle states give the middle places.
    """
    ends, out = np.cumsum([0, *sizes]), []
    for d in range(first, first + draws):
        medians = []
        for a, n in zip(ends[:-1].tolist(), sizes, strict=True):
            lo, hi = (_middle_states(n, d * int(ends[-1]) + a) / 2.0**32 * len(pool)).astype(np.int64)
            medians.append((float(pool[lo]) + float(pool[hi])) / 2)
        out.append(shift(medians))
    return out


def _difference(x: np.ndarray, own: np.ndarray, stratum: np.ndarray) -> float | None:
    """Mean over the strata of (median of own - median of the rest), without its sign; strata with one of a side are left out."""
    parts = []
    for s in np.unique(stratum):
        a, b = x[(stratum == s) & own], x[(stratum == s) & ~own]
        if len(a) >= 2 and len(b) >= 2:
            parts.append(float(np.median(a) - np.median(b)))
    return abs(sum(parts) / len(parts)) if parts else None


def _kth(mask: np.ndarray, value: bool, k: int) -> int:
    """The place of the k-th (from 0) of a mask's entries that have the value."""
    lo, hi = 0, len(mask)
    while hi - lo > PART:
        half = (lo + hi) // 2
        n = int(np.count_nonzero(mask[lo:half]))
        n = n if value else half - lo - n
        lo, hi, k = (lo, half, k) if k < n else (half, hi, k - n)
    return lo + int(np.flatnonzero(mask[lo:hi] == value)[k])


def _middle_of(x: np.ndarray, mask: np.ndarray, value: bool, n: int) -> float:
    """Median of the n entries of sorted x whose mask has the value."""
    return (float(x[_kth(mask, value, (n - 1) // 2)]) + float(x[_kth(mask, value, n // 2)])) / 2


def _least(parts: Callable, n: int, k: int) -> np.ndarray:
    """Mask of the k least of n different states; parts() gives them in pieces.

    The k-th is near k/n of the range: states clearly below are marked at once, and only the few near it are put in
    order. Should it lie outside after all, all are.
    """
    spread = 8 * np.sqrt(k / n * (1 - k / n) / n) + 64 / n
    for lo, hi in ((bound(k / n - spread), bound(k / n + spread)), (0, 1 << 32)):
        mask, at, near = np.empty(n, bool), [], []
        first = below = 0
        for part in parts():
            here = mask[first : first + len(part)]
            np.less(part, np.uint32(min(lo, 0xFFFFFFFF)), out=here)
            below += int(np.count_nonzero(here))
            # Unsigned differences wrap round, so one comparison tells both ends.
            inside = np.flatnonzero(part - np.uint32(lo) <= np.uint32(hi - 1 - lo))
            at.append(inside + first)
            near.append(part[inside])
            first += len(part)
        left, at, near = k - below, np.concatenate(at), np.concatenate(near)
        if 0 <= left <= len(at):
            break
    if left:
        mask[at[np.argpartition(near, left - 1)[:left]]] = True
    return mask


def permuted_differences(x: np.ndarray, own: np.ndarray, stratum: np.ndarray, first: int, draws: int) -> list[float | None]:
    """Differences when the labels are dealt anew within each stratum, by the order of uniform numbers.

    Rows are put in the order of their values once; each keeps the factor and step that lead from a draw's first
    state to its own, so a draw neither sorts nor gathers.
    """
    a, b = lcg_jumps(len(x))
    strata = []
    for s in np.unique(stratum):
        at = np.flatnonzero(stratum == s)
        k = int(own[at].sum())
        if k >= 2 and len(at) - k >= 2:
            at = at[np.argsort(x[at], kind="stable")]
            strata.append((a[at], b[at], x[at], k))
    out: list[float | None] = []
    for d in range(first, first + draws):
        state, total = np.uint32(lcg_state(SEED, d * len(x))), 0.0
        for a, b, values, k in strata:
            n = len(values)
            dealt = _least(lambda a=a, b=b, n=n: (a[i : i + PART] * state + b[i : i + PART] for i in range(0, n, PART)), n, k)
            total += _middle_of(values, dealt, True, k) - _middle_of(values, dealt, False, n - k)
        out.append(abs(total / len(strata)) if strata else None)
    return out


def _run(batches: Iterator[pd.DataFrame], key: str, draws: int, work: Callable) -> Iterator[pd.DataFrame]:
    for b in batches:
        for row in b.to_dict("records"):
            values = work(row, row["first"], min(BLOCK, draws - row["first"]))
            yield pd.DataFrame({key: [row[key]] * len(values), "value": pd.array(values, dtype="Float64")})


def _dealt(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks over several tasks a core. The number is stated: without one Spark puts such small rows together into one task, however long they take."""
    spark = blocks.sparkSession
    return blocks.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key, "first")


def per_draw(groups: DataFrame, key: str, draws: int, work: Callable) -> DataFrame:
    """key, value for every draw of every group; groups has the key, and what work(row, first, draws) reads."""
    blocks = groups.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(BLOCK))))
    kind = groups.schema[key].dataType.simpleString()
    return _dealt(blocks, key).mapInPandas(functools.partial(_run, key=key, draws=draws, work=work), f"{key} {kind}, value double")


def _mixture(row: dict, first: int, draws: int) -> list[float]:
    return mixture_distances(int(row["pool"]), np.array(row["cohort"], dtype=float), first, draws)


def _nearest(p: float) -> F.Column:
    """Value at place floor(p n) of the draws, counted from 0; null without any. Draws of a group are a fixed number."""
    return F.try_element_at(F.sort_array(F.collect_list("value")), (F.floor(p * F.count("value")) + 1).cast("int"))


def null_distances(groups: DataFrame, key: str) -> DataFrame:
    """key, pool, cohort (shares, largest first), observed -> key, distance, null_distance (median), p_value."""
    drawn = per_draw(groups.select(key, "pool", "cohort"), key, SIMULATIONS, _mixture).join(groups.select(key, "observed"), key)
    out = drawn.groupBy(key).agg(F.max("observed").alias("observed"), _nearest(0.5).alias("null"), F.avg((F.col("value") >= F.col("observed") - 1e-12).cast("int")).alias("p"))
    return out.select(key, F.round("observed", 6).alias("distance"), F.round("null", 6).alias("null_distance"), F.round("p", 6).alias("p_value"))


def _ranked(batches: Iterator[pd.DataFrame], key: str, draws: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        for row in b.to_dict("records"):
            many = min(BLOCK, draws - row["first"])
            found = bootstrap_ranks(int(row["n"]), row["first"], many, int(row["skip"]))
            yield pd.DataFrame({key: [row[key]] * many, "draw": range(row["first"], row["first"] + many), "lo": [x for x, _ in found], "hi": [x for _, x in found]})


def values_of_ranks(rows: DataFrame, key: str, wanted: DataFrame, sizes: list) -> DataFrame:
    """wanted (key, rank from 0) with x, the value at that rank among the key's values; sizes: key, n, lo, hi, first, last rank wanted.

    Only the values between a group's first and last wanted rank are put in order, each distinct one once; these ends
    are found by exact counts over all rows.
    """
    narrow = rows.select(F.col(key).alias("key"), F.col("x").cast("double").alias("x"))
    ends = [_Range(g[key], rank + 1, g["lo"], g["hi"], g["n"]) for g in sizes for rank in (g["first"], g["last"])]
    at = values_at(narrow, ends)
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    spans = [(g[key], at[2 * i][0], at[2 * i + 1][0], g["first"] + 1 - at[2 * i][1]) for i, g in enumerate(sizes)]
    spans = spark.createDataFrame(spans, f"key {kind}, lo double, hi double, below long")
    inside = narrow.join(F.broadcast(spans), "key").where(F.col("x").between(F.col("lo"), F.col("hi"))).groupBy("key", "x", "below").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = inside.select("key", (F.col("below") + before).alias("rank"), "x", F.lit(0).alias("asked"))
    asked = wanted.select(F.col(key).alias("key"), "rank", F.lit(None).cast("double").alias("x"), F.lit(1).alias("asked")).distinct()
    # The last value that starts at a rank or before it has the rank.
    last = F.last("x", ignorenulls=True).over(Window.partitionBy("key").orderBy("rank", "asked").rowsBetween(Window.unboundedPreceding, 0))
    return starts.unionByName(asked).withColumn("value", last).where("asked = 1").select(F.col("key").alias(key), "rank", F.col("value").alias("x"))


def bootstrap(rows: DataFrame, key: str, least: int = 1) -> DataFrame:
    """key, x -> key, n, median, lo, hi, se of the median, for groups of at least so many values.

    One stream runs through all groups in the order of their keys. A draw's median is the value at the middle
    rank that it drew, so tasks draw ranks and hold no values; the few ranks that occur are looked up afterwards.
    There are few groups, of any size.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi")).where(F.col("n") >= least).orderBy(key).collect()
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    out = f"{key} {kind}, n long, median double, lo double, hi double, se double"
    if not sizes:
        return spark.createDataFrame([], out)
    groups, skip = [], 0
    for g in sizes:
        groups.append((g[key], g["n"], skip))
        skip += RESAMPLES * g["n"]
    blocks = spark.createDataFrame(groups, f"{key} {kind}, n long, skip long").withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(RESAMPLES - 1), F.lit(BLOCK))))
    drawn = _dealt(blocks, key).mapInPandas(functools.partial(_ranked, key=key, draws=RESAMPLES), f"{key} {kind}, draw int, lo long, hi long")
    drawn = staged(drawn, "bootstrap-ranks")
    # The true median's ranks are looked up with those of the draws.
    own = spark.createDataFrame([(g[key], -1, (g["n"] - 1) // 2, g["n"] // 2) for g in sizes], drawn.schema)
    drawn = drawn.unionByName(own)
    ends = {r[key]: r for r in drawn.groupBy(key).agg(F.min("lo").alias("first"), F.max("hi").alias("last")).collect()}
    wanted = drawn.select(key, F.explode(F.array("lo", "hi")).alias("rank")).distinct()
    found = values_of_ranks(rows, key, wanted, [g.asDict() | ends[g[key]].asDict() for g in sizes])
    a, b = (found.select(key, F.col("rank").alias(r), F.col("x").alias(f"x_{r}")) for r in ("lo", "hi"))
    medians = drawn.join(a, [key, "lo"]).join(b, [key, "hi"]).select(key, "draw", ((F.col("x_lo") + F.col("x_hi")) / 2).alias("value"))
    drawn = medians.where("draw >= 0").groupBy(key).agg(_nearest(0.025).alias("lo"), _nearest(0.975).alias("hi"), F.stddev_samp("value").alias("se"))
    known = medians.where("draw < 0").select(key, F.col("value").alias("median")).join(F.broadcast(spark.createDataFrame([(g[key], g["n"]) for g in sizes], f"{key} {kind}, n long")), key)
    return known.join(drawn, key).select(key, "n", *[F.round(x, 6).alias(x) for x in ("median", "lo", "hi", "se")])


def _shifts(row: dict, first: int, draws: int) -> list[float]:
    return resampled_shifts(np.array(row["pool"], dtype=float), [int(n) for n in row["sizes"]], first, draws)


def null_shifts(groups: DataFrame, key: str) -> DataFrame:
    """key, pool (sorted values), sizes, observed -> key, null_shift, p_value."""
    drawn = per_draw(groups.select(key, "pool", "sizes"), key, REPLICAS, _shifts).join(groups.select(key, "observed"), key)
    return drawn.groupBy(key).agg(F.round(_nearest(0.5), 6).alias("null_shift"), F.round(F.avg((F.col("value") >= F.col("observed")).cast("int")), 6).alias("p_value"))


def _permuted(row: dict, first: int, draws: int) -> list[float | None]:
    return permuted_differences(np.array(row["x"], dtype=float), np.array(row["own"], dtype=bool), np.array(row["stratum"], dtype=int), first, draws)


def _observed(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [_difference(np.array(r["x"], dtype=float), np.array(r["own"], dtype=bool), np.array(r["stratum"], dtype=int)) for r in b.to_dict("records")]
        yield pd.DataFrame({key: b[key], "observed": pd.array(found, dtype="Float64")})


def permutation_test(rows: DataFrame, key: str) -> DataFrame:
    """key, id, x, own, stratum -> key, n_own, n_rest, observed, null_difference, p_value.

    The difference of medians between own rows and the rest, within strata, against labels dealt at random. With fewer
    than LEAST_SIDE rows on a side, or no stratum that has two of each, nothing is tested: p_value is 1, and
    observed the median of the own rows or null.
    """
    item = F.sort_array(F.collect_list(F.struct("id", "x", "own", "stratum")))
    groups = rows.groupBy(key).agg(F.count_if(F.col("own")).alias("n_own"), F.count_if(~F.col("own")).alias("n_rest"), F.percentile(F.when(F.col("own"), F.col("x")), 0.5).alias("own_median"), item.alias("r"))
    enough = (F.col("n_own") >= LEAST_SIDE) & (F.col("n_rest") >= LEAST_SIDE)
    few = groups.where(~enough).select(key, "n_own", "n_rest", F.col("own_median").alias("observed"), F.lit(None).cast("double").alias("null"), F.lit(1.0).alias("p"))
    groups = groups.where(enough).select(key, "n_own", "n_rest", *[F.col(f"r.{c}").alias(c) for c in ("x", "own", "stratum")])
    kind = groups.schema[key].dataType.simpleString()
    seen = groups.select(key, "x", "own", "stratum").mapInPandas(functools.partial(_observed, key=key), f"{key} {kind}, observed double")
    drawn = per_draw(groups.select(key, "x", "own", "stratum"), key, PERMUTATIONS, _permuted).join(seen, key)
    out = drawn.groupBy(key).agg(F.max("observed").alias("observed"), _nearest(0.5).alias("null"), F.avg((F.col("value") >= F.col("observed")).cast("int")).alias("p"))
    out = groups.select(key, "n_own", "n_rest").join(out, key).withColumn("p", F.coalesce("p", F.lit(1.0))).unionByName(few)
    return out.select(key, "n_own", "n_rest", *[F.round(a, 6).alias(b) for a, b in (("observed", "observed"), ("null", "null_difference"), ("p", "p_value"))])
