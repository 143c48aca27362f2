"""Exact tiles (as ntile gives them) of large groups, from cut rows instead of one sorted window.

A window over a whole group sorts the group in one task. Here the cuts are found first: the range of values that
holds each cut's rank is narrowed by percentiles and exact counts, each one aggregate over all rows, until few
distinct values are left. The cuts then are literals, so a row's tile depends on the row alone and on no setting.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a range whose distinct values may come to the driver, and the error of the percentiles that narrow a range.
FEW = 20_000
ACCURACY = 10_000


@dataclass
class _Range:
    """Values from lo to hi hold the rank, counted within them; `rows` are in the range."""

    key: object
    rank: int
    lo: float
    hi: float
    rows: int


def _in(r: _Range) -> Column:
    return F.col("key").eqNullSafe(F.lit(r.key)) & F.col("x").between(F.lit(r.lo), F.lit(r.hi))


def _one(rows: DataFrame, wanted: dict[str, Column]) -> dict:
    return rows.agg(*[c.alias(name) for name, c in wanted.items()]).first().asDict() if wanted else {}


def values_at(rows: DataFrame, ranks: list[_Range], few: int = FEW) -> list[tuple[object, int, int]]:
    """rows: key, x. For every range the value at its rank, the rank among the rows that have this value, and their number."""
    ranks = list(ranks)
    while wide := [(i, r) for i, r in enumerate(ranks) if r.rows > few and r.lo < r.hi]:
        # Ranks that still share a range share one digest of it.
        shared: dict[tuple, list] = {}
        for i, r in wide:
            shared.setdefault((r.key, r.lo, r.hi), []).append((i, r))
        near, place = {}, {}
        for j, mine in enumerate(shared.values()):
            at = [r.rank / r.rows for _, r in mine]
            near[f"p{j}"] = F.percentile_approx(F.when(_in(mine[0][1]), F.col("x")), [p for a in at for p in (max(0.0, a - 2 / ACCURACY), min(1.0, a + 2 / ACCURACY))], ACCURACY)
            place |= {i: (f"p{j}", 2 * k) for k, (i, _) in enumerate(mine)}
        found, counts = _one(rows, near), {}
        for i, r in wide:
            name, k = place[i]
            lo, hi = found[name][k : k + 2]
            counts[f"b{i}"] = F.count_if(_in(r) & (F.col("x") < F.lit(lo)))
            counts[f"n{i}"] = F.count_if(_in(r) & F.col("x").between(F.lit(lo), F.lit(hi)))
        n = _one(rows, counts)
        for i, r in wide:
            name, k = place[i]
            (lo, hi), below, inside = found[name][k : k + 2], n[f"b{i}"], n[f"n{i}"]
            # The percentiles' error is bounded, so the rank is inside; a range that can't shrink ends the search.
            stuck = not below < r.rank <= below + inside or inside == r.rows
            ranks[i] = _Range(r.key, r.rank, r.lo, r.hi, 0) if stuck else _Range(r.key, r.rank - below, lo, hi, inside)
    counted = rows.where(functools.reduce(operator.or_, map(_in, ranks))).groupBy("key", "x").count().collect() if ranks else []
    out = []
    for r in ranks:
        left = r.rank
        for x, n in sorted((c["x"], c["count"]) for c in counted if c["key"] == r.key and r.lo <= c["x"] <= r.hi):
            if n >= left:
                out.append((x, left, n))
                break
            left -= n
    return out


def tile_cuts(rows: DataFrame, tiles: int, few: int = FEW) -> dict[object, list[tuple[object, object]]]:
    """rows: key, x, id (x not null, ids distinct in a key) -> for each key the last (x, id) of every tile but the last.

    There are few keys. Equal values are parted by id, so ties of any number are cut exactly.
    """
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    ranges = [_Range(g["key"], t * (g["n"] // tiles) + min(t, g["n"] % tiles), g["lo"], g["hi"], g["n"]) for g in groups for t in range(1, tiles)]
    if not ranges:
        return {}
    at = values_at(rows, ranges, few)
    marks = F.array_compact(F.array(*[F.when(F.col("key").eqNullSafe(F.lit(r.key)) & (F.col("x") == F.lit(x)), F.lit(i)) for i, (r, (x, *_)) in enumerate(zip(ranges, at, strict=True))]))
    same = rows.select(F.explode(marks).alias("key"), F.col("id").alias("x"))
    ids = values_at(same, [_Range(i, left, -(2**63), 2**63 - 1, n) for i, (_, left, n) in enumerate(at)], few)
    out: dict[object, list[tuple[object, object]]] = {}
    for r, (x, *_), (i, *_) in zip(ranges, at, ids, strict=True):
        out.setdefault(r.key, []).append((x, i))
    return out


def with_tile(rows: DataFrame, x: str, id_: str, tiles: int, out: str, key: str | None = None, few: int = FEW) -> DataFrame:
    """Adds the tile 1..tiles of each row by (x, id) among the rows that share its key; x must not be null."""
    k = F.lit(0) if key is None else F.col(key)
    narrow = rows.select(k.alias("key"), F.col(x).cast("double").alias("x"), F.col(id_).cast("long").alias("id")).persist()
    cuts = tile_cuts(narrow, tiles, few)
    narrow.unpersist()
    place = F.struct(F.col(x).cast("double").alias("x"), F.col(id_).cast("long").alias("id"))
    tile = F.lit(None).cast("int")
    for value, ends in cuts.items():
        mine = sum([(place > F.struct(F.lit(float(v)).alias("x"), F.lit(i).cast("long").alias("id"))).cast("int") for v, i in ends], F.lit(1))
        tile = F.when(k.eqNullSafe(F.lit(value)), mine).otherwise(tile)
    return rows.withColumn(out, tile)


def with_tile_nulls_last(rows: DataFrame, x: str, id_: str, tiles: int, out: str, key: str | None = None, few: int = FEW) -> DataFrame:
    """with_tile, where rows whose x is null (or infinite) come behind all others, by id."""
    held = f"__{out}_by"
    placed = rows.withColumn(held, F.coalesce(F.col(x).cast("double"), F.lit(float("inf"))))
    return with_tile(placed, held, id_, tiles, out, key, few).drop(held)
