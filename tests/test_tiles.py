"""Tiles equal those of ntile under any partitioning and adaptive setting, with ties of any number."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.tiles import tile_cuts, with_tile, with_tile_nulls_last


@pytest.fixture
def rows(spark):
    r = random.Random(3)
    data = [(i * 7 % 1501, r.choice("abc"), r.choice((round(r.gauss(0, 1), 2), 0.5, r.random()))) for i in range(1500)] + [(10**9 + i, "d", float(i)) for i in range(2)]
    return spark.createDataFrame(data, "id long, k string, x double")


@pytest.mark.parametrize("parts", [1, 3, 8, 50])
@pytest.mark.parametrize("adaptive", [True, False])
def test_tiles_equal_ntile(spark, rows, parts, adaptive):
    settings = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.enabled": str(adaptive).lower(), "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = rows.repartition(parts)
        out = with_tile(with_tile(df, "x", "id", 3, "t", few=50), "x", "id", 5, "tk", key="k")
        got = [tuple(r) for r in out.select("x", "id", "k", "t", "tk").collect()]
        for key in (None, *"abcd"):
            tiles, mine = (3, sorted(got)) if key is None else (5, sorted(r for r in got if r[2] == key))
            size, more = divmod(len(mine), tiles)
            want = [t + 1 for t in range(tiles) for _ in range(size + (t < more))]
            assert [r[3 if key is None else 4] for r in mine] == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_no_rows_and_one_value(spark):
    none = spark.createDataFrame([], "key int, x double, id long")
    assert tile_cuts(none, 3) == {}
    same = spark.range(1000).select(F.lit(0).alias("key"), F.lit(2.5).alias("x"), "id")
    assert tile_cuts(same, 4, few=10) == {0: [(2.5, 249), (2.5, 499), (2.5, 749)]}


def test_nulls_come_last(spark):
    rows = [(i, None if i % 3 == 0 else float(i % 7)) for i in range(40)]
    got = {r.id: r.t for r in with_tile_nulls_last(spark.createDataFrame(rows, "id long, x double"), "x", "id", 4, "t").collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert got == {i: 1 + k // 10 for k, (i, _) in enumerate(order)}
