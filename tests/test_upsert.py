"""Keyed tables: what a merge changes, what it leaves, and what a merge that dies leaves behind."""

import pytest
from pyspark.sql import functions as F

from tessera.sources.upsert import KeyedTable

ROWS = "report string, loan long, noi double, note string"


def rows_of(df):
    return sorted(map(tuple, df.select("report", "loan", "noi", "note").collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/t", ("report", "loan"), buckets=8)


def test_merge_replaces_adds_and_keeps(spark, table):
    assert table.read() is None
    assert table.merge(spark.createDataFrame([("a", 1, 1.0, "x"), ("a", 2, 2.0, "y"), ("b", 1, 3.0, "z"), (None, 1, 9.0, "n")], ROWS))
    second = spark.createDataFrame([("a", 1, None, "new"), ("c", 1, 5.0, None), (None, 1, 8.0, "n")], ROWS)
    assert table.merge(second, keep=("noi",))
    want = sorted([("a", 1, 1.0, "new"), ("a", 2, 2.0, "y"), ("b", 1, 3.0, "z"), ("c", 1, 5.0, None), (None, 1, 8.0, "n")], key=repr)
    assert rows_of(table.read()) == want
    assert not table.merge(second, keep=("noi",)) and table.versions() == [1, 2]
    assert len(rows_of(table.read(1))) == 4


def test_only_touched_buckets_are_written(spark, table):
    table.merge(spark.range(50).select(F.concat(F.lit("r"), F.col("id") % 20).alias("report"), F.col("id").alias("loan"), F.lit(1.0).alias("noi"), F.lit("").alias("note")))
    before = table._list(1)["buckets"]
    table.merge(spark.createDataFrame([("r3", 3, 7.0, "")], ROWS))
    after = table._list(2)["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and set(before) == set(after)
    assert table.read().where("noi = 7").count() == 1 and table.read().count() == 50


def test_repeated_keys_take_the_latest(spark, table):
    rows = spark.createDataFrame([("a", 1, 1.0, "x", 2), ("a", 1, 2.0, "y", 3), ("a", 1, 3.0, "z", 1)], ROWS + ", seq int")
    table.merge(rows, order="seq")
    assert rows_of(table.read()) == [("a", 1, 2.0, "y")]


def test_a_merge_that_dies_changes_nothing(spark, table, monkeypatch):
    table.merge(spark.createDataFrame([("a", 1, 1.0, "x")], ROWS))
    with monkeypatch.context() as m:
        m.setattr(table.files, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            table.merge(spark.createDataFrame([("a", 1, 2.0, "y"), ("b", 1, 1.0, "z")], ROWS))
    assert rows_of(table.read()) == [("a", 1, 1.0, "x")]
    assert table.merge(spark.createDataFrame([("a", 1, 2.0, "y")], ROWS)) and rows_of(table.read()) == [("a", 1, 2.0, "y")]
    assert table.vacuum(1) == 2 and rows_of(table.read()) == [("a", 1, 2.0, "y")]


def test_two_merges_at_once_and_other_columns(spark, table):
    table.merge(spark.createDataFrame([("a", 1, 1.0, "x")], ROWS))
    with pytest.raises(RuntimeError):
        table.files.publish(f"{table.path}/versions/00000001.json", "{}")
    with pytest.raises(ValueError):
        table.merge(spark.createDataFrame([("a", 1)], "report string, loan long"))
    assert not table.merge(spark.createDataFrame([], ROWS))
