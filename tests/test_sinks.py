"""Harvests replace their own rows only; snapshots are compared with the one before."""

import json
from pathlib import Path

from tessera.sources import sinks

LOANS = "loan_id long, accession string, row_index int, name string"


def test_harvest_is_replaced_and_read_back(spark, tmp_path):
    path = str(tmp_path / "loans")
    sinks.save_harvest(spark.createDataFrame([(1, "1-2020", 2, "b"), (2, "1-2020", 1, "a"), (3, "2-2020", 1, "c")], LOANS), path)
    sinks.save_harvest(spark.createDataFrame([(9, "1-2020", 1, "new")], LOANS), path)
    assert [(r.loan_id, r.accession) for r in sinks.load_harvest(spark, path).collect()] == [(9, "1-2020"), (3, "2-2020")]
    assert [r.name for r in sinks.load_harvest(spark, path, "2-2020").collect()] == ["c"]


def test_harvest_as_json(spark, tmp_path):
    loans = spark.createDataFrame([(1, "x", 2, "b"), (2, "x", 1, "a")], LOANS)
    seen = spark.createDataFrame([(1, "ltv", "0.5", "LTV", 0.9), (1, "dscr", "2", "DSCR", 0.9)], "loan_id long, metric_key string, value string, source_header string, confidence double")
    sinks.harvest_json(loans, seen, str(tmp_path / "j"))
    (row,) = [json.loads(x) for p in Path(tmp_path, "j").glob("part-*") for x in p.read_text().splitlines()]
    assert [x["loan_id"] for x in row["loans"]] == [2, 1] and [o["metric_key"] for o in row["loans"][1]["observations"]] == ["dscr", "ltv"]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "s")
    of = lambda *rows: spark.createDataFrame(rows, "metric string, value double, notable double")
    sinks.append_snapshot(of(("ltv", 0.5, 0.02), ("dscr", 2.0, 0.1)), path, "2024-01")
    assert sinks.last_moves(spark, path).count() == 0
    sinks.append_snapshot(of(("ltv", 0.6, 0.02), ("dscr", 2.1, 0.1), ("new", 1.0, 0.1)), path, "2024-02")
    assert {r.metric: (round(r.rel, 6), r.moved) for r in sinks.last_moves(spark, path).collect()} == {"ltv": (0.2, True), "dscr": (0.05, False)}
