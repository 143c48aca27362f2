import os
from collections import Counter

import duckdb
import pytest
from helpers import awkward, frame
from test_dedup import want_near
from test_native import LABELS

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    good = [(500 + i, " ".join(f"g{(i * 31 + j * (i + 3)) % 211}" for j in range(120)), "en", f"s{i % 3}", 1) for i in range(20)]
    frame(spark, awkward() + good).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(500 + i, 1, 0) for i in range(10)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    start = docs.count()
    for name, stage in p.STAGES[:-1]:
        before = docs.collect()
        out = stage(spark, docs, folder)
        assert tuple(out.columns) == p.COLUMNS
        after = out.collect()
        if name == "near-duplicates":
            want = want_near([tuple(r) for r in before], p.NEAR_PERCENT)
            assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in before if r["doc_id"] is None or want[r["doc_id"]][1] == r["doc_id"])
        if name == "mixing":
            assert max(Counter(repr(r) for r in after).values()) <= 2 * max(Counter(repr(r) for r in before).values())
        elif name != "line dedup":
            assert not Counter(map(repr, after)) - Counter(map(repr, before))
        assert after
        docs = spark.createDataFrame(after, docs.schema)
    assert docs.count() < 2 * start
    tokens = p.STAGES[-1][1](spark, docs, folder).collect()
    assert len(tokens) == docs.count() and all(r["n_tokens"] == len(r["ids"]) for r in tokens)
    assert p.run(spark, folder).count() == len(tokens)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", ["op1_chat_format", "op3_exact_dedup", "op7_line_dedup"])
def test_sql(spark, name):
    from tessera.llm import queries

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out = queries.QUERIES[name](spark, SF)
    ref = con.execute(queries.SQL[name])
    cols = [d[0] for d in ref.description]
    order = [cols.index(c) for c in out.columns]
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in ref.fetchall())
