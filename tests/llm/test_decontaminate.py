"""Decontamination against a loop over every window, with every awkward row."""

import hashlib
import random
import re

import duckdb
import pytest
from helpers import DOCS, LOWER, awkward, frame

from tessera.llm import decontaminate as d
from tessera.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, n_hit long, words string"


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, window=10):
    found = {}
    for i, t, *_ in items:
        w = words(t)
        k = min(window, len(w))
        for s in range(len(w) - k + 1) if k else ():
            found.setdefault(tuple(w[s : s + k]), set()).add(i)
    lengths = {len(w) for w in found}
    out = []
    for doc_id, t, *_ in docs:
        w, hit, ids = words(t), set(), set()
        for k in lengths:
            for s in range(len(w) - k + 1):
                if (got := found.get(tuple(w[s : s + k]))) is not None:
                    hit |= set(range(s, s + k))
                    ids |= got
        names = sorted(str(i) for i in ids if i is not None)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


def made(seed=5):
    r = random.Random(seed)
    vocab = ["a", "b", "the", "of", "É", "é", "Σ", "İ", "日本", "x1", "K", "ß", "w7"]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, say(r.choice([1, 3, 4, 6, 9, 10, 11, 30])) if i % 5 else "rare%d " % i * 3 + say(12), 1, "w") for i in range(40)]
    items += [(100, None, None, None), (101, "", 2, ""), (102, "!?", 2, ""), (None, "only without an id stands here", 2, ""), (3, "another text of the third item with more than ten words in it", 0, "")]
    items += [items[7], (200, items[7][1], 0, "")]
    docs = awkward(n=20)
    for i in range(60):
        t = say(r.choice([0, 5, 12, 80]))
        if i % 2:
            w = words(r.choice(items)[1])
            cut = w[r.randint(0, 3) :]
            t = t + " -- " + ", ".join(x.upper() if i % 4 == 1 else x for x in cut) + "; " + say(4)
        docs.append((300 + i, t, "en", "s", 1))
    docs.append((500, (say(700) + " " + items[5][1] + " ") * 3, "en", "s", 1))
    return docs, items


@pytest.mark.parametrize("window,block", [(10, 512), (10, 16), (4, 7), (1, 5)])
def test_equals_brute_force(spark, window, block):
    docs, items = made()
    assert got(d.decontaminate(frame(spark, docs), frame(spark, items, ITEMS), window, block)) == brute(docs, items, window)


def test_large_benchmarks_go_in_parts(spark, monkeypatch):
    monkeypatch.setattr(d, "PART_ROWS", 30)
    monkeypatch.setattr(d, "LIKELY_ROWS", 3)
    docs, items = made(6)
    assert got(d.decontaminate(frame(spark, docs), frame(spark, items, ITEMS))) == brute(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    docs, items = made()
    clash = frame(spark, docs).selectExpr("*", "1 as n_words", "2 as rid", "'x' as words", "3 as start", "4 as k", "5 as shingle", "6 as met")
    assert got(d.decontaminate(clash, frame(spark, [], ITEMS))) == brute(docs, [])
    assert got(d.decontaminate(clash, frame(spark, items, ITEMS))) == brute(docs, items)
    assert got(d.decontaminate(frame(spark, [], DOCS), frame(spark, items, ITEMS))) == []


def test_one_passage_in_all_documents_and_items(spark):
    passage = "this common passage of eleven words stands in every single text"
    docs = [(i, f"head{i} {passage} tail{i} " * (1 + i % 2), "en", "s", 1) for i in range(300)]
    items = [(i, f"{passage} and item{i}", 1, "") for i in range(200)]
    assert got(d.decontaminate(frame(spark, docs), frame(spark, items, ITEMS))) == brute(docs, items)


def test_only_rarest_shingles_are_searched_for(spark):
    windows = spark.createDataFrame([(1, "a b c d e f g h i j", 10, 1), (2, "k l m n o p q r s t", 10, 2)], "wid long, text string, k int, set_id long")
    per = d.window_shingles(windows)
    seen = per.where("wid = 1").selectExpr("shingle", "cast(10 - at as bigint) as n").unionByName(per.where("wid = 2 and at < 5").selectExpr("shingle", "1L as n"))
    out = d.rarest(windows, per, seen).collect()
    assert [(r["text"][0], r["at"]) for r in out] == [("a", 5)]


def test_query_equals_sql_and_uses_no_python_workers(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(queries.SQL["op13_decontamination"])
    cols = [c[0] for c in cur.description]
    out = queries.op13_decontamination(spark, sf).select(*cols)
    want = sorted(cur.fetchall())
    assert sorted(map(tuple, out.collect())) == want
    assert sum(r[cols.index("contaminated")] for r in want) > 0
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
