"""Importance resampling against plain loops, its hash and table against the library and a dict."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from helpers import LOWER, awkward, frame
from pyspark.sql import functions as F

from tessera.llm import queries
from tessera.llm.common import durable
from tessera.llm.importance import Interned, eights, features, importance_resample, with_top_ranks, xxh64

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BENCH = "item_id long, text string, score string"
ITEMS = [(1, "The w1 w2 W3 w4 É ß", "x"), (2, None, ""), (3, "", None), (None, "w5 w5 w5 日本", "y"), (1, "The w1 w2 W3 w4 É ß", "x")]


def grams(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, bench, n=1, percent=10, least=20, buckets=10_000):
    bucket = lambda g: zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets
    count = lambda texts: np.bincount([bucket(g) for t in texts for g in grams(t, n)[1]], minlength=buckets) if any(grams(t, n)[1] for t in texts) else np.zeros(buckets)
    s, t = count([r[1] for r in docs]), count([r[1] for r in bench])
    s_all, t_all = float(s.sum()), float(t.sum())
    gain = lambda g: math.floor(1000 * math.log((t[bucket(g)] + 1.0) * (t_all * 0 + s_all + buckets) / ((s[bucket(g)] + 1.0) * (t_all + buckets))))
    rows = []
    for doc_id, text, *_ in docs:
        words, gs = grams(text, n)
        weight = sum(map(gain, gs)) // len(gs) if gs else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, words, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    drawn = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("n,percent", [(1, 10), (2, 50), (3, 100), (1, 0)])
def test_equals_brute_force(spark, n, percent):
    docs = awkward() + [(200 + i, "w%d " % (i % 9) * 25, "en", "s", 1) for i in range(60)]
    out = importance_resample(frame(spark, docs), frame(spark, ITEMS, BENCH), ngrams=n, percent=percent)
    assert got(out) == brute(docs, ITEMS, n, percent)


def test_empty_tables_and_clashing_columns(spark):
    docs = frame(spark, awkward()).selectExpr("*", "1 as score", "2 as rank", "'x' as bucket", "3 as weight")
    assert got(importance_resample(docs, frame(spark, [], BENCH))) == brute(awkward(), [])
    assert got(importance_resample(docs.limit(0), frame(spark, ITEMS, BENCH))) == []


def test_one_repeated_id_and_equal_scores(spark):
    rows = durable(frame(spark, [(7, 5) for _ in range(500)] + [(i, i % 4) for i in range(300)] + [(None, 5)] * 3, "doc_id long, score long"), "rows")
    out = with_top_ranks(rows, F.col("score") >= 3, 520).collect()
    ranked = sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])
    assert len(out) == 803 and [r["rank"] for r in ranked] == list(range(1, 521))
    assert [(r["score"], r["doc_id"]) for r in ranked] == [(5, 7)] * 500 + [(5, None)] * 3 + [(3, i) for i in range(3, 71, 4)]


def test_hash_is_xxh64_and_table_counts(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcé日0") for _ in range(r.randint(1, 45))) for _ in range(300)] + ["x" * k for k in range(1, 70)]
    text = " ".join(r.choice(words) for _ in range(5000)) + " " + " ".join(words)
    raw, start, end, _, _ = features([text, "", "..", text[:50]], 1)
    spelled = [raw[s:e].tobytes() for s, e in zip(start, end)]
    assert spelled == [w.encode() for x in (text, text[:50]) for w in x.split(" ") if w]
    keys = xxh64(raw, eights(raw), start, end)
    assert keys.tolist() == [xxhash.xxh64_intdigest(w) for w in spelled]
    # Whatever the keys are, bytes decide: all features with one key, or with a few.
    for some in (keys, keys % np.uint64(3), keys * np.uint64(0)):
        t = Interned(raw, start, end, 97, some)
        assert len(t.used) == len(set(spelled)) and t.count.sum() == len(spelled)
        assert all(spelled[t.owner[k]] == w for k, w in zip(t.slot, spelled))
        assert all(t.bucket[k] == zlib.crc32(w) % 97 for k, w in zip(t.slot, spelled))


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(queries.SQL["op12_importance_resampling"])
    cols = [d[0] for d in cur.description]
    assert sorted(map(tuple, queries.op12_importance_resampling(spark, sf).select(*cols).collect())) == sorted(cur.fetchall())
