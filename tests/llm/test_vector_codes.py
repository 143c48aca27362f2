"""Vector codes against a loop over every distance, and every awkward row."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from helpers import frame

from tessera.llm import common, queries
from tessera.llm.pivot_codes import choose_pivots, lengths, nearest, pivot_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, v string"


def brute(rows, parts=16, entries=64, rounds=2):
    ok = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label, *_ in ok]
    if not ok:
        return []
    d = len(ok[0][1]) // parts
    cut = lambda v, k: v[k * d : k * d + d]
    first = sorted(ok, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(r[1], k) for r in first] for k in range(parts)]
    find = lambda k, p: min((sum((a - b) ** 2 for a, b in zip(p, e)), j) for j, e in enumerate(books[k]))
    for _ in range(rounds):
        for k in range(parts):
            mine = [(find(k, cut(v, k))[1], cut(v, k)) for _, v, _ in ok]
            for j in range(len(books[k])):
                if got := [p for e, p in mine if e == j]:
                    books[k][j] = [sum(c) // len(got) for c in zip(*got)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, label in ok:
        picks = [find(k, cut(v, k)) for k in range(parts)]
        out.append((i, label, "".join("%02x" % j for _, j in picks), sum(e for e, _ in picks)))
    return [(*r, sum(o[3] for o in out if o[1] == r[1]), digest) for r in out]


def made(n=150, dim=32, seed=3):
    r = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.float32(r.normal(0, 0.2, dim))], int(i % 3) if i % 7 else None, "clash", "v") for i in r.permutation(n)]
    same = rows[5][1]
    rows += [(1000 + i, same, 9, None, None) for i in range(40)]
    rows += [(2000, None, 1, "", ""), (2001, [*same[:-1], None], 1, "", ""), (2002, [*same[:-1], math.nan], 1, "", ""), (-5, [*same[:-1], math.inf], 1, "", "")]
    rows += [(2003, [0.0] * dim, 4, "", ""), (2003, [0.0] * dim, 4, "", ""), (None, same, None, None, None), (2004, [-0.5 / 256] * dim, 4, "", ""), (2005, [1000.0] * dim, 4, "", "")]
    return rows


def got(df):
    return sorted(map(tuple, df.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_codes_equal_brute_force(spark):
    rows = made()
    assert got(pivot_codes(frame(spark, rows, VECTORS))) == sorted(brute(rows), key=repr)


def test_fewer_vectors_than_entries_other_lengths_and_huge_components(spark):
    rows = made(20)[:20]
    rows = [r for r in rows if r[0] < 1000]
    odd = [(500, [0.5] * 7, 1, "", ""), (501, [], 1, "", ""), (502, [0.5] * 48, 1, "", ""), (503, [3e38] * 32, 1, "", "")]
    assert got(pivot_codes(frame(spark, rows + odd, VECTORS))) == sorted(brute(rows), key=repr)


def test_one_part_of_many_components_and_other_parameters(spark):
    rows = made(60, 24)
    assert got(pivot_codes(frame(spark, rows, VECTORS), parts=3, entries=5, rounds=4, n_pivots=2)) == sorted(brute(rows, 3, 5, 4), key=repr)


def test_empty(spark):
    assert got(pivot_codes(frame(spark, [], VECTORS))) == []
    assert got(pivot_codes(frame(spark, [(1, None, 2, "", "")], VECTORS))) == []


def test_totals_of_many_labels_are_joined_by_salt(spark):
    rows = frame(spark, [(i, i % 5 or None) for i in range(100)], "vec_id long, label int")
    rows = common.durable(rows, "rows")
    totals = rows.groupBy("label").count()
    want = sorted(map(tuple, common.with_group_totals(rows, "label", totals).collect()), key=repr)
    assert sorted(map(tuple, common.with_group_totals(rows, "label", totals, broadcast_rows=2).collect()), key=repr) == want
    assert len(want) == 100 and all(r[2] == 20 for r in want)


@pytest.mark.parametrize("spread", [3, 300, 100_000_000])
def test_pruned_search_is_exact_and_prunes(spread):
    r = np.random.default_rng(spread)
    book = r.integers(-spread, spread, (64, 4))
    book[7] = book[3]
    x = np.concatenate([r.integers(-spread, spread, (500, 4)), book])
    pivots = choose_pivots(book, 4)
    arg, best, made = nearest(x, lengths(x, pivots), book, pivots)
    every = ((x[:, None] - book) ** 2).sum(-1)
    assert (arg == every.argmin(1)).all() and (best == every.min(1)).all()
    assert made < len(x) * 64 / (2 if spread > 3 else 1)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    cur = con.execute(queries.SQL["op11_vector_codes"])
    cols = [d[0] for d in cur.description]
    assert sorted(map(tuple, queries.op11_vector_codes(spark, sf).select(*cols).collect())) == sorted(cur.fetchall())
