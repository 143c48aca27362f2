import hashlib
from collections import defaultdict

import pytest
from helpers import LOWER, awkward, frame, words
from pyspark.sql import functions as F

from tessera.llm import exact_dedup as ex
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.line_dedup import SortedRuns, line_dedup
from tessera.llm.near_dedup import near_dedup
from tessera.llm.substring_dedup import SuffixAutomaton, substring_dedup


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def key(rows):
    return sorted(rows, key=repr)


def clashing(df):
    """Extra columns with names that the operators might use."""
    for name in ("keep_id", "h", "ph", "k", "sig", "words", "marks", "gone", "size", "label", "rep", "start", "anchor"):
        df = df.withColumn(name, F.lit("extra"))
    return df


@pytest.mark.parametrize("table_bytes", [64 << 20, 2000])
def test_exact(spark, monkeypatch, table_bytes):
    rows = awkward()
    assert sorted(map(tuple, ex.grace(iter([(r[1] or "", r[0], 1) for r in rows]), table_bytes=table_bytes)), key=repr) == key(want_groups(rows))
    group = {t: (k, n) for t, k, n in want_groups(rows)}
    want = [(d, *group[t or ""], d is not None and d == group[t or ""][0], sha(t or "")) for d, t, *_ in rows]
    got = [tuple(r) for r in exact_dedup(clashing(frame(spark, rows))).collect()]
    assert key(got) == key(want)


def want_groups(rows):
    group = defaultdict(list)
    for d, t, *_ in rows:
        group[t or ""].append(d)
    return [(t, max((x for x in ids if x is not None), default=None), len(ids)) for t, ids in group.items()]


def test_table_compares_content():
    table = ex.ContentTable(slots=4)
    for i in range(50):
        table.add(f"text {i % 10}", 7, i, 1)  # one hash for all
    assert [(x[0], x[1], x[2]) for x in table.items] == [(f"text {i}", 40 + i, 5) for i in range(10)]


def test_lines(spark):
    rows = awkward()
    held = defaultdict(set)
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for d, t, *_ in rows:
        if d is not None:
            for x in (t or "").split("\n"):
                held[norm(x)].add(d)
    hot = {k: max(v) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    want = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or hot.get(norm(x), d) == d]
        want.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert any(w[3] for w in want)
    for batches in (1, 4, 7):
        got = [tuple(r) for r in line_dedup(clashing(frame(spark, rows)), batches=batches).collect()]
        assert key(got) == key(want)


def test_runs_compact(spark):
    store = SortedRuns(spark, fanin=2)
    for k in (3, 2, 1, 0):
        store.add(spark.createDataFrame([(k * 10 + i, bytes([i])) for i in range(3)], "doc_id long, h binary"))
    assert [len(x) for x in store.levels] == [0, 0, 1]
    got = {bytes(r["h"]): (r["n_docs"], r["holder"]) for r in store.merged(store.runs()).collect()}
    assert got == {bytes([i]): (4, 30 + i) for i in range(3)}
    # Runs meet bucket by bucket: merging two of them deals nothing.
    for k in (5, 4):
        store.add(spark.createDataFrame([(k - 10, bytes([k]))], "doc_id long, h binary"))
    plan = store.merged(store.runs())._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange" not in plan
    store.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tessera_run")]


def test_hot_lines_are_dealt(spark, monkeypatch):
    from tessera.llm import line_dedup as module

    monkeypatch.setattr(module, "HOT_LEAST", 5)
    rows = [(d, h) for d in range(40) for h in ((b"hot", b"own%d" % d) if d % 2 else (b"hot", b"few"))]
    lines = spark.createDataFrame(rows, "doc_id long, h binary")
    drop = module.repeated_lines(lines, 3)
    got = {(r["doc_id"], bytes(r["h"])) for r in module.lost_lines(lines, drop).collect()}
    assert got == {(d, b"hot") for d in range(39)} | {(d, b"few") for d in range(0, 38, 2)}


def want_near(rows, percent=85):
    sets, parent = {}, {}
    for d, t, *_ in rows:
        w = words((t or "").translate(LOWER))
        s = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        if d is not None:
            sets[d], parent[d] = s, d
    find = lambda x: x if parent[x] == x else find(parent[x])
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("deep", [2000, 2])
def test_near(spark, deep):
    rows = awkward(n=40)
    want = want_near(rows)
    got = near_dedup(clashing(frame(spark, rows)), deep=deep).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (*want[r["doc_id"]], want[r["doc_id"]][1] == r["doc_id"])


def want_substring(rows):
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            w = words(t)
            for i in range(len(w) - 12):
                k = tuple(w[i : i + 13])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t, *_ in rows:
        w = words(t)
        gone = set()
        if d is not None:
            for i in range(len(w) - 12):
                if first[tuple(w[i : i + 13])] < d:
                    gone.update(range(i, i + 13))
        out.append((d, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return out


@pytest.mark.parametrize("shard_pieces", [2000, 1])
def test_substring(spark, shard_pieces):
    rows = awkward()
    want = want_substring(rows)
    assert any(x[3] for x in want)
    got = [tuple(r) for r in substring_dedup(clashing(frame(spark, rows)), shard_pieces).collect()]
    assert key(got) == key(want)


def test_automaton():
    a = SuffixAutomaton()
    texts = [(1, "abcabcd"), (2, "bcdabca"), (3, "zzabcabz")]
    for owner, t in texts:
        a.add(t, owner)
    for size in (2, 3, 4):
        for _, t in texts:
            want = [min((o for o, u in texts if t[i : i + size] in u)) for i in range(len(t) - size + 1)]
            assert a.owners(t, size) == want
    assert a.owners("qab", 2) == [None, 1]


@pytest.mark.parametrize("operator", [exact_dedup, line_dedup, near_dedup, substring_dedup])
def test_empty_table(spark, operator):
    assert operator(frame(spark, [])).count() == 0
