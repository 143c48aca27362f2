import math
from collections import Counter

from helpers import awkward, frame, words
from pyspark.sql import functions as F

from tessera.llm.mixing import mix, source_targets
from tessera.llm.quality_rules import BUCKETS, quality_rules

LABELS = "doc_id long, quality int, toxic int"


def want_targets(sizes, share=1.5, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        free = sum(w[s] for s in order if s not in full)
        t = {s: 2 * sizes[s] if s in full else rest * w[s] / free for s in order}
        over = {s for s in order if s not in full and t[s] > 2 * sizes[s]}
        if not over:
            return t
        full |= over


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 30, None: 5}, {"a": 100, "b": 100, "c": 100, "d": 100}, {"é": 7, "z": 0, "Z": 50}):
        got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = want_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix(spark):
    rows = awkward(n=300)
    docs = frame(spark, rows).withColumn("size", F.lit("x")).withColumn("target", F.lit("x"))
    got = mix(docs, carry=("source",)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    want = want_targets(sizes)
    taken = Counter()
    for r in got:
        s = r["in_source"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
    largest = {s: max(len(words(t)) for _, t, _, s2, _ in rows if s2 == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= max(largest[s], 0.02 * want[s]) for s in sizes)
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, mix(docs, carry=("source",)).collect()))
    assert mix(frame(spark, [])).count() == 0


def want_base(t):
    w = words(t)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality(spark):
    rows = awkward() + [(200, "a b c a b c x\nq\nq\n\n q", "en", "s", 1), (201, "### $$ |", "en", "s", 1)]
    good = " ".join(f"good{i % 40}" for i in range(100))
    junk = " ".join(f"&&&{i % 9}" for i in range(90))
    rows += [(300 + i, good + f" {i}", "en", "s", 1) for i in range(30)] + [(400, junk + " " + " ".join(f"{i}" for i in range(100)), "en", "s", 1)]
    labels = spark.createDataFrame([(300 + i, 1, 0) for i in range(20)] + [(400, 0, 0), (5, 1, 1), (None, 1, 0)], LABELS)
    got = quality_rules(frame(spark, rows).withColumn("words", F.lit("x")).withColumn("bucket", F.lit("x")), labels).collect()
    key = lambda x: repr(x)
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got), key=key) == sorted(((d, *want_base(t)) for d, t, *_ in rows), key=key)
    assert all(not r["kept"] for r in got if r["base_failed"])
    by = {r["doc_id"]: r for r in got}
    assert by[400]["llr"] < by[325]["llr"]


def test_quality_score_is_the_mean_ratio(spark):
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(60)), "en", "s", 1) for i in range(1, 12)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS)
    bucket = {r["w"]: r["b"] for r in spark.createDataFrame([(f"w{i}",) for i in range(17)], "w string").select("w", F.pmod(F.xxhash64(F.lit(1), "w"), F.lit(BUCKETS)).alias("b")).collect()}
    raw, good = Counter(), Counter()
    for d, t, *_ in rows:
        for w in t.split():
            raw[bucket[w]] += 1
            good[bucket[w]] += d in (1, 2)
    n, g = sum(raw.values()), sum(good.values())
    p = lambda b: (raw[b] + 1) / (n + BUCKETS)
    llr = lambda b: math.log((good[b] + BUCKETS * p(b)) / (g + BUCKETS)) - math.log(p(b))
    for r in quality_rules(frame(spark, rows), labels).collect():
        ws = dict((x[0], x[1]) for x in rows)[r["doc_id"]].split()
        assert abs(r["llr"] - sum(llr(bucket[w]) for w in ws) / len(ws)) < 1e-9


def test_quality_without_trusted_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    text = " ".join(f"w{i}" for i in range(80))
    assert [r["kept"] for r in quality_rules(frame(spark, [(1, text, None, None, 1), (2, None, None, None, None)]), none).orderBy("doc_id").collect()] == [True, False]
    assert quality_rules(frame(spark, []), none).count() == 0
