import random
from math import comb

from helpers import LOWER, frame, words

from tessera.llm.near_dedup import MINIMA, PACKED, near_dedup, near_share, tree_count


def shingles(t):
    w = words((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def want_kept(rows, percent):
    sets, parent = {d: shingles(t) for d, t, *_ in rows}, {d: d for d, *_ in rows}
    find = lambda x: x if parent[x] == x else find(parent[x])
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d for d in ids if find(d) == d}


def test_near_at_eighty_percent(spark):
    r, rows = random.Random(2), []
    for i in range(60):
        # Two edits in 94 words leave 80 of 100 shingles; one edit more leaves fewer.
        base = [f"b{i}w{r.randrange(10**6)}" for _ in range(94)]
        for j, places in enumerate(((), (30, 60), (20, 45, 70))):
            w = list(base)
            for k in places:
                w[k] = f"edit{i}x{j}x{k}"
            rows.append((3 * i + j, " ".join(w), "en", "s", 1))
    assert len(shingles(rows[0][1]) & shingles(rows[1][1])) * 100 == 80 * len(shingles(rows[0][1]) | shingles(rows[1][1]))
    want = want_kept(rows, 80)
    assert want != want_kept(rows, 85)
    assert {x["doc_id"] for x in near_dedup(frame(spark, rows), percent=80).where("kept").collect()} == want


def test_share_and_trees_follow_the_limit():
    for percent in (60, 80, 85, 90):
        x, need = percent / 100, round(near_share(percent) * MINIMA)
        below = [comb(MINIMA, k) * x**k * (1 - x) ** (MINIMA - k) for k in range(need + 1)]
        assert sum(below[:-1]) <= 1e-5 < sum(below)
        assert (1 - x**PACKED) ** tree_count(percent) <= 1e-5 or tree_count(percent) == 64
    assert (tree_count(85), tree_count(80)) == (16, 22)
