"""MinHash near-duplicate detection with an LSH forest.

Documents with one shingle set are one node. Every set has 256 minima, packed four to a number; tree t of the
forest sorts all sets by the packed numbers of all trees from the t-th on, wrapping round; all of them tell how near
two sets are. Sets that share a tree's first
number form a region: candidates are pairs of a set and a leader met before it. A region with many members is
cut by the next number, to the depth at which its parts are small, and only the leaders of the parts meet above.
Within a region a leader stands for the members that the minima show to be near it, so that a group of copies
gives one candidate pair for each member and not all pairs. Candidates are confirmed on full shingle sets. What
confirmed links leave apart is then looked at again: in regions that hold more than one component, cut into blocks,
each task compares the sets of different components in full where the minima show them to be near, joins
components as it goes and gives only the links that joined some, so that no link hangs on the choice of leaders.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, small_batches, text_or_empty
from .components import components
from .words import chunks, mix, window_hashes, word_hashes

SHINGLE = 5
PERCENT = 85
PACKED = 4
#: Packed numbers of a signature; the first of them order the trees.
NUMBERS = 64
MINIMA = NUMBERS * PACKED
SEED = 11
#: Chance at most, for a pair at the limit, to have too few equal minima, and to share no tree.
MISSED = 1e-5
#: Members from which a region is cut one number deeper.
DEEP = 2_000
#: Members of a region that are held at once, twice over, when its components are compared.
BLOCK = 1_000

_r = np.random.default_rng(SEED)
_FACTORS = (_r.integers(1, 1 << 62, MINIMA, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADDENDS = _r.integers(1, 1 << 62, MINIMA, dtype=np.uint64)


@functools.cache
def near_share(percent: int) -> float:
    """Share of equal minima that makes a pair a candidate: a pair at the limit falls below it by MISSED at most."""
    p, below, need = percent / 100, 0.0, 0
    while need < MINIMA and (below := below + math.comb(MINIMA, need) * p**need * (1 - p) ** (MINIMA - need)) <= MISSED:
        need += 1
    return need / MINIMA


def tree_count(percent: int) -> int:
    """Trees of which a pair at the limit shares the first number of one, but for MISSED; as many as there are numbers at most."""
    shared = (percent / 100) ** PACKED
    return NUMBERS if shared <= 0 else 1 if shared >= 1 else min(NUMBERS, math.ceil(math.log(MISSED) / math.log(1 - shared)))


def shingle_sets(texts: list[str], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; fewer words are one shingle; no words, none."""
    out: list[np.ndarray] = []
    for lo, hi in chunks(texts):
        h, text, *_ = word_hashes(texts[lo:hi], lower=True)
        windows = window_hashes(h, k)
        first = np.searchsorted(text, np.arange(hi - lo + 1))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(windows[a : b - k + 1]))
            elif b > a:
                out.append(window_hashes(h[a:b], b - a))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """NUMBERS packed numbers for each non-empty set: PACKED minima of 16 bits each."""
    flat = np.concatenate(sets)
    start = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.zeros((len(sets), NUMBERS), dtype=np.uint64)
    flat = mix(flat)
    for i in range(MINIMA):
        least = np.minimum.reduceat((flat * _FACTORS[i] + _ADDENDS[i]) >> np.uint64(24), start)
        out[:, i // PACKED] |= (mix(least) & np.uint64(0xFFFF)) << np.uint64(16 * (i % PACKED))
    return out


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _sign(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = shingle_sets(b.column(1).to_pylist())
        full = [k for k, s in enumerate(sets) if len(s)]
        sig: list = [None] * len(sets)
        at = 0
        while at < len(full):  # a bounded number of shingles at once
            part, size = [], 0
            while at < len(full) and (not part or size + len(sets[full[at]]) < 1 << 19):
                part.append(full[at])
                size += len(sets[full[at]])
                at += 1
            for k, row in zip(part, signature([sets[k] for k in part]).view(np.int64).tolist(), strict=True):
                sig[k] = row
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()), pa.array(sig, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "k", "sig"],
        )


def _sets(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = shingle_sets(b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["k", "set"])


def _groups(batches, width: int) -> Iterator[tuple[tuple, list]]:
    """Rows of a sorted stream by their first `width` columns, as (group, rows) pieces; `rows` come batch by batch."""
    for b in batches:
        rows = list(zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True))
        start = 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or rows[k][:width] != rows[start][:width]:
                yield rows[start][:width], rows[start:k]
                start = k


def _minima(sigs: list[list[int]]) -> np.ndarray:
    return np.array(sigs, dtype=np.int64).view(np.uint16).reshape(len(sigs), MINIMA)


def _lead(batches, near: float) -> Iterator[pa.RecordBatch]:
    """Sorted (tree, part, k, sig) -> (tree, region, leader, member): each member's nearest leader; itself if it leads."""
    need = int(np.ceil(near * MINIMA))
    group, leaders, table = None, [], np.zeros((0, MINIMA), np.uint16)
    for key, rows in _groups(batches, 2):
        if key != group:
            group, leaders, table = key, [], np.zeros((16, MINIMA), np.uint16)
        got = []
        for row, minima in zip(rows, _minima([r[3] for r in rows]), strict=True):
            if leaders:
                same = (table[: len(leaders)] == minima).sum(axis=1)
                best = int(same.argmax())
                if same[best] >= need:
                    got.append((leaders[best], row[2]))
                    continue
            if len(leaders) == len(table):
                table = np.concatenate([table, np.zeros_like(table)])
            table[len(leaders)] = minima
            leaders.append(row[2])
            got.append((row[2], row[2]))
        yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(got), pa.int32()), pa.array([x[0] for x in got], pa.binary()), pa.array([x[1] for x in got], pa.binary())], ["tree", "a", "b"])


def _near_enough(s: np.ndarray, u: np.ndarray, percent: int) -> bool:
    if 100 * min(len(s), len(u)) < percent * max(len(s), len(u)):
        return False
    both = len(np.intersect1d(s, u, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(u) - both)


def _across(batches, near: float, percent: int) -> Iterator[pa.RecordBatch]:
    """Sorted (tree, region, p, q, block, k, sig, label, set) -> links that join components, found cell by cell.

    A cell holds two blocks of a region, or one (p = q). A pair is looked at if its ends are still in different
    components and the minima show it to be near; a confirmed link joins the components at once, so that a cell
    gives at most one link for each set.
    """
    need = int(np.ceil(near * MINIMA))

    def linked(cell: tuple, rows: list) -> pa.RecordBatch:
        a, b = [], []
        block, keys, table = np.array([r[4] for r in rows]), [r[5] for r in rows], _minima([r[6] for r in rows])
        part, sets = np.array([r[7] for r in rows], dtype=np.int64), [np.frombuffer(r[8], np.uint64) for r in rows]
        for i in range(1, len(rows)):
            other = part[:i] != part[i]
            if cell[2] != cell[3]:
                other &= block[:i] != block[i]
            other = np.flatnonzero(other)
            for j in other[(table[other] == table[i]).sum(axis=1) >= need].tolist():
                if part[j] != part[i] and _near_enough(sets[i], sets[j], percent):
                    a.append(min(keys[i], keys[j]))
                    b.append(max(keys[i], keys[j]))
                    part[part == part[j]] = part[i]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    cell, held = None, []
    for key, rows in _groups(batches, 4):
        if key != cell:
            if held:
                yield linked(cell, held)
            cell, held = key, []
        held += rows
    if held:
        yield linked(cell, held)


def _confirm(batches, percent: int) -> Iterator[pa.RecordBatch]:
    for t in batches:
        a, b = [], []
        for x, y, s, u in zip(*(t.column(k).to_pylist() for k in range(4)), strict=True):
            if _near_enough(np.frombuffer(s, np.uint64), np.frombuffer(u, np.uint64), percent):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, k (name of the set, null if empty), sig."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_sign, "doc_id long, n_shingles long, k binary, sig array<long>")


def regions(sets: DataFrame, trees: int) -> DataFrame:
    """tree, region, size, k: members of the regions that have two or more sets."""
    rows = sets.select("k", F.posexplode(F.slice("sig", 1, trees)).alias("tree", "region"))
    size = rows.groupBy("tree", "region").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    return rows.join(size, ["tree", "region"]).select("tree", "region", "size", "k")


def leader_pairs(members: DataFrame, sets: DataFrame, trees: int, near: float, deep: int = DEEP) -> DataFrame:
    """Candidate pairs a, b (names of sets)."""
    sig, tree = F.col("sig"), F.col("tree")
    turned = F.concat(F.slice(sig, tree + 1, trees - tree), F.slice(sig, F.lit(1), tree))
    rows = members.join(sets.select("k", "sig"), "k").withColumn("turned", turned)
    # The part of a region in which a set looks for a leader: one number deeper for every `deep` times more members.
    depth = F.least(F.floor(F.log(F.greatest(F.col("size") / deep, F.lit(1))) / F.log(F.lit(float(deep)))) + F.when(F.col("size") > deep, 1).otherwise(0), F.lit(trees - 1))
    rows = durable(rows.withColumn("part", F.xxhash64(F.slice("turned", F.lit(1), (depth + 1).cast("int")))), "members")
    schema = "tree int, a binary, b binary"
    run = functools.partial(_lead, near=near)
    order = lambda df: df.repartition("tree", "part").sortWithinPartitions("tree", "part", "turned", "k").select("tree", "part", "k", "sig").mapInArrow(run, schema)
    low = durable(order(rows), "leaders")
    # The leaders of the parts of a cut region meet in the region itself.
    heads = low.where(F.col("a") == F.col("b")).select("tree", F.col("a").alias("k"))
    top = order(rows.where(F.col("size") > deep).join(heads, ["tree", "k"]).withColumn("part", F.col("region")))
    pairs = low.unionAll(top).where(F.col("a") != F.col("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def full_sets(keys: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """k, set: the full shingle sets of the named ones."""
    holder = sets.join(keys.distinct(), "k").select(F.col("rep").alias("__rep")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(holder, F.col("doc_id") == F.col("__rep"), "left_semi")
    small_batches(docs.sparkSession)
    full = texts.select("text").mapInArrow(_sets, "k binary, set binary")
    return durable(full.groupBy("k").agg(F.first("set").alias("set")), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs a, b whose full shingle sets are near enough."""
    full = full_sets(pairs.select(F.col("a").alias("k")).unionAll(pairs.select(F.col("b").alias("k"))), docs, sets)
    a, b = full.select(F.col("k").alias("a"), F.col("set").alias("set_a")), full.select(F.col("k").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b")
    return durable(both.mapInArrow(functools.partial(_confirm, percent=percent), "a binary, b binary"), "links")


def across_links(members: DataFrame, marked: DataFrame, docs: DataFrame, sets: DataFrame, near: float, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Links a, b between components that meet in a region; marked: k, sig, label (the component)."""
    left = members.join(marked.select("k", "label"), "k")
    size = left.groupBy("tree", "region").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"))
    mixed = size.where(F.col("lo") != F.col("hi")).select("tree", "region", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = durable(left.join(mixed, ["tree", "region"]).select("tree", "region", "blocks", "k", "label"), "mixed")
    rows = rows.withColumn("block", F.pmod(F.hash("k"), F.col("blocks"))).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("tree", "region", F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"), "block", "k", "label")
    rows = rows.join(marked.select("k", "sig"), "k").join(full_sets(rows.select("k"), docs, sets), "k")
    rows = rows.repartition("tree", "region", "p", "q").sortWithinPartitions("tree", "region", "p", "q", "k")
    found = rows.select("tree", "region", "p", "q", "block", "k", "sig", "label", "set").mapInArrow(functools.partial(_across, near=near, percent=percent), "a binary, b binary")
    return durable(found.distinct(), "across")


def near_dedup(docs: DataFrame, percent: int = PERCENT, deep: int = DEEP) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Null text, or text without words, has no shingle and is linked with nothing. A row with a null doc_id is
    linked with nothing: component_id null, kept. Repeated rows of one doc_id are one document: links of any of
    its texts are its links, and all its rows are kept or dropped together. An empty table gives an empty result.
    """
    near, trees = near_share(percent), tree_count(percent)
    signed = durable(signatures(docs), "signed")
    named = signed.where(F.col("k").isNotNull() & F.col("doc_id").isNotNull())
    sets = durable(named.groupBy("k").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "nodes")
    members = durable(regions(sets, trees), "regions")
    rep = sets.select("k", "rep")

    def edges(links: DataFrame) -> DataFrame:
        of_a, of_b = rep.select(F.col("k").alias("a"), F.col("rep").alias("ra")), rep.select(F.col("k").alias("b"), F.col("rep").alias("rb"))
        return links.join(of_a, "a").join(of_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))

    # A doc_id with several texts joins their sets.
    several = named.join(rep, "k").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where(F.col("lo") != F.col("hi"))
    more = several.select(F.col("doc_id").alias("a"), F.col("lo").alias("b")).unionAll(several.select(F.col("doc_id").alias("a"), F.col("hi").alias("b")))
    pairs = durable(leader_pairs(members, sets, trees, near, deep), "pairs")
    links = edges(confirmed(pairs, docs, sets, percent)).unionAll(more)
    labels = components(links)

    # Regions that still hold several components.
    marked = sets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("k", "sig", F.coalesce("label", "rep").alias("label"))
    across = across_links(members, marked, docs, sets, near, percent)
    if across.limit(1).count():
        labels = components(links.unionAll(edges(across)))

    final = sets.select("k", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("k", F.coalesce("label", "rep").alias("label"))
    # Adaptive execution splits a set that very many documents share.
    out = signed.select("doc_id", "n_shingles", "k").join(final, "k", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
