"""Importance resampling towards a target text distribution, over hashed n-gram features.

Every batch of texts interns its n-grams in an open-addressed table of numpy arrays: a feature's key is the XXH64 of
its bytes, and the bytes decide whether two features with one key are one. A slot holds the feature's bucket, worked
out once, and its count in the batch; every occurrence keeps its slot's number, through which it gets its gain.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, hidden, small_batches
from .words import chunks

NGRAMS = 1
BUCKETS = 10_000
SEED = 2024
PERCENT = 10
MIN_WORDS = 20

_U = np.uint64
# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Longer features go through the library one by one.
SHORT = 32
#: Word bytes: digits, a-z (after lower-casing) and whatever is not ASCII.
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _left(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U(n)) | (x >> _U(64 - n))


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one little-endian number; zeros follow the end."""
    padded = np.r_[raw, np.zeros(8, dtype=np.uint8)]
    return np.lib.stride_tricks.as_strided(padded, (len(raw) + 1, 8), (1, 1)).copy().view("<u8").ravel()


def xxh64(raw: np.ndarray, lanes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 with seed 0 of raw[start:end] for all slices at once."""
    size = end - start
    h = _P5 + size.astype(_U)
    at = start.copy()
    for k in range(SHORT // 8 - 1):
        rows = np.flatnonzero(size >= 8 * (k + 1))
        if not len(rows):
            break
        h[rows] = _left(h[rows] ^ _left(lanes[at[rows]] * _P2, 31) * _P1, 27) * _P1 + _P4
        at[rows] += 8
    rows = np.flatnonzero(end - at >= 4)
    h[rows] = _left(h[rows] ^ (lanes[at[rows]] & _U(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
    at[rows] += 4
    for _ in range(3):
        rows = np.flatnonzero(at < end)
        if not len(rows):
            break
        h[rows] = _left(h[rows] ^ raw[at[rows]].astype(_U) * _P5, 11) * _P1
        at[rows] += 1
    h = (h ^ h >> _U(33)) * _P2
    h = (h ^ h >> _U(29)) * _P3
    h ^= h >> _U(32)
    for row in np.flatnonzero(size >= SHORT):
        h[row] = xxhash.xxh64_intdigest(raw[start[row] : end[row]].tobytes())
    return h


def same_bytes(lanes: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size bytes at a equal those at b, for all rows at once."""
    same = np.ones(len(a), dtype=bool)
    rows, done = np.arange(len(a)), 0
    while len(rows := rows[size[rows] > done]):
        left = np.minimum(size[rows] - done, 8).astype(_U)
        differ = (lanes[a[rows] + done] ^ lanes[b[rows] + done]) << (_U(64) - left * _U(8))
        same[rows] = differ == 0
        rows, done = rows[same[rows]], done + 8
    return same


class Interned:
    """The distinct features of a batch in open-addressed slots, and the slot of every occurrence.

    slot: of each occurrence. owner: of each slot, the occurrence that spells its feature, or -1. bucket and
    count: of each slot.
    """

    def __init__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int, keys: np.ndarray | None = None):
        n = len(start)
        lanes = eights(raw)
        keys = xxh64(raw, lanes, start, end) if keys is None else keys
        room = 1 << max(4, int(2 * n - 1).bit_length())
        self.owner = np.full(room, -1, dtype=np.int64)
        self.slot = (keys & _U(room - 1)).astype(np.int64)
        size = end - start
        rows = np.arange(n)
        while len(rows):
            at = self.slot[rows]
            free = self.owner[at] < 0
            self.owner[at[free]] = rows[free]
            o = self.owner[at]
            same = o == rows
            ask = np.flatnonzero(~same & (keys[o] == keys[rows]) & (size[o] == size[rows]))
            same[ask] = same_bytes(lanes, start[o[ask]], start[rows[ask]], size[rows[ask]])
            rows = rows[~same]
            self.slot[rows] = (self.slot[rows] + 1) & (room - 1)
        self.used = np.flatnonzero(self.owner >= 0)
        text, who = raw.tobytes(), self.owner[self.used]
        self.bucket = np.zeros(room, dtype=np.int64)
        self.bucket[self.used] = [zlib.crc32(text[s:e]) % buckets for s, e in zip(start[who].tolist(), end[who].tolist())]
        self.count = np.bincount(self.slot, minlength=room)


def features(texts: list[str], ngrams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bytes; first byte and end of each feature and its text's number, in the texts' order; words of each text.

    The bytes are the texts' words in lower case (A-Z only), one space behind each, so that a run of words is
    one slice.
    """
    data = [x.encode("utf-8", "surrogatepass") for x in texts]
    raw = np.frombuffer(b" ".join(data) + b" ", dtype=np.uint8)
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    word = _IN_WORD[raw]
    last = np.r_[False, word[:-1]] & ~word
    ends = np.cumsum([len(x) + 1 for x in data])
    place = np.cumsum(word | last)
    end = place[last] - 1
    start = np.r_[0, end[:-1] + 1] if len(end) else end
    text = np.searchsorted(ends, np.flatnonzero(last), side="right")
    # A text's last word ends at the blank that was put behind the text at the latest.
    n_words = np.bincount(text, minlength=len(texts))
    squeezed = np.where(word, raw, np.uint8(32))[word | last]
    s, e, t = [start], [end], [text]
    for k in range(1, ngrams):
        whole = text[:-k] == text[k:]
        s, e, t = [*s, start[:-k][whole]], [*e, end[k:][whole]], [*t, text[:-k][whole]]
    order = np.argsort(np.concatenate(t), kind="stable") if ngrams > 1 else slice(None)
    return squeezed, np.concatenate(s)[order], np.concatenate(e)[order], np.concatenate(t)[order], n_words


def _count(ngrams: int, buckets: int):
    """One row for each bucket that a task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for a, b in chunks(texts):
                raw, start, end, _, _ = features(texts[a:b], ngrams)
                if len(start):
                    t = Interned(raw, start, end, buckets)
                    np.add.at(total, t.bucket[t.used], t.count[t.used])
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, ngrams: int, buckets: int) -> np.ndarray:
    """Occurrences of features by bucket over all rows of texts (a text column); as many numbers as buckets."""
    rows = texts.mapInArrow(_count(ngrams, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log ratio of both smoothed distributions, for each bucket."""
    s_all, t_all, n = float(corpus.sum()), float(target.sum()), len(corpus)
    ratio = [(t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Floored thousandfold Gumbel number of a document; a null id counts as the word null."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(gains: np.ndarray, ngrams: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = [x or "" for x in batch.column("text").to_pylist()], batch.column("doc_id").to_pylist()
            n, total, words = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
            for a, b in chunks(texts):
                raw, start, end, text, n_words = features(texts[a:b], ngrams)
                words[a:b] = n_words
                if len(start):
                    t = Interned(raw, start, end, len(gains))
                    np.add.at(total, a + text, gains[t.bucket][t.slot])
                    n[a:b] = np.bincount(text, minlength=b - a)
            weight = total // np.maximum(n, 1)
            score = weight + np.array([noise(seed, i) for i in ids], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (words, n, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def with_top_ranks(rows: DataFrame, asked, k: int) -> DataFrame:
    """rows (a durable table with score and doc_id) with rank: 1 to k by score descending, then doc_id, among the asked.

    A score's rows are counted first, so that only those from the k-th best score on are sorted, by ranges; a
    row's rank is the number of rows in earlier ranges and its place in its own. Equal rows are dealt apart,
    so no value is bound to one task. Scores are floored logarithms: some 10^5 of them at any size.
    """
    spark = rows.sparkSession
    cut, seen = None, 0
    if k > 0:
        for r in sorted(rows.where(asked).groupBy("score").count().collect(), key=lambda r: -r["score"]):
            cut, seen = r["score"], seen + r["count"]
            if seen >= k:
                break
    if cut is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    top = asked & (F.col("score") >= cut)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col(hidden("deal"))]
    best = rows.where(top).withColumn(hidden("deal"), F.xxhash64(F.monotonically_increasing_id()))
    best = best.repartitionByRange(*order).sortWithinPartitions(*order).drop(hidden("deal")).withColumn(hidden("at"), F.monotonically_increasing_id())
    best = durable(best, "ranked")
    # monotonically_increasing_id holds the partition above bit 33 and the row's place in it below.
    place, within = F.shiftright(hidden("at"), 33), F.col(hidden("at")).bitwiseAND((1 << 33) - 1)
    before, offsets = 0, []
    for r in sorted(best.groupBy(place.alias("p")).count().collect(), key=lambda r: r["p"]):
        offsets.append((r["p"], before))
        before += r["count"]
    offsets = spark.createDataFrame(offsets, f"{hidden('p')} long, {hidden('before')} long")
    best = best.join(F.broadcast(offsets), place == F.col(hidden("p")))
    rank = F.col(hidden("before")) + within + 1
    best = best.select(*rows.columns, F.when(rank <= k, rank).alias("rank"))
    return best.unionByName(rows.where(~top).withColumn("rank", F.lit(None).cast("long")))


def importance_resample(
    docs: DataFrame, target: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS, text_column: str = "text"
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_features, weight, score, rank.

    Both tables are counted whole. Drawn are percent of the documents with at least min_words words, those with the
    highest scores (Gumbel top-k), ranked by score and then doc_id; rank is null for all others. A null or empty
    text has no features and weight 0. A null doc_id gets the noise of the word null and ranks behind equal
    scores with an id; repeated rows are rows of their own and share their score. An empty docs table gives an
    empty result; without target texts all gains follow from the smoothing alone. Other columns are ignored,
    whatever their names.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    gains = gains_of(bucket_counts(texts.select("text"), ngrams, buckets), bucket_counts(target.select(F.col(text_column).alias("text")), ngrams, buckets))
    scored = durable(texts.mapInArrow(_score(gains, ngrams, seed), "doc_id long, n_words long, n_features long, weight long, score long"), "importance")
    asked = F.col("n_words") >= min_words
    return with_top_ranks(scored, asked, percent * scored.where(asked).count() // 100)
