"""Product codes of vectors, with exact integer k-means whose distance evaluations are pruned by fixed pivots (LAESA).

The distances of every vector part to a few fixed pivots are computed once and written beside the vector. In each
round only the codebook's entries are compared with the pivots; the difference of two distances to the same pivot
bounds the distance of part and entry from below. Entries are tried in the order of their bounds, and a part is done
as soon as the next bound exceeds the best exact distance found. All distances that decide are exact integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, with_group_totals

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Pivots of each part position: distances kept with every vector part.
PIVOTS = 4
#: Numbers of vector components that a Python worker holds at once.
HELD = 1 << 20
PREPARED = "vec_id long, label string, v binary, near binary"


def largest(dim: int) -> int:
    """Integers up to this size have squared distances that fit a long, whatever the vectors."""
    return int((1 << 30) / math.sqrt(dim))


def usable(vector: Column, scale: int, limit: int) -> Column:
    """A vector without nulls, NaN, infinities and components beyond the limit."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < limit)), F.lit(False))


def split(v: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, components of a part) of rows of whole vectors."""
    return v.reshape(len(v), parts, -1)


def lengths(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of x (..., d) to pivots (p, d), as (..., p) single floats."""
    gap = x[..., None, :] - pivots
    return np.sqrt((gap * gap).sum(-1).astype(np.float64)).astype(np.float32)


def choose_pivots(book: np.ndarray, n: int) -> np.ndarray:
    """n entries that lie far apart, the first one first: each next one has the largest distance to those chosen."""
    chosen = [0]
    near = ((book - book[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(book)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((book - book[chosen[-1]]) ** 2).sum(1))
    return book[chosen]


def nearest(x: np.ndarray, near: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For parts x (n, d) with pivot distances near (n, p): nearest entry of book, squared distance, evaluations made.

    Ties go to the lower index. A bound is lowered by more than the rounding of two single floats, so no
    entry that could win or tie is left out.
    """
    entry = lengths(book, pivots).astype(np.float64)
    low = np.zeros((len(x), len(book)))
    for p in range(len(pivots)):
        mine = near[:, p, None].astype(np.float64)
        np.maximum(low, np.abs(mine - entry[:, p]) - (mine + entry[:, p]) * 2.0**-22, out=low)
    low *= low
    order = np.argsort(low, axis=1, kind="stable")
    best, arg = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), dtype=np.int64)
    rows, made = np.arange(len(x)), 0
    for k in range(len(book)):
        e = order[rows, k]
        going = low[rows, e] * (1 - 2.0**-40) <= best[rows]
        rows, e = rows[going], e[going]
        if not len(rows):
            break
        gap = x[rows] - book[e]
        d = (gap * gap).sum(1)
        made += len(rows)
        wins = (d < best[rows]) | ((d == best[rows]) & (e < arg[rows]))
        best[rows[wins]], arg[rows[wins]] = d[wins], e[wins]
    return arg, best, made


def _held(batches: Iterator[pa.RecordBatch], size) -> Iterator[pa.Table]:
    """Batches put together to at most about HELD components, cut where a batch has more."""
    part, n = [], 0
    for batch in batches:
        step = max(1, HELD // max(1, size))
        for at in range(0, len(batch), step):
            piece = batch.slice(at, step)
            if n and (n + len(piece)) * size > HELD:
                yield pa.Table.from_batches(part)
                part, n = [], 0
            part.append(piece)
            n += len(piece)
    if n:
        yield pa.Table.from_batches(part)


def _matrix(column: pa.ChunkedArray, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


def _prepare(dim: int, parts: int, pivots: np.ndarray, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _held(batches, dim):
            x = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            v = np.floor(x * scale).astype(np.int64).reshape(len(rows), dim)
            near = np.stack([lengths(split(v, parts)[:, k], pivots[k]) for k in range(parts)], axis=1)
            out = [[r.tobytes() for r in v.astype("<i4")], [r.tobytes() for r in near.astype("<f4")]]
            yield pa.RecordBatch.from_arrays([rows["vec_id"].combine_chunks(), rows["label"].combine_chunks(), *[pa.array(o, pa.binary()) for o in out]], ["vec_id", "label", "v", "near"])

    return run


def _assigned(rows: pa.Table, books: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, parts, d) integers, nearest entries and squared distances (rows, parts)."""
    parts, _, d = books.shape
    x = split(_matrix(rows["v"], "<i4", parts * d).astype(np.int64), parts)
    near = _matrix(rows["near"], "<f4", parts * pivots.shape[1]).reshape(len(rows), parts, -1)
    found = [nearest(x[:, k], near[:, k], books[k], pivots[k]) for k in range(parts)]
    return x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(books: np.ndarray, pivots: np.ndarray):
    """One row for each entry that a task has met: its parts' number and their sum."""
    parts, entries, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, d), dtype=np.int64)
        for rows in _held(batches, parts * d):
            x, arg, _ = _assigned(rows, books, pivots)
            for k in range(parts):
                np.add.at(n[k], arg[:, k], 1)
                np.add.at(total[k], arg[:, k], x[:, k])
        part, entry = np.nonzero(n)
        if len(part):
            sums = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(sums, ["part", "entry", "n", "total"])

    return run


def _encode(books: np.ndarray, pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _held(batches, books.shape[0] * books.shape[2]):
            _, arg, best = _assigned(rows, books, pivots)
            codes = [bytes(r).hex() for r in arg.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([rows["vec_id"].combine_chunks(), rows["label"].combine_chunks(), pa.array(codes), pa.array(best.sum(1))], ["vec_id", "label", "code", "error"])

    return run


def train(prepared: DataFrame, books: np.ndarray, pivots: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks (parts, entries, d) after so many rounds over all prepared vectors; unused entries stay.

    A round brings one row for each entry and component to the driver, whatever the number of vectors.
    """
    parts, entries, d = books.shape
    for _ in range(rounds):
        met = prepared.mapInArrow(_sums(books, pivots), "part int, entry int, n long, total array<long>")
        met = met.select("part", "entry", "n", F.posexplode("total").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        books = books.copy()
        for r in met.collect():
            books[r["part"], r["entry"], r["at"]] = r["s"] // r["n"]
    return books


def pivot_codes(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, n_pivots: int = PIVOTS, scale: int = SCALE
) -> DataFrame:
    """One row for each kept row of vectors: vec_id, label, code, error, label_error, codebooks_sha256.

    Dropped are rows whose vector is null or holds a null or non-finite component, or one whose integer
    exceeds 2^30 / sqrt(length) (its squared distances would not fit a long), and rows whose vector has not the
    most frequent length (at ties the greatest) among those that parts divides; an empty vector has none. Rows with
    a null vec_id are coded; null ids come last in the order that starts the codebooks. Repeated rows are
    coded each, and order by their vectors among equal ids. With fewer than `entries` kept rows the codebooks have
    so many entries. Null labels are one label. Other columns of the table are ignored, whatever their names;
    an empty table gives an empty result.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index must fit two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).alias("vector"))
    size = F.size("vector")
    good = rows.where(F.col("vector").isNotNull() & (size > 0) & (size % parts == 0))
    label_type = vectors.schema[label_column].dataType
    # One row for each length that occurs with usable components; a limit that follows the length.
    limit = F.floor(F.lit(float(1 << 30)) / F.sqrt(size.cast("double")))
    good = good.where(usable(F.col("vector"), scale, limit))
    common = good.groupBy(size.alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    out_columns = ["vec_id", F.col("label").cast(label_type).alias("label"), "code", "error", "label_error"]
    if common is None:
        empty = spark.createDataFrame([], "vec_id long, label string, code string, error long, label_error long, codebooks_sha256 string")
        return empty.select(*out_columns, "codebooks_sha256")
    dim = common["dim"]
    good = good.where(size == dim)
    first = good.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = np.floor(np.array([r["vector"] for r in first], dtype=np.float64) * scale).astype(np.int64)
    books = np.ascontiguousarray(split(start, parts).transpose(1, 0, 2))
    pivots = np.stack([choose_pivots(b, n_pivots) for b in books])
    prepared = durable(good.mapInArrow(_prepare(dim, parts, pivots, scale), PREPARED), "vector-parts")
    books = train(prepared, books, pivots, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = durable(prepared.mapInArrow(_encode(books, pivots), "vec_id long, label string, code string, error long"), "vector-codes")
    discard(prepared)
    out = with_group_totals(coded, "label", coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    return out.select(*out_columns, F.lit(digest).alias("codebooks_sha256"))
