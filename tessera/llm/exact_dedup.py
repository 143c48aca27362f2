"""Exact deduplication by Grace hashing.

Texts are dealt out by a 64-bit hash. Each task then partitions its records recursively to spill files,
taking other bits of a second hash at every level, until a bucket fits an open-addressing table that
compares the complete content. Copies are merged inside every input task before anything is shuffled, so a
text that a third of all rows share crosses the network once per input task.
"""

from __future__ import annotations

import os
import pickle
import shutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty, worker_dir

FANOUT_BITS = 4
#: Bytes of text that one table may hold.
TABLE_BYTES = 64 << 20


class ContentTable:
    """Open addressing with linear probing; a slot matches only if the whole content is equal."""

    def __init__(self, slots: int = 1024):
        self.slots = np.full(slots, -1, dtype=np.int64)
        self.hashes: list[int] = []
        self.items: list[list] = []
        self.bytes = 0

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
        mask = len(self.slots) - 1
        for k, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k

    def add(self, text: str, h: int, keep, size: int) -> None:
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            item = self.items[k]
            if self.hashes[k] == h and item[0] == text:
                item[2] += size
                if keep is not None and (item[1] is None or keep > item[1]):
                    item[1] = keep
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.items)
        self.hashes.append(h)
        self.items.append([text, keep, size])
        self.bytes += len(text) + 150
        if 3 * len(self.items) > 2 * len(self.slots):
            self._grow()


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _rows(batches) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True)


def _out(items: list[list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in items], t) for k, t in enumerate(kinds)], ["text", "keep_id", "group_size"])


def _parts(items, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    part, held = [], 0
    for x in items:
        part.append(x)
        held += len(x[0]) + 40
        if held > most:
            yield _out(part)
            part, held = [], 0
    if part:
        yield _out(part)


def combine_local(batches) -> Iterator[pa.RecordBatch]:
    """(text, doc_id) -> one record per distinct text of this task, table by table."""
    table = ContentTable()
    for text, doc in _rows(batches):
        table.add(text, _hash(text), doc, 1)
        if table.bytes > TABLE_BYTES:
            yield from _parts(table.items)
            table = ContentTable()
    yield from _parts(table.items)


def grace(records: Iterator[tuple], level: int = 0, table_bytes: int = TABLE_BYTES) -> Iterator[list]:
    """(text, keep, size) records -> distinct [text, keep, size], with at most table_bytes of text in memory."""
    table = ContentTable()
    for text, keep, size in records:
        table.add(text, _hash(text), keep, size)
        if table.bytes > table_bytes and len(table.items) > 1 and level < 16:
            break
    else:
        yield from table.items
        return
    folder = worker_dir("grace")
    try:
        files = [open(os.path.join(folder, str(k)), "wb") for k in range(1 << FANOUT_BITS)]
        shift = 64 - FANOUT_BITS * (level + 1)

        def spill(text, keep, size):
            pickle.dump((text, keep, size), files[_hash(text) >> shift & (1 << FANOUT_BITS) - 1])

        for item in table.items:
            spill(*item)
        table = None
        for record in records:
            spill(*record)
        for f in files:
            f.close()
        for f in files:
            yield from grace(_unspilled(f.name), level + 1, table_bytes)
            os.remove(f.name)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _unspilled(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def grace_task(batches) -> Iterator[pa.RecordBatch]:
    yield from _parts(grace(_rows(batches)))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """One row per distinct text: text, keep_id (largest doc_id), group_size."""
    small_batches(docs.sparkSession)
    schema = "text string, keep_id long, group_size long"
    local = docs.select(text_or_empty().alias("text"), F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(combine_local, schema)
    return local.repartition(F.xxhash64("text")).mapInArrow(grace_task, schema)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text).

    Null text is the empty text. Rows with a null doc_id count in group_size; such a row is never the kept one
    unless its group has no other id (keep_id null, kept false). Repeated rows with one doc_id and text are all
    reported, and are all `kept` if that id is kept. An empty table gives an empty result.
    """
    groups = distinct_texts(docs).select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    # The digest names the group on the way back: content was compared where groups were made. Only digests and
    # ids are joined, and adaptive execution splits the digest of a hot group.
    rows = docs.select("doc_id", F.sha2(text_or_empty(), 256).alias("text_sha256"))
    out = rows.join(groups, "text_sha256")
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")
