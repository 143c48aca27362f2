"""Line deduplication over levelled sorted runs of line hashes.

The store keeps runs of (line hash, documents, largest doc_id), each dealt into buckets and sorted by hash, in the
shared folder. Documents come in batches of descending doc_id, so that the batch that first brings a line also brings
its largest doc_id. A new batch is merge-joined with the runs: lines that the runs lack (the anti-join) are
added with their holder, lines that they have add their count only. When a level holds FANIN runs they are
compacted into one run of the next level. At the end all runs are merged and lines found in enough documents
are dropped everywhere but in the holder.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANK_CHARS, discard, durable, shared_dir, small_batches, text_or_empty

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANIN = 3
#: Documents from which a line may count as hot.
HOT_LEAST = 1_000


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of the normalised line, None if it is too short to count."""
    key = line.strip(BLANK_CHARS)
    if len(key) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower())  # bytes.lower() touches A-Z only


def _keys_of(batches, min_chars: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, hashes = [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if doc is None:
                continue
            found = {line_key(x, min_chars) for x in text.split("\n")}
            found.discard(None)
            ids += [doc] * len(found)
            hashes += found
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], ["doc_id", "h"])


def document_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, h: the distinct line hashes of each document; rows without doc_id have none."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(functools.partial(_keys_of, min_chars=min_chars), "doc_id long, h binary")


class SortedRuns:
    """Levels of runs; a run at level k holds up to FANIN**k batches.

    A run is a table dealt into buckets by hash, each bucket a file sorted by hash. All runs have the same buckets,
    so joining a batch to the runs deals the batch only, and runs are compacted bucket by bucket without a shuffle.
    """

    def __init__(self, spark: SparkSession, fanin: int = FANIN):
        self.spark, self.fanin = spark, fanin
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        """Runs merged by hash: counts add up, the first holder (of the largest documents) stays."""
        out = runs[0]
        for run in runs[1:]:
            more = run.select("h", F.col("n_docs").alias("__n"), F.col("holder").alias("__holder"))
            out = out.join(more, "h", "full").select("h", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("n_docs"), F.greatest("holder", "__holder").alias("holder"))
        return out

    def add(self, lines: DataFrame) -> None:
        """lines: (doc_id, h) of one batch, each pair once, all ids below those of earlier batches."""
        new = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("holder"))
        for run in self.runs():
            # The anti-join: a line that an earlier run holds adds its count only.
            known = run.where(F.col("holder").isNotNull()).select("h", F.lit(True).alias("known"))
            new = new.join(known, "h", "left").select("h", "n_docs", F.when(F.col("known").isNull(), F.col("holder")).alias("holder"))
        self._put(0, new)

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        name = f"tessera_run_{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{shared_dir(self.spark)}/tessera/{name}").saveAsTable(name)
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanin:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self.merged([self.spark.table(x) for x in full]))
            self._forget(full)

    def _forget(self, names: list[str]) -> None:
        for name in names:
            discard(self.spark.table(name))
            self.spark.sql(f"drop table {name}")

    def close(self) -> None:
        self._forget([name for level in self.levels for name in level])


def repeated_lines(lines: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """h, n_docs, holder of every line found in at least min_docs documents, written once."""
    spark = lines.sparkSession
    cuts = lines.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()[0] or []
    store = SortedRuns(spark)
    ends = [None, *sorted(set(cuts)), None]
    for lo, hi in reversed(list(zip(ends[:-1], ends[1:], strict=True))):
        part = lines if lo is None else lines.where(F.col("doc_id") > lo)
        store.add(part if hi is None else part.where(F.col("doc_id") <= hi))
    out = durable(store.merged(store.runs()).where(F.col("n_docs") >= min_docs), "repeated")
    store.close()
    return out


def lost_lines(lines: DataFrame, drop: DataFrame) -> DataFrame:
    """doc_id, h: the pairs to drop. A line that very many documents share is dealt into parts.

    A line is such if it is in more documents than a ten-thousandth of all pairs, so there are at most 10,000.
    """
    most = max(HOT_LEAST, lines.count() // 10_000)
    hot = drop.where(F.col("n_docs") > most).select("h", F.ceil(F.col("n_docs") / most).cast("int").alias("parts"))
    dealt = drop.join(F.broadcast(hot), "h", "left").select("h", "holder", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    salted = lines.join(F.broadcast(hot), "h", "left").select("doc_id", "h", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    return salted.join(dealt, ["h", "part"]).where(F.col("doc_id") < F.col("holder")).select("doc_id", "h")


def _drop(batches, min_chars: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text, hashes to drop, carried columns -> doc_id, text, n_lines, n_dropped, carried columns."""
    for b in batches:
        texts, n_lines, n_dropped = [], [], []
        for text, drop in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            lines = text.split("\n")
            kept = lines
            if drop:
                gone = set(drop)
                kept = [x for x in lines if line_key(x, min_chars) not in gone]
            texts.append("\n".join(kept))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        carried = [b.column(k) for k in range(3, b.num_columns)]
        names = ["doc_id", "text", "n_lines", "n_dropped", *b.schema.names[3:]]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), *carried], names)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, carry: tuple = ()) -> DataFrame:
    """doc_id, text without the dropped lines, n_lines (before dropping), n_dropped, for every row of docs.

    Null or empty text is one empty line. Rows without doc_id keep all lines and don't count as documents.
    Repeated rows of one doc_id count as one document and lose the same lines. An empty table gives an empty
    result. A document all of whose lines go keeps an empty text. `carry` names further columns of docs to keep,
    as "in_<name>".
    """
    # A repeated row would count its document twice, so pairs are made distinct (with a combine in each task).
    lines = durable(document_lines(docs, min_chars).distinct(), "lines")
    drop = repeated_lines(lines, min_docs, batches)
    gone = lost_lines(lines, drop).groupBy("doc_id").agg(F.collect_list("h").alias("gone"))
    carried = [F.col(c).alias(f"in_{c}") for c in carry]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *carried)
    rows = rows.join(gone, "doc_id", "left").select("doc_id", "text", "gone", *[f"in_{c}" for c in carry])
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), *rows.schema.fields[3:]])
    return rows.mapInArrow(functools.partial(_drop, min_chars=min_chars), schema)
