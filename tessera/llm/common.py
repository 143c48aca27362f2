"""What the training-data operators share: word rules, reading, durable intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII blanks (space, tab, LF, VT, FF, CR).
WORD = r"[^\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"

#: Rows in one Arrow batch: keeps a Python worker's batch small although texts may be long.
ARROW_ROWS = 500
ARROW_BYTES = 64 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Python workers get ARROW_ROWS rows and ARROW_BYTES at a time at most (a longer row comes alone), whatever the session's default."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def one_blas_thread() -> None:
    """Keep numpy's products in the calling Python worker to one thread: Spark runs a worker for each core, and lets each have as many threads as there are cores."""
    if not os.path.exists("/proc/self/maps"):
        return
    with open("/proc/self/maps") as maps:
        loaded = {line.split(None, 5)[5].strip() for line in maps if "openblas" in line}
    for path in loaded:
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break


def spread(rows: DataFrame, *by: Column | str) -> DataFrame:
    """rows dealt evenly over several tasks a core, however few or uneven the parts are in which they were read."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, *by)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; one of our own only in local mode, where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def durable(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df once in the shared folder and read it back: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete durable tables that nothing reads any more: what was made from them must be durable itself."""
    for df in tables:
        if files := df.inputFiles():
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of one small row each that a broadcast may have: some ten MB.
BROADCAST_ROWS = 100_000
#: Parts that a group's rows are dealt into where its totals are not broadcast.
SALTS = 64


def with_group_totals(rows: DataFrame, key: str, totals: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """rows (a durable table) with the columns of totals, which has one row for each value of key, null included.

    Totals are written first and broadcast if they are at most so many rows; else every total is copied for each
    salt and the rows join on key and salt, so that no group meets in one task.
    """
    totals = durable(totals.withColumnRenamed(key, hidden("key")), "totals")
    same = F.col(key).eqNullSafe(F.col(hidden("key")))
    if totals.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rows.join(F.broadcast(totals), same, "left").drop(hidden("key"))
    rows = rows.withColumn(hidden("salt"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)))
    totals = totals.withColumn(hidden("part"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(totals, same & (F.col(hidden("salt")) == F.col(hidden("part"))), "left").drop(hidden("key"), hidden("salt"), hidden("part"))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of phases whose results are durable: it does so when their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def hidden(name: str) -> str:
    """A column name that no input table is expected to carry."""
    return f"__tessera_{name}"


def worker_dir(name: str) -> str:
    """A scratch folder of one Python task; the task removes it."""
    return tempfile.mkdtemp(prefix=f"{name}-{os.getpid()}-")
