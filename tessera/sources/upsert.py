"""Keyed tables in a shared folder: rows merge by key, only touched buckets are written, readers see whole versions.

A table is a number of buckets, each a folder of Parquet files that is never changed, and a list of these folders for
every version. A merge writes the buckets that it touches to new folders and then publishes the next list by renaming
a file. Until that, readers go on with the old list; a merge that dies leaves files that no list names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64
BUCKET = "__bucket"


class _Files:
    """The folder through Hadoop's file system, whatever it is."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark._jvm
        self.path, self.io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """The file appears whole or not at all, and never in another's place."""
        scratch = f"{path}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(scratch), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.exists(self.path(path)) or not self.fs.rename(self.path(scratch), self.path(path)):
            self.fs.delete(self.path(scratch), False)
            raise RuntimeError(f"another merge has published {path}; merge again")

    def delete(self, folder: str) -> None:
        self.fs.delete(self.path(folder), True)


class KeyedTable:
    """A table at `path` with one row for each value of `keys`, in buckets by `bucket_by` (the first key if not given)."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], bucket_by: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.bucket_by, self.buckets, self.files = bucket_by or keys[0], buckets, _Files(spark, path)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.path}/versions") if n.endswith(".json") and n[:-5].isdigit())

    def _list(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self.path}/versions/{version:08d}.json"))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of a version, the newest if none is given; None before the first merge."""
        versions = self.versions()
        if not versions:
            return None
        return self._rows(self._list(versions[-1] if version is None else version)).drop(BUCKET)

    def _rows(self, listed: dict, only: list[int] | None = None) -> DataFrame:
        folders = [f for b, f in listed["buckets"].items() if only is None or int(b) in only]
        schema = self.spark.createDataFrame([], listed["schema"]).schema
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def merge(self, rows: DataFrame, keep: tuple[str, ...] = (), order: str | None = None) -> bool:
        """Rows with known keys replace what is there, others are added; False if that changes nothing.

        A null in a column of `keep` leaves the old value. Of several rows with one key the one with the
        greatest `order` counts (that column is not stored), or else the greatest row. Null keys are equal.
        """
        bucket = F.pmod(F.xxhash64(self.bucket_by), F.lit(self.buckets)).cast("int")
        plain = [c for c in rows.columns if c not in self.keys and c != order]
        by = Window.partitionBy(*self.keys).orderBy(*([F.desc(order)] if order else []), *[F.desc_nulls_last(c) for c in plain], self.keys[0])
        new = rows.withColumn(BUCKET, bucket).withColumn("__n", F.row_number().over(by)).where("__n = 1").select(*self.keys, *plain, BUCKET)
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())
        if not touched:
            return False
        versions = self.versions()
        last = self._list(versions[-1]) if versions else {"buckets": {}, "schema": None, "columns": [], "count": self.buckets}
        if last["count"] != self.buckets:
            raise ValueError(f"the table has {last['count']} buckets")
        if last["columns"] and sorted(last["columns"]) != sorted([*self.keys, *plain]):
            raise ValueError(f"the table has the columns {last['columns']}")
        merged = new.withColumn("__changed", F.lit(True))
        if last["schema"]:
            merged = self._merged(new, self._rows(last, touched), plain, keep)
            if merged.where("__changed").isEmpty():
                return False
        out = f"data/{uuid.uuid4().hex}"
        final = merged.drop("__changed")
        final.repartition(len(touched), BUCKET).withColumn("__folder", F.col(BUCKET)).write.partitionBy("__folder").parquet(f"{self.path}/{out}")
        listed = last["buckets"] | {str(b): f"{out}/__folder={b}" for b in touched}
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in final.schema)
        self.files.publish(f"{self.path}/versions/{(versions[-1] if versions else 0) + 1:08d}.json", json.dumps({"buckets": listed, "schema": schema, "columns": [*self.keys, *plain], "count": self.buckets}))
        return True

    def _merged(self, new: DataFrame, old: DataFrame, plain: list[str], keep: tuple[str, ...]) -> DataFrame:
        n, o = new.withColumn("__new", F.lit(True)).alias("n"), old.withColumn("__old", F.lit(True)).alias("o")
        same = F.lit(True)
        for k in [*self.keys, BUCKET]:
            same = same & F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
        is_new, is_old = F.col("__new").isNotNull(), F.col("__old").isNotNull()

        def value(c: str) -> Column:
            fresh = F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep else F.col(f"n.{c}")
            return F.when(is_new, fresh).otherwise(F.col(f"o.{c}"))

        differs = ~is_old
        for c in plain:
            differs = differs | ~value(c).eqNullSafe(F.col(f"o.{c}"))
        columns = [value(c).alias(c) for c in [*self.keys, *plain, BUCKET]]
        return n.join(o, same, "full").select(*columns, (is_new & differs).alias("__changed"))

    def vacuum(self, keep_versions: int = 2) -> int:
        """Deletes folders that none of the newest versions names; the number of folders that went."""
        kept = self.versions()[-keep_versions:]
        named = {f.split("/")[1] for v in kept for f in self._list(v)["buckets"].values()}
        stale = [n for n in self.files.names(f"{self.path}/data") if n not in named]
        for n in stale:
            self.files.delete(f"{self.path}/data/{n}")
        for v in self.versions()[:-keep_versions]:
            self.files.delete(f"{self.path}/versions/{v:08d}.json")
        return len(stale)
