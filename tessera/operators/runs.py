"""Gaps in a histogram: runs of empty buckets between its lowest and its highest one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def empty_runs(buckets: DataFrame, keys: list[str], bucket: str = "bucket") -> DataFrame:
    """keys, start, length, longest: every run of whole numbers that no bucket has, between a group's floor and ceiling.

    The missing numbers are those of the generated axis without those present; numbers of one run are as far
    apart as their places. longest marks a group's first run of the greatest length. An axis has as many rows as its
    ends are apart, so it is meant for histograms; groups without buckets, or with null buckets only, have no row.
    """
    present = buckets.where(F.col(bucket).isNotNull()).select(*keys, F.col(bucket).cast("long").alias("at")).distinct()
    ends = present.groupBy(*keys).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    axis = ends.select(*keys, F.explode(F.sequence("lo", "hi")).alias("at"))
    missing = axis.join(present, [*keys, "at"], "left_anti")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("at"))
    runs = missing.withColumn("island", F.col("at") - place).groupBy(*keys, "island").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("length"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("length"), "start")) == 1
    return runs.select(*keys, "start", "length", first.alias("longest"))
