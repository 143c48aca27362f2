"""Tables of harvests and snapshots on disk: replaced issuance by issuance, appended, read back in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_harvest(rows: DataFrame, path: str, key: str = "accession") -> None:
    """Replaces the rows of the keys that `rows` has and leaves all others: a harvest that is run again adds nothing twice."""
    rows.write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def load_harvest(spark: SparkSession, path: str, accession: str | None = None, key: str = "accession") -> DataFrame:
    """The rows of one issuance or of all, as they stood in their documents."""
    rows = spark.read.parquet(path).withColumn(key, F.col(key).cast("string"))
    rows = rows if accession is None else rows.where(F.col(key) == accession)
    return rows.orderBy(key, "row_index")


def harvest_json(loans: DataFrame, observations: DataFrame, path: str) -> None:
    """One JSON object for each issuance: its loans in order, each with its observations."""
    seen = observations.groupBy("loan_id").agg(F.sort_array(F.collect_list(F.struct("metric_key", "value", "source_header", "confidence"))).alias("observations"))
    rows = loans.join(seen, "loan_id", "left")
    rest = [c for c in loans.columns if c not in ("accession", "row_index")]
    rows.groupBy("accession").agg(F.sort_array(F.collect_list(F.struct("row_index", *rest, "observations"))).alias("loans")).write.mode("overwrite").json(path)


def append_snapshot(metrics: DataFrame, path: str, taken_at: str) -> None:
    """metrics: metric, value, notable. Snapshots are never rewritten."""
    metrics.withColumn("taken_at", F.lit(taken_at)).write.mode("append").json(path)


def last_moves(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot against the one before: metric, before, after, rel, moved. Metrics that are new have no row."""
    rows = spark.read.json(path)
    times = [r[0] for r in rows.select("taken_at").distinct().orderBy(F.desc("taken_at")).limit(2).collect()]
    if len(times) < 2:
        return rows.limit(0).select("metric", F.col("value").alias("before"), F.col("value").alias("after"), F.lit(0.0).alias("rel"), F.lit(False).alias("moved"))
    at = lambda t, name: rows.where(F.col("taken_at") == t).select("metric", F.col("value").alias(name), "notable")
    both = at(times[0], "after").join(at(times[1], "before").drop("notable"), "metric").where(F.col("after").isNotNull() & F.col("before").isNotNull())
    rel = F.when(F.col("before") == 0, F.when(F.col("after") == 0, 0.0).otherwise(1.0)).otherwise(F.abs(F.col("after") - F.col("before")) / F.abs("before"))
    return both.select("metric", "before", "after", rel.alias("rel"), (rel >= F.col("notable")).alias("moved"))
