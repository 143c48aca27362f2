"""From observations to facts, and from monthly reports to one performance row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONFLICT_RATIO = 1.5


def dedupe_observations(observations: DataFrame) -> DataFrame:
    """One observation per loan, metric and header: the most confident, the leftmost column among equals."""
    w = Window.partitionBy("loan_id", "metric_key", "source_header").orderBy(F.desc("confidence"), "source_column")
    return observations.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def promote_facts(observations: DataFrame) -> DataFrame:
    """One fact per loan and metric: the most confident observation, the leftmost among equals, and why."""
    w = Window.partitionBy("loan_id", "metric_key")
    rows = observations.withColumn("__place", F.row_number().over(w.orderBy(F.desc("confidence"), "source_column"))).withColumn("candidates", F.count(F.lit(1)).over(w))
    why = F.when(F.col("candidates") == 1, "only candidate").otherwise(F.concat(F.lit("best of "), F.col("candidates"), F.lit(" at "), F.format_string("%.2f", F.col("confidence"))))
    return rows.where("__place = 1").select("loan_id", "metric_key", "value", "confidence", "source_header", "candidates", why.alias("rationale"))


def merge_reports(months: DataFrame, full_year_only: bool = False) -> DataFrame:
    """months: report_order, loan_id, annualized_noi, noi_start, noi_end, period_days, is_full_year.

    A loan keeps its full-year period, else the longest, else the latest. `conflict` marks loans whose reports
    differ by CONFLICT_RATIO or more.
    """
    w = Window.partitionBy("loan_id")
    order = w.orderBy(F.desc("is_full_year"), F.desc("period_days"), F.desc("noi_end"), "report_order")
    lo, hi = F.min("annualized_noi").over(w), F.max("annualized_noi").over(w)
    rows = months.withColumn("conflict", F.coalesce((lo > 0) & (hi / lo >= CONFLICT_RATIO), F.lit(False))).withColumn("__place", F.row_number().over(order))
    rows = rows.where("__place = 1").drop("__place")
    return rows.where("is_full_year") if full_year_only else rows


def annualise(rows: DataFrame, least_days: int = 80, full_days: int = 300) -> DataFrame:
    """loan_id, noi, noi_start, noi_end -> annualized_noi, period_days, is_full_year; short or undated periods go."""
    days = F.datediff("noi_end", "noi_start") + 1
    rows = rows.withColumn("period_days", days).where(F.col("period_days") >= least_days)
    full = F.col("period_days") >= full_days
    return rows.withColumn("is_full_year", full).withColumn("annualized_noi", F.when(full, F.col("noi")).otherwise(F.col("noi") * 365 / F.col("period_days")))


def merge_event_feeds(delinquent: DataFrame, special: DataFrame) -> DataFrame:
    """Full outer join of two feeds by report and loan; shared columns take the first that is there."""
    key = ["report_accession", "loan_id"]
    shared = [x for x in special.columns if x not in key and x in delinquent.columns]
    d = delinquent.withColumn("__d", F.lit(True))
    s = special.select(*key, *[F.col(x).alias(f"__s_{x}") for x in special.columns if x not in key]).withColumn("__s", F.lit(True))
    out = d.join(s, key, "full")
    for x in shared:
        out = out.withColumn(x, F.coalesce(x, f"__s_{x}"))
    rest = [F.col(f"__s_{x}").alias(x) for x in special.columns if x not in key and x not in shared]
    source = F.when(F.col("__d").isNull(), "special").when(F.col("__s").isNull(), "delinquency").otherwise("both")
    return out.select(*key, *[x for x in delinquent.columns if x not in key], *rest, source.alias("source"))
