"""The state of a corpus as snapshots, what moved between two of them, and thresholds that the corpus has outgrown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Falls of coverage and rises of the share without a type that are news; growth from which a threshold is worth rereading: fixed values.
DROP, UNTYPED_RISE, GROWTH = 0.02, 0.005, 0.25
#: Unmapped headers that a snapshot holds, those of most filings.
HEADERS = 400

# Thresholds, the number of loans that each was justified with, and whether it has a basis at all.
THRESHOLDS = (
    ("db:power", "CLAIMED_EFFECT", "10.5%", 8935, True),
    ("db:cohort", "MAX_EXCESS", "1.6x the floor", 9694, False),
    ("db:cohort / cohortBenchmark", "MIN_PAIRS", "15", 8935, True),
    ("cohortBenchmark", "TYPE_CONCENTRATION", "0.8", 9694, True),
    ("cohortBenchmark", "MIN_PER_METRIC", "10 loans", 9694, True),
    ("annexStructure", "MAX_PHANTOM_SHARE", "15%", 9694, True),
)

SNAPSHOT = "taken_at string, kind string, subject string, value double"


def snapshot(filings: DataFrame, loans: DataFrame, facts: DataFrame, metrics: tuple[str, ...], taken_at: str) -> DataFrame:
    """taken_at, kind, subject, value of the corpus whose filings are given.

    Kinds: loans, issuances, coverage (share of loans with a metric that is a number without sign), untyped
    (loans without a type), taxonomy (newest version), versions (number of them), header (an unmapped header and its filings).
    """
    mine = loans.join(filings.select("accession"), "accession", "left_semi")
    row = lambda kind, subject, value: F.struct(F.lit(kind).alias("kind"), F.lit(subject).alias("subject"), value.cast("double").alias("value"))
    totals = mine.agg(F.count(F.lit(1)).alias("loans"), F.count(F.when(F.col("property_type").isNull(), 1)).alias("untyped"))
    counts = totals.select(F.inline(F.array(row("loans", None, F.col("loans")), row("untyped", None, F.col("untyped")))))
    about = filings.agg(F.count(F.lit(1)).alias("n"), F.max("taxonomy_version").alias("newest"), F.count_distinct("taxonomy_version").alias("versions"))
    about = about.select(F.inline(F.array(row("issuances", None, F.col("n")), row("taxonomy", None, F.col("newest")), row("versions", None, F.col("versions")))))
    good = facts.where(F.col("metric_key").isin(*metrics) & F.col("value").rlike("^[0-9.]+$")).join(mine.select("loan_id"), "loan_id", "left_semi")
    had = good.select("metric_key", "loan_id").distinct().groupBy("metric_key").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(totals))
    coverage = had.select(F.lit("coverage").alias("kind"), F.col("metric_key").alias("subject"), (F.col("n") / F.greatest("loans", F.lit(1))).alias("value"))
    headers = filings.select("accession", F.explode("columns_unmapped").alias("subject")).groupBy("subject").agg(F.count_distinct("accession").cast("double").alias("value"))
    headers = headers.orderBy(F.desc("value"), "subject").limit(HEADERS).select(F.lit("header").alias("kind"), "subject", "value")
    out = counts.unionByName(about).unionByName(coverage).unionByName(headers)
    return out.select(F.lit(taken_at).alias("taken_at"), "kind", "subject", "value")


def save_snapshot(rows: DataFrame, folder: str) -> None:
    """Adds a snapshot; what is there stays as it is."""
    rows.write.mode("append").json(folder)


def snapshot_as_of(spark: SparkSession, folder: str, when: str) -> DataFrame:
    """The newest snapshot taken at `when` or before; no rows if there is none."""
    rows = spark.read.schema(SNAPSHOT).json(folder).where(F.col("taken_at") <= when)
    newest = rows.agg(F.max("taken_at").alias("newest"))
    return rows.join(F.broadcast(newest), F.col("taken_at") == F.col("newest")).drop("newest")


def alerts(before: DataFrame, after: DataFrame) -> DataFrame:
    """severity (alert or note), kind, subject, before, after: what changed between two snapshots and matters.

    Alerts: a metric's coverage that fell by DROP, a share without type that rose by UNTYPED_RISE, every header
    that the snapshot before doesn't have, several versions of the taxonomy at once. Notes: another taxonomy,
    another number of loans. Without a snapshot before only the versions are judged.
    """
    b, a = (x.select("kind", "subject", F.col("value").alias(n)) for x, n in ((before, "before"), (after, "after")))
    same = (F.col("a.kind") == F.col("b.kind")) & F.col("a.subject").eqNullSafe(F.col("b.subject"))
    pairs = a.alias("a").join(b.alias("b"), same, "full").select(F.coalesce("a.kind", "b.kind").alias("kind"), F.coalesce("a.subject", "b.subject").alias("subject"), "before", "after")
    total = lambda x, n: F.max(F.when(F.col("kind") == "loans", F.col(x))).alias(n)
    sizes = pairs.agg(total("before", "loans_before"), total("after", "loans_after"))
    rows = pairs.crossJoin(F.broadcast(sizes)).withColumn("first", F.col("loans_before").isNull())
    share = lambda n: F.col(n) / F.greatest(F.col(f"loans_{n}"), F.lit(1.0))
    is_ = lambda kind: F.col("kind") == kind
    # A share at a limit must not hang on its last bit.
    reaches = lambda x, limit: F.round(x, 9) >= limit
    fell = is_("coverage") & reaches(F.coalesce("before", F.lit(0.0)) - F.coalesce("after", F.lit(0.0)), DROP)
    untyped = is_("untyped") & reaches(share("after") - share("before"), UNTYPED_RISE)
    new = is_("header") & F.col("before").isNull() & F.col("after").isNotNull()
    alert = (~F.col("first") & (fell | untyped | new)) | (is_("versions") & (F.col("after") > 1))
    note = ~F.col("first") & (is_("taxonomy") | is_("loans")) & ~F.col("before").eqNullSafe(F.col("after"))
    shown: dict[str, Column] = {n: F.when(is_("untyped"), share(n)).otherwise(F.col(n)) for n in ("before", "after")}
    severity = F.when(F.coalesce(alert, F.lit(False)), "alert").when(F.coalesce(note, F.lit(False)), "note")
    return rows.withColumn("severity", severity).where(F.col("severity").isNotNull()).select("severity", "kind", "subject", *[c.alias(n) for n, c in shown.items()])


def stale_thresholds(loans: DataFrame, growth: float = GROWTH) -> DataFrame:
    """script, name, setting, justified_with, loans, grew, stale, founded: each threshold against the corpus of today."""
    spark = loans.sparkSession
    rows = spark.createDataFrame(list(THRESHOLDS), "script string, name string, setting string, justified_with long, founded boolean")
    grew = (F.col("loans") - F.col("justified_with")) / F.greatest("justified_with", F.lit(1))
    out = rows.crossJoin(loans.agg(F.count(F.lit(1)).alias("loans"))).withColumn("grew", F.round(grew, 6))
    return out.withColumn("stale", F.col("grew") >= growth)
