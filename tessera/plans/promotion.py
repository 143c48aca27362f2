"""Promotion of observations, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import promotion as op
from ..sources.bridge import Corpus
from .registry import query


@query("select loan_id, metric_key, value, confidence, source_header, n as candidates, case when n = 1 then 'only candidate' else concat('best of ', n, ' at ', printf('%.2f', confidence)) end as rationale from (select *, count(*) over (partition by loan_id, metric_key) as n, row_number() over (partition by loan_id, metric_key order by confidence desc, source_column) as place from observations) where place = 1")
def promote_facts(c: Corpus) -> DataFrame:
    return op.promote_facts(c.held().observations)


@query("select loan_id, metric_key, source_header, value from (select *, row_number() over (partition by loan_id, metric_key, source_header order by confidence desc, source_column) as place from observations) where place = 1")
def dedupe_observations(c: Corpus) -> DataFrame:
    return op.dedupe_observations(c.held().observations).select("loan_id", "metric_key", "source_header", "value")


@query("""with m as (select 1 as report_order, loan_id, annualized_noi, noi_end, period_days, is_full_year from performance union all select 2, loan_id, annualized_noi * 1.6e0, noi_end + 30, 365, true from performance where loan_id % 3 = 0 union all select 3, loan_id, annualized_noi * 1.1e0, noi_end + 60, 180, false from performance where loan_id % 5 = 0)
    select loan_id, report_order, period_days, is_full_year, conflict from (select *, coalesce(min(annualized_noi) over (partition by loan_id) > 0 and max(annualized_noi) over (partition by loan_id) / min(annualized_noi) over (partition by loan_id) >= 1.5, false) as conflict,
    row_number() over (partition by loan_id order by is_full_year desc, period_days desc, noi_end desc, report_order) as place from m) where place = 1""")
def merge_reports(c: Corpus) -> DataFrame:
    p = c.performance.select(F.lit(1).alias("report_order"), "loan_id", "annualized_noi", "noi_end", "period_days", "is_full_year")
    later = p.where(F.col("loan_id") % 3 == 0).select(F.lit(2), "loan_id", F.col("annualized_noi") * 1.6, F.date_add("noi_end", 30), F.lit(365), F.lit(True))
    half = p.where(F.col("loan_id") % 5 == 0).select(F.lit(3), "loan_id", F.col("annualized_noi") * 1.1, F.date_add("noi_end", 60), F.lit(180), F.lit(False))
    return op.merge_reports(p.unionAll(later).unionAll(half)).select("loan_id", "report_order", "period_days", "is_full_year", "conflict")
