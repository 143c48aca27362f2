"""The corpus against its own past: histories of reports, snapshots and alerts, thresholds, gaps in histograms, merged reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import monitor, picking, runs, servicer
from ..sources.bridge import Corpus
from ..sources.stage import shared_folder
from ..sources.upsert import KeyedTable
from .quality import KPIS
from .registry import query

SPACED = """r as (select cik, accession, coalesce(period, filed_at) as dated, row_number() over (partition by cik order by coalesce(period, filed_at) desc, accession) as n from monthly_reports),
    fold(cik, n, last, dated, accession, place) as (
        select cik, n, dated, dated, accession, 1 from r where n = 1
        union all
        select r.cik, r.n, case when f.last - r.dated >= 6 * 30.44 - 10 then r.dated else f.last end, r.dated, case when f.last - r.dated >= 6 * 30.44 - 10 then r.accession end, case when f.last - r.dated >= 6 * 30.44 - 10 then f.place + 1 else f.place end
        from fold f join r on r.cik = f.cik and r.n = f.n + 1),
    chosen as (select cik, accession, dated, place from fold where accession is not null)"""
HISTORY = """per as (
    select c.cik, count(distinct c.accession) as reports, min(c.dated) as oldest, max(c.dated) as newest,
        count(distinct case when c.place = 1 and e.transfer_date is not null then e.loan_id end) as today, count(distinct case when e.transfer_date is not null then e.loan_id end) as ever
    from chosen c left join monthly_events e on e.report = c.accession group by c.cik)"""


def _history(c: Corpus) -> DataFrame:
    reports = picking.spaced_reports(c.monthly_reports, 6)
    return servicer.stock_and_history(reports, c.monthly_events)


@query(f"with recursive {SPACED}, {HISTORY} select cik, reports, oldest, newest, today, ever, case when today > 0 then round(ever / cast(today as double), 6) when ever = 0 then 1.0e0 end as ratio from per")
def history_ratio(c: Corpus) -> DataFrame:
    """Events that a deal's newest report shows against all that its reports of every half year have shown."""
    return _history(c)


@query(f"with recursive {SPACED}, {HISTORY} select split_part(cik, '-', 2) as vintage, sum(today) as today, sum(ever) as ever, case when sum(today) > 0 then round(sum(ever) / cast(sum(today) as double), 6) else 0 end as ratio from per group by 1")
def history_by_vintage(c: Corpus) -> DataFrame:
    out = _history(c).groupBy(F.split_part("cik", F.lit("-"), F.lit(2)).alias("vintage")).agg(F.sum("today").alias("today"), F.sum("ever").alias("ever"))
    return out.withColumn("ratio", F.when(F.col("today") > 0, F.round(F.col("ever") / F.col("today"), 6)).otherwise(0.0))


@query("""with n as (select l.accession, l.loan_id, count(f.loan_id) as k from loans l left join facts f on f.loan_id = l.loan_id group by 1, 2),
    h as (select distinct accession, k from n), nexts as (select *, lead(k) over (partition by accession order by k) as following from h),
    gaps as (select accession, k + 1 as start, following - k - 1 as length from nexts where following - k > 1)
    select *, row_number() over (partition by accession order by length desc, start) = 1 as longest from gaps""")
def audit_empty_runs(c: Corpus) -> DataFrame:
    """Numbers of facts that no loan of an issuance has, between its least and its greatest."""
    n = c.loans.select("accession", "loan_id").join(c.facts.select("loan_id", "metric_key"), "loan_id", "left").groupBy("accession", "loan_id").agg(F.count("metric_key").alias("k"))
    return runs.empty_runs(n, ["accession"], "k")


#: Two days on which the corpus is looked at.
BEFORE, AFTER = "2019-02-28", "2022-12-31"
METRICS = ", ".join(f"'{k}'" for k in KPIS)


def _state(name: str, day: str) -> str:
    return f"""{name}_f as (select * from filings where filed_at <= date '{day}'), {name}_l as (select l.* from loans l join {name}_f f on f.accession = l.accession),
    {name}_n as (select count(*) as n, count(*) filter (where property_type is null) as untyped from {name}_l),
    {name}_c as (select metric_key, count(distinct l.loan_id) / cast((select n from {name}_n) as double) as share from facts join {name}_l l on l.loan_id = facts.loan_id where metric_key in ({METRICS}) and regexp_matches(value, '^[0-9.]+$') group by 1),
    {name}_h as (select header, count(distinct accession) as n from (select accession, unnest(columns_unmapped) as header from {name}_f) group by 1)"""


@query(f"""with {_state("b", BEFORE)}, {_state("a", AFTER)}
    select 'alert' as severity, 'coverage' as kind, k.metric_key as subject, b_c.share as before, a_c.share as after from (select metric_key from b_c union select metric_key from a_c) k left join b_c on b_c.metric_key = k.metric_key left join a_c on a_c.metric_key = k.metric_key
        where round(coalesce(b_c.share, 0) - coalesce(a_c.share, 0), 9) >= 0.02
    union all select 'alert', 'untyped', null, b.untyped / cast(b.n as double), a.untyped / cast(a.n as double) from b_n b, a_n a where round(a.untyped / cast(a.n as double) - b.untyped / cast(b.n as double), 9) >= 0.005
    union all select 'alert', 'header', header, null, n from a_h where header not in (select header from b_h)
    union all select 'alert', 'versions', null, (select count(distinct taxonomy_version) from b_f), count(distinct taxonomy_version) from a_f having count(distinct taxonomy_version) > 1
    union all select 'note', 'taxonomy', null, b.v, a.v from (select max(taxonomy_version) as v from b_f) b, (select max(taxonomy_version) as v from a_f) a where a.v <> b.v
    union all select 'note', 'loans', null, b.n, a.n from b_n b, a_n a where a.n <> b.n""")
def monitor_alerts(c: Corpus) -> DataFrame:
    """What a monitor would report between two looks at the corpus; each look is stored, and read back as of its day."""
    folder = f"{shared_folder(c.spark)}/tessera/snapshots-{uuid.uuid4().hex}"
    for day in (BEFORE, AFTER):
        known = c.filed_by(day)
        monitor.save_snapshot(monitor.snapshot(known.filings, known.loans, known.facts_of(*KPIS), KPIS, day), folder)
    return monitor.alerts(monitor.snapshot_as_of(c.spark, folder, BEFORE), monitor.snapshot_as_of(c.spark, folder, "2023-06-30"))


@query("""with t as (select * from (values ('db:power', 'CLAIMED_EFFECT', '10.5%', 8935, true), ('db:cohort', 'MAX_EXCESS', '1.6x the floor', 9694, false), ('db:cohort / cohortBenchmark', 'MIN_PAIRS', '15', 8935, true),
        ('cohortBenchmark', 'TYPE_CONCENTRATION', '0.8', 9694, true), ('cohortBenchmark', 'MIN_PER_METRIC', '10 loans', 9694, true), ('annexStructure', 'MAX_PHANTOM_SHARE', '15%', 9694, true)) v(script, name, setting, justified_with, founded))
    select *, round((loans - justified_with) / cast(justified_with as double), 6) as grew, round((loans - justified_with) / cast(justified_with as double), 6) >= 0.25 as stale from t, (select count(*) as loans from loans)""")
def stale_thresholds(c: Corpus) -> DataFrame:
    """Thresholds that were justified with a much smaller corpus, and those without a basis."""
    return monitor.stale_thresholds(c.loans)


@query("""with second as (
        select report_accession, loan_id, case when loan_id % 8 = 0 then null else annualized_noi * 1.5e0 end as annualized_noi, period_days + 1 as period_days from performance where loan_id % 12 = 0
        union all select concat('N-', report_accession), loan_id, annualized_noi, period_days from performance where loan_id % 20 = 0)
    select coalesce(s.report_accession, p.report_accession) as report_accession, coalesce(s.loan_id, p.loan_id) as loan_id, coalesce(s.annualized_noi, p.annualized_noi) as annualized_noi, coalesce(s.period_days, p.period_days) as period_days, 2 as n_versions
    from performance p full join second s on s.report_accession = p.report_accession and s.loan_id = p.loan_id""")
def report_upserts(c: Corpus) -> DataFrame:
    """Two months' incomes merged into one table by report and loan; a merge that is run again publishes nothing."""
    table = KeyedTable(c.spark, f"{shared_folder(c.spark)}/tessera/performance-{uuid.uuid4().hex}", ("report_accession", "loan_id"), buckets=16)
    first = c.performance.select("report_accession", "loan_id", "annualized_noi", "period_days")
    noi = F.when(F.col("loan_id") % 8 != 0, F.col("annualized_noi") * 1.5)
    second = first.where(F.col("loan_id") % 12 == 0).select("report_accession", "loan_id", noi.alias("annualized_noi"), (F.col("period_days") + 1).alias("period_days"))
    second = second.unionByName(first.where(F.col("loan_id") % 20 == 0).withColumn("report_accession", F.concat(F.lit("N-"), "report_accession")))
    for rows in (first, second, second):
        table.merge(rows, keep=("annualized_noi",))
    return table.read().withColumn("n_versions", F.lit(len(table.versions())))
