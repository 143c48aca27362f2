"""Coverage, gaps and monitoring of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import count_if, loans_wide, num_nonneg, pct, share_if, shelf, with_filing
from ..sources.bridge import Corpus
from .registry import query
from .shared_sql import GATE_NONNEG, fact, med, shelf_sql

_SHELF = shelf_sql("sr.company_name")
KPIS = ("loan_amount", "ltv", "dscr", "debt_yield", "occupancy", "interest_rate", "noi_underwritten")


@query("select cast(sum(parsed_rows) as bigint) as parsed, cast(sum(matched_rows) as bigint) as joined, (select count(*) from delinquency) as n_rows from servicer_reports")
def coverage_global(c: Corpus) -> DataFrame:
    rows = c.delinquency.agg(F.count(F.lit(1)).alias("n_rows"))
    return c.servicer_reports.agg(F.sum("parsed_rows").alias("parsed"), F.sum("matched_rows").alias("joined")).crossJoin(F.broadcast(rows))


@query(f"""select {_SHELF} as shelf, count(*) as issuances, cast(sum(parsed_rows) as bigint) as parsed, cast(sum(matched_rows) as bigint) as joined, cast(sum((select count(*) from delinquency d where d.report_accession = sr.accession)) as bigint) as n_rows, cast(sum(pool_loans) as bigint) as pool from servicer_reports sr group by 1""")
def coverage_by_shelf(c: Corpus) -> DataFrame:
    n = c.delinquency.groupBy(F.col("report_accession").alias("accession")).agg(F.count(F.lit(1)).alias("n"))
    rows = c.servicer_reports.join(n, "accession", "left")
    return rows.groupBy(shelf().alias("shelf")).agg(F.count(F.lit(1)).alias("issuances"), F.sum("parsed_rows").alias("parsed"), F.sum("matched_rows").alias("joined"), F.sum(F.coalesce("n", F.lit(0))).alias("n_rows"), F.sum("pool_loans").alias("pool"))


@query("select left(company_name, 36) as issuance, parsed_rows as parsed, matched_rows as joined, pool_loans as pool from servicer_reports where parsed_rows > matched_rows order by parsed_rows - matched_rows desc, company_name limit 12")
def coverage_worst(c: Corpus) -> DataFrame:
    lost = F.col("parsed_rows") - F.col("matched_rows")
    rows = c.servicer_reports.where(lost > 0).orderBy(lost.desc(), "company_name").limit(12)
    return rows.select(F.left("company_name", F.lit(36)).alias("issuance"), F.col("parsed_rows").alias("parsed"), F.col("matched_rows").alias("joined"), F.col("pool_loans").alias("pool"))


@query(f"select {_SHELF} as shelf, count(*) as n, count(*) filter (where d.months_delinquent = 0) as zero, count(*) filter (where d.months_delinquent >= 2) as two_plus, count(d.transfer_date) as transferred, count(*) filter (where d.foreclosure_date is not null or d.reo_date is not null) as foreclosure, {med('d.months_delinquent')} as median from delinquency d join servicer_reports sr on sr.accession = d.report_accession group by 1 having count(*) >= 5")
def delinquency_population(c: Corpus) -> DataFrame:
    rows = c.delinquency.join(c.servicer_reports.select(F.col("accession").alias("report_accession"), "company_name"), "report_accession")
    m = F.col("months_delinquent")
    out = rows.groupBy(shelf().alias("shelf")).agg(F.count(F.lit(1)).alias("n"), count_if(m == 0).alias("zero"), count_if(m >= 2).alias("two_plus"), F.count("transfer_date").alias("transferred"), count_if(F.col("foreclosure_date").isNotNull() | F.col("reo_date").isNotNull()).alias("foreclosure"), pct(m).alias("median"))
    return out.where(F.col("n") >= 5)


@query(f"select {_SHELF} as shelf, count(*) as issuances, count(*) filter (where delinquency_tables = 0) as no_block, count(*) filter (where delinquency_tables > 0 and data_rows = 0) as empty_block, count(*) filter (where data_rows > 0 and parsed_rows = 0) as all_discarded, count(*) filter (where parsed_rows > 0) as with_rows from servicer_reports sr group by 1")
def coverage_causes(c: Corpus) -> DataFrame:
    tables, rows, parsed = F.col("delinquency_tables"), F.col("data_rows"), F.col("parsed_rows")
    return c.servicer_reports.groupBy(shelf().alias("shelf")).agg(F.count(F.lit(1)).alias("issuances"), count_if(tables == 0).alias("no_block"), count_if((tables > 0) & (rows == 0)).alias("empty_block"), count_if((rows > 0) & (parsed == 0)).alias("all_discarded"), count_if(parsed > 0).alias("with_rows"))


@query(f"select {_SHELF} as shelf, coalesce(master_servicer, '(no data)') as master, count(*) as n from servicer_reports sr group by 1, 2")
def shelf_master_crosstab(c: Corpus) -> DataFrame:
    return c.servicer_reports.groupBy(shelf().alias("shelf"), F.coalesce("master_servicer", F.lit("(no data)")).alias("master")).agg(F.count(F.lit(1)).alias("n"))


# --- missing states

_EMPTY = "(l.state is null or trim(l.state) = '')"


def _empty(column: str = "state") -> Column:
    return F.col(column).isNull() | (F.trim(column) == "")


@query(f"select count(*) filter (where {_EMPTY}) as empty, count(*) as total, count(*) filter (where not {_EMPTY} and length(trim(l.state)) <> 2) as invalid from loans l")
def missing_state_totals(c: Corpus) -> DataFrame:
    return c.loans.agg(count_if(_empty()).alias("empty"), F.count(F.lit(1)).alias("total"), count_if(~_empty() & (F.length(F.trim("state")) != 2)).alias("invalid"))


@query(f"""with p as (select accession, count(*) filter (where {_EMPTY}) as empty from loans l group by 1) select count(*) filter (where empty > 0) as issuances_with, count(*) as issuances_total, (select cast(sum(empty) as bigint) from (select empty from p order by empty desc limit 5)) as top5,
    (select cast(percentile_disc(0.5) within group (order by empty) as bigint) from p where empty > 0) as median from p""")
def missing_state_concentration(c: Corpus) -> DataFrame:
    p = c.loans.groupBy("accession").agg(count_if(_empty()).alias("empty"))
    top = p.orderBy(F.desc("empty")).limit(5).agg(F.sum("empty").alias("top5"))
    middle = p.where(F.col("empty") > 0).agg(F.expr("percentile_disc(0.5) within group (order by empty)").cast("long").alias("median"))
    return p.agg(count_if(F.col("empty") > 0).alias("issuances_with"), F.count(F.lit(1)).alias("issuances_total")).crossJoin(F.broadcast(top)).crossJoin(F.broadcast(middle))


@query(f"select count(*) as n, count(*) filter (where p.v > 1) as multi, count(p.v) as with_count, count(*) filter (where l.city is null) as without_city, count(*) filter (where lower(trim(coalesce(l.city, ''))) like 'various%') as city_various, count(*) filter (where l.property_type is null) as without_type from loans l {fact('p', 'property_count', gate=GATE_NONNEG)} where {_EMPTY}")
def missing_state_evidence(c: Corpus) -> DataFrame:
    rows = loans_wide(c, ("property_count",), num_nonneg).where(_empty())
    return rows.agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("property_count") > 1).alias("multi"), F.count("property_count").alias("with_count"), count_if(F.col("city").isNull()).alias("without_city"),
        count_if(F.lower(F.trim(F.coalesce("city", F.lit("")))).like("various%")).alias("city_various"), count_if(F.col("property_type").isNull()).alias("without_type"),
    )


@query(f"select cast(year(f.filed_at) as varchar) as year, count(*) filter (where {_EMPTY}) as empty, count(*) as loans, count(distinct l.accession) as issuances from loans l join filings f on f.accession = l.accession group by 1")
def missing_state_by_year(c: Corpus) -> DataFrame:
    return with_filing(c, c.loans).groupBy(F.date_format("filed_at", "yyyy").alias("year")).agg(count_if(_empty()).alias("empty"), F.count(F.lit(1)).alias("loans"), F.count_distinct("accession").alias("issuances"))


@query(f"select l.accession, count(*) filter (where {_EMPTY}) as n, count(*) as loans, count(*) filter (where {_EMPTY} and p.v > 1) as multi from loans l {fact('p', 'property_count', gate=GATE_NONNEG)} group by 1 having count(*) filter (where {_EMPTY}) > 0 order by n desc, l.accession limit 10")
def missing_state_worst(c: Corpus) -> DataFrame:
    out = loans_wide(c, ("property_count",), num_nonneg).groupBy("accession").agg(count_if(_empty()).alias("n"), F.count(F.lit(1)).alias("loans"), count_if(_empty() & (F.col("property_count") > 1)).alias("multi"))
    return out.where(F.col("n") > 0).orderBy(F.desc("n"), "accession").limit(10)


@query("select count(property_rows_dropped) as with_count, cast(coalesce(sum(property_rows_dropped), 0) as bigint) as dropped, count(*) as filings from filings")
def missing_state_dropped(c: Corpus) -> DataFrame:
    return c.filings.agg(F.count("property_rows_dropped").alias("with_count"), F.coalesce(F.sum("property_rows_dropped"), F.lit(0)).alias("dropped"), F.count(F.lit(1)).alias("filings"))


@query("select year(f.filed_at) as vintage, count(*) as loans, count(*) filter (where l.property_type is null) as untyped, count(distinct l.accession) filter (where l.property_type is null) as issuances from loans l join filings f on f.accession = l.accession group by 1")
def type_gap_by_vintage(c: Corpus) -> DataFrame:
    gap = F.col("property_type").isNull()
    return with_filing(c, c.loans).groupBy("vintage").agg(F.count(F.lit(1)).alias("loans"), count_if(gap).alias("untyped"), F.count_distinct(F.when(gap, F.col("accession"))).alias("issuances"))


# --- monitoring


@query("select metric_key, count(distinct loan_id) as n from facts where metric_key in ('" + "', '".join(KPIS) + f"') and regexp_matches(value, {GATE_NONNEG}) group by 1")
def monitor_coverage(c: Corpus) -> DataFrame:
    rows = c.facts.where(F.col("metric_key").isin(*KPIS) & F.col("value").rlike(r"^[0-9.]+$"))
    return rows.groupBy("metric_key").agg(F.count_distinct("loan_id").alias("n"))


@query("select coalesce(nullif(trim(state), ''), '(empty)') as value, count(*) as n from loans where state is null or length(trim(state)) <> 2 group by 1 order by n desc, value limit 12")
def monitor_invalid_states(c: Corpus) -> DataFrame:
    value = F.coalesce(F.nullif(F.trim("state"), F.lit("")), F.lit("(empty)"))
    rows = c.loans.where(F.col("state").isNull() | (F.length(F.trim("state")) != 2))
    return rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(12)


@query("select trim(state) as state, count(*) as n from loans where length(trim(state)) = 2 group by 1")
def monitor_by_state(c: Corpus) -> DataFrame:
    return c.loans.where(F.length(F.trim("state")) == 2).groupBy(F.trim("state").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as n from loans where property_type is null")
def monitor_without_type(c: Corpus) -> DataFrame:
    return c.loans.where(F.col("property_type").isNull()).agg(F.count(F.lit(1)).alias("n"))


@query("select round(1.0 * count(*) filter (where loan_ref <> '') / nullif(count(*), 0), 6) as with_id, round(1.0 * count(*) filter (where property_type <> '') / nullif(count(*), 0), 6) as with_type, count(*) as loans from loans")
def snapshot_shares(c: Corpus) -> DataFrame:
    return c.loans.agg(share_if(F.col("loan_ref") != "").alias("with_id"), share_if(F.col("property_type") != "").alias("with_type"), F.count(F.lit(1)).alias("loans"))


@query(f"select l.accession, count(*) as pool, count(o.v) as with_occupancy, round(count(o.v) * 1.0e0 / count(*), 6) as share from loans l {fact('o', 'occupancy')} group by 1")
def occupancy_coverage_by_issuance(c: Corpus) -> DataFrame:
    out = loans_wide(c, ("occupancy",)).groupBy("accession").agg(F.count(F.lit(1)).alias("pool"), F.count("occupancy").alias("with_occupancy"))
    return out.withColumn("share", F.round(F.col("with_occupancy") / F.col("pool"), 6))


@query("select metric_key, count(distinct l.accession) as issuances, count(*) as n from facts f join loans l on l.loan_id = f.loan_id group by 1 having count(*) >= 10")
def audit_metric_presence(c: Corpus) -> DataFrame:
    out = c.facts.join(c.loans.select("loan_id", "accession"), "loan_id").groupBy("metric_key").agg(F.count_distinct("accession").alias("issuances"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= 10)


@query("with n as (select l.loan_id, count(f.loan_id) as k from loans l left join facts f on f.loan_id = l.loan_id group by 1) select lpad(cast(k as varchar), 3, '0') as facts, count(*) as loans from n group by 1")
def audit_fact_histogram(c: Corpus) -> DataFrame:
    n = c.loans.select("loan_id").join(c.facts.select("loan_id", "metric_key"), "loan_id", "left").groupBy("loan_id").agg(F.count("metric_key").alias("k"))
    return n.groupBy(F.lpad(F.col("k").cast("string"), 3, "0").alias("facts")).agg(F.count(F.lit(1)).alias("loans"))


@query("select property_name, count(*) as n, count(distinct accession) as issuances from loans group by 1 having count(*) > 1 order by n desc, property_name limit 20")
def audit_duplicates(c: Corpus) -> DataFrame:
    out = c.loans.groupBy("property_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("accession").alias("issuances"))
    return out.where(F.col("n") > 1).orderBy(F.desc("n"), "property_name").limit(20)


@query("select accession, taxonomy_version from filings where taxonomy_version < (select max(taxonomy_version) from filings)")
def stale_filings(c: Corpus) -> DataFrame:
    newest = c.filings.agg(F.max("taxonomy_version").alias("newest"))
    return c.filings.crossJoin(F.broadcast(newest)).where(F.col("taxonomy_version") < F.col("newest")).select("accession", "taxonomy_version")


@query("select distinct cik from filings")
def known_ciks(c: Corpus) -> DataFrame:
    return c.filings.select("cik").distinct()
