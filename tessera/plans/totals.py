"""Counts and small statements around the analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import count_if, loans_wide, with_filing
from ..functions.parsing import loan_prefix
from ..sources.bridge import TABLES, Corpus
from .outcomes import outcomes
from .registry import QUERIES, SQL, query
from .shared_sql import OUTCOMES, fact

#: What the queries of one issuer and one deal ask for.
CIK, DEAL = "003", "3-2022"


def count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


@query("select (select count(*) from filings) as filings, (select count(*) from loans) as loans")
def analyze_totals(c: Corpus) -> DataFrame:
    return count(c.filings, "filings").crossJoin(F.broadcast(count(c.loans, "loans")))


@query("select count(distinct cik) as issuers, count(*) as filings, cast(sum(n) as bigint) as loans from filings f left join (select accession, count(*) as n from loans group by 1) l on l.accession = f.accession")
def batch_totals(c: Corpus) -> DataFrame:
    n = c.loans.groupBy("accession").agg(F.count(F.lit(1)).alias("n"))
    return c.filings.join(n, "accession", "left").agg(F.count_distinct("cik").alias("issuers"), F.count(F.lit(1)).alias("filings"), F.sum("n").alias("loans"))


@query(f"select count(*) as loans, count(distinct l.accession) as filings from loans l {fact('d', 'debt_yield', 'join')} where d.v is not null")
def identity_coverage_total(c: Corpus) -> DataFrame:
    return loans_wide(c, ("debt_yield",)).where(F.col("debt_yield").isNotNull()).agg(F.count(F.lit(1)).alias("loans"), F.count_distinct("accession").alias("filings"))


@query("select count(*) as rows_n, count(distinct loan_id) as loans_n from performance")
def performance_size(c: Corpus) -> DataFrame:
    return c.performance.agg(F.count(F.lit(1)).alias("rows_n"), F.count_distinct("loan_id").alias("loans_n"))


@query(f"with {OUTCOMES} select count(*) as total, count(noi_underwritten) as with_uw, count(*) filter (where noi_underwritten is not null and noi_trailing is not null) as with_all from outcomes")
def performance_join_coverage(c: Corpus) -> DataFrame:
    both = F.col("noi_underwritten").isNotNull() & F.col("noi_trailing").isNotNull()
    return outcomes(c).agg(F.count(F.lit(1)).alias("total"), F.count("noi_underwritten").alias("with_uw"), count_if(both).alias("with_all"))


@query("select metric_key, count(distinct loan_id) as loans, count(distinct source_header) as distinct_headers from observations group by 1 order by loans desc, metric_key limit 40")
def corpus_stats_metrics(c: Corpus) -> DataFrame:
    # Each pair once, where its loan is: two distinct counts in one pass would multiply the rows and send them all.
    pairs = lambda x: c.held().observations.select("metric_key", x).distinct().groupBy("metric_key")
    out = pairs("loan_id").agg(F.count(F.lit(1)).alias("loans")).join(pairs("source_header").agg(F.count("source_header").alias("distinct_headers")), "metric_key")
    return out.orderBy(F.desc("loans"), "metric_key").limit(40)


def _headers(c: Corpus, most: int) -> DataFrame:
    h = c.filings.select("accession", F.explode("columns_unmapped").alias("header")).groupBy("header").agg(F.count_distinct("accession").alias("filings"))
    return h.orderBy(F.desc("filings"), "header").limit(most)


_UNMAPPED = "select header, count(distinct accession) as filings from (select accession, unnest(columns_unmapped) as header from filings) group by 1 order by filings desc, header limit {}"


@query(_UNMAPPED.format(15))
def corpus_stats_unmapped(c: Corpus) -> DataFrame:
    return _headers(c, 15)


@query(_UNMAPPED.format(400))
def monitor_headers(c: Corpus) -> DataFrame:
    return _headers(c, 400)


@query(f"select f.accession, f.company_name, f.filed_at, count(l.loan_id) as loans from filings f left join loans l on l.accession = f.accession where f.cik = '{CIK}' group by 1, 2, 3")
def filings_of_cik(c: Corpus) -> DataFrame:
    rows = c.filings.where(F.col("cik") == CIK).join(c.loans.select("accession", "loan_id"), "accession", "left")
    return rows.groupBy("accession", "company_name", "filed_at").agg(F.count("loan_id").alias("loans"))


@query("select f.cik, count(l.loan_id) as loans from filings f join loans l on l.accession = f.accession where f.accession not in (select distinct accession from loans where regexp_matches(loan_ref, '^[0-9]')) group by 1")
def missing_id_filings(c: Corpus) -> DataFrame:
    numbered = c.loans.where(F.col("loan_ref").rlike("^[0-9]")).select("accession").distinct()
    return c.filings.join(numbered, "accession", "left_anti").join(c.loans, "accession").groupBy("cik").agg(F.count("loan_id").alias("loans"))


@query("select count(*) as rows_n, count(distinct p.loan_id) as loans_n from performance p join loans l on l.loan_id = p.loan_id join filings f on f.accession = l.accession where f.taxonomy_version < (select max(taxonomy_version) from filings)")
def refresh_cost(c: Corpus) -> DataFrame:
    newest = c.filings.agg(F.max("taxonomy_version").alias("newest"))
    stale = c.filings.crossJoin(F.broadcast(newest)).where(F.col("taxonomy_version") < F.col("newest")).select("accession")
    rows = c.performance.join(c.loans.join(stale, "accession", "left_semi").select("loan_id"), "loan_id")
    return rows.agg(F.count(F.lit(1)).alias("rows_n"), F.count_distinct("loan_id").alias("loans_n"))


@query(f"""select sr.accession, f.accession as deal_accession from servicer_reports sr
    join (select cik, min(accession) as accession from filings group by 1 having count(*) = 1) f on regexp_matches(f.cik, '^[0-9]+$') and regexp_matches(sr.cik, '^[0-9]+$') and try_cast(f.cik as bigint) = try_cast(sr.cik as bigint)""")
def backfill_deal_accession(c: Corpus) -> DataFrame:
    """The deal of each report by its issuer's number, where the issuer has one filing."""
    one = c.filings.groupBy("cik").agg(F.min("accession").alias("deal_accession"), F.count(F.lit(1)).alias("n")).where(F.col("n") == 1)
    number = lambda x: F.when(F.col(x).rlike("^[0-9]+$"), F.col(x).try_cast("long"))
    reports = c.servicer_reports.select("accession", number("cik").alias("k"))
    return reports.join(one.select(number("cik").alias("k"), "deal_accession"), "k").select("accession", "deal_accession")


@query("""with p as (select f.accession, year(f.filed_at) as vintage, count(*) as pool from filings f join loans l on l.accession = f.accession group by 1, 2)
    select vintage, accession, pool from (select *, row_number() over (partition by vintage order by pool desc, accession) as place from p) where place = 1""")
def tie_trusts(c: Corpus) -> DataFrame:
    p = with_filing(c, c.loans).groupBy("accession", "vintage").agg(F.count(F.lit(1)).alias("pool"))
    best = p.groupBy("vintage").agg(F.min(F.struct((-F.col("pool")).alias("m"), "accession")).alias("b"))
    return best.select("vintage", "b.accession", (-F.col("b.m")).alias("pool"))


@query("""select left(f.company_name, 34) as name, f.accession, count(l.loan_id) as pool, count(d.loan_id) as with_dscr, count(t.loan_id) as with_ltv, strftime(f.filed_at, '%m') as month from filings f join loans l on l.accession = f.accession
    left join (select loan_id from facts where metric_key = 'dscr') d on d.loan_id = l.loan_id left join (select loan_id from facts where metric_key = 'ltv') t on t.loan_id = l.loan_id group by f.company_name, f.accession, f.filed_at""")
def cohort_issuances(c: Corpus) -> DataFrame:
    facts = c.facts_of("dscr", "ltv").groupBy("loan_id").agg(count_if(F.col("metric_key") == "dscr").alias("d"), count_if(F.col("metric_key") == "ltv").alias("t"))
    rows = with_filing(c, c.loans.join(facts, "loan_id", "left"))
    return rows.groupBy(F.left("company_name", F.lit(34)).alias("name"), "accession", F.date_format("filed_at", "MM").alias("month")).agg(F.count("loan_id").alias("pool"), F.sum(F.coalesce("d", F.lit(0))).alias("with_dscr"), F.sum(F.coalesce("t", F.lit(0))).alias("with_ltv"))


def schema_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the tables that the corpus is made from can be read, with the number of their columns."""
    found = []
    for t in TABLES:
        try:
            found.append((t, len(spark.read.parquet(f"{sf_dir}/{t}.parquet").columns)))
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found.append((t, 0))
    return spark.createDataFrame(found, "name string, n_columns int")


QUERIES["schema_ready"] = schema_ready
SQL["schema_ready"] = "select table_name as name, cast(count(*) as integer) as n_columns from information_schema.columns where table_name in ('orders', 'customer', 'lineitem') group by 1"


# --- reports against loans of one deal

_PAIRS = f"""own as (select * from (select cast(try_cast(regexp_extract(loan_ref, '^0*([0-9]+)', 1) as bigint) as bigint) as k, l.loan_id, row_number() over (partition by regexp_extract(loan_ref, '^0*([0-9]+)', 1) order by row_index) as place from loans l where l.accession = '{DEAL}') where place = 1 and k is not null),
    served as (select distinct l.row_index as k, p.annualized_noi as actual from performance p join loans l on l.loan_id = p.loan_id where l.accession = '{DEAL}')"""


def _sides(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """Loans of the deal by their number, the first of each, and reported loans by theirs."""
    own = c.loans.where(F.col("accession") == DEAL).select(loan_prefix("loan_ref").cast("long").alias("k"), "loan_id", "row_index").where(F.col("k").isNotNull())
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("row_index"))).where("place = 1").select("k", "loan_id")
    served = c.performance.join(c.loans.where(F.col("accession") == DEAL).select("loan_id", "row_index"), "loan_id").select(F.col("row_index").cast("long").alias("k"), F.col("annualized_noi").alias("actual")).distinct()
    return own, served


@query(f"with {_PAIRS} select s.k, round(u.v / nullif(s.actual, 0) - 1, 6) as gap from served s join own o on o.k = s.k {fact('u', 'noi_underwritten', 'join', loan='o.loan_id')}")
def servicer_join_pairs(c: Corpus) -> DataFrame:
    own, served = _sides(c)
    rows = served.join(own, "k").join(loans_wide(c, ("noi_underwritten",)).select("loan_id", "noi_underwritten"), "loan_id").where(F.col("noi_underwritten").isNotNull())
    return rows.select("k", F.round(F.col("noi_underwritten") / F.nullif("actual", F.lit(0.0)) - 1, 6).alias("gap"))


@query(f"with {_PAIRS} select (select count(*) from served s join own o on o.k = s.k) as matched, (select count(*) from served where k not in (select k from own)) as servicer_only, (select count(*) from own where k not in (select k from served)) as corpus_only")
def servicer_join_split(c: Corpus) -> DataFrame:
    own, served = _sides(c)
    both = own.withColumn("o", F.lit(True)).join(served.withColumn("s", F.lit(True)), "k", "full")
    return both.agg(count_if(F.col("o") & F.col("s")).alias("matched"), count_if(F.col("o").isNull()).alias("servicer_only"), count_if(F.col("s").isNull()).alias("corpus_only"))
