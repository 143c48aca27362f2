"""Annexes printed as HTML from the corpus, with group headers, pages, a continued table, properties and a phantom row, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import annex
from ..operators.documents import PageHarvest, value_of
from ..sources.bridge import Corpus
from ..sources.stage import staged
from .registry import query
from .reports import _table, _tr

FIRST = ("Loan ID", "Loan / Property Flag", "Property Name", "State", "Cut-off Date Balance ($)", "Interest Rate (%)", "Broker Code")
SECOND = ("Loan ID", "Property Name", "Cut-off Date LTV (%)", "Occupancy (%)", "UW NOI ($)", "Number of Units", "Unit of Measure")
#: Loans up to here stand in the first table, those up to the next in its continuation, the rest on another page.
FIRST_TABLE, CONTINUED = 3, 5


def _percent(x: str) -> Column:
    n = F.floor(F.col(x) * 10000 + 0.5)
    return F.concat((n / 100).cast("decimal(20,2)").cast("string"), F.lit("%"))


def printed_annexes(c: Corpus) -> DataFrame:
    """doc_id, html: two blocks of tables on the same loans; some loans have two properties below them."""
    loans = c.by_document("annex_loans")
    pos = F.col("pos").cast("string")
    own = _tr(pos, "Loan", F.concat(F.lit("N"), pos), F.col("state"), F.concat(F.lit("$"), F.format_number("amount", 0)), _percent("rate"), (F.col("loan_id") % 1000).cast("string"))
    below = [_tr(F.concat(pos, F.lit(f".0{k}")), "Property", F.concat(F.lit("N"), pos, F.lit(f" part {k}")), "TX", "NAP", "NAP", "NAP") for k in (1, 2)]
    first = F.concat(own, F.when(F.col("loan_id") % 4 == 0, F.concat(*below)).otherwise(""))
    occupancy = F.when(F.col("loan_id") % 50 == 0, "350.00%").otherwise(_percent("occupancy"))
    noi = F.concat(F.lit("$"), F.format_number((F.floor(F.col("rev") / 10).cast("decimal(20,2)") / 100).cast("decimal(20,2)"), 2))
    is_area = F.col("loan_id") % 3 != 0
    units = F.when(is_area, F.format_number(1000 + F.col("loan_id") % 5000, 0)).otherwise(F.col("n").cast("string"))
    tie = F.col("nat") % 3 == 0
    cells = [F.concat(pos, F.lit(".00")), F.concat(F.lit("N"), pos), _percent("ltv"), occupancy, noi, units, F.when(is_area, "SF").otherwise("Units")]
    second = F.when(tie, _tr(*cells, "1.00")).otherwise(_tr(*cells))
    head, head2 = _tr(*FIRST), F.when(tie, _tr(*SECOND, "Underwritten NOI ($)")).otherwise(_tr(*SECOND))
    groups = _tr("", "", "", "Collateral", "Mortgage Loan Terms", "", "")
    # A document's few hundred loans are in one part already, and are dealt over its tables.
    docs = loans.select("doc_id", "nat", F.struct("pos", first.alias("first"), second.alias("second")).alias("x")).groupBy("doc_id", "nat").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    part = lambda name, cond: F.transform(F.filter("xs", lambda x: cond(x["pos"])), lambda x: x[name])
    out = docs.select(
        "doc_id", "nat", part("first", lambda p: p <= FIRST_TABLE).alias("one"), part("first", lambda p: p.between(FIRST_TABLE + 1, CONTINUED)).alias("more"),
        part("first", lambda p: p > CONTINUED).alias("page"), part("second", lambda p: F.lit(True)).alias("second"),
    )
    body = lambda x: F.array_join(x, "")
    phantom = _tr("", "", "", "", "", "", "12")
    some = lambda x, *rows: F.when(F.size(x) > 0, _table(*rows, body(x))).otherwise("")
    html = F.concat(_table(groups, head, body("one"), phantom), some("more"), _table(_tr("footnote", "text")), some("page", head), _table(head2, body("second"), _tr("Total", "Total", "1%", "1%", "$1")))
    return out.select("doc_id", html.alias("html"))


def _harvest(c: Corpus) -> PageHarvest:
    return PageHarvest(printed_annexes(c))


NUMBERS = """seen as (
    select doc_id, pos, 'loan_amount' as metric_key, amount * 1.0e0 as value from annex_loans
    union all select doc_id, pos, 'interest_rate', floor(rate * 10000 + 0.5) / 10000.0e0 from annex_loans where rate is not null
    union all select doc_id, pos, 'ltv', floor(ltv * 10000 + 0.5) / 10000.0e0 from annex_loans where ltv is not null
    union all select doc_id, pos, 'occupancy', case when loan_id % 50 = 0 then 3.5e0 else floor(occupancy * 10000 + 0.5) / 10000.0e0 end from annex_loans where occupancy is not null or loan_id % 50 = 0
    union all select doc_id, pos, 'noi_underwritten', floor(rev / 10.0e0) / 100.0e0 from annex_loans where rev is not null
    union all select doc_id, pos, case when loan_id % 3 <> 0 then 'square_feet' else 'units' end, case when loan_id % 3 <> 0 then 1000.0e0 + loan_id % 5000 else n * 1.0e0 end from annex_loans where loan_id % 3 <> 0 or n is not null)"""


@query(f"with {NUMBERS} select doc_id, pos * 1.0e0 as loan, metric_key, value from seen")
def annex_observations(c: Corpus) -> DataFrame:
    """Every number of a loan, from the HTML of its annex, by the joined table's rows."""
    wanted = ("loan_amount", "interest_rate", "ltv", "occupancy", "noi_underwritten", "units", "square_feet")
    numbers = F.when(value_of("seen", "loan_id").isNotNull(), F.filter("seen", lambda x: x["metric_key"].isin(*wanted)))
    seen = _harvest(c).rows.select("doc_id", value_of("seen", "loan_id").cast("double").alias("loan"), F.inline(numbers))
    return seen.select("doc_id", "loan", "metric_key", F.col("value").cast("double").alias("value"))


@query("""select doc_id, concat(pos, '.0', k) as property_ref, cast(pos as varchar) as loan_ref, concat('N', pos, ' part ', k) as property_name, 'TX' as state, loan_id
    from annex_loans, (select 1 as k union all select 2) where loan_id % 4 = 0""")
def annex_properties(c: Corpus) -> DataFrame:
    """The properties below the loans, with the corpus loan that each belongs to."""
    found = annex.with_loan(_harvest(c).properties, c.annex_loans.select("doc_id", "loan_id", F.col("pos").cast("string").alias("loan_ref")))
    return found.select("doc_id", "property_ref", "loan_ref", "property_name", "state", "loan_id")


@query("""with n as (select doc_id, count(*) as loans, 2 * count(*) filter (where loan_id % 4 = 0) as props from annex_loans group by 1)
    select doc_id, 'loan' as kind, loans as n from n union all select doc_id, 'property', props from n where props > 0
    union all select doc_id, case when 1.0e0 / (loans + props + 1) <= 0.15 then 'phantom' else 'unknown' end, 1 from n""")
def annex_rows(c: Corpus) -> DataFrame:
    """What the rows of the first block are, after pages and continuations have been put together."""
    return _harvest(c).kinds.where("table_idx = 0").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""select doc_id, case when nat % 3 = 0 then 13 else 12 end as n_columns, max(pos) + case when count(*) + 2 * count(*) filter (where loan_id % 4 = 0) < 0 then 1 else 0 end as n_rows,
    '{"|".join(SECOND)}' || case when nat % 3 = 0 then '|Underwritten NOI ($)' else '' end || '|{"|".join((FIRST[1], *FIRST[3:]))}' as headers from annex_loans group by doc_id, nat""")
def annex_joined(c: Corpus) -> DataFrame:
    """The one table that a document's blocks make: its columns, and its rows with a loan's number."""
    joined = _harvest(c).joined.where("row_idx = 0 or col_idx = 0")
    head = F.array_sort(F.collect_list(F.when(F.col("row_idx") == 0, F.struct("col_idx", "text"))))
    n_rows = F.count_if((F.col("row_idx") > 0) & (F.col("col_idx") == 0) & (F.col("text") != "Total")).cast("int")
    out = joined.groupBy("doc_id").agg(head.alias("head"), n_rows.alias("n_rows")).where("n_rows > 0")
    return out.select("doc_id", F.size("head").alias("n_columns"), "n_rows", F.array_join(F.transform("head", lambda x: x["text"]), "|").alias("headers"))


@query(f"""with {NUMBERS}, repeats as (
        select doc_id, metric_key, max(k) as bad, sum(k) as n from (select doc_id, metric_key, value, count(*) as k from seen where metric_key in ('interest_rate', 'noi_underwritten', 'loan_amount') group by all) group by 1, 2),
    placed as (select *, row_number() over (partition by doc_id, metric_key order by value) as r, count(*) over (partition by doc_id, metric_key) as n from seen),
    middles as (select doc_id, max(value) filter (where metric_key = 'noi_underwritten') as noi, max(value) filter (where metric_key = 'loan_amount') as loan, max(n) filter (where metric_key = 'noi_underwritten') + max(n) filter (where metric_key = 'loan_amount') as n
        from placed where r = n // 2 + 1 and metric_key in ('noi_underwritten', 'loan_amount') group by 1),
    rows_of as (select doc_id, count(*) as n, count(rev) as with_noi, count(*) filter (where occupancy is not null or loan_id % 50 = 0) as with_occupancy from annex_loans group by 1)
    select doc_id, 'error' as severity, 'occupancy' as metric, count(*) filter (where value > 1) as bad, count(*) as n from seen where metric_key = 'occupancy' group by 1 having count(*) filter (where value > 1) > 0
    union all select doc_id, 'error', metric_key, bad, n from repeats where n >= 20 and 1.0e0 * bad / n > 0.15
    union all select doc_id, 'error', 'noi_underwritten', n, n from middles where noi > loan
    union all select doc_id, 'warning', 'NOI', n - with_noi, n from rows_of where 1.0e0 * with_noi / n < 0.5
    union all select doc_id, 'warning', 'occupancy', n - with_occupancy, n from rows_of where 1.0e0 * with_occupancy / n < 0.5""")
def annex_sanity(c: Corpus) -> DataFrame:
    """What can't be right in an annex."""
    seen = _harvest(c).observations.select("doc_id", "table_idx", "row_idx", "metric_key", "value")
    return annex.sanity_issues(staged(seen, "annex-observations"))


@query("select distinct doc_id, 'noi_underwritten' as metric_key, 1.0e0 as score, 'UW NOI ($)|Underwritten NOI ($)' as headers, 'UW NOI ($)' as winner from annex_loans where nat % 3 = 0")
def annex_header_ties(c: Corpus) -> DataFrame:
    """Metrics for which only the order of columns decided."""
    h = _harvest(c)
    return annex.header_ties(h.columns, h.headers).withColumn("headers", F.array_join("headers", "|"))


@query("""with d as (select distinct doc_id, nat from annex_loans)
    select doc_id, 'UW NOI ($)' as header, 'mapped' as verdict, 'noi_underwritten' as taken_by, 1.0e0 as score from d
    union all select doc_id, 'Underwritten NOI ($)', 'not assigned', null, 1.0e0 from d where nat % 3 = 0
    union all select doc_id, 'Occupancy (%)', 'excluded', 'occupancy', 0.0e0 from d""")
def annex_explained(c: Corpus) -> DataFrame:
    """Why a header that sounds like an income stands for the underwritten one, or doesn't."""
    h = _harvest(c)
    out = annex.explain_headers(h.columns.drop("metric_key"), h.headers, h.mapping, "noi_underwritten", "(?i)noi|occup")
    return out.select("doc_id", "header", "verdict", "taken_by", "score")
