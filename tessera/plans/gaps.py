"""Gaps of property types, occupancy and states, broken filings, and what explains them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import CLASSES, count_if, loans_wide, num_nonneg, r6, ratio, senior, senior_parts_only, with_filing
from ..functions.parsing import normalize_state
from ..sources.bridge import Corpus
from .registry import query
from .shared_sql import GATE, GATE_NONNEG, SENIOR, SENIOR_JOINS, fact

#: Headers that may name a property type, and those that don't after all; headers that look like several in one: fixed values.
TYPE_HEADER, NO_TYPE_HEADER = r"(?i)(property|asset|collateral|general)\s*type", r"(?i)title|appraised|footnote"
GLUED = "[0-9]{3}"
THIN = 5


def raw(c: Corpus, *keys: str) -> DataFrame:
    """loan_id with the text of each metric."""
    facts = c.facts_of(*keys)
    return facts.groupBy("loan_id").agg(*[F.max(F.when(F.col("metric_key") == k, F.col("value"))).alias(k) for k in keys])


def _text(alias: str, key: str) -> str:
    return f" left join (select loan_id, value as v from facts where metric_key = '{key}') {alias} on {alias}.loan_id = l.loan_id "


# --- types


@query("with x as (select accession, count(*) filter (where property_type is null) as k from loans group by 1) select round(avg(k) filter (where k > 0), 2) as per_issuance, count(*) filter (where k > 0) as issuances, max(k) as most from x")
def type_gap_shape(c: Corpus) -> DataFrame:
    x = c.loans.groupBy("accession").agg(count_if(F.col("property_type").isNull()).alias("k"))
    return x.agg(F.round(F.avg(F.when(F.col("k") > 0, F.col("k"))), 2).alias("per_issuance"), count_if(F.col("k") > 0).alias("issuances"), F.max("k").alias("most"))


@query(f"""select count(*) as total, count(pc.v) as with_count, count(*) filter (where regexp_matches(pc.v, {GATE_NONNEG}) and try_cast(pc.v as double) > 1) as multi, count(*) filter (where regexp_matches(l.property_name, '(?i)various|portfolio')) as name_various,
    count(pd.v) as with_detail, count(ds.v) as with_dscr from loans l {_text("pc", "property_count")} {_text("pd", "property_type_detailed")} {_text("ds", "dscr")} where l.property_type is null""")
def type_gap_known(c: Corpus) -> DataFrame:
    """What is known of loans without a type."""
    rows = c.loans.where(F.col("property_type").isNull()).join(raw(c, "property_count", "property_type_detailed", "dscr"), "loan_id", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count("property_count").alias("with_count"), count_if(num_nonneg("property_count") > 1).alias("multi"), count_if(F.col("property_name").rlike("(?i)various|portfolio")).alias("name_various"),
        F.count("property_type_detailed").alias("with_detail"), F.count("dscr").alias("with_dscr"),
    )


def type_headers(c: Corpus) -> DataFrame:
    """accession, headers: the unmapped headers that may hold a type, and those that look glued together."""
    h = c.filings.select("accession", F.explode("columns_unmapped").alias("h"))
    named = F.col("h").rlike(TYPE_HEADER) & ~F.col("h").rlike(NO_TYPE_HEADER)
    glued = (F.length("h") > 45) | F.col("h").rlike(GLUED)
    joined = lambda cond: F.nullif(F.array_join(F.sort_array(F.collect_list(F.when(cond, F.col("h")))), " · "), F.lit(""))
    return h.groupBy("accession").agg(joined(named).alias("headers"), joined(glued).alias("glued"))


_HEADERS = f"""heads as (select accession, string_agg(h, ' · ' order by h) filter (where regexp_matches(h, '{TYPE_HEADER}') and not regexp_matches(h, '{NO_TYPE_HEADER}')) as headers,
    string_agg(h, ' · ' order by h) filter (where length(h) > 45 or regexp_matches(h, '{GLUED}')) as glued from (select accession, unnest(columns_unmapped) as h from filings) group by 1)"""


@query(f"""with {_HEADERS} select f.company_name as issuance, l.loan_ref, l.property_name as name, pc.v as n_properties, pd.v as detail, h.headers from loans l join filings f on f.accession = l.accession left join heads h on h.accession = l.accession
    {_text("pc", "property_count")} {_text("pd", "property_type_detailed")} where l.property_type is null and year(f.filed_at) = (select max(year(filed_at)) from filings)""")
def type_gap_detail(c: Corpus) -> DataFrame:
    """Loans without a type of the newest year."""
    newest = c.filings.agg(F.max(F.year("filed_at")).alias("newest"))
    rows = with_filing(c, c.loans.where(F.col("property_type").isNull())).join(F.broadcast(newest), F.col("vintage") == F.col("newest"))
    rows = rows.join(raw(c, "property_count", "property_type_detailed"), "loan_id", "left").join(type_headers(c).drop("glued"), "accession", "left")
    return rows.select(F.col("company_name").alias("issuance"), "loan_ref", F.col("property_name").alias("name"), F.col("property_count").alias("n_properties"), F.col("property_type_detailed").alias("detail"), "headers")


@query("select property_type as type, count(*) as n from loans where property_type is not null and " + " and ".join(f"not regexp_matches(property_type, '(?i){p}')" for p, _ in CLASSES) + " group by 1 order by n desc, type limit 15")
def type_gap_unclassified(c: Corpus) -> DataFrame:
    """The most frequent types that no class takes."""
    none = F.lit(True)
    for pattern, _ in CLASSES:
        none = none & ~F.col("property_type").rlike(f"(?i){pattern}")
    out = c.loans.where(F.col("property_type").isNotNull() & none).groupBy(F.col("property_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "type").limit(15)


@query(f"""with {_HEADERS}, x as (select l.accession, f.company_name as issuance, year(f.filed_at) as vintage, count(*) as n, count(*) filter (where property_type is null) as no_type, count(pc.v) filter (where property_type is null) as with_count from loans l join filings f on f.accession = l.accession {_text("pc", "property_count")} group by 1, 2, 3)
    select issuance, vintage, n, no_type, with_count, h.headers, h.glued from x left join heads h on h.accession = x.accession where no_type >= 5 order by no_type desc, issuance limit 12""")
def type_gap_concentrated(c: Corpus) -> DataFrame:
    rows = with_filing(c, c.loans).join(raw(c, "property_count"), "loan_id", "left")
    gap = F.col("property_type").isNull()
    x = rows.groupBy("accession", F.col("company_name").alias("issuance"), "vintage").agg(F.count(F.lit(1)).alias("n"), count_if(gap).alias("no_type"), F.count(F.when(gap, F.col("property_count"))).alias("with_count"))
    top = x.where(F.col("no_type") >= 5).orderBy(F.desc("no_type"), "issuance").limit(12)
    return top.join(type_headers(c), "accession", "left").drop("accession")


# --- occupancy and thin loans

_WITH_OCC = f"o as (select l.*, f.company_name, case when x.v is not null then 1 else 0 end as has from loans l join filings f on f.accession = l.accession left join (select loan_id, value as v from facts where metric_key = 'occupancy' and regexp_matches(value, {GATE})) x on x.loan_id = l.loan_id)"


def with_occupancy(c: Corpus) -> DataFrame:
    return with_filing(c, loans_wide(c, ("occupancy",))).withColumn("has", F.col("occupancy").isNotNull().cast("int"))


@query(f"with {_WITH_OCC}, e as (select accession, split_part(company_name, ' ', 1) as shelf, max(has) as has from o group by 1, 2) select shelf, count(*) as total, count(*) filter (where has = 1) as with_occ from e group by 1 having count(*) >= 2")
def audit_occ_by_shelf(c: Corpus) -> DataFrame:
    e = with_occupancy(c).groupBy("accession", F.split_part("company_name", F.lit(" "), F.lit(1)).alias("shelf")).agg(F.max("has").alias("has"))
    return e.groupBy("shelf").agg(F.count(F.lit(1)).alias("total"), count_if(F.col("has") == 1).alias("with_occ")).where(F.col("total") >= 2)


def _occ_by_type(rows: DataFrame) -> DataFrame:
    out = rows.groupBy(F.coalesce("property_type", F.lit("(no type)")).alias("type")).agg(F.count(F.lit(1)).alias("total"), F.sum("has").alias("with_occ"))
    return out.where(F.col("total") >= 10)


_BY_TYPE = "select coalesce(property_type, '(no type)') as type, count(*) as total, cast(sum(has) as bigint) as with_occ from o {} group by 1 having count(*) >= 10"


@query(f"with {_WITH_OCC} {_BY_TYPE.format('')}")
def audit_by_type(c: Corpus) -> DataFrame:
    return _occ_by_type(with_occupancy(c))


@query(f"with {_WITH_OCC} {_BY_TYPE.format('where accession in (select accession from o group by 1 having sum(has) * 1.0e0 / count(*) > 0.5)')}")
def audit_healthy(c: Corpus) -> DataFrame:
    rows = with_occupancy(c)
    healthy = rows.groupBy("accession").agg(F.avg("has").alias("share")).where(F.col("share") > 0.5)
    return _occ_by_type(rows.join(healthy, "accession", "left_semi"))


@query("select coalesce(property_type, '(no type)') as type, count(*) as n, count(distinct accession) as issuances from loans group by 1")
def audit_categories(c: Corpus) -> DataFrame:
    return c.loans.groupBy(F.coalesce("property_type", F.lit("(no type)")).alias("type")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("accession").alias("issuances"))


@query(f"""select f.company_name as name, coalesce(l.loan_ref, concat('row ', l.row_index)) as loan, l.property_type as type, l.property_name as prop_name, pc.v as prop_count from loans l join filings f on f.accession = l.accession {_text("pc", "property_count")} where regexp_matches(l.property_type, '^[0-9.,\\s]+$')""")
def audit_numeric_types(c: Corpus) -> DataFrame:
    """Loans whose class is a number."""
    rows = with_filing(c, c.loans.where(F.col("property_type").rlike(r"^[0-9.,\s]+$"))).join(raw(c, "property_count"), "loan_id", "left")
    return rows.select(F.col("company_name").alias("name"), F.coalesce("loan_ref", F.concat(F.lit("row "), "row_index")).alias("loan"), F.col("property_type").alias("type"), F.col("property_name").alias("prop_name"), F.col("property_count").alias("prop_count"))


@query(f"with k as (select l.accession, l.loan_id, count(f.loan_id) as facts from loans l left join facts f on f.loan_id = l.loan_id group by 1, 2) select f.company_name as name, count(*) as pool, count(*) filter (where facts <= {THIN}) as thin, count(*) filter (where facts = 0) as empty, min(facts) as min_facts from k join filings f on f.accession = k.accession group by 1 having count(*) filter (where facts <= {THIN}) > 0")
def audit_phantoms(c: Corpus) -> DataFrame:
    """Issuances with loans of few facts."""
    facts = c.facts.groupBy("loan_id").agg(F.count(F.lit(1)).alias("k"))
    rows = with_filing(c, c.loans.join(facts, "loan_id", "left").withColumn("k", F.coalesce("k", F.lit(0))))
    out = rows.groupBy(F.col("company_name").alias("name")).agg(F.count(F.lit(1)).alias("pool"), count_if(F.col("k") <= THIN).alias("thin"), count_if(F.col("k") == 0).alias("empty"), F.min("k").cast("long").alias("min_facts"))
    return out.where(F.col("thin") > 0)


@query("select left(company_name, 30) as issuance, cast(json_extract_string(stats, '$.delinquencyDropped') as bigint) as discarded, json_extract_string(stats, '$.delinquencyDroppedSamples[0]') as sample from servicer_reports where data_rows > 0 and parsed_rows = 0 order by company_name, accession limit 20")
def discarded_samples(c: Corpus) -> DataFrame:
    rows = c.servicer_reports.where((F.col("data_rows") > 0) & (F.col("parsed_rows") == 0)).orderBy("company_name", "accession").limit(20)
    stat = lambda path: F.get_json_object("stats", f"$.{path}")
    return rows.select(F.left("company_name", F.lit(30)).alias("issuance"), stat("delinquencyDropped").cast("long").alias("discarded"), stat("delinquencyDroppedSamples[0]").alias("sample"))


# --- states

_EMPTY = "(l.state is null or trim(l.state) = '')"
FIX_SQL = "case when upper(trim(state)) = 'NEW YORK' then 'NY' when regexp_matches(trim(state), '^[A-Z]{2}$') then trim(state) end"


@query(f"""select count(*) filter (where pc.v is not null) as portfolio, count(*) filter (where pc.v is null) as blind, count(*) filter (where pc.v is null and property_type is null) as blind_without_type, count(*) filter (where pc.v is not null and property_type is null) as portfolio_without_type,
    count(distinct accession) filter (where pc.v is null) as blind_issuances from loans l {fact("pc", "property_count", gate=GATE_NONNEG)} where {_EMPTY}""")
def missing_state_population(c: Corpus) -> DataFrame:
    rows = loans_wide(c, ("property_count",), num_nonneg).where(F.col("state").isNull() | (F.trim("state") == ""))
    blind, untyped = F.col("property_count").isNull(), F.col("property_type").isNull()
    return rows.agg(count_if(~blind).alias("portfolio"), count_if(blind).alias("blind"), count_if(blind & untyped).alias("blind_without_type"), count_if(~blind & untyped).alias("portfolio_without_type"), F.count_distinct(F.when(blind, F.col("accession"))).alias("blind_issuances"))


@query(f"select loan_id, case when {FIX_SQL} is distinct from state then {FIX_SQL} else state end as state, {FIX_SQL} is distinct from state as changed from loans")
def fix_states(c: Corpus) -> DataFrame:
    """The loans' states after the correction: what an update of the table would leave."""
    fixed = normalize_state("state")
    return c.loans.select("loan_id", fixed.alias("state"), (~fixed.eqNullSafe(F.col("state"))).alias("changed"))


# --- filings that don't close

_OK = f"""per_loan as (select l.accession, l.loan_id, abs((noi.v / nullif({SENIOR}, 0)) / nullif(dy.v, 0) - 1) <= 0.01 as ok from loans l {fact("dy", "debt_yield")} {fact("noi", "noi_underwritten")} {SENIOR_JOINS}
    where dy.v is not null and noi.v is not null and amt.v is not null and amt.v <> 0 and dy.v <> 0)"""


def per_loan(c: Corpus, balance: Column) -> DataFrame:
    """accession, loan_id, ok: whether the debt yield follows from income and balance."""
    rows = loans_wide(c, ("debt_yield", "noi_underwritten", "loan_amount", "balance_pari_passu_non_trust", "balance_senior_total"))
    rows = rows.where(F.col("noi_underwritten").isNotNull() & (F.col("loan_amount") != 0) & (F.col("debt_yield") != 0))
    return rows.select("accession", "loan_id", (F.abs(ratio(ratio(F.col("noi_underwritten"), balance), F.col("debt_yield")) - 1) <= 0.01).alias("ok"))


@query(f"with {_OK} select f.company_name as company, year(f.filed_at) as year, count(*) as loans from per_loan p join filings f on f.accession = p.accession group by 1, 2 having count(*) filter (where ok) = 0 order by loans desc, company limit 15")
def broken_filings(c: Corpus) -> DataFrame:
    """Deals of which no loan closes."""
    rows = with_filing(c, per_loan(c, senior()))
    out = rows.groupBy(F.col("company_name").alias("company"), F.col("vintage").alias("year")).agg(F.count(F.lit(1)).alias("loans"), count_if(F.col("ok")).alias("closing"))
    return out.where(F.col("closing") == 0).drop("closing").orderBy(F.desc("loans"), "company").limit(15)


SHOWN = ("debt_yield", "loan_amount", "ltv", "noi_underwritten", "balance_pari_passu_non_trust")


@query(f"""with ok as (select l.accession, l.loan_id, abs((noi.v / nullif(amt.v + coalesce(npp.v, 0), 0)) / nullif(dy.v, 0) - 1) <= 0.01 as ok from loans l {fact("dy", "debt_yield")} {fact("noi", "noi_underwritten")} {SENIOR_JOINS} where dy.v is not null and noi.v is not null and amt.v is not null and amt.v <> 0 and dy.v <> 0),
    bad as (select accession from ok group by 1 having count(*) filter (where ok) = 0)
    select f.company_name as company, o.metric_key, o.source_header, count(*) as n from observations o join loans l on l.loan_id = o.loan_id join filings f on f.accession = l.accession where l.accession in (select accession from bad) and o.metric_key in ({", ".join(f"'{k}'" for k in SHOWN)}) group by 1, 2, 3""")
def broken_headers(c: Corpus) -> DataFrame:
    """Headers used by deals of which no loan closes; the balance leaves the published total out, on purpose."""
    ok = per_loan(c, senior_parts_only())
    bad = ok.groupBy("accession").agg(count_if(F.col("ok")).alias("closing")).where(F.col("closing") == 0)
    rows = c.observations.where(F.col("metric_key").isin(*SHOWN)).join(c.loans.select("loan_id", "accession").join(bad, "accession", "left_semi"), "loan_id")
    return with_filing(c, rows).groupBy(F.col("company_name").alias("company"), "metric_key", "source_header").agg(F.count(F.lit(1)).alias("n"))


#: The loan that the explaining queries ask for.
LOAN = 3


@query(f"select l.loan_ref, l.property_name, l.property_type, f.company_name, f.accession from loans l join filings f on f.accession = l.accession where l.loan_id = {LOAN}")
def explain_meta(c: Corpus) -> DataFrame:
    return with_filing(c, c.loans.where(F.col("loan_id") == LOAN)).select("loan_ref", "property_name", "property_type", "company_name", "accession")


@query(f"select metric_key, value, source_header, confidence from observations where loan_id = {LOAN} and metric_key in ({', '.join(repr(k) for k in SHOWN)})")
def explain_observations(c: Corpus) -> DataFrame:
    return c.observations.where((F.col("loan_id") == LOAN) & F.col("metric_key").isin(*SHOWN)).select("metric_key", "value", "source_header", "confidence")


@query("select f.company_name as issuer, count(*) filter (where regexp_matches(pd.v, '(?i)cooperative')) as coops, count(*) as total, " + "round(percentile_cont(0.5) within group (order by case when regexp_matches(pd.v, '(?i)cooperative') then t.v end), 8) as ltv_coop, round(percentile_cont(0.5) within group (order by case when not regexp_matches(pd.v, '(?i)cooperative') then t.v end), 8) as ltv_conv from loans l join filings f on f.accession = l.accession " + _text("pd", "property_type_detailed") + fact("t", "ltv") + " where l.property_type = 'Multifamily' group by 1 having count(*) filter (where regexp_matches(pd.v, '(?i)cooperative')) > 0")
def challenge_coops(c: Corpus) -> DataFrame:
    """Cooperatives against conventional loans."""
    rows = with_filing(c, loans_wide(c, ("ltv",)).where(F.col("property_type") == "Multifamily")).join(raw(c, "property_type_detailed"), "loan_id", "left")
    coop = F.col("property_type_detailed").rlike("(?i)cooperative")
    out = rows.groupBy(F.col("company_name").alias("issuer")).agg(count_if(coop).alias("coops"), F.count(F.lit(1)).alias("total"), F.round(F.percentile(F.when(coop, F.col("ltv")), 0.5), 8).alias("ltv_coop"), F.round(F.percentile(F.when(~coop, F.col("ltv")), 0.5), 8).alias("ltv_conv"))
    return out.where(F.col("coops") > 0)


@query("select split_part(f.company_name, ' ', 1) as issuer, count(distinct l.loan_id) as n, round(percentile_cont(0.5) within group (order by t.v), 8) as ltv from loans l join filings f on f.accession = l.accession " + fact("t", "ltv", "join") + " where l.property_type = 'Multifamily' and f.filed_at >= (select max(make_date(year(filed_at), 1, 1)) from filings) group by 1 having count(distinct l.loan_id) >= 15")
def challenge_mf_issuers(c: Corpus) -> DataFrame:
    newest = c.filings.agg(F.max(F.year("filed_at")).alias("newest"))
    rows = with_filing(c, loans_wide(c, ("ltv",)).where((F.col("property_type") == "Multifamily") & F.col("ltv").isNotNull())).join(F.broadcast(newest), F.col("vintage") == F.col("newest"))
    out = rows.groupBy(F.split_part("company_name", F.lit(" "), F.lit(1)).alias("issuer")).agg(F.count_distinct("loan_id").alias("n"), F.round(F.percentile("ltv", 0.5), 8).alias("ltv"))
    return out.where(F.col("n") >= 15)


#: Relative moves of a number between two vintages that are worth a look: fixed values.
NOTABLE = {"ltv": 0.02, "dscr": 0.02, "interest_rate": 0.05, "debt_yield": 0.05}


@query("with m as (" + " union all ".join(f"select '{k}' as metric, year(f.filed_at) as vintage, percentile_cont(0.5) within group (order by x.v) as v, {n} as notable from loans l join filings f on f.accession = l.accession {fact('x', k, 'join')} group by 2" for k, n in NOTABLE.items()) + """), p as (select *, lag(v) over (partition by metric order by vintage) as before from m),
    r as (select *, case when before = 0 then case when v = 0 then 0.0e0 else 1.0e0 end else abs(v - before) / abs(before) end as rel from p where before is not null) select metric, vintage, round(before, 6) as before, round(v, 6) as after, round(rel, 6) as rel, rel >= notable as moved from r""")
def snapshot_diff(c: Corpus) -> DataFrame:
    """Each vintage's medians as a snapshot, against the snapshot before."""
    by = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("v"), F.lit(n).alias("notable")) for k, n in NOTABLE.items()])
    rows = with_filing(c, loans_wide(c, tuple(NOTABLE))).select("vintage", F.explode(by).alias("m")).select("vintage", "m.*").where(F.col("v").isNotNull())
    snapshots = rows.groupBy("metric", "vintage", "notable").agg(F.percentile("v", 0.5).alias("v"))
    return moves(snapshots.withColumn("before", F.lag("v").over(Window.partitionBy("metric").orderBy("vintage"))).where(F.col("before").isNotNull()))


def moves(pairs: DataFrame) -> DataFrame:
    """metric, vintage, notable, v, before -> how far each number moved, and whether that is notable."""
    rel = F.when(F.col("before") == 0, F.when(F.col("v") == 0, 0.0).otherwise(1.0)).otherwise(F.abs(F.col("v") - F.col("before")) / F.abs("before"))
    return pairs.select("metric", "vintage", r6(F.col("before")).alias("before"), r6(F.col("v")).alias("after"), r6(rel).alias("rel"), (rel >= F.col("notable")).alias("moved"))
