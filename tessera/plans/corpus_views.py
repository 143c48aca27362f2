"""Corpus views, distributions and arithmetic identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import CORE, TOLERANCE, count_if, loans_wide, num, pct, quartiles, r6, ratio, senior, senior_parts_only, share_if, with_filing
from ..sources.bridge import Corpus
from .registry import query
from .shared_sql import SENIOR, SENIOR_JOINS, fact, med, quart

MIN_SAMPLE = 5


@query("""select metric_key, count(distinct loan_id) as loans, count(*) as observations, round(avg(confidence), 3) as avg_confidence, count(distinct source_header) as headers from observations group by metric_key""")
def metric_coverage(c: Corpus) -> DataFrame:
    return c.observations.groupBy("metric_key").agg(
        F.count_distinct("loan_id").alias("loans"), F.count(F.lit(1)).alias("observations"), F.round(F.avg("confidence"), 3).alias("avg_confidence"), F.count_distinct("source_header").alias("headers")
    )


@query("select header, count(*) as filings from (select unnest(columns_unmapped) as header from filings) group by header")
def unmapped_headers(c: Corpus) -> DataFrame:
    return c.filings.select(F.explode("columns_unmapped").alias("header")).groupBy("header").agg(F.count(F.lit(1)).alias("filings"))


@query("select (select count(*) from filings) as filings, (select count(*) from loans) as loans, (select count(*) from observations) as observations, (select count(*) from facts) as facts")
def corpus_stats(c: Corpus) -> DataFrame:
    one = lambda name: getattr(c, name).agg(F.count(F.lit(1)).alias(name))
    return one("filings").crossJoin(F.broadcast(one("loans"))).crossJoin(F.broadcast(one("observations"))).crossJoin(F.broadcast(one("facts")))


@query("select count(*) as filings, max(taxonomy_version) as taxonomy, count(distinct taxonomy_version) as versions, min(filed_at) as first_filed, max(filed_at) as last_filed from filings")
def corpus_state(c: Corpus) -> DataFrame:
    return c.filings.agg(
        F.count(F.lit(1)).alias("filings"), F.max("taxonomy_version").alias("taxonomy"), F.count_distinct("taxonomy_version").alias("versions"), F.min("filed_at").alias("first_filed"), F.max("filed_at").alias("last_filed")
    )


@query("""select distinct loan_id, state, 'loan' as origin from loans where state is not null
    union select distinct p.loan_id, upper(l.state), 'property' from properties p join loans l on l.loan_id = p.loan_id where l.state is not null""")
def loan_states(c: Corpus) -> DataFrame:
    loan = c.loans.where(F.col("state").isNotNull()).select("loan_id", "state", F.lit("loan").alias("origin"))
    of_property = c.properties.select("loan_id").join(loan.select("loan_id", F.upper("state").alias("state")), "loan_id")
    return loan.unionAll(of_property.select("loan_id", "state", F.lit("property").alias("origin"))).distinct()


@query("""select f.company_name, l.accession, count(*) as loans, count(distinct l.loan_ref) as distinct_ids, max(try_cast(l.loan_ref as double)) as max_id
    from loans l join filings f on f.accession = l.accession where regexp_matches(l.loan_ref, '^[0-9.]+$') group by 1, 2""")
def id_integrity(c: Corpus) -> DataFrame:
    rows = with_filing(c, c.loans.where(F.col("loan_ref").rlike(r"^[0-9.]+$")))
    return rows.groupBy("company_name", "accession").agg(F.count(F.lit(1)).alias("loans"), F.count_distinct("loan_ref").alias("distinct_ids"), F.max(F.col("loan_ref").try_cast("double")).alias("max_id"))


@query("select state, case when upper(trim(state)) = 'NEW YORK' then 'NY' end as fixed, count(*) as n from loans where state is not null and not regexp_matches(state, '^[A-Z]{2}$') group by 1, 2")
def fix_states_preview(c: Corpus) -> DataFrame:
    from ..functions.parsing import normalize_state

    odd = c.loans.where(F.col("state").isNotNull() & ~F.col("state").rlike("^[A-Z]{2}$"))
    return odd.groupBy("state", normalize_state("state").alias("fixed")).agg(F.count(F.lit(1)).alias("n"))


# --- distributions


def _by_type(metric: str) -> str:
    return f"""select '{metric}' as metric, l.property_type, count(*) as n, {quart("a.v")} from loans l {fact("a", metric, "join")}
        where l.property_type is not null and a.v is not null group by l.property_type having count(*) >= {MIN_SAMPLE}"""


@query(" union all ".join(map(_by_type, ("dscr", "ltv", "debt_yield"))))
def ratios_by_type(c: Corpus) -> DataFrame:
    keys = ("dscr", "ltv", "debt_yield")
    rows = c.facts.where(F.col("metric_key").isin(*keys)).select("loan_id", F.col("metric_key").alias("metric"), num("value").alias("v")).where(F.col("v").isNotNull())
    typed = rows.join(c.loans.where(F.col("property_type").isNotNull()).select("loan_id", "property_type"), "loan_id")
    return typed.groupBy("metric", "property_type").agg(F.count(F.lit(1)).alias("n"), *quartiles(F.col("v"))).where(F.col("n") >= MIN_SAMPLE)


@query(f"""with pairs as (select l.property_type, u.v as uw, m.v as mr from loans l {fact("u", "noi_underwritten", "join")} {fact("m", "noi_most_recent", "join")} where l.property_type is not null and m.v > 0 and u.v is not null)
    select property_type, count(*) as n, {quart("uw / mr - 1")}, round(100.0 * count(*) filter (where uw > mr) / count(*), 0) as share_above from pairs group by property_type having count(*) >= {MIN_SAMPLE}""")
def uw_vs_trailing_gap_by_type(c: Corpus) -> DataFrame:
    rows = loans_wide(c, ("noi_underwritten", "noi_most_recent")).where(F.col("property_type").isNotNull() & (F.col("noi_most_recent") > 0) & F.col("noi_underwritten").isNotNull())
    gap = F.col("noi_underwritten") / F.col("noi_most_recent") - 1
    above = F.round(100.0 * count_if(F.col("noi_underwritten") > F.col("noi_most_recent")) / F.count(F.lit(1)), 0)
    return rows.groupBy("property_type").agg(F.count(F.lit(1)).alias("n"), *quartiles(gap), above.alias("share_above")).where(F.col("n") >= MIN_SAMPLE)


@query(f"""with pairs as (select l.property_type, u.v / nullif(a.v, 0) as cap from loans l {fact("u", "noi_underwritten", "join")} {fact("a", "appraised_value", "join")} where l.property_type is not null)
    select property_type, count(*) as n, {quart("cap")} from pairs where cap between 0.01 and 0.25 group by property_type having count(*) >= {MIN_SAMPLE}""")
def cap_rate_by_type(c: Corpus) -> DataFrame:
    cap = ratio(F.col("noi_underwritten"), F.col("appraised_value"))
    rows = loans_wide(c, ("noi_underwritten", "appraised_value")).where(F.col("property_type").isNotNull()).withColumn("cap", cap).where(F.col("cap").between(0.01, 0.25))
    return rows.groupBy("property_type").agg(F.count(F.lit(1)).alias("n"), *quartiles(F.col("cap"))).where(F.col("n") >= MIN_SAMPLE)


def _terms(c: Corpus) -> DataFrame:
    rows = with_filing(c, loans_wide(c, ("dscr", "ltv", "debt_yield")))
    return rows.withColumn("period", F.concat(F.year("filed_at"), F.lit("-Q"), F.quarter("filed_at")))


_TERMS = f"""from filings f join loans l on l.accession = f.accession {fact("d", "dscr")} {fact("v", "ltv")} {fact("y", "debt_yield")}"""
_PERIOD = "concat(year(f.filed_at), '-Q', quarter(f.filed_at))"


@query(f"""select {_PERIOD} as period, count(distinct l.loan_id) as n, count(distinct f.accession) as deals, {med("d.v")} as dscr, {med("v.v")} as ltv, {med("y.v")} as dy,
    round(1.0 * count(*) filter (where l.property_type = 'Multifamily') / nullif(count(*), 0), 6) as mf_share {_TERMS} group by 1 having count(distinct l.loan_id) >= {MIN_SAMPLE}""")
def quarterly_terms(c: Corpus) -> DataFrame:
    out = _terms(c).groupBy("period").agg(
        F.count_distinct("loan_id").alias("n"), F.count_distinct("accession").alias("deals"), pct(F.col("dscr")).alias("dscr"), pct(F.col("ltv")).alias("ltv"), pct(F.col("debt_yield")).alias("dy"),
        share_if(F.col("property_type") == "Multifamily").alias("mf_share"),
    )
    return out.where(F.col("n") >= MIN_SAMPLE)


@query(f"""select {_PERIOD} as period, count(distinct l.loan_id) as n, {med("d.v")} as dscr, {med("v.v")} as ltv, {med("y.v")} as dy {_TERMS} where l.property_type = 'Multifamily' group by 1 having count(distinct l.loan_id) >= 20""")
def quarterly_terms_mf(c: Corpus) -> DataFrame:
    rows = _terms(c).where(F.col("property_type") == "Multifamily")
    return rows.groupBy("period").agg(F.count_distinct("loan_id").alias("n"), pct(F.col("dscr")).alias("dscr"), pct(F.col("ltv")).alias("ltv"), pct(F.col("debt_yield")).alias("dy")).where(F.col("n") >= 20)


# --- identities

IDENTITY_KEYS = ("dscr", "dscr_ncf", "debt_yield", "ltv", "noi_underwritten", "net_cash_flow", "appraised_value", "debt_service_pi", *CORE)


def _identities() -> dict[str, tuple[Column, Column]]:
    """name -> (expected, actual) over the wide row."""
    col = F.col
    service = ratio(col("debt_service_pi") * senior(), col("loan_amount"))
    return {
        "dscr_ncf": (ratio(col("net_cash_flow"), service), col("dscr_ncf")),
        "dscr_noi": (ratio(col("noi_underwritten"), service), col("dscr")),
        "ncf": (col("noi_underwritten") * 0.95, col("net_cash_flow")),
        "debt_yield": (ratio(col("noi_underwritten"), senior()), col("debt_yield")),
        "ltv": (ratio(senior(), col("appraised_value")), col("ltv")),
    }


def identity_pairs(c: Corpus) -> DataFrame:
    """identity, loan_id, accession, err: every loan with both sides, once for each identity."""
    wide = loans_wide(c, IDENTITY_KEYS)
    sides = F.array(*[F.struct(F.lit(k).alias("identity"), e.alias("expected"), a.alias("actual")) for k, (e, a) in _identities().items()])
    rows = wide.select("loan_id", "accession", F.explode(sides).alias("s")).select("loan_id", "accession", "s.*")
    rows = rows.where(F.col("expected").isNotNull() & (F.col("actual") != 0))
    return rows.withColumn("err", F.abs(F.col("expected") / F.col("actual") - 1))


_SERVICE = f"(s.v * {SENIOR} / nullif(amt.v, 0))"
_SIDES = {
    "dscr_ncf": (f"n.v / nullif({_SERVICE}, 0)", "x.v"),
    "dscr_noi": (f"u.v / nullif({_SERVICE}, 0)", "d.v"),
    "ncf": ("u.v * 0.95e0", "n.v"),
    "debt_yield": (f"u.v / nullif({SENIOR}, 0)", "y.v"),
    "ltv": (f"{SENIOR} / nullif(a.v, 0)", "t.v"),
}
_ALL = fact("d", "dscr") + fact("x", "dscr_ncf") + fact("y", "debt_yield") + fact("t", "ltv") + fact("u", "noi_underwritten") + fact("n", "net_cash_flow") + fact("a", "appraised_value") + fact("s", "debt_service_pi") + SENIOR_JOINS
_PAIRS = "pairs as (" + " union all ".join(f"select '{k}' as identity, l.loan_id, l.accession, abs({e} / nullif({a}, 0) - 1) as err from loans l {_ALL} where {e} is not null and {a} <> 0" for k, (e, a) in _SIDES.items()) + ")"


@query(f"with {_PAIRS} select identity, count(*) as n, count(*) filter (where err <= {TOLERANCE}) as holds, {med('err')} as median_error from pairs group by identity having count(*) >= 20")
def identities(c: Corpus) -> DataFrame:
    out = identity_pairs(c).groupBy("identity").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("err") <= TOLERANCE).alias("holds"), pct(F.col("err")).alias("median_error"))
    return out.where(F.col("n") >= 20)


@query(f"""with {_PAIRS}, r as (select *, row_number() over (partition by identity order by round(err, 9) desc, loan_id) as place from pairs)
    select identity, loan_id, round(err, 6) as err, place from r where place <= 3""")
def identity_worst(c: Corpus) -> DataFrame:
    w = Window.partitionBy("identity").orderBy(F.round("err", 9).desc(), "loan_id")
    return identity_pairs(c).withColumn("place", F.row_number().over(w)).where(F.col("place") <= 3).select("identity", "loan_id", r6(F.col("err")).alias("err"), "place")


def _debt_yield_ok(c: Corpus) -> DataFrame:
    return identity_pairs(c).where(F.col("identity") == "debt_yield").withColumn("ok", F.col("err") <= TOLERANCE)


_PER = f"with {_PAIRS}, per as (select loan_id, accession, err <= {TOLERANCE} as ok from pairs where identity = 'debt_yield')"


@query(f"{_PER}, t as (select accession, count(*) as n, count(*) filter (where ok) as ok from per group by 1) select count(*) as filings, count(*) filter (where ok = n) as clean, count(*) filter (where ok = 0) as broken, count(*) filter (where ok > 0 and ok < n) as mixed from t")
def identity_by_filing(c: Corpus) -> DataFrame:
    t = _debt_yield_ok(c).groupBy("accession").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("ok")).alias("good"))
    good, n = F.col("good"), F.col("n")
    return t.agg(F.count(F.lit(1)).alias("filings"), count_if(good == n).alias("clean"), count_if(good == 0).alias("broken"), count_if((good > 0) & (good < n)).alias("mixed"))


@query(f"{_PER} select count(*) filter (where not ok) as n from per")
def identity_fail_count(c: Corpus) -> DataFrame:
    return _debt_yield_ok(c).agg(count_if(~F.col("ok")).alias("n"))


@query(f"""{_PER} select case when ok then 'closes' else 'does not close' end as group_name, count(*) as n, {med("p.v")} as props, {med("a2.v")} as amount, {med("u2.v")} as noi
    from per l {fact("p", "property_count")} {fact("a2", "loan_amount")} {fact("u2", "noi_underwritten")} group by 1""")
def identity_profile(c: Corpus) -> DataFrame:
    more = loans_wide(c, ("property_count", "loan_amount", "noi_underwritten")).drop("accession")
    rows = _debt_yield_ok(c).join(more, "loan_id").withColumn("group_name", F.when(F.col("ok"), "closes").otherwise("does not close"))
    return rows.groupBy("group_name").agg(F.count(F.lit(1)).alias("n"), pct(F.col("property_count")).alias("props"), pct(F.col("loan_amount")).alias("amount"), pct(F.col("noi_underwritten")).alias("noi"))


_CANDIDATES = {"trust part": "amt.v", "parts": "amt.v + coalesce(npp.v, 0)", "published": "sen.v", "senior": SENIOR}


@query(" union all ".join(f"select '{k}' as candidate, count(*) as n, count(*) filter (where abs(u.v / nullif({e}, 0) / y.v - 1) <= {TOLERANCE}) as holds from loans l {fact('u', 'noi_underwritten')} {fact('y', 'debt_yield')} {SENIOR_JOINS} where u.v is not null and y.v <> 0 and {e} <> 0" for k, e in _CANDIDATES.items()))
def balance_denominator_search(c: Corpus) -> DataFrame:
    wide = loans_wide(c, ("noi_underwritten", "debt_yield", *CORE)).where(F.col("noi_underwritten").isNotNull() & (F.col("debt_yield") != 0))
    by = {"trust part": F.col("loan_amount"), "parts": senior_parts_only(), "published": F.col("balance_senior_total"), "senior": senior()}
    rows = wide.select("noi_underwritten", "debt_yield", F.explode(F.array(*[F.struct(F.lit(k).alias("candidate"), v.alias("balance")) for k, v in by.items()])).alias("s")).select("*", "s.*").where(F.col("balance") != 0)
    err = F.abs(F.col("noi_underwritten") / F.col("balance") / F.col("debt_yield") - 1)
    return rows.groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), count_if(err <= TOLERANCE).alias("holds"))


@query(f"""select f.company_name as company, year(f.filed_at) as year, round(sum(p.v), 3) as value_sum, count(*) as loans from loans l {fact("p", "pool_share")} join filings f on f.accession = l.accession where p.v is not null
    group by 1, 2, f.accession having round(sum(p.v), 3) < 0.97 or round(sum(p.v), 3) > 1.03""")
def pool_share_outliers(c: Corpus) -> DataFrame:
    rows = with_filing(c, loans_wide(c, ("pool_share",)).where(F.col("pool_share").isNotNull()))
    out = rows.groupBy(F.col("company_name").alias("company"), F.col("vintage").alias("year"), "accession").agg(F.round(F.sum("pool_share"), 3).alias("value_sum"), F.count(F.lit(1)).alias("loans"))
    return out.where(~F.col("value_sum").between(0.97, 1.03)).drop("accession")


@query(f"select count(distinct l.accession) as n from loans l {fact('p', 'pool_share')} where p.v is not null")
def pool_share_evaluated(c: Corpus) -> DataFrame:
    return loans_wide(c, ("pool_share",)).where(F.col("pool_share").isNotNull()).agg(F.count_distinct("accession").alias("n"))


@query("""select source_header, count(*) as n from observations where source_header ilike '%balance%' or source_header ilike '%loan amount%' or source_header ilike '%cut-off%' group by 1 order by n desc, 1 limit 12""")
def balance_headers(c: Corpus) -> DataFrame:
    h = F.col("source_header")
    rows = c.observations.where(h.ilike("%balance%") | h.ilike("%loan amount%") | h.ilike("%cut-off%"))
    return rows.groupBy("source_header").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source_header").limit(12)


@query("""select header, count(distinct accession) as filings from (select accession, unnest(columns_unmapped) as header from filings) where header ilike '%balance%' or header ilike '%cut-off%' group by 1 order by filings desc, header limit 10""")
def unmapped_balance_headers(c: Corpus) -> DataFrame:
    rows = c.filings.select("accession", F.explode("columns_unmapped").alias("header")).where(F.col("header").ilike("%balance%") | F.col("header").ilike("%cut-off%"))
    return rows.groupBy("header").agg(F.count_distinct("accession").alias("filings")).orderBy(F.desc("filings"), "header").limit(10)


def _with_ids(c: Corpus) -> DataFrame:
    return c.loans.where(F.col("loan_ref").rlike("^[0-9]")).select("accession").distinct()


@query("select count(distinct f.accession) as filings, count(l.loan_id) as loans from filings f join loans l on l.accession = f.accession where f.accession not in (select distinct accession from loans where regexp_matches(loan_ref, '^[0-9]'))")
def filings_without_id(c: Corpus) -> DataFrame:
    return c.loans.join(_with_ids(c), "accession", "left_anti").agg(F.count_distinct("accession").alias("filings"), F.count("loan_id").alias("loans"))


@query(r"""select header, count(distinct accession) as filings from (select accession, unnest(columns_unmapped) as header from filings) where accession not in (select distinct accession from loans where regexp_matches(loan_ref, '^[0-9]'))
    and regexp_matches(header, '(?i)loan|\bid\b|number|\bno\.?\b|control|seq') group by 1 order by filings desc, header limit 15""")
def id_header_candidates(c: Corpus) -> DataFrame:
    rows = c.filings.join(_with_ids(c), "accession", "left_anti").select("accession", F.explode("columns_unmapped").alias("header"))
    rows = rows.where(F.col("header").rlike(r"(?i)loan|\bid\b|number|\bno\.?\b|control|seq"))
    return rows.groupBy("header").agg(F.count_distinct("accession").alias("filings")).orderBy(F.desc("filings"), "header").limit(15)


@query(f"""{_PER}, failing as (select accession, count(*) as n from per where not ok group by 1)
    select header, cast(sum(n) as bigint) as loans, count(*) as filings, string_agg(distinct left(company_name, 22), ' · ' order by left(company_name, 22)) as examples
    from (select fa.n, f.company_name, unnest(f.columns_unmapped) as header from failing fa join filings f on f.accession = fa.accession) where header ilike '%balance%' and header not ilike '%per sf%' group by header""")
def failing_balance_candidates(c: Corpus) -> DataFrame:
    failing = _debt_yield_ok(c).where(~F.col("ok")).groupBy("accession").agg(F.count(F.lit(1)).alias("n"))
    rows = failing.join(c.filings, "accession").select("n", "company_name", F.explode("columns_unmapped").alias("header"))
    rows = rows.where(F.col("header").ilike("%balance%") & ~F.col("header").ilike("%per sf%"))
    examples = F.array_join(F.sort_array(F.collect_set(F.left("company_name", F.lit(22)))), " · ")
    return rows.groupBy("header").agg(F.sum("n").alias("loans"), F.count(F.lit(1)).alias("filings"), examples.alias("examples"))
