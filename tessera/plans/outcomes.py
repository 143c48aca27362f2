"""Underwriting against outcomes, and events of distress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import CORE, EVENT_WINDOW_MONTHS, MONTH_DAYS, YEAR_DAYS, count_if, loans_wide, observed, pct, quartiles, r6, ratio, senior, share_if, wilson, with_filing, within_window
from ..sources.bridge import Corpus
from .registry import query
from .shared_sql import EVENT, OBSERVED, OUTCOMES, POST, SENIOR, SENIOR_JOINS, fact, med, quart, wilson_sql


def outcomes(c: Corpus) -> DataFrame:
    """Promise, history and outcome of each loan with a performance row."""
    wide = with_filing(c, loans_wide(c, ("noi_underwritten", "noi_most_recent", *CORE))).withColumnRenamed("noi_most_recent", "noi_trailing")
    rows = wide.join(c.performance.select("loan_id", F.col("annualized_noi").alias("noi_actual"), "noi_start", "noi_end", "is_full_year"), "loan_id")
    uw, trailing, actual = F.col("noi_underwritten"), F.col("noi_trailing"), F.col("noi_actual")
    return rows.withColumns(
        {
            "loan_amount_senior": senior(),
            "days_after_origination": F.datediff("noi_start", "filed_at"),
            "gap_vs_trailing": ratio(uw, trailing) - 1,
            "gap_vs_actual": ratio(uw, actual) - 1,
            "growth_delivered": ratio(actual, trailing) - 1,
        }
    )


def after_closing(c: Corpus) -> DataFrame:
    return outcomes(c).where((F.col("days_after_origination") >= 0) & F.col("is_full_year") & F.col("gap_vs_actual").isNotNull())


DY_MISS = "(noi_actual - noi_underwritten) / nullif(loan_amount_senior, 0)"


def _dy_miss():
    return ratio(F.col("noi_actual") - F.col("noi_underwritten"), F.col("loan_amount_senior"))


@query(f"with {OUTCOMES} select loan_id, accession, company_name, originated_at, loan_ref, property_type, state, round(loan_amount_senior, 6) as loan_amount_senior, is_full_year, days_after_origination, round(gap_vs_trailing, 6) as gap_vs_trailing, round(gap_vs_actual, 6) as gap_vs_actual, round(growth_delivered, 6) as growth_delivered from outcomes")
def underwriting_outcomes(c: Corpus) -> DataFrame:
    rounded = [r6(F.col(x)).alias(x) for x in ("loan_amount_senior", "gap_vs_trailing", "gap_vs_actual", "growth_delivered")]
    return outcomes(c).select("loan_id", "accession", "company_name", F.col("filed_at").alias("originated_at"), "loan_ref", "property_type", "state", "is_full_year", "days_after_origination", *rounded)


@query(f"with {OUTCOMES} select count(distinct accession) as trusts, count(*) as loans, count(noi_underwritten) as with_uw, count(*) filter (where noi_underwritten is not null and noi_trailing is not null) as with_all, concat(min(noi_start), ' to ', max(noi_end)) as period from outcomes")
def outcome_sample(c: Corpus) -> DataFrame:
    both = F.col("noi_underwritten").isNotNull() & F.col("noi_trailing").isNotNull()
    period = F.concat(F.min("noi_start"), F.lit(" to "), F.max("noi_end"))
    return outcomes(c).agg(F.count_distinct("accession").alias("trusts"), F.count(F.lit(1)).alias("loans"), F.count("noi_underwritten").alias("with_uw"), count_if(both).alias("with_all"), period.alias("period"))


@query(f"with {OUTCOMES} select count(*) as total, count(*) filter (where days_after_origination < 0) as overlapping from outcomes where gap_vs_actual is not null")
def outcome_overlap(c: Corpus) -> DataFrame:
    return outcomes(c).where(F.col("gap_vs_actual").isNotNull()).agg(F.count(F.lit(1)).alias("total"), count_if(F.col("days_after_origination") < 0).alias("overlapping"))


@query(f"with {OUTCOMES} select count(*) as n, {quart('gap_vs_actual')}, round(1.0 * count(*) filter (where gap_vs_actual >= 0.05) / count(*), 6) as share from outcomes where {POST}")
def outcome_headline(c: Corpus) -> DataFrame:
    return after_closing(c).agg(F.count(F.lit(1)).alias("n"), *quartiles(F.col("gap_vs_actual")), share_if(F.col("gap_vs_actual") >= 0.05).alias("share"))


@query(f"""with {OUTCOMES} select year(originated_at) as vintage, count(*) as n, {med("gap_vs_actual")} as median, round(1.0 * count(*) filter (where gap_vs_actual >= 0.05) / count(*), 6) as share,
    {med("gap_vs_trailing")} as projected, {med("growth_delivered")} as growth, {med(DY_MISS)} as dy_miss from outcomes where {POST} group by 1 having count(*) >= 30""")
def outcome_by_vintage(c: Corpus) -> DataFrame:
    out = after_closing(c).groupBy("vintage").agg(
        F.count(F.lit(1)).alias("n"), pct(F.col("gap_vs_actual")).alias("median"), share_if(F.col("gap_vs_actual") >= 0.05).alias("share"), pct(F.col("gap_vs_trailing")).alias("projected"),
        pct(F.col("growth_delivered")).alias("growth"), pct(_dy_miss()).alias("dy_miss"),
    )
    return out.where(F.col("n") >= 30)


#: Upper ends of the optimism bands.
BANDS = ((0.0, "1. conservative"), (0.05, "2. neutral"), (0.15, "3. optimistic"))
_BAND = "case " + " ".join(f"when gap_vs_trailing < {x} then '{n}'" for x, n in BANDS) + " else '4. very optimistic' end"


def _band():
    out = None
    for x, n in BANDS:
        cond = F.col("gap_vs_trailing") < x
        out = F.when(cond, n) if out is None else out.when(cond, n)
    return out.otherwise("4. very optimistic")


@query(f"with {OUTCOMES} select {_BAND} as bucket, count(*) as n, {med('gap_vs_actual')} as gap_actual, {med('growth_delivered')} as growth, round(1.0 * count(*) filter (where growth_delivered < -0.10) / count(*), 6) as fail from outcomes where {POST} and gap_vs_trailing is not null and growth_delivered is not null group by 1")
def outcome_by_optimism(c: Corpus) -> DataFrame:
    rows = after_closing(c).where(F.col("gap_vs_trailing").isNotNull() & F.col("growth_delivered").isNotNull())
    return rows.groupBy(_band().alias("bucket")).agg(F.count(F.lit(1)).alias("n"), pct(F.col("gap_vs_actual")).alias("gap_actual"), pct(F.col("growth_delivered")).alias("growth"), share_if(F.col("growth_delivered") < -0.10).alias("fail"))


@query(f"with {OUTCOMES} select count(*) filter (where gap_vs_trailing < 0) as conservative, count(*) filter (where gap_vs_trailing < 0 and growth_delivered < -0.25) as collapsed from outcomes where {POST} and gap_vs_trailing is not null and growth_delivered is not null")
def outcome_paradox(c: Corpus) -> DataFrame:
    low = F.col("gap_vs_trailing") < 0
    rows = after_closing(c).where(F.col("gap_vs_trailing").isNotNull() & F.col("growth_delivered").isNotNull())
    return rows.agg(count_if(low).alias("conservative"), count_if(low & (F.col("growth_delivered") < -0.25)).alias("collapsed"))


@query(f"""with {OUTCOMES}, b as (select {_BAND} as bucket, noi_underwritten / loan_amount_senior as uw, noi_actual / loan_amount_senior as actual from outcomes where {POST} and gap_vs_trailing is not null and loan_amount_senior > 0)
    select bucket, count(*) as n, {med("uw")} as dy_uw, {med("actual")} as dy_actual, {med("actual - uw")} as fall from b where uw is not null and actual is not null group by 1""")
def outcome_dy_buckets(c: Corpus) -> DataFrame:
    rows = after_closing(c).where(F.col("gap_vs_trailing").isNotNull() & (F.col("loan_amount_senior") > 0))
    uw, actual = F.col("noi_underwritten") / F.col("loan_amount_senior"), F.col("noi_actual") / F.col("loan_amount_senior")
    return rows.groupBy(_band().alias("bucket")).agg(F.count(F.lit(1)).alias("n"), pct(uw).alias("dy_uw"), pct(actual).alias("dy_actual"), pct(actual - uw).alias("fall"))


@query(f"with {OUTCOMES} select coalesce(nullif(property_type, ''), 'no type') as ptype, count(*) as n, {med('gap_vs_trailing')} as vs_trailing, {med('gap_vs_actual')} as vs_actual, {med('growth_delivered')} as growth, {med(DY_MISS)} as dy_miss from outcomes where {POST} group by 1 having count(*) >= 8")
def outcome_by_type(c: Corpus) -> DataFrame:
    kind = F.coalesce(F.nullif(F.col("property_type"), F.lit("")), F.lit("no type")).alias("ptype")
    out = after_closing(c).groupBy(kind).agg(F.count(F.lit(1)).alias("n"), pct(F.col("gap_vs_trailing")).alias("vs_trailing"), pct(F.col("gap_vs_actual")).alias("vs_actual"), pct(F.col("growth_delivered")).alias("growth"), pct(_dy_miss()).alias("dy_miss"))
    return out.where(F.col("n") >= 8)


@query(f"""select case when p.loan_id is null then 'not reported' else 'reported' end as reported, count(*) as n, {med("u.v / nullif(m.v, 0) - 1")} as uw_gap, {med("d.v")} as dscr, {med("t.v")} as ltv
    from loans l left join performance p on p.loan_id = l.loan_id {fact("u", "noi_underwritten")} {fact("m", "noi_most_recent")} {fact("d", "dscr")} {fact("t", "ltv")}
    where l.accession in (select l2.accession from performance p2 join loans l2 on l2.loan_id = p2.loan_id) group by 1""")
def reporting_bias(c: Corpus) -> DataFrame:
    done = c.performance.select("loan_id", F.lit(True).alias("done"))
    wide = loans_wide(c, ("noi_underwritten", "noi_most_recent", "dscr", "ltv"))
    deals = wide.join(done, "loan_id", "left_semi").select("accession").distinct()
    rows = wide.join(deals, "accession", "left_semi").join(done, "loan_id", "left")
    kind = F.when(F.col("done").isNull(), "not reported").otherwise("reported").alias("reported")
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), pct(ratio(F.col("noi_underwritten"), F.col("noi_most_recent")) - 1).alias("uw_gap"), pct(F.col("dscr")).alias("dscr"), pct(F.col("ltv")).alias("ltv"))


_WITH = "exists (select 1 from performance p where p.loan_id = l.loan_id and p.noi_start - f.filed_at >= 0)"


@query(f"""with b as (select year(f.filed_at) as vintage, {SENIOR} as balance, u.v as noi, t.v as ltv, {_WITH} as has from loans l join filings f on f.accession = l.accession {SENIOR_JOINS} {fact("u", "noi_underwritten")} {fact("t", "ltv")})
    select vintage, count(*) as n_total, count(*) filter (where has) as n_with, {med("case when has then balance end")} as balance_with, {med("case when not has then balance end")} as balance_without,
    {med("case when has then noi end")} as noi_with, {med("case when not has then noi end")} as noi_without, {med("case when has then ltv end")} as ltv_with, {med("case when not has then ltv end")} as ltv_without from b group by vintage""")
def bias_by_vintage(c: Corpus) -> DataFrame:
    wide = with_filing(c, loans_wide(c, ("noi_underwritten", "ltv", *CORE)))
    late = c.performance.select("loan_id", "noi_start").join(wide.select("loan_id", "filed_at"), "loan_id").where(F.datediff("noi_start", "filed_at") >= 0).select("loan_id", F.lit(True).alias("has")).distinct()
    rows = wide.join(late, "loan_id", "left").withColumn("has", F.coalesce("has", F.lit(False))).withColumn("balance", senior())
    sides = []
    for name, column in (("balance", "balance"), ("noi", "noi_underwritten"), ("ltv", "ltv")):
        sides += [pct(F.when(F.col("has"), F.col(column))).alias(f"{name}_with"), pct(F.when(~F.col("has"), F.col(column))).alias(f"{name}_without")]
    return rows.groupBy("vintage").agg(F.count(F.lit(1)).alias("n_total"), count_if(F.col("has")).alias("n_with"), *sides)


@query("select count(*) as n_rows, count(distinct p.loan_id) as loans, count(*) filter (where p.noi_start - f.filed_at >= 0) as after_closing from performance p join loans l on l.loan_id = p.loan_id join filings f on f.accession = l.accession")
def performance_health(c: Corpus) -> DataFrame:
    rows = with_filing(c, c.performance.join(c.loans, "loan_id"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("loan_id").alias("loans"), count_if(F.datediff("noi_start", "filed_at") >= 0).alias("after_closing"))


@query(f"with {OUTCOMES} select year(originated_at) as vintage, count(*) as n, {med('growth_delivered')} as delivered, {med('gap_vs_trailing')} as projected from outcomes where days_after_origination >= 0 and is_full_year and growth_delivered is not null and loan_amount_senior between 10000000 and 30000000 group by 1 having count(*) >= 20")
def size_band_strata(c: Corpus) -> DataFrame:
    rows = outcomes(c).where((F.col("days_after_origination") >= 0) & F.col("is_full_year") & F.col("growth_delivered").isNotNull() & F.col("loan_amount_senior").between(10_000_000, 30_000_000))
    return rows.groupBy("vintage").agg(F.count(F.lit(1)).alias("n"), pct(F.col("growth_delivered")).alias("delivered"), pct(F.col("gap_vs_trailing")).alias("projected")).where(F.col("n") >= 20)


# --- distress


def pool(c: Corpus) -> DataFrame:
    """Loans of deals with a report, with their filing and their event row if they have one."""
    return observed(c, with_filing(c, c.loans)).join(c.delinquency.drop("report_accession", "source"), "loan_id", "left")


_POOL = f"from loans l join filings f on f.accession = l.accession left join delinquency d on d.loan_id = l.loan_id"
_EXPECTED = "greatest(0, floor((period - paid_through) / 30.44e0))"


def _expected():
    return F.greatest(F.lit(0), F.floor(F.datediff("period", "paid_through") / MONTH_DAYS))


@query(f"select count(*) as n, count(*) filter (where abs({_EXPECTED} - months_delinquent) <= 1) as closes from delinquency where months_delinquent is not null")
def delinquency_identity(c: Corpus) -> DataFrame:
    rows = c.delinquency.where(F.col("months_delinquent").isNotNull())
    return rows.agg(F.count(F.lit(1)).alias("n"), count_if(F.abs(_expected() - F.col("months_delinquent")) <= 1).alias("closes"))


@query(f"select loan_id, cast(months_delinquent as double) as published, paid_through, cast({_EXPECTED} as double) as expected from delinquency where abs({_EXPECTED} - months_delinquent) > 1 order by abs({_EXPECTED} - months_delinquent) desc, loan_id limit 5")
def delinquency_deviations(c: Corpus) -> DataFrame:
    off = F.abs(_expected() - F.col("months_delinquent"))
    rows = c.delinquency.where(off > 1).orderBy(off.desc(), "loan_id").limit(5)
    return rows.select("loan_id", F.col("months_delinquent").cast("double").alias("published"), "paid_through", _expected().cast("double").alias("expected"))


def _rates(c: Corpus) -> DataFrame:
    special, closed = F.col("transfer_date").isNotNull(), F.col("foreclosure_date").isNotNull() | F.col("reo_date").isNotNull()
    out = pool(c).groupBy("vintage").agg(F.count(F.lit(1)).alias("pool"), count_if(F.col("months_delinquent") > 0).alias("delinquent"), count_if(special).alias("special"), count_if(closed).alias("foreclosure"))
    return out.withColumns({"special_lo": wilson(F.col("special"), F.col("pool"), -1), "special_hi": wilson(F.col("special"), F.col("pool"), 1)})


_RATES = f"""rates as (select vintage, pool, delinquent, special, foreclosure, {wilson_sql("special", "pool", -1)} as special_lo, {wilson_sql("special", "pool", 1)} as special_hi from (
    select year(f.filed_at) as vintage, count(*) as pool, count(*) filter (where d.months_delinquent > 0) as delinquent, count(d.transfer_date) as special, count(*) filter (where d.foreclosure_date is not null or d.reo_date is not null) as foreclosure {_POOL} where {OBSERVED} group by 1))"""


@query(f"with {_RATES} select * from rates")
def delinquency_rates_by_vintage(c: Corpus) -> DataFrame:
    return _rates(c)


@query(f"with {_RATES} select a.vintage as earlier, b.vintage as later from rates a join rates b on a.vintage < b.vintage where a.special_hi < b.special_lo or b.special_hi < a.special_lo")
def vintages_distinguishable(c: Corpus) -> DataFrame:
    r = _rates(c).select("vintage", "special_lo", "special_hi")
    a, b = r.toDF("earlier", "lo_a", "hi_a"), r.toDF("later", "lo_b", "hi_b")
    return a.join(b, (F.col("earlier") < F.col("later")) & ((F.col("hi_a") < F.col("lo_b")) | (F.col("hi_b") < F.col("lo_a")))).select("earlier", "later")


@query(f"""with e as (select year(f.filed_at) as vintage, f.accession, count(*) as pool, count(d.transfer_date) as events {_POOL} where {OBSERVED} group by 1, 2)
    select vintage, accession, pool, events, round(events * 1.0e0 / sum(events) over (partition by vintage), 6) as share from e where events > 0""")
def events_by_issuance(c: Corpus) -> DataFrame:
    e = pool(c).groupBy("vintage", "accession").agg(F.count(F.lit(1)).alias("pool"), F.count("transfer_date").alias("events")).where(F.col("events") > 0)
    return e.withColumn("share", r6(F.col("events") / F.sum("events").over(Window.partitionBy("vintage"))))


@query(f"""with newest as (select max(filed_at) as d0 from filings), ev as (select year(f.filed_at) as vintage, (d.transfer_date - f.filed_at) / 30.44e0 as months, (d0 - f.filed_at) / 365.25e0 as age from delinquency d join loans l on l.loan_id = d.loan_id join filings f on f.accession = l.accession cross join newest where d.transfer_date >= f.filed_at),
    po as (select year(f.filed_at) as vintage, count(*) as pool from loans l join filings f on f.accession = l.accession where {OBSERVED} group by 1)
    select ev.vintage, count(*) as n, {quart("months")}, round(max(age), 6) as age, max(pool) as pool, round(1000.0e0 * count(*) / nullif(max(pool) * max(age), 0), 6) as per_1000_years from ev join po on po.vintage = ev.vintage group by 1""")
def event_timing(c: Corpus) -> DataFrame:
    """Ages are counted to the newest filing, so that reruns agree."""
    now = c.filings.agg(F.max("filed_at").alias("d0"))
    ev = with_filing(c, c.delinquency.join(c.loans, "loan_id")).where(F.col("transfer_date") >= F.col("filed_at")).crossJoin(F.broadcast(now))
    months, age = F.datediff("transfer_date", "filed_at") / MONTH_DAYS, F.datediff("d0", "filed_at") / YEAR_DAYS
    po = observed(c, with_filing(c, c.loans)).groupBy("vintage").agg(F.count(F.lit(1)).alias("pool"))
    out = ev.groupBy("vintage").agg(F.count(F.lit(1)).alias("n"), *quartiles(months), F.max(age).alias("age")).join(po, "vintage")
    return out.withColumn("per_1000_years", r6(1000.0 * F.col("n") / F.nullif(F.col("pool") * F.col("age"), F.lit(0.0)))).withColumn("age", r6(F.col("age")))


@query(f"with w as (select year(f.filed_at) as vintage, count(*) as pool, count(*) filter (where {EVENT}) as events {_POOL} where {OBSERVED} group by 1) select *, {wilson_sql('events', 'pool', -1)} as lo, {wilson_sql('events', 'pool', 1)} as hi from w")
def fixed_window_rates(c: Corpus) -> DataFrame:
    out = pool(c).groupBy("vintage").agg(F.count(F.lit(1)).alias("pool"), count_if(within_window(EVENT_WINDOW_MONTHS)).alias("events"))
    return out.withColumns({"lo": wilson(F.col("events"), F.col("pool"), -1), "hi": wilson(F.col("events"), F.col("pool"), 1)})


@query(f"""select year(f.filed_at) as vintage, count(*) as n, {med("t.v")} as ltv, {med("d.v")} as dscr, {med("y.v")} as dy, round(avg(cast(l.property_type ilike '%office%' as int)), 6) as office, round(avg(cast(l.property_type ilike '%retail%' as int)), 6) as retail
    from loans l join filings f on f.accession = l.accession {fact("t", "ltv")} {fact("d", "dscr")} {fact("y", "debt_yield")} where {OBSERVED} group by 1""")
def vintage_profile(c: Corpus) -> DataFrame:
    rows = observed(c, with_filing(c, loans_wide(c, ("ltv", "dscr", "debt_yield"))))
    part = lambda x: r6(F.avg(F.col("property_type").ilike(f"%{x}%").cast("int")))
    return rows.groupBy("vintage").agg(F.count(F.lit(1)).alias("n"), pct(F.col("ltv")).alias("ltv"), pct(F.col("dscr")).alias("dscr"), pct(F.col("debt_yield")).alias("dy"), part("office").alias("office"), part("retail").alias("retail"))


@query(f"select l.property_type, year(f.filed_at) as vintage, count(*) as pool, count(*) filter (where {EVENT}) as events {_POOL} where l.property_type is not null and year(f.filed_at) in (2023, 2024) and {OBSERVED} group by 1, 2")
def type_window_rates(c: Corpus) -> DataFrame:
    rows = pool(c).where(F.col("property_type").isNotNull() & F.col("vintage").isin(2023, 2024))
    return rows.groupBy("property_type", "vintage").agg(F.count(F.lit(1)).alias("pool"), count_if(within_window()).alias("events"))


@query(f"""with t as (select l.property_type as k, count(*) filter (where year(f.filed_at) = 2023) as p23, count(*) filter (where {EVENT} and year(f.filed_at) = 2023) as e23, count(*) filter (where year(f.filed_at) = 2024) as p24 {_POOL}
    where l.property_type is not null and year(f.filed_at) in (2023, 2024) and {OBSERVED} group by 1)
    select round(sum(e23) * 1.0e0 / sum(p23), 6) as own_rate, round(sum(p24 * (e23 * 1.0e0 / nullif(p23, 0))) / sum(p24), 6) as standardised from t""")
def standardised_rate(c: Corpus) -> DataFrame:
    """The rates of one vintage on the mix of the next."""
    rows = pool(c).where(F.col("property_type").isNotNull() & F.col("vintage").isin(2023, 2024))
    t = rows.groupBy("property_type").agg(count_if(F.col("vintage") == 2023).alias("p23"), count_if((F.col("vintage") == 2023) & within_window()).alias("e23"), count_if(F.col("vintage") == 2024).alias("p24"))
    return t.agg(r6(F.sum("e23") / F.sum("p23")).alias("own_rate"), r6(F.sum(F.col("p24") * (F.col("e23") / F.nullif(F.col("p23"), F.lit(0)))) / F.sum("p24")).alias("standardised"))


@query(f"""with m as (select f.accession, count(*) as pool, count(*) filter (where {EVENT}) as events, {med("t.v")} as ltv, {med("s.v")} as dscr, {med("r.v")} as rate {_POOL} {fact("t", "ltv")} {fact("s", "dscr")} {fact("r", "interest_rate")}
    where l.property_type ilike '%multifamily%' and year(f.filed_at) = 2023 and {OBSERVED} group by 1)
    select *, cast(sum(events) over (order by events desc, accession rows unbounded preceding) as bigint) as running from m""")
def mf_issuer_events(c: Corpus) -> DataFrame:
    wide = loans_wide(c, ("ltv", "dscr", "interest_rate")).select("loan_id", "ltv", "dscr", "interest_rate")
    rows = pool(c).where(F.col("property_type").ilike("%multifamily%") & (F.col("vintage") == 2023)).join(wide, "loan_id", "left")
    m = rows.groupBy("accession").agg(F.count(F.lit(1)).alias("pool"), count_if(within_window()).alias("events"), pct(F.col("ltv")).alias("ltv"), pct(F.col("dscr")).alias("dscr"), pct(F.col("interest_rate")).alias("rate"))
    # One row per deal of a single vintage: few enough for one ordered running sum.
    return m.withColumn("running", F.sum("events").over(Window.orderBy(F.desc("events"), "accession").rowsBetween(Window.unboundedPreceding, 0)))
