"""Predictors of distress, and observed against expected counts by shelf, seller and servicer."""

from __future__ import annotations

import statistics

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import byar, count_if, loans_wide, observed, pct, r6, ratio, share_if, shelf, standard_type, wilson, with_filing
from ..operators.tiles import with_tile, with_tile_nulls_last
from ..sources.bridge import Corpus
from ..sources.stage import staged
from .registry import query
from .shared_sql import OBSERVED, fact, med, shelf_sql, standard_sql, wilson_sql

MIN_POOL = 150
DSCR_CUT, RATE_CUT = 1.5, 0.065


def base(c: Corpus) -> DataFrame:
    """Loans of observed deals with their metrics and whether they had an event."""
    c = c.held()
    rows = observed(c, with_filing(c, loans_wide(c, ("ltv", "dscr", "debt_yield", "interest_rate"))))
    rows = rows.join(c.delinquency.select("loan_id", "transfer_date"), "loan_id", "left")
    return rows.withColumns({"event": F.col("transfer_date").isNotNull().cast("long"), "shelf": shelf(), "kind": standard_type()})


BASE = f"""pop as (select l.loan_id, l.accession, year(f.filed_at) as vintage, t.v as ltv, s.v as dscr, y.v as dy, r.v as rate, l.property_type, l.loan_seller, f.company_name,
    {shelf_sql("f.company_name")} as shelf, {standard_sql("l.property_type")} as kind, cast(d.transfer_date is not null as bigint) as event
    from loans l join filings f on f.accession = l.accession left join delinquency d on d.loan_id = l.loan_id {fact("t", "ltv")} {fact("s", "dscr")} {fact("y", "debt_yield")} {fact("r", "interest_rate")} where {OBSERVED})"""

N_EV = "count(*) as n, cast(sum(event) as bigint) as events"


def n_ev() -> list:
    return [F.count(F.lit(1)).alias("n"), F.sum("event").alias("events")]


@query(f"with {BASE} select {N_EV} from pop")
def predictor_totals(c: Corpus) -> DataFrame:
    return base(c).agg(*n_ev())


@query(f"with {BASE}, q as (" + " union all ".join(f"select '{k}' as metric, event, {k} as x, ntile(5) over (order by {k}, loan_id) as q from pop where {k} is not null" for k in ("ltv", "dscr", "dy", "rate")) + f") select metric, q, {N_EV}, round(min(x), 6) as lo, round(max(x), 6) as hi from q group by metric, q")
def predictor_quintiles(c: Corpus) -> DataFrame:
    """Quintiles within each metric."""
    by = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(k).alias("x")) for n, k in (("ltv", "ltv"), ("dscr", "dscr"), ("dy", "debt_yield"), ("rate", "interest_rate"))])
    rows = base(c).select("loan_id", "event", F.explode(by).alias("m")).select("loan_id", "event", "m.*").where(F.col("x").isNotNull())
    rows = with_tile(rows, "x", "loan_id", 5, "q", key="metric")
    return rows.groupBy("metric", "q").agg(*n_ev(), r6(F.min("x")).alias("lo"), r6(F.max("x")).alias("hi"))


@query(f"with {BASE} select case when dscr < {DSCR_CUT} then 'thin' else 'ample' end as coverage, case when rate > {RATE_CUT} then 'expensive' else 'cheap' end as cost, {N_EV} from pop where dscr is not null and rate is not null group by 1, 2")
def predictor_cross(c: Corpus) -> DataFrame:
    rows = base(c).where(F.col("dscr").isNotNull() & F.col("interest_rate").isNotNull())
    coverage, cost = F.when(F.col("dscr") < DSCR_CUT, "thin").otherwise("ample"), F.when(F.col("interest_rate") > RATE_CUT, "expensive").otherwise("cheap")
    return rows.groupBy(coverage.alias("coverage"), cost.alias("cost")).agg(*n_ev())


@query(f"with {BASE} select vintage, {N_EV} from pop where dscr < {DSCR_CUT} and rate > {RATE_CUT} group by 1")
def predictor_thin_expensive(c: Corpus) -> DataFrame:
    return base(c).where((F.col("dscr") < DSCR_CUT) & (F.col("interest_rate") > RATE_CUT)).groupBy("vintage").agg(*n_ev())


@query(f"with {BASE}, q as (select *, ntile(3) over (partition by vintage order by dscr, loan_id) as tercile from pop where dscr is not null) select vintage, tercile, {N_EV} from q group by 1, 2")
def predictor_terciles_by_vintage(c: Corpus) -> DataFrame:
    rows = with_tile(base(c).where(F.col("dscr").isNotNull()), "dscr", "loan_id", 3, "tercile", key="vintage")
    return rows.groupBy("vintage", "tercile").agg(*n_ev())


_GRID = f"{BASE}, grid as (select *, ntile(3) over (order by dscr, loan_id) as td, ntile(3) over (order by ltv, loan_id) as tl from pop where dscr is not null and ltv is not null)"


def _grid(c: Corpus) -> DataFrame:
    rows = base(c).where(F.col("dscr").isNotNull() & F.col("ltv").isNotNull())
    return with_tile(with_tile(rows, "dscr", "loan_id", 3, "td"), "ltv", "loan_id", 3, "tl")


@query(f"with {_GRID} select td, tl, {N_EV} from grid group by 1, 2")
def predictor_grid(c: Corpus) -> DataFrame:
    return _grid(c).groupBy("td", "tl").agg(*n_ev())


def sir(rows: DataFrame, unit: str, strata: list[str], least: int) -> DataFrame:
    """Observed and expected events of each unit, expected from the rates of the strata, with Byar's interval."""
    rates = rows.groupBy(*strata).agg((F.sum("event") / F.count(F.lit(1))).alias("rate"))
    out = rows.join(rates, strata).groupBy(unit).agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("observed"), F.sum("rate").alias("e")).where(F.col("n") >= least)
    o, e = F.col("observed"), F.col("e")
    return out.select(unit, "n", "observed", F.round("e", 4).alias("expected"), r6(ratio(o, e)).alias("sir"), byar(o, e, -1).alias("lo"), byar(o, e, 1).alias("hi"))


def _sir_sql(source: str, unit: str, strata: str, least: int) -> str:
    on = " and ".join(f"b.{k} = t.{k}" for k in strata.split(", "))
    end = lambda o, sign: f"{o} * power(1 - 1 / (9.0e0 * {o}) {sign} 1.96e0 / (3 * sqrt({o})), 3) / e"
    return f"""rates as (select {strata}, sum(event) * 1.0e0 / count(*) as rate from {source} group by {strata}),
        sums as (select b.{unit}, count(*) as n, cast(sum(b.event) as bigint) as observed, sum(t.rate) as e from {source} b join rates t on {on} group by 1 having count(*) >= {least})
        select {unit}, n, observed, round(e, 4) as expected, round(observed / nullif(e, 0), 6) as sir,
            case when e <= 0 or observed <= 0 then 0 else round({end("observed", "-")}, 6) end as lo, case when e <= 0 then 0 else round({end("(observed + 1)", "+")}, 6) end as hi from sums"""


@query(f"with {_GRID}, {_sir_sql('grid', 'shelf', 'vintage, td', 200)}")
def predictor_shelf_sir(c: Corpus) -> DataFrame:
    rows = base(c).where(F.col("dscr").isNotNull() & F.col("ltv").isNotNull())
    return sir(with_tile(rows, "dscr", "loan_id", 3, "td"), "shelf", ["vintage", "td"], 200)


@query(f"with {BASE} select upper(split_part(company_name, ' ', 1)) as shelf, vintage, count(*) as n from pop group by 1, 2")
def predictor_shelf_mix(c: Corpus) -> DataFrame:
    return base(c).groupBy(F.upper(F.split_part("company_name", F.lit(" "), F.lit(1))).alias("shelf"), "vintage").agg(F.count(F.lit(1)).alias("n"))


@query("""select upper(split_part(f.company_name, ' ', 1)) as shelf, count(*) as pool, count(*) filter (where exists (select 1 from performance p where p.loan_id = l.loan_id) or exists (select 1 from delinquency d where d.loan_id = l.loan_id)) as matched
    from loans l join filings f on f.accession = l.accession where l.accession in (select deal_accession from servicer_reports) group by 1""")
def predictor_shelf_coverage(c: Corpus) -> DataFrame:
    seen = c.performance.select("loan_id").unionAll(c.delinquency.select("loan_id")).distinct().withColumn("seen", F.lit(True))
    rows = observed(c, with_filing(c, c.loans)).join(seen, "loan_id", "left")
    return rows.groupBy(F.upper(F.split_part("company_name", F.lit(" "), F.lit(1))).alias("shelf")).agg(F.count(F.lit(1)).alias("pool"), count_if(F.col("seen")).alias("matched"))


@query(f"with {BASE} select round(corr(dscr, event), 6) as dscr, round(corr(ltv, event), 6) as ltv, round(corr(rate, event), 6) as rate from pop")
def predictor_correlations(c: Corpus) -> DataFrame:
    return base(c).agg(*[r6(F.corr(k, "event")).alias(n) for n, k in (("dscr", "dscr"), ("ltv", "ltv"), ("rate", "interest_rate"))])


_TYPED = f"{BASE}, typed as (select * from pop where property_type is not null)"


def typed(c: Corpus) -> DataFrame:
    return base(c).where(F.col("property_type").isNotNull())


@query(f"with {BASE} select shelf, count(*) as n, count(property_type) as with_type from pop group by 1")
def composition_by_shelf(c: Corpus) -> DataFrame:
    return base(c).groupBy("shelf").agg(F.count(F.lit(1)).alias("n"), F.count("property_type").alias("with_type"))


@query(f"with {_TYPED} select kind, {N_EV}, count(distinct property_type) as variants, string_agg(distinct property_type, ', ' order by property_type) as originals from typed group by 1")
def composition_types(c: Corpus) -> DataFrame:
    return typed(c).groupBy("kind").agg(*n_ev(), F.count_distinct("property_type").alias("variants"), F.array_join(F.sort_array(F.collect_set("property_type")), ", ").alias("originals"))


@query(f"with {_TYPED} select shelf, kind, count(*) as n, round(count(*) * 1.0e0 / sum(count(*)) over (partition by shelf), 6) as share from typed group by 1, 2")
def composition_mix_by_shelf(c: Corpus) -> DataFrame:
    n = typed(c).groupBy("shelf", "kind").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("shelf"))))


@query(f"with {_TYPED}, {_sir_sql('typed', 'shelf', 'kind, vintage', MIN_POOL)}")
def composition_sir_type(c: Corpus) -> DataFrame:
    return sir(typed(c), "shelf", ["kind", "vintage"], MIN_POOL)


@query(f"with {BASE}, top as (select loan_seller from pop group by 1 order by count(*) desc, loan_seller limit 3), sold as (select b.*, case when b.loan_seller in (select loan_seller from top) then b.loan_seller else 'others' end as v from pop b where loan_seller is not null), {_sir_sql('sold', 'shelf', 'v, vintage', MIN_POOL)}")
def composition_sir_seller(c: Corpus) -> DataFrame:
    """Sellers beyond the three largest are one."""
    rows = base(c).where(F.col("loan_seller").isNotNull())
    top = rows.groupBy("loan_seller").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "loan_seller").limit(3).select("loan_seller", F.lit(True).alias("top"))
    rows = rows.join(F.broadcast(top), "loan_seller", "left").withColumn("v", F.when(F.col("top"), F.col("loan_seller")).otherwise("others"))
    return sir(rows, "shelf", ["v", "vintage"], MIN_POOL)


_MASTER = f"{BASE}, served as (select b.*, r.master_servicer as master from pop b join servicer_reports r on r.deal_accession = b.accession where r.master_servicer is not null)"


def served(c: Corpus) -> DataFrame:
    """A loan counts once per report of its deal."""
    reports = c.servicer_reports.where(F.col("master_servicer").isNotNull()).select(F.col("deal_accession").alias("accession"), F.col("master_servicer").alias("master"))
    return base(c).join(reports, "accession")


@query(f"with {_MASTER} select master, count(distinct shelf) as issuers, {N_EV} from served group by 1")
def servicer_rates(c: Corpus) -> DataFrame:
    return served(c).groupBy("master").agg(F.count_distinct("shelf").alias("issuers"), *n_ev())


@query(f"with {_MASTER} select shelf, master, {N_EV}, string_agg(distinct vintage, ',' order by vintage) as vintages from served group by 1, 2 having count(*) >= {MIN_POOL}")
def servicer_cells(c: Corpus) -> DataFrame:
    out = served(c).groupBy("shelf", "master").agg(*n_ev(), F.array_join(F.sort_array(F.collect_set(F.col("vintage").cast("string"))), ",").alias("vintages"))
    return out.where(F.col("n") >= MIN_POOL)


def _spread_sql(cells: str, by: str) -> str:
    return f"select {by}, count(*) as cells, round(min(events * 1.0e0 / n), 6) as lo, round(max(events * 1.0e0 / n), 6) as hi from ({cells}) group by 1 having count(*) > 1"


def spread(cells: DataFrame, by: str) -> DataFrame:
    r = F.col("events") / F.col("n")
    return cells.groupBy(by).agg(F.count(F.lit(1)).alias("cells"), r6(F.min(r)).alias("lo"), r6(F.max(r)).alias("hi")).where(F.col("cells") > 1)


@query(f"with {_MASTER} " + _spread_sql(f"select shelf, master, {N_EV} from served group by 1, 2 having count(*) >= {MIN_POOL}", "shelf"))
def servicer_spread(c: Corpus) -> DataFrame:
    return spread(servicer_cells(c), "shelf")


@query(f"with {BASE} select loan_seller as seller, {N_EV}, count(distinct shelf) as shelves, {wilson_sql('sum(event)', 'count(*)', -1)} as lo, {wilson_sql('sum(event)', 'count(*)', 1)} as hi from pop where loan_seller is not null group by 1")
def seller_rates(c: Corpus) -> DataFrame:
    out = base(c).where(F.col("loan_seller").isNotNull()).groupBy(F.col("loan_seller").alias("seller")).agg(*n_ev(), F.count_distinct("shelf").alias("shelves"))
    return out.withColumns({"lo": wilson(F.col("events"), F.col("n"), -1), "hi": wilson(F.col("events"), F.col("n"), 1)})


_CELLS = f"select shelf, loan_seller as seller, {N_EV} from pop where loan_seller is not null group by 1, 2 having count(*) >= {MIN_POOL}"


@query(f"with {BASE} {_CELLS}")
def seller_cells(c: Corpus) -> DataFrame:
    return base(c).where(F.col("loan_seller").isNotNull()).groupBy("shelf", F.col("loan_seller").alias("seller")).agg(*n_ev()).where(F.col("n") >= MIN_POOL)


@query(f"with {BASE} {_spread_sql(_CELLS, 'seller')}")
def seller_spread(c: Corpus) -> DataFrame:
    return spread(seller_cells(c), "seller")


@query(f"with {_GRID}, sold as (select * from grid where loan_seller is not null and property_type is not null), {_sir_sql('sold', 'loan_seller', 'kind, vintage, td', 1)}")
def seller_sir(c: Corpus) -> DataFrame:
    rows = with_tile(base(c).where(F.col("dscr").isNotNull() & F.col("ltv").isNotNull()), "dscr", "loan_id", 3, "td")
    return sir(rows.where(F.col("loan_seller").isNotNull() & F.col("property_type").isNotNull()), "loan_seller", ["kind", "vintage", "td"], 1)


@query(f"with {BASE} select loan_seller as seller, vintage, {N_EV}, round(sum(event) * 1.0e0 / sum(sum(event)) over (partition by loan_seller), 6) as share_events, round(count(*) * 1.0e0 / sum(count(*)) over (partition by loan_seller), 6) as share_pool from pop where loan_seller is not null group by 1, 2")
def seller_by_vintage(c: Corpus) -> DataFrame:
    w = Window.partitionBy("seller")
    out = base(c).where(F.col("loan_seller").isNotNull()).groupBy(F.col("loan_seller").alias("seller"), "vintage").agg(*n_ev())
    return out.withColumns({"share_events": r6(F.col("events") / F.sum("events").over(w)), "share_pool": r6(F.col("n") / F.sum("n").over(w))})


# --- coverage and details of composition, servicers and sellers

MIN_COVERAGE = 0.9


@query(f"with {BASE} select count(*) as n, count(property_type) as with_type, (select count(*) from (select shelf from pop group by 1 having count(property_type) * 1.0e0 / count(*) < {MIN_COVERAGE})) as weak_shelves from pop")
def composition_coverage(c: Corpus) -> DataFrame:
    by_shelf = base(c).groupBy("shelf").agg(F.count(F.lit(1)).alias("n"), F.count("property_type").alias("with_type"))
    return by_shelf.agg(F.sum("n").alias("n"), F.sum("with_type").alias("with_type"), count_if(F.col("with_type") / F.col("n") < MIN_COVERAGE).alias("weak_shelves"))


@query(f"with {_MASTER} select {N_EV}, count(distinct master) as masters from served")
def servicer_totals(c: Corpus) -> DataFrame:
    return served(c).agg(*n_ev(), F.count_distinct("master").alias("masters"))


@query(f"with {BASE} select count(*) as n, count(nullif(trim(loan_seller), '')) as with_seller, (select count(*) from filings) as issuances, (select count(distinct accession) from loans where nullif(trim(loan_seller), '') is not null) as with_col from pop")
def seller_coverage(c: Corpus) -> DataFrame:
    named = F.nullif(F.trim("loan_seller"), F.lit(""))
    rows = base(c).agg(F.count(F.lit(1)).alias("n"), F.count(named).alias("with_seller"))
    return rows.crossJoin(F.broadcast(c.filings.agg(F.count(F.lit(1)).alias("issuances")))).crossJoin(F.broadcast(c.loans.where(named.isNotNull()).agg(F.count_distinct("accession").alias("with_col"))))


#: The seller that the detail queries look at, and the detailed types of its multifamily loans.
SELLER, DETAILS = "BUILDING", ("Garden", "Mid Rise")
_DETAIL = f"{BASE}, det as (select p.*, nullif(trim(x.v), '') as detail from pop p left join (select loan_id, value as v from facts where metric_key = 'property_type_detailed') x on x.loan_id = p.loan_id)"


def detailed(c: Corpus) -> DataFrame:
    facts = c.facts_of("property_type_detailed").select("loan_id", F.nullif(F.trim("value"), F.lit("")).alias("detail"))
    return base(c).join(facts, "loan_id", "left")


@query(f"with {_DETAIL} select count(*) as n, count(detail) as with_detail, count(*) filter (where loan_seller = '{SELLER}') as own_n, count(detail) filter (where loan_seller = '{SELLER}') as own_with from det")
def seller_detail_coverage(c: Corpus) -> DataFrame:
    own = F.col("loan_seller") == SELLER
    return detailed(c).agg(F.count(F.lit(1)).alias("n"), F.count("detail").alias("with_detail"), count_if(own).alias("own_n"), F.count(F.when(own, F.col("detail"))).alias("own_with"))


@query(f"with {_DETAIL}, rate as (select detail, sum(event) * 1.0e0 / count(*) as rate from det where detail is not null group by 1) select d.loan_seller as seller, d.detail, {N_EV}, round(max(t.rate) * 100, 1) as corpus_rate from det d join rate t on t.detail = d.detail where d.loan_seller in ('{SELLER}', 'MACHINERY') group by 1, 2 having count(*) >= 10")
def seller_detail_mix(c: Corpus) -> DataFrame:
    rows = detailed(c).where(F.col("detail").isNotNull())
    rate = rows.groupBy("detail").agg(F.avg("event").alias("rate"))
    out = rows.where(F.col("loan_seller").isin(SELLER, "MACHINERY")).join(F.broadcast(rate), "detail").groupBy(F.col("loan_seller").alias("seller"), "detail").agg(*n_ev(), F.round(F.max("rate") * 100, 1).alias("corpus_rate"))
    return out.where(F.col("n") >= 10)


@query(f"with {_DETAIL} select vintage, count(*) filter (where loan_seller = '{SELLER}') as n, cast(sum(event) filter (where loan_seller = '{SELLER}') as bigint) as events, count(*) filter (where loan_seller is distinct from '{SELLER}') as corpus_n, cast(sum(event) filter (where loan_seller is distinct from '{SELLER}') as bigint) as corpus_events from det where detail in {DETAILS} group by 1")
def seller_mf_vintage(c: Corpus) -> DataFrame:
    own = F.col("loan_seller").eqNullSafe(SELLER)
    return detailed(c).where(F.col("detail").isin(*DETAILS)).groupBy("vintage").agg(count_if(own).alias("n"), F.sum(F.when(own, F.col("event"))).alias("events"), count_if(~own).alias("corpus_n"), F.sum(F.when(~own, F.col("event"))).alias("corpus_events"))


def bonferroni_z(tests: int, alpha: float = 0.05) -> float:
    """Two-sided critical value of the normal distribution at alpha over the number of tests."""
    return statistics.NormalDist().inv_cdf(1 - alpha / max(1, tests) / 2)


# The limit by bisection of the normal distribution, whose erf is the usual polynomial (Abramowitz and Stegun 7.1.26).
_BONF = f"""with recursive {_GRID}, sold as (select * from grid where loan_seller is not null and property_type is not null), s as (with {_sir_sql('sold', 'loan_seller', 'kind, vintage, td', MIN_POOL)}),
    halved(k, lo, hi) as (
        select 0, 0.0e0, 10.0e0 union all select k + 1, case when below then mid else lo end, case when below then hi else mid end from (
            select k, lo, hi, mid, 0.5 + 0.5 * (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-mid * mid / 2)) < 1 - 0.025e0 / greatest(1, (select count(*) from s)) as below
            from (select *, 1 / (1 + 0.3275911 * mid / sqrt(2)) as t from (select *, (lo + hi) / 2 as mid from halved where k < 60)))),
    z as (select *, abs(ln(observed / expected)) * sqrt(observed) as z from s where observed >= 1 and expected > 0)"""


@query(f"{_BONF} select loan_seller, round(z, 4) as z, z > 1.96 as departs, z > (select hi from halved where k = 60) as departs_bonferroni from z")
def seller_bonferroni(c: Corpus) -> DataFrame:
    """Sellers of at least MIN_POOL loans whose observed events depart from the expected ones, with and without regard to how many sellers are tested."""
    rows = staged(seller_sir(c).where(F.col("n") >= MIN_POOL), "sellers")
    limit = bonferroni_z(rows.count())
    z = F.abs(F.log(F.col("observed") / F.col("expected"))) * F.sqrt("observed")
    out = rows.where((F.col("observed") >= 1) & (F.col("expected") > 0)).withColumn("z", z)
    return out.select("loan_seller", F.round("z", 4).alias("z"), (F.col("z") > 1.96).alias("departs"), (F.col("z") > limit).alias("departs_bonferroni"))


@query(f"""with {BASE}, r as (select rank() over (order by dscr) + (count(*) over (partition by dscr) - 1) / 2.0e0 as a, rank() over (order by rate) + (count(*) over (partition by rate) - 1) / 2.0e0 as b from (select accession, vintage, percentile_cont(0.5) within group (order by dscr) as dscr, percentile_cont(0.5) within group (order by rate) as rate from pop where dscr is not null and rate is not null group by 1, 2)),
    k as (select count(*) as n, corr(a, b) as rho from r) select n, round(rho, 6) as rho, round(rho * sqrt((n - 2) / greatest(1e-9, 1 - rho * rho)), 6) as t from k""")
def predictor_spearman(c: Corpus) -> DataFrame:
    """Rank correlation of the issuances' median coverage and rate, with Student's t; ties take their average rank."""
    rows = base(c).where(F.col("dscr").isNotNull() & F.col("interest_rate").isNotNull()).groupBy("accession").agg(F.percentile("dscr", 0.5).alias("dscr"), F.percentile("interest_rate", 0.5).alias("rate"))
    # Issuances are few against loans: their ranks may be counted in one task.
    mean_rank = lambda x: F.rank().over(Window.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(x)) - 1) / 2.0
    k = rows.select(mean_rank("dscr").alias("a"), mean_rank("rate").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("a", "b").alias("both"), (F.stddev_pop("a") * F.stddev_pop("b")).alias("spread"))
    # Ranks that are all tied have no correlation; corr() divides by their spread of zero and stops the job.
    rho = F.when(F.col("spread") == 0, F.lit(float("nan"))).otherwise(F.col("both") / F.col("spread"))
    return k.select("n", r6(rho).alias("rho"), r6(rho * F.sqrt((F.col("n") - 2) / F.greatest(F.lit(1e-9), 1 - rho * rho))).alias("t"))


@query(f"with {BASE}, k as (select count(*) filter (where dscr < {DSCR_CUT}) as k, count(*) as n from pop where event = 1 and dscr is not null) select k, n, round(k * 1.0e0 / n, 6) as share, round((k * 1.0e0 / n - 0.5) / sqrt(0.25e0 / n), 6) as z from k")
def predictor_thin_share(c: Corpus) -> DataFrame:
    """Share of thin loans among those with an event, against one half."""
    k = base(c).where((F.col("event") == 1) & F.col("dscr").isNotNull()).agg(count_if(F.col("dscr") < DSCR_CUT).alias("k"), F.count(F.lit(1)).alias("n"))
    share = F.col("k") / F.nullif(F.col("n"), F.lit(0))
    return k.select("k", "n", r6(share).alias("share"), r6((share - 0.5) / F.sqrt(0.25 / F.col("n"))).alias("z"))


# --- falsification cuts

_GAPS = f"gaps as (select l.loan_id, l.accession, l.property_type, u.v / nullif(m.v, 0) - 1 as gap, o.v as occupancy, b.v as balance from loans l {fact('u', 'noi_underwritten', 'join')} {fact('m', 'noi_most_recent', 'join')} {fact('o', 'occupancy')} {fact('b', 'loan_amount')} where m.v > 0 and u.v is not null)"


def gaps(c: Corpus) -> DataFrame:
    rows = loans_wide(c, ("noi_underwritten", "noi_most_recent", "occupancy", "loan_amount")).where((F.col("noi_most_recent") > 0) & F.col("noi_underwritten").isNotNull())
    return rows.withColumn("gap", F.col("noi_underwritten") / F.col("noi_most_recent") - 1)


_STEP = "case when gap < 0 then '1. negative' when gap < 0.1 then '2. 0-10%' when gap < 0.25 then '3. 10-25%' else '4. >25%' end"


@query(f"with {_GAPS} select {_STEP} as bucket, count(*) as n, {med('occupancy')} as occ, {med('gap')} as gap from gaps where property_type ilike '%office%' group by 1")
def challenge_leaseup(c: Corpus) -> DataFrame:
    step = F.when(F.col("gap") < 0, "1. negative").when(F.col("gap") < 0.1, "2. 0-10%").when(F.col("gap") < 0.25, "3. 10-25%").otherwise("4. >25%")
    return gaps(c).where(F.col("property_type").ilike("%office%")).groupBy(step.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), pct(F.col("occupancy")).alias("occ"), pct(F.col("gap")).alias("gap"))


@query(f"with {_GAPS} select count(*) as n, round(avg(gap), 6) as unweighted, round(sum(gap * balance) / nullif(sum(balance), 0), 6) as weighted from gaps where property_type ilike '%office%' and balance > 0")
def challenge_weighted(c: Corpus) -> DataFrame:
    rows = gaps(c).where(F.col("property_type").ilike("%office%") & (F.col("loan_amount") > 0))
    return rows.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("gap")).alias("unweighted"), r6(F.sum(F.col("gap") * F.col("loan_amount")) / F.sum("loan_amount")).alias("weighted"))


@query(f"with {_GAPS} select split_part(f.company_name, ' ', 1) as issuer, count(*) as n, {med('gap')} as gap from gaps g join filings f on f.accession = g.accession where property_type ilike '%office%' group by 1 having count(*) >= 20")
def challenge_by_issuer(c: Corpus) -> DataFrame:
    rows = with_filing(c, gaps(c).where(F.col("property_type").ilike("%office%")))
    return rows.groupBy(F.split_part("company_name", F.lit(" "), F.lit(1)).alias("issuer")).agg(F.count(F.lit(1)).alias("n"), pct(F.col("gap")).alias("gap")).where(F.col("n") >= 20)


@query(f"with {_GAPS} select coalesce(property_type, 'no type') as ptype, count(*) as n, {med('gap')} as median, round(1.0 * count(*) filter (where gap >= 0.05) / count(*), 6) as share from gaps group by 1 having count(*) >= 40")
def challenge_by_type(c: Corpus) -> DataFrame:
    out = gaps(c).groupBy(F.coalesce("property_type", F.lit("no type")).alias("ptype")).agg(F.count(F.lit(1)).alias("n"), pct(F.col("gap")).alias("median"), share_if(F.col("gap") >= 0.05).alias("share"))
    return out.where(F.col("n") >= 40)


@query(f"""with {_GAPS}, deal as (select accession, count(*) filter (where property_type ilike '%office%') as a, count(*) filter (where property_type ilike '%retail%') as b,
    percentile_cont(0.5) within group (order by case when property_type ilike '%office%' then gap end) as x, percentile_cont(0.5) within group (order by case when property_type ilike '%retail%' then gap end) as y from gaps group by 1)
    select count(*) as deals, count(*) filter (where x > y) as higher, {med("x - y")} as difference from deal where a >= 2 and b >= 2""")
def challenge_paired(c: Corpus) -> DataFrame:
    office, retail = F.col("property_type").ilike("%office%"), F.col("property_type").ilike("%retail%")
    deal = gaps(c).groupBy("accession").agg(count_if(office).alias("a"), count_if(retail).alias("b"), F.percentile(F.when(office, F.col("gap")), 0.5).alias("x"), F.percentile(F.when(retail, F.col("gap")), 0.5).alias("y"))
    return deal.where((F.col("a") >= 2) & (F.col("b") >= 2)).agg(F.count(F.lit(1)).alias("deals"), count_if(F.col("x") > F.col("y")).alias("higher"), pct(F.col("x") - F.col("y")).alias("difference"))


@query(f"with {_GAPS} select 'TOTAL' as segment, count(*) as n, {med('gap')} as gap from gaps union all select property_type, count(*), {med('gap')} from gaps where property_type is not null group by 1")
def challenge_segments(c: Corpus) -> DataFrame:
    rows = gaps(c)
    total = rows.agg(F.lit("TOTAL").alias("segment"), F.count(F.lit(1)).alias("n"), pct(F.col("gap")).alias("gap"))
    return total.unionAll(rows.where(F.col("property_type").isNotNull()).groupBy(F.col("property_type").alias("segment")).agg(F.count(F.lit(1)).alias("n"), pct(F.col("gap")).alias("gap")))


@query(f"""with q as (select (year(f.filed_at) * 4 + quarter(f.filed_at)) as x, percentile_cont(0.5) within group (order by r.v) as y from loans l join filings f on f.accession = l.accession {fact("r", "interest_rate")} where r.v is not null group by 1)
    select count(*) as points, round(4 * regr_slope(y, x), 6) as per_year, round(regr_r2(y, x), 6) as r2 from q having count(*) >= 4""")
def challenge_rates(c: Corpus) -> DataFrame:
    rows = with_filing(c, loans_wide(c, ("interest_rate",))).where(F.col("interest_rate").isNotNull())
    q = rows.groupBy((F.year("filed_at") * 4 + F.quarter("filed_at")).alias("x")).agg(F.percentile("interest_rate", 0.5).alias("y"))
    return q.agg(F.count(F.lit(1)).alias("points"), r6(4 * F.regr_slope("y", "x")).alias("per_year"), r6(F.regr_r2("y", "x")).alias("r2")).where(F.col("points") >= 4)


# --- sellers against strata of type, vintage, coverage, leverage and size

#: Share of a stratum from which a seller is its own yardstick.
OWN_STRATUM = 0.8
STRATUM = ("kind", "vintage", "td", "tl", "tb")


@query(f"""with {BASE}, sized as (
        select *, ntile(3) over (order by dscr, loan_id) as td, ntile(3) over (order by ltv, loan_id) as tl, ntile(3) over (order by balance, loan_id) as tb from (
            select p.*, a.v as balance from pop p {fact("a", "loan_amount", loan="p.loan_id")}) where loan_seller is not null and property_type is not null and dscr is not null and ltv is not null and balance is not null),
    strata as (select kind, vintage, td, tl, tb, sum(event) * 1.0e0 / count(*) as rate from sized group by 1, 2, 3, 4, 5),
    parts as (select loan_seller, kind, vintage, td, tl, tb, count(*) as nc, count(*) * 1.0e0 / sum(count(*)) over (partition by kind, vintage, td, tl, tb) as share from sized group by 1, 2, 3, 4, 5, 6),
    own as (select loan_seller, coalesce(sum(nc) filter (where share >= {OWN_STRATUM}), 0) * 1.0e0 / sum(nc) as own from parts group by 1)
    select s.loan_seller, count(*) as n, cast(sum(event) as bigint) as observed, round(sum(t.rate), 4) as expected, count(distinct shelf) as shelves, round(max(own), 6) as own_share
    from sized s join strata t on t.kind = s.kind and t.vintage = s.vintage and t.td = s.td and t.tl = s.tl and t.tb = s.tb join own o on o.loan_seller = s.loan_seller group by 1""")
def seller_sir_sized(c: Corpus) -> DataFrame:
    """Observed and expected events of each seller within type, vintage and three terciles, and how much of it is compared with itself."""
    rows = base(c).join(loans_wide(c, ("loan_amount",)).select("loan_id", F.col("loan_amount").alias("balance")), "loan_id")
    known = F.lit(True)
    for x in ("loan_seller", "property_type", "dscr", "ltv", "balance"):
        known = known & F.col(x).isNotNull()
    rows = staged(rows.where(known).select("loan_id", "loan_seller", "kind", "vintage", "shelf", "event", "dscr", "ltv", "balance"), "sized")
    for x, name in (("dscr", "td"), ("ltv", "tl"), ("balance", "tb")):
        rows = with_tile(rows, x, "loan_id", 3, name)
    cells = rows.groupBy("loan_seller", *STRATUM).agg(F.count(F.lit(1)).alias("nc"), F.sum("event").alias("events"), F.collect_set("shelf").alias("shelves"))
    # Sellers' cells are few, so strata are summed up over them.
    w = Window.partitionBy(*STRATUM)
    cells = cells.withColumns({"rate": F.sum("events").over(w) / F.sum("nc").over(w), "share": F.col("nc") / F.sum("nc").over(w)})
    own = F.coalesce(F.sum(F.when(F.col("share") >= OWN_STRATUM, F.col("nc"))), F.lit(0)) / F.sum("nc")
    shelves = F.size(F.array_distinct(F.flatten(F.collect_set("shelves")))).cast("long")
    return cells.groupBy("loan_seller").agg(F.sum("nc").alias("n"), F.sum("events").alias("observed"), F.round(F.sum(F.col("nc") * F.col("rate")), 4).alias("expected"), shelves.alias("shelves"), F.round(own, 6).alias("own_share"))


@query(f"with {BASE}, t as (select *, ntile(3) over (order by dscr nulls last, loan_id) as tile from pop) select tile, {N_EV}, count(*) filter (where dscr is null) as unknown from t group by 1")
def predictor_terciles_open(c: Corpus) -> DataFrame:
    """Terciles of coverage over all loans, those without a figure last."""
    rows = with_tile_nulls_last(staged(base(c).select("loan_id", "dscr", "event"), "coverage"), "dscr", "loan_id", 3, "tile")
    return rows.groupBy("tile").agg(*n_ev(), count_if(F.col("dscr").isNull()).alias("unknown"))
