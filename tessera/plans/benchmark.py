"""An issuance against its cohort, comparables, and the statistics behind them."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import canon_type, count_if, loans_wide, num, num_nonneg, pct, quartiles, r6, with_filing
from ..operators.resample import BOOTSTRAP_SEED, RESAMPLES, SIMULATIONS, bootstrap, null_distances
from ..sources.bridge import Corpus
from .outcomes import outcomes
from .registry import query
from .shared_sql import GATE_NONNEG, OUTCOMES, STREAM_JOIN, STREAM_VALUE, canon_sql, fact, med, quart, stream_sql

MIN_PAIRS, CONCENTRATION, MIN_PER_METRIC = 15, 0.8, 10
#: Bounds of the cohort metrics and the end that counts as aggressive: fixed values.
COHORT = {
    "ltv": (0.01, 2.0, "high"), "dscr": (0.1, 20.0, "low"), "debt_yield": (0.01, 1.0, "low"), "interest_rate": (0.001, 0.2, "high"), "loan_amount": (1e5, 1e10, "high"), "occupancy": (0.1, 1.01, "low"),
}


@query("""with pools as (select accession, count(*) as pool, count(property_type) as typed_pool from loans group by 1),
    kinds as (select accession, property_type as kind, count(*) as n, row_number() over (partition by accession order by count(*) desc, property_type) as rn, sum(count(*)) over (partition by accession) as total from loans where property_type is not null group by 1, 2)
    select f.accession, f.company_name, year(f.filed_at) as vintage, p.pool, p.typed_pool, k.kind as dominant_type, round(k.n * 1.0e0 / nullif(k.total, 0), 6) as dominant_share from filings f join pools p on p.accession = f.accession left join kinds k on k.accession = f.accession and k.rn = 1""")
def issuance_candidates(c: Corpus) -> DataFrame:
    pools = c.loans.groupBy("accession").agg(F.count(F.lit(1)).alias("pool"), F.count("property_type").alias("typed_pool"))
    kinds = c.loans.where(F.col("property_type").isNotNull()).groupBy("accession", "property_type").agg(F.count(F.lit(1)).alias("n"))
    # The most frequent type, the first by name among equals.
    best = kinds.groupBy("accession").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), F.col("property_type").alias("kind"))).alias("b"))
    top = best.select("accession", F.col("b.kind").alias("dominant_type"), r6(-F.col("b.m") / F.col("total")).alias("dominant_share"))
    return with_filing(c, pools).drop("filed_at").join(top, "accession", "left")


_MEDIANS = "medians as (" + " union all ".join(f"select '{k}' as metric, l.accession, year(f.filed_at) as vintage, percentile_cont(0.5) within group (order by a.v) as median from loans l join filings f on f.accession = l.accession {fact('a', k, 'join')} where a.v between {lo} and {hi} group by 2, 3 having count(*) >= {MIN_PER_METRIC}" for k, (lo, hi, _) in COHORT.items()) + ")"


def medians(c: Corpus) -> DataFrame:
    inside = functools.reduce(lambda a, b: a | b, [(F.col("metric") == k) & F.col("v").between(lo, hi) for k, (lo, hi, _) in COHORT.items()])
    rows = c.facts_of(*COHORT).select("loan_id", F.col("metric_key").alias("metric"), num("value").alias("v")).where(inside)
    rows = with_filing(c, rows.join(c.loans.select("loan_id", "accession"), "loan_id"))
    out = rows.groupBy("metric", "accession", "vintage").agg(F.count(F.lit(1)).alias("n"), F.percentile("v", 0.5).alias("median"))
    return out.where(F.col("n") >= MIN_PER_METRIC).drop("n")


@query(f"with {_MEDIANS} select metric, accession, vintage, round(median, 8) as median from medians")
def cohort_medians(c: Corpus) -> DataFrame:
    return medians(c).withColumn("median", F.round("median", 8))


_HIGH, _LOW = ([k for k, (*_, end) in COHORT.items() if end == side] for side in ("high", "low"))


@query(f"""with {_MEDIANS}, r as (select a.metric, a.accession, a.median as value, count(b.median) as others, count(*) filter (where b.median < a.median) + 1 as rank, list_sort(list(b.median)) as sorted from medians a join medians b on a.metric = b.metric and a.vintage = b.vintage and a.accession <> b.accession group by 1, 2, 3)
    select metric, accession, round(value, 8) as value, others, rank, rank <= 3 or rank >= others - 1 as extreme, (metric in ({", ".join(f"'{k}'" for k in _HIGH)}) and rank >= others - 1) or (metric in ({", ".join(f"'{k}'" for k in _LOW)}) and rank <= 3) as aggressive,
    round(sorted[least(others, cast(floor(0.25 * others) as int) + 1)], 8) as p25, round(sorted[least(others, cast(floor(0.5 * others) as int) + 1)], 8) as p50, round(sorted[least(others, cast(floor(0.75 * others) as int) + 1)], 8) as p75 from r where others >= {MIN_PAIRS}""")
def benchmark_ranks(c: Corpus) -> DataFrame:
    """Each issuance among the others of its vintage; quartiles by nearest rank.

    All issuances of a vintage have equally many others, so a quartile stands at the same place for each; without
    itself an issuance finds there the cohort's value at that place, or the next one if it stands before.
    """
    cohort = Window.partitionBy("metric", "vintage")
    rows = medians(c).withColumn("at", F.row_number().over(cohort.orderBy("median", "accession"))).withColumn("rank", F.rank().over(cohort.orderBy("median")).cast("long"))
    rows = rows.withColumn("others", F.count(F.lit(1)).over(cohort) - 1)

    def quartile(p: float) -> Column:
        place = F.least(F.col("others"), F.floor(p * F.col("others")) + 1)
        here, after = (F.max(F.when(F.col("at") == place + k, F.col("median"))).over(cohort) for k in (0, 1))
        return F.round(F.when(F.col("at") > place, here).otherwise(after), 8)

    rows = rows.withColumns({name: quartile(p) for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))}).where(F.col("others") >= MIN_PAIRS)
    low, high = F.col("rank") <= 3, F.col("rank") >= F.col("others") - 1
    aggressive = (F.col("metric").isin(_HIGH) & high) | (F.col("metric").isin(_LOW) & low)
    return rows.select("metric", "accession", F.round("median", 8).alias("value"), "others", "rank", (low | high).alias("extreme"), aggressive.alias("aggressive"), "p25", "p50", "p75")


_KINDS = f"kinds as (select l.accession, year(f.filed_at) as vintage, {canon_sql('l.property_type', 'Unclassified')} as kind, count(*) as n from loans l join filings f on f.accession = l.accession where l.property_type is not null group by 1, 2, 3)"


def kinds(c: Corpus) -> DataFrame:
    rows = with_filing(c, c.loans.where(F.col("property_type").isNotNull()))
    return rows.groupBy("accession", "vintage", canon_type("property_type", "Unclassified").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_KINDS} select accession, kind, round(n * 1.0e0 / sum(n) over (partition by accession), 6) as share from kinds")
def composition_by_pair(c: Corpus) -> DataFrame:
    return kinds(c).select("accession", "kind", r6(F.col("n") / F.sum("n").over(Window.partitionBy("accession"))).alias("share"))


def mix(c: Corpus) -> DataFrame:
    """accession, kind, own and cohort share; the cohort is the vintage without the issuance, by totals less its own."""
    k = kinds(c)
    total = k.groupBy("vintage", "kind").agg(F.sum("n").alias("all_n"))
    every = k.select("accession", "vintage").distinct().join(total, "vintage").join(k.select("accession", "kind", "n"), ["accession", "kind"], "left").fillna(0, ["n"])
    w = Window.partitionBy("accession")
    rest = F.col("all_n") - F.col("n")
    return every.select("accession", "vintage", "kind", "n", F.sum("n").over(w).alias("pool"), (F.col("n") / F.sum("n").over(w)).alias("own"), (rest / F.sum(rest).over(w)).alias("cohort"))


_MIX = f"""{_KINDS}, m as (select a.accession, b.kind, coalesce(max(case when b.accession = a.accession then b.n end), 0) as own_n, coalesce(sum(case when b.accession <> a.accession then b.n end), 0) as rest_n
    from (select distinct accession, vintage from kinds) a join kinds b on b.vintage = a.vintage group by 1, 2),
    mix as (select accession, kind, own_n * 1.0e0 / sum(own_n) over (partition by accession) as own, rest_n * 1.0e0 / sum(rest_n) over (partition by accession) as cohort from m)"""


@query(f"with {_MIX} select accession, kind, round(own, 6) as own, round(cohort, 6) as cohort from mix")
def composition_mix(c: Corpus) -> DataFrame:
    return mix(c).select("accession", "kind", r6(F.col("own")).alias("own"), r6(F.col("cohort")).alias("cohort"))


@query(f"with {_MIX} select accession, round(0.5 * sum(abs(own - cohort)), 6) as distance from mix group by 1")
def composition_distance_only(c: Corpus) -> DataFrame:
    return mix(c).groupBy("accession").agg(r6(0.5 * F.sum(F.abs(F.col("own") - F.col("cohort")))).alias("distance"))


_DISTANCES = f"""{_MIX}, seen as (select accession, 0.5 * sum(abs(own - cohort)) as observed from mix group by 1), pools as (select accession, cast(sum(own_n) as bigint) as pool from m group by 1),
    edges as (select accession, kind, cohort, row_number() over (partition by accession order by cohort desc, kind) as k, count(*) over (partition by accession) as kinds, sum(cohort) over (partition by accession order by cohort desc, kind rows unbounded preceding) as upper from mix),
    bands as (select *, coalesce(lag(upper) over (partition by accession order by k), -1) as lower, case when k = kinds then 2 else upper end as till from edges),
    {stream_sql(0xC0FFEE, f"select {SIMULATIONS} * max(pool) + 1 from pools")},
    numbers as (select t, {STREAM_VALUE} as u from (select unnest(range((select {SIMULATIONS} * max(pool) from pools))) as t) {STREAM_JOIN}),
    hits as (select p.accession, n.t // p.pool as d, b.k, count(*) as n from pools p join numbers n on n.t < {SIMULATIONS} * p.pool join bands b on b.accession = p.accession and n.u >= b.lower and n.u < b.till group by 1, 2, 3),
    sims as (select p.accession, d, 0.5 * (1 + sum(abs(h.n / cast(p.pool as double) - e.cohort) - e.cohort)) as v from hits h join pools p on p.accession = h.accession join edges e on e.accession = h.accession and e.k = h.k group by 1, 2),
    placed as (select *, row_number() over (partition by accession order by v) - 1 as r from sims),
    tested as (
        select s.accession, round(observed, 6) as distance, round(max(v) filter (where r = {SIMULATIONS // 2}), 6) as null_distance, round(avg(case when v >= observed - 1e-12 then 1.0e0 else 0.0e0 end), 6) as p_value
        from placed p join seen s on s.accession = p.accession group by 1, observed)"""


@query(f"with recursive {_DISTANCES} select *, round(distance - null_distance, 6) as excess, case when p_value < 0.05 then 'different' when p_value < 0.2 then 'borderline' else 'market' end as band from tested")
def composition_distance(c: Corpus) -> DataFrame:
    """Distance of each issuance's mix from its cohort's, against chance: a fixed random stream for every issuance."""
    m = mix(c).withColumn("kinds", F.struct((-F.col("cohort")).alias("o"), "kind", "own", "cohort"))
    groups = m.groupBy("accession").agg(F.max("pool").alias("pool"), F.sort_array(F.collect_list("kinds")).alias("k"), (0.5 * F.sum(F.abs(F.col("own") - F.col("cohort")))).alias("observed"))
    return banded(null_distances(groups.select("accession", "pool", F.col("k.cohort").alias("cohort"), "observed"), "accession"))


def banded(rows: DataFrame) -> DataFrame:
    band = F.when(F.col("p_value") < 0.05, "different").when(F.col("p_value") < 0.2, "borderline").otherwise("market")
    return rows.withColumns({"excess": F.round(F.col("distance") - F.col("null_distance"), 6), "band": band})


def growth(c: Corpus) -> DataFrame:
    """vintage, x: growth delivered in the 10-30M band, of full years after closing."""
    rows = outcomes(c).where((F.col("days_after_origination") >= 0) & F.col("is_full_year") & F.col("growth_delivered").isNotNull() & F.col("loan_amount_senior").between(10_000_000, 30_000_000))
    return rows.select("vintage", F.col("growth_delivered").alias("x"))


#: Loans that a vintage needs for an interval.
LEAST_GROWTHS = 30
_BOOTSTRAP = f"""{OUTCOMES}, grown as (
        select year(originated_at) as vintage, growth_delivered as x from outcomes where days_after_origination >= 0 and is_full_year and growth_delivered is not null and loan_amount_senior between 10000000 and 30000000),
    sizes as (select vintage, count(*) as n from grown group by 1 having count(*) >= {LEAST_GROWTHS}),
    starts as (select *, coalesce(sum(n) over (order by vintage rows between unbounded preceding and 1 preceding), 0) * {RESAMPLES} as skip from sizes),
    sorted as (select vintage, x, row_number() over (partition by vintage order by x) - 1 as place from grown),
    {stream_sql(BOOTSTRAP_SEED, f"select {RESAMPLES} * sum(n) + 1 from sizes")},
    spots as (select vintage, n, r, cast(skip + r * n + i as bigint) as t from (select *, unnest(range(n)) as i from (select *, unnest(range({RESAMPLES})) as r from starts))),
    drawn as (select vintage, n, r, cast(floor({STREAM_VALUE} * n) as bigint) as place from spots {STREAM_JOIN}),
    middle as (select *, row_number() over (partition by vintage, r order by place) as k from drawn),
    medians as (select m.vintage, r, avg(x) as v from middle m join sorted s on s.vintage = m.vintage and s.place = m.place where k in ((n + 1) // 2, n // 2 + 1) group by 1, 2),
    ordered as (select vintage, v, row_number() over (partition by vintage order by v) - 1 as k from medians),
    power as (
        select s.vintage, s.n, (select percentile_cont(0.5) within group (order by x) from grown g where g.vintage = s.vintage) as median, max(v) filter (where k = {RESAMPLES // 40}) as lo, max(v) filter (where k = {RESAMPLES * 39 // 40}) as hi, stddev_samp(v) as se
        from sizes s join ordered o on o.vintage = s.vintage group by 1, 2)"""


@query(f"with recursive {_BOOTSTRAP} select vintage, n, round(median, 6) as median, round(lo, 6) as lo, round(hi, 6) as hi, round(se, 6) as se from power")
def power_bootstrap(c: Corpus) -> DataFrame:
    """Bootstrap interval of the median growth in a vintage's 10-30M band."""
    return bootstrap(growth(c), "vintage", LEAST_GROWTHS)


TARGET_EFFECT = 0.05


@query(f"""with recursive {_BOOTSTRAP}, typical as (select percentile_cont(0.5) within group (order by round(se, 6)) as se, percentile_cont(0.5) within group (order by n) as n, cast(sum(n) as bigint) as measured from power)
    select round(se, 6) as typical_se, n as typical_n, measured, round(1.96 * sqrt(2) * se, 6) as detectable, round(pow(1.96 * sqrt(2) * se / {TARGET_EFFECT}, 2), 6) as sample_factor from typical""")
def power_detectable(c: Corpus) -> DataFrame:
    """The least difference between vintages that the sample could show, and how many times more loans TARGET_EFFECT would take."""
    out = power_bootstrap(c).agg(F.percentile("se", 0.5).alias("typical_se"), F.percentile("n", 0.5).alias("typical_n"), F.sum("n").alias("measured"))
    mde = 1.96 * math.sqrt(2) * F.col("typical_se")
    return out.select(r6(F.col("typical_se")).alias("typical_se"), "typical_n", "measured", r6(mde).alias("detectable"), r6(F.pow(mde / TARGET_EFFECT, F.lit(2))).alias("sample_factor"))


@query(f"""with {_KINDS}, v as (select * from kinds where vintage = (select max(vintage) from kinds)), s as (select accession, kind, n * 1.0e0 / sum(n) over (partition by accession) as own from v),
    g as (select a.accession, k.kind, coalesce(max(case when b.accession = a.accession then b.own end), 0) as own, coalesce(sum(case when b.accession <> a.accession then b.own end), 0) / greatest(1, (select count(distinct accession) from v) - 1) as others
    from (select distinct accession from v) a cross join (select distinct kind from v) k left join s b on b.kind = k.kind group by 1, 2) select accession, round(0.5 * sum(abs(own - others)), 6) as distance_by_issuance from g group by 1""")
def composition_by_issuance(c: Corpus) -> DataFrame:
    """The newest vintage's issuances against the others, each of which weighs alike."""
    return signal_mix(c).groupBy("accession").agg(r6(0.5 * F.sum(F.abs(F.col("own") - F.col("cohort")))).alias("distance_by_issuance"))


def signal_mix(c: Corpus) -> DataFrame:
    """accession, kind, pool, own, cohort: shares of an issuance and the mean shares of the others, by totals less its own."""
    k = kinds(c)
    v = k.join(F.broadcast(k.agg(F.max("vintage").alias("vintage"))), "vintage")
    share = v.withColumn("pool", F.sum("n").over(Window.partitionBy("accession"))).withColumn("own", F.col("n") / F.col("pool"))
    pools = share.groupBy("accession").agg(F.max("pool").alias("pool"))
    total = share.groupBy("kind").agg(F.sum("own").alias("all_own")).crossJoin(F.broadcast(pools.agg(F.count(F.lit(1)).alias("m"))))
    every = pools.crossJoin(F.broadcast(total)).join(share.select("accession", "kind", "own"), ["accession", "kind"], "left").fillna(0.0, ["own"])
    return every.select("accession", "kind", "pool", "own", ((F.col("all_own") - F.col("own")) / F.greatest(F.lit(1), F.col("m") - 1)).alias("cohort"))


@query(None)
def composition_signal(c: Corpus) -> DataFrame:
    """Issuances of the newest vintage that chance doesn't explain, with the others weighing by loan and by issuance."""
    m = signal_mix(c).withColumn("kinds", F.struct((-F.col("cohort")).alias("o"), "kind", "own", "cohort"))
    groups = m.groupBy("accession").agg(F.max("pool").alias("pool"), F.sort_array(F.collect_list("kinds")).alias("k"), (0.5 * F.sum(F.abs(F.col("own") - F.col("cohort")))).alias("observed"))
    alike = null_distances(groups.select("accession", "pool", F.col("k.cohort").alias("cohort"), "observed"), "accession").select("accession", F.col("p_value").alias("p_by_issuance"))
    by_loan = composition_distance(c).select("accession", "distance", F.col("p_value").alias("p_by_loan"))
    return by_loan.join(alike, "accession").withColumn("robust", (F.col("p_by_loan") < 0.05) & (F.col("p_by_issuance") < 0.05))


# --- comparables

#: Census divisions and their states: fixed values.
DIVISIONS = {
    "New England": ("CT", "ME", "MA", "NH", "RI", "VT"),
    "Mid-Atlantic": ("NJ", "NY", "PA"),
    "East North Central": ("IL", "IN", "MI", "OH", "WI"),
    "West North Central": ("IA", "KS", "MN", "MO", "NE", "ND", "SD"),
    "South Atlantic": ("DE", "DC", "FL", "GA", "MD", "NC", "SC", "VA", "WV"),
    "East South Central": ("AL", "KY", "MS", "TN"),
    "West South Central": ("AR", "LA", "OK", "TX"),
    "Mountain": ("AZ", "CO", "ID", "MT", "NV", "NM", "UT", "WY"),
    "Pacific": ("AK", "CA", "HI", "OR", "WA"),
}
BAND, MONTHS, MIN_COMPS = 0.5, 18, 10
LIMITS = {"ltv": 2, "dscr": 20, "debt_yield": 2, "interest_rate": 1}
#: The request that the queries answer.
ASKED = {"state": "NY", "kind": "Multifamily", "amount": 25_000_000.0, "target_ltv": 0.6}


def comparables(c: Corpus, kind: str, amount: float, band: float = BAND, months: int = MONTHS) -> DataFrame:
    """Loans of one class, near in size and closed in the months before the newest filing, with their metrics."""
    newest = c.filings.agg(F.add_months(F.max("filed_at"), -months).alias("since"))
    rows = with_filing(c, loans_wide(c, ("loan_amount", *LIMITS), num_nonneg)).crossJoin(F.broadcast(newest))
    near = (canon_type("property_type") == kind) & (F.col("loan_amount") > 0) & F.col("loan_amount").between(amount * (1 - band), amount * (1 + band))
    return rows.where(near & (F.col("filed_at") >= F.col("since"))).withColumn("state", F.trim("state"))


def rungs(state: str) -> list[tuple[int, str, tuple | None]]:
    region = next(((n, s) for n, s in DIVISIONS.items() if state in s), None)
    return [(1, state, (state,)), *([(2, *region)] if region else []), (3, "country", None)]


def _comps_sql(band: float = BAND, months: int = MONTHS) -> str:
    lo, hi = ASKED["amount"] * (1 - band), ASKED["amount"] * (1 + band)
    joins = "".join(fact(f"m_{k}", k, gate=GATE_NONNEG) for k in LIMITS)
    picks = ", ".join(f"m_{k}.v as {k}" for k in LIMITS)
    return f"""comps as (select l.loan_id, l.accession, f.company_name, f.filed_at, trim(l.state) as state, a.v as amount, {picks} from loans l join filings f on f.accession = l.accession {fact("a", "loan_amount", "join", GATE_NONNEG)} {joins}
        where {canon_sql("l.property_type")} = '{ASKED["kind"]}' and a.v > 0 and a.v between {lo} and {hi} and f.filed_at >= (select max(filed_at) from filings) - interval {months} month)"""


def _asked(c: Corpus, **more) -> DataFrame:
    return comparables(c, ASKED["kind"], ASKED["amount"], **more)


def _in(states: tuple | None) -> Column:
    return F.lit(True) if states is None else F.coalesce(F.col("state").isin(*states), F.lit(False))


def _in_sql(states: tuple | None) -> str:
    return "true" if states is None else "state in (" + ", ".join(f"'{s}'" for s in states) + ")"


@query(f"with {_comps_sql()} " + " union all ".join(f"select {i} as rung, '{n}' as label, count(*) as found from comps where {_in_sql(s)}" for i, n, s in rungs(ASKED["state"])))
def comps_ladder(c: Corpus) -> DataFrame:
    """All rungs are counted in one pass, used or not."""
    counted = _asked(c).agg(*[count_if(_in(s)).alias(f"r{i}") for i, _, s in rungs(ASKED["state"])])
    parts = F.array(*[F.struct(F.lit(i).alias("rung"), F.lit(n).alias("label"), F.col(f"r{i}").alias("found")) for i, n, _ in rungs(ASKED["state"])])
    return counted.select(F.explode(parts).alias("x")).select("x.*")


@query(f"with {_comps_sql()} " + " union all ".join(f"select '{k}' as metric, count(*) as base, {quart(k)} from comps where {k} > 0 and {k} < {m}" for k, m in LIMITS.items()))
def comps_distributions(c: Corpus) -> DataFrame:
    by = F.array(*[F.struct(F.lit(k).alias("metric"), F.when((F.col(k) > 0) & (F.col(k) < m), F.col(k)).alias("v")) for k, m in LIMITS.items()])
    rows = _asked(c).select(F.explode(by).alias("x")).select("x.*").where(F.col("v").isNotNull())
    return rows.groupBy("metric").agg(F.count(F.lit(1)).alias("base"), *quartiles(F.col("v")))


@query(f"with {_comps_sql()} select count(*) filter (where ltv >= {ASKED['target_ltv']}) as reached, count(*) as base from comps where ltv > 0 and ltv <= 2")
def comps_target(c: Corpus) -> DataFrame:
    return _asked(c).where((F.col("ltv") > 0) & (F.col("ltv") <= 2)).agg(count_if(F.col("ltv") >= ASKED["target_ltv"]).alias("reached"), F.count(F.lit(1)).alias("base"))


@query(f"with {_comps_sql()} select loan_id, company_name, filed_at, state, amount from comps order by filed_at desc, amount desc, loan_id limit 25")
def comps_sample(c: Corpus) -> DataFrame:
    rows = _asked(c).withColumnRenamed("loan_amount", "amount").orderBy(F.desc("filed_at"), F.desc("amount"), "loan_id").limit(25)
    return rows.select("loan_id", "company_name", "filed_at", "state", "amount")


@query(f"select (with {_comps_sql(band=1.0)} select count(*) from comps) as wider_band, (with {_comps_sql(months=36)} select count(*) from comps) as longer_window")
def comps_if_widened(c: Corpus) -> DataFrame:
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(_asked(c, band=1.0), "wider_band").crossJoin(F.broadcast(one(_asked(c, months=36), "longer_window")))


@query(f"select year(f.filed_at) as vintage, count(distinct f.accession) as issuances, count(l.loan_id) as loans, {med('n')} as median_pool from filings f join loans l on l.accession = f.accession join (select accession, count(*) as n from loans group by 1) p on p.accession = f.accession group by 1")
def cohort_viability(c: Corpus) -> DataFrame:
    rows = with_filing(c, c.loans).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("accession")))
    return rows.groupBy("vintage").agg(F.count_distinct("accession").alias("issuances"), F.count("loan_id").alias("loans"), pct(F.col("n")).alias("median_pool"))


@query("""with p as (select f.accession, year(f.filed_at) as vintage, count(*) as pool from filings f join loans l on l.accession = f.accession group by 1, 2), r as (select *, row_number() over (partition by vintage order by pool desc, accession) as place, sum(pool) over (partition by vintage) as total from p)
    select vintage, accession, pool, place, round(pool * 1.0e0 / total, 6) as share from r where place <= 2""")
def history_trusts(c: Corpus) -> DataFrame:
    p = with_filing(c, c.loans).groupBy("accession", "vintage").agg(F.count(F.lit(1)).alias("pool"))
    w = Window.partitionBy("vintage")
    r = p.withColumn("place", F.row_number().over(w.orderBy(F.desc("pool"), "accession"))).withColumn("share", r6(F.col("pool") / F.sum("pool").over(w)))
    return r.where(F.col("place") <= 2)
