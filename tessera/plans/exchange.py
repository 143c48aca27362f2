"""Whether vintages and sellers are exchangeable: stability of medians, and a seller's loans against the rest."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import count_if, loans_wide, num, num_nonneg, r6, with_filing
from ..operators.resample import STRATA, null_shifts, permutation_test
from ..operators.tiles import _Range, values_at
from ..sources.bridge import Corpus
from ..sources.stage import staged
from .registry import query
from .shared_sql import GATE_NONNEG, fact, med
from .standardise import _DETAIL, DETAILS, SELLER, detailed, n_ev

#: Bounds of the metrics and of the terms, and the least loans of a vintage: fixed values.
BOUNDS = {"interest_rate": (0.001, 0.2), "dscr": (0.1, 20), "ltv": (0.01, 2), "debt_yield": (0.01, 1), "loan_amount": (1e5, 1e10), "occupancy": (0.1, 1.01), "term_original": (12, 480)}
TERMS = {"<= 84 months": (12, 84), "> 84 months": (85, 480)}
MIN_PER_VINTAGE, MIN_PER_BUCKET, TOLERABLE = 100, 50, 0.2


def values(c: Corpus) -> DataFrame:
    """loan_id, metric, vintage, v inside the metric's bounds."""
    inside = functools.reduce(operator.or_, [(F.col("metric") == k) & F.col("v").between(lo, hi) for k, (lo, hi) in BOUNDS.items()])
    rows = c.facts_of(*BOUNDS).select("loan_id", F.col("metric_key").alias("metric"), num("value").alias("v")).where(inside)
    return with_filing(c, rows.join(c.loans.select("loan_id", "accession"), "loan_id")).select("loan_id", "metric", "vintage", "v")


def _values_sql(more: str = "") -> str:
    return "vals as (" + " union all ".join(f"select '{k}' as metric, year(f.filed_at) as vintage, a.v{', b.v as term' if more else ''} from loans l join filings f on f.accession = l.accession {fact('a', k, 'join')} {more} where a.v between {lo} and {hi}" for k, (lo, hi) in BOUNDS.items()) + ")"


@query(f"select year(f.filed_at) as vintage, count(l.loan_id) as n from filings f join loans l on l.accession = f.accession group by 1 having count(l.loan_id) >= {MIN_PER_VINTAGE}")
def stability_vintages(c: Corpus) -> DataFrame:
    return with_filing(c, c.loans).groupBy("vintage").agg(F.count("loan_id").alias("n")).where(F.col("n") >= MIN_PER_VINTAGE)


def vintage_medians(rows: DataFrame, *keys: str, least: int = MIN_PER_VINTAGE) -> DataFrame:
    return rows.groupBy(*keys, "metric", "vintage").agg(F.percentile("v", 0.5).alias("median"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def shifts(medians: DataFrame, *keys: str) -> DataFrame:
    """How far a metric's medians spread over the vintages, and whether they only rise or only fall; three vintages at least."""
    before = F.lag("median").over(Window.partitionBy(*keys, "metric").orderBy("vintage"))
    m = medians.withColumns({"up": F.coalesce(F.col("median") >= before, F.lit(True)), "down": F.coalesce(F.col("median") <= before, F.lit(True))})
    out = m.groupBy(*keys, "metric").agg(
        F.count(F.lit(1)).alias("vintages"),
        F.max("median").alias("hi"),
        F.min("median").alias("lo"),
        F.element_at(F.sort_array(F.collect_list("median")), (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")).alias("centre"),
        (F.bool_and("up") | F.bool_and("down")).alias("monotone"),
    )
    return out.where(F.col("vintages") >= 3).withColumn("shift", F.coalesce((F.col("hi") - F.col("lo")) / F.abs(F.nullif(F.col("centre"), F.lit(0.0))), F.lit(0.0)))


def _shifts_sql(medians: str, keys: str = "") -> str:
    return f"""lagged as (select *, lag(median) over (partition by {keys} metric order by vintage) as before from ({medians})),
        shifts as (select {keys} metric, count(*) as vintages, bool_and(coalesce(median >= before, true)) or bool_and(coalesce(median <= before, true)) as monotone,
        coalesce((max(median) - min(median)) / abs(nullif(list_sort(list(median))[cast(floor(count(*) / 2) as int) + 1], 0)), 0) as shift from lagged group by {keys} metric having count(*) >= 3)"""


_MEDIANS = f"select metric, vintage, percentile_cont(0.5) within group (order by v) as median, count(*) as n from vals group by 1, 2 having count(*) >= {MIN_PER_VINTAGE}"


@query(f"with {_values_sql()} select metric, vintage, round(median, 8) as median, n from ({_MEDIANS})")
def stability_medians(c: Corpus) -> DataFrame:
    return vintage_medians(values(c)).withColumn("median", F.round("median", 8))


@query(f"with {_values_sql()}, {_shifts_sql(_MEDIANS)} select metric, vintages, round(shift, 6) as shift, monotone, shift > {TOLERABLE} as unstable from shifts")
def stability_shifts(c: Corpus) -> DataFrame:
    return shifts(vintage_medians(values(c))).select("metric", "vintages", r6(F.col("shift")).alias("shift"), "monotone", (F.col("shift") > TOLERABLE).alias("unstable"))


@query(None)
def stability_null(c: Corpus) -> DataFrame:
    """The shift that sampling alone gives, if all vintages were drawn from one pool."""
    rows = values(c)
    medians = vintage_medians(rows)
    kept = rows.join(medians.select("metric", "vintage"), ["metric", "vintage"])
    pool = kept.groupBy("metric").agg(F.sort_array(F.collect_list("v")).alias("pool"))
    sizes = medians.groupBy("metric").agg(F.sort_array(F.collect_list(F.struct("vintage", "n")))["n"].alias("sizes"))
    observed = shifts(medians).select("metric", F.col("shift").alias("observed"))
    groups = pool.join(sizes, "metric").join(observed, "metric")
    return observed.withColumn("observed", r6(F.col("observed"))).join(null_shifts(groups, "metric"), "metric")


_BUCKET = "case " + " ".join(f"when term between {lo} and {hi} then '{n}'" for n, (lo, hi) in TERMS.items()) + " end"


@query(f"with {_values_sql(fact('b', 'term_original', 'join', GATE_NONNEG))}, t as (select *, {_BUCKET} as bucket from vals where metric <> 'term_original'), {_shifts_sql(f'select bucket, metric, vintage, percentile_cont(0.5) within group (order by v) as median from t where bucket is not null group by 1, 2, 3 having count(*) >= {MIN_PER_BUCKET}', 'bucket,')} select bucket, metric, vintages, round(shift, 6) as shift from shifts")
def stability_term_buckets(c: Corpus) -> DataFrame:
    """Shifts within loans of like term."""
    term = c.facts_of("term_original").select("loan_id", num_nonneg("value").alias("term"))
    rows = values(c).where(F.col("metric") != "term_original").join(term, "loan_id").withColumn("bucket", F.expr(_BUCKET)).where(F.col("bucket").isNotNull())
    return shifts(vintage_medians(rows, "bucket", least=MIN_PER_BUCKET), "bucket").select("bucket", "metric", "vintages", r6(F.col("shift")).alias("shift"))


# --- a seller's loans against the rest

FACTS = {"io": "io_period_original", "term": "term_original", "reserve": "reserve_replacement_monthly", "uw": "noi_underwritten", "hist": "noi_most_recent", "balance": "loan_amount"}
DERIVED = {"io_share": "io / nullif(term, 0)", "reserve_bp": "reserve * 12 / nullif(balance, 0) * 10000", "projection": "uw / nullif(hist, 0)", "balance": "balance"}


def profile(c: Corpus) -> DataFrame:
    """loan_id, own, event and the derived metrics of the detailed types' loans."""
    wide = loans_wide(c, tuple(FACTS.values()), num_nonneg).select("loan_id", *[F.col(k).alias(a) for a, k in FACTS.items()])
    rows = detailed(c).where(F.col("detail").isin(*DETAILS) & F.col("loan_seller").isNotNull()).select("loan_id", "event", (F.col("loan_seller") == SELLER).alias("own"))
    return rows.join(wide, "loan_id").select("loan_id", "own", "event", *[F.expr(x).alias(f"m_{k}") for k, x in DERIVED.items()])


_PROFILE = f"{_DETAIL}, prof as (select d.loan_seller = '{SELLER}' as own, event, " + ", ".join(f"{x} as m_{k}" for k, x in DERIVED.items()) + " from (select d.*, " + ", ".join(f"{a}_.v as {a}" for a in FACTS) + " from det d " + " ".join(fact(f"{a}_", k, gate=GATE_NONNEG, loan="d.loan_id") for a, k in FACTS.items()) + f" where d.detail in {DETAILS} and d.loan_seller is not null) d)"


@query(f"with {_PROFILE} select own, count(*) as n, cast(sum(event) as bigint) as events, " + ", ".join(f"{med(f'm_{k}')} as {k}" for k in DERIVED) + " from prof group by 1")
def mechanism_base(c: Corpus) -> DataFrame:
    return profile(c).groupBy("own").agg(*n_ev(), *[F.round(F.percentile(f"m_{k}", 0.5), 8).alias(k) for k in DERIVED])


def _long(c: Corpus) -> DataFrame:
    by = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"m_{k}").alias("x")) for k in DERIVED])
    return profile(c).withColumn("by_balance", F.col("m_balance")).select(F.col("loan_id").alias("id"), "own", "by_balance", F.explode(by).alias("m")).select("id", "own", "by_balance", "m.*").where(F.col("x").isNotNull())


@query(None)
def mechanism_permutation(c: Corpus) -> DataFrame:
    """Differences of medians against labels dealt at random among the loans that have the metric."""
    return permutation_test(_long(c).withColumn("stratum", F.lit(0)), "metric")


#: Rows that a stratified test needs: in all, on each side, and of the own side within the common range.
LEAST_ALL, LEAST_SIDE, LEAST_OWN = 12, 4, 4


def balance_strata(rows: DataFrame, strata: int = STRATA) -> DataFrame:
    """rows (metric, by_balance) with stratum: the number of cuts below a row's balance, so equal balances stay together.

    The cuts are the balances at whole parts of each metric's order, found by exact counts; there are few metrics.
    """
    narrow = rows.select(F.col("metric").alias("key"), F.col("by_balance").cast("double").alias("x"))
    sizes = narrow.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    ranks = [_Range(g["key"], (i + 1) * g["n"] // strata + 1, g["lo"], g["hi"], g["n"]) for g in sizes for i in range(strata - 1)]
    cuts = [(r.key, x) for r, (x, *_) in zip(ranks, values_at(narrow, ranks), strict=True)]
    cuts = rows.sparkSession.createDataFrame(cuts, "metric string, cut double").groupBy("metric").agg(F.collect_list("cut").alias("cuts"))
    return rows.join(F.broadcast(cuts), "metric").withColumn("stratum", F.size(F.filter("cuts", lambda x: x < F.col("by_balance")))).drop("cuts")


@query(None)
def mechanism_stratified(c: Corpus) -> DataFrame:
    """The same within strata of the balance, over the range of balances that both sides have; too few rows give p = 1 and no counts."""
    rows = staged(_long(c).where(F.col("by_balance").isNotNull()), "profile")
    side = lambda own: F.when(F.col("own") == own, F.col("by_balance"))
    ends = rows.groupBy("metric").agg(
        F.greatest(F.min(side(True)), F.min(side(False))).alias("lo"), F.least(F.max(side(True)), F.max(side(False))).alias("hi"),
        count_if(F.lit(True)).alias("all_n"), F.count(side(True)).alias("all_own"), F.count(side(False)).alias("all_rest"),
    )
    inside = F.col("by_balance").between(F.col("lo"), F.col("hi"))
    kept = rows.join(F.broadcast(ends), "metric").where(inside)
    counts = ends.join(kept.groupBy("metric").agg(count_if(F.lit(True)).alias("base_n"), count_if(F.col("own")).alias("base_own")), "metric", "left").fillna(0, ["base_n", "base_own"])
    ready = (F.col("all_n") >= LEAST_ALL) & (F.col("all_own") >= LEAST_SIDE) & (F.col("all_rest") >= LEAST_SIDE)
    counts = staged(counts.withColumns({"ready": ready, "tested": ready & (F.col("base_own") >= LEAST_OWN)}), "profile-counts")
    tested = kept.join(F.broadcast(counts.where("tested").select("metric")), "metric", "left_semi").select("id", "own", "by_balance", "metric", "x")
    out = counts.join(permutation_test(balance_strata(staged(tested, "profile-kept")), "metric"), "metric", "left")
    had = F.col("observed").isNotNull() & F.col("tested")
    n = lambda c: F.when(had, F.col(c)).otherwise(0)
    trimmed = F.when(F.col("ready"), F.col("all_n") - F.col("base_n")).otherwise(0)
    return out.select("metric", n("n_own").alias("n_own"), n("n_rest").alias("n_rest"), F.when(had, F.col("observed")).alias("observed"), F.when(had, F.col("null_difference")).alias("null_difference"), F.when(had, F.col("p_value")).otherwise(1.0).alias("p_value"), trimmed.alias("trimmed"))
