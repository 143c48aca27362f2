"""Requests for comparable loans, many at a time: a dozen scenarios, and texts that loans make requests of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import CLASSES, canon_type, loans_wide, num_nonneg, with_filing
from ..operators import requests as op
from ..sources.bridge import Corpus
from .benchmark import DIVISIONS, LIMITS
from .registry import query
from .shared_sql import GATE_NONNEG, canon_sql, fact, quart

KINDS = tuple(name for _, name in CLASSES)
# State, class, amount and target of the scenarios; amounts are scaled to those of the corpus.
SCENARIOS = (
    ("GA", "Multifamily", 28_000_000, "0.7"), ("TX", "Multifamily", 15_000_000, None), ("NY", "Office", 45_000_000, "0.6"), ("CA", "Industrial", 30_000_000, None),
    ("FL", "Hospitality", 22_000_000, None), ("FL", "Retail", 12_000_000, None), ("NJ", "Industrial", 25_000_000, "65"), ("NY", "Multifamily", 60_000_000, "0.75"),
    ("AZ", "Self Storage", 8_000_000, None), ("IL", "Mixed Use", 20_000_000, None), ("OH", "Retail", 4_000_000, None), ("WY", "Manufactured", 6_000_000, None),
)
#: Every scenario as it is, with a longer window, and with the whole country.
VARIANTS = ((None, None), ("60", None), ("120", "true"))
ASKED = tuple((i * len(VARIANTS) + j, s, k, str(a), None, months, ltv, national) for i, (s, k, a, ltv) in enumerate(SCENARIOS) for j, (months, national) in enumerate(VARIANTS))


def _loans(c: Corpus) -> DataFrame:
    rows = with_filing(c, loans_wide(c, ("loan_amount", *LIMITS), num_nonneg))
    return rows.select("loan_id", canon_type("property_type").alias("kind"), F.trim("state").alias("state"), "loan_amount", "filed_at", *LIMITS)


def _answers(c: Corpus) -> tuple[DataFrame, DataFrame]:
    raw = c.spark.createDataFrame(list(ASKED), "request_id long, " + ", ".join(f"{k} string" for k in op.RAW))
    return op.answers(_loans(c), op.checked_requests(raw, KINDS), DIVISIONS, LIMITS)


def _region(x: str) -> str:
    return f"case {x} " + " ".join(f"when '{s}' then '{name}'" for name, states in DIVISIONS.items() for s in states) + " end"


def _ltv(x: str | None) -> str:
    return "null" if x is None else f"{float(x) / 100 if float(x) > 2 else float(x)}e0"


_WANTED = ", ".join(f"({i}, '{s}', '{k}', {a}.0e0, {m or op.MONTHS}, {_ltv(t)}, {'true' if n else 'false'})" for i, s, k, a, _, m, t, n in ASKED)
_ANSWERS = f"""wanted(request_id, asked_state, kind, asked, months, target, national) as (values {_WANTED}),
    pool as (select l.loan_id, {canon_sql("l.property_type")} as kind, trim(l.state) as state, a.v as amount, f.filed_at, {", ".join(f"m_{k}.v as {k}" for k in LIMITS)}
        from loans l join filings f on f.accession = l.accession {fact("a", "loan_amount", "join", GATE_NONNEG)} {"".join(fact(f"m_{k}", k, gate=GATE_NONNEG) for k in LIMITS)} where a.v > 0),
    near as (select w.*, p.* exclude (kind), amount between asked * 0.5 and asked * 1.5 as in_band, amount <= asked * 2 as wider, filed_at >= (select max(filed_at) from filings) - to_months(months) as in_months,
        filed_at >= (select max(filed_at) from filings) - interval 36 month as longer, coalesce(state = asked_state, false) as same_state, coalesce({_region("state")} = {_region("asked_state")}, false) as same_region from wanted w join pool p on p.kind = w.kind),
    told as (select w.request_id, any_value(w.national) as national, count(*) filter (where in_band and in_months and same_state) as n_state,
        case when any_value({_region("w.asked_state")}) is not null then count(*) filter (where in_band and in_months and same_region) end as n_region, count(*) filter (where in_band and in_months) as n_country,
        count(*) filter (where wider and in_months) as wider_band, count(*) filter (where in_band and longer) as longer_window from wanted w left join near n on n.request_id = w.request_id group by 1),
    scoped as (select *, case when n_state >= 10 then 'state' when n_region >= 10 then 'region' when national and n_country >= 10 then 'country' end as scope from told),
    mine as (select n.*, s.scope from near n join scoped s on s.request_id = n.request_id where in_band and in_months and (scope = 'country' or scope = 'state' and same_state or scope = 'region' and same_region))"""


@query(f"""with {_ANSWERS}, reached_of as (select request_id, count(*) filter (where ltv > 0 and ltv <= 2 and ltv >= target) as reached, count(*) filter (where ltv > 0 and ltv <= 2) as of_loans from mine where target is not null group by 1)
    select s.request_id, scope is not null as sufficient, scope, case scope when 'region' then n_region when 'country' then n_country else n_state end as found, n_state, n_region, n_country, wider_band, longer_window, reached, of_loans as "of"
    from scoped s left join reached_of r on r.request_id = s.request_id""")
def scenario_answers(c: Corpus) -> DataFrame:
    """Whether there are enough comparables for each scenario, and where."""
    return _answers(c)[0]


@query(f"with {_ANSWERS} " + " union all ".join(f"select request_id, '{k}' as metric, count(*) as base, {quart(k)} from mine where {k} > 0 and {k} < {m} group by 1" for k, m in LIMITS.items()))
def scenario_distributions(c: Corpus) -> DataFrame:
    """How the comparables of each scenario were lent on."""
    return _answers(c)[1].select("request_id", "metric", "base", *[F.round(p, 8).alias(p) for p in ("p25", "p50", "p75")])


_RAW = {
    "state": "case when loan_id % 7 = 0 then 'New York' when loan_id % 5 = 0 then ' tx ' else state end", "kind": "case when loan_id % 11 = 0 then 'Castle' else 'Office' end",
    "amount": "case loan_id % 6 when 0 then '-5' when 1 then 'much' when 2 then '1e7' else '28000000' end", "band": "case loan_id % 4 when 0 then '3.5' when 1 then '0.25' end",
    "months": "case loan_id % 3 when 0 then '1.5' when 1 then '240' end", "target_ltv": "case loan_id % 8 when 0 then '0' when 1 then '70' when 2 then '0.7' when 3 then '101' end", "national": "case when loan_id % 2 = 0 then '1' end",
}


@query(f"""with raw as (select loan_id, {", ".join(f"{v} as r_{k}" for k, v in _RAW.items())} from loans)
    select loan_id as request_id, concat_ws(',', case when not coalesce(regexp_full_match(upper(trim(r_state)), '[A-Z][A-Z]'), false) then 'invalid_state' end, case when r_kind = 'Castle' then 'invalid_type' end, case when loan_id % 6 < 2 then 'invalid_amount' end,
        case when loan_id % 4 = 0 then 'invalid_band' end, case when loan_id % 3 = 0 then 'invalid_months' end, case when loan_id % 8 in (0, 3) then 'invalid_ltv' end) as failures,
        case loan_id % 8 when 0 then 0.0e0 when 1 then 0.7e0 when 2 then 0.7e0 when 3 then 1.01e0 end as target_ltv from raw""")
def request_failures(c: Corpus) -> DataFrame:
    """What is wrong with requests that loans make of themselves."""
    raw = c.loans.selectExpr("loan_id as request_id", *[f"{v} as {k}" for k, v in _RAW.items()])
    return op.checked_requests(raw, KINDS).select("request_id", F.array_join("failures", ",").alias("failures"), "target_ltv")
