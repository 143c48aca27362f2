"""Pieces of oracle SQL: one left join per metric, as an independent way to the same rows."""

from __future__ import annotations

from ..functions.expr import CLASSES, SHELF_PATTERNS, STANDARD_CLASSES

GATE = "'^-?[0-9.]+$'"
GATE_NONNEG = "'^[0-9.]+$'"


def fact(alias: str, key: str, kind: str = "left join", gate: str = GATE, loan: str = "l.loan_id") -> str:
    return f" {kind} (select loan_id, try_cast(value as double) as v from facts where metric_key = '{key}' and regexp_matches(value, {gate})) {alias} on {alias}.loan_id = {loan} "


SENIOR_JOINS = fact("amt", "loan_amount") + fact("npp", "balance_pari_passu_non_trust") + fact("sen", "balance_senior_total")
SENIOR = "coalesce(sen.v, amt.v + coalesce(npp.v, 0))"
OBSERVED = "l.accession in (select deal_accession from servicer_reports where deal_accession is not null)"
EVENT = "(d.transfer_date is not null and d.transfer_date >= f.filed_at and (d.transfer_date - f.filed_at) <= 24 * 30.44)"


def med(x: str, p: float = 0.5) -> str:
    return f"round(percentile_cont({p}) within group (order by {x}), 8)"


def quart(x: str) -> str:
    return f"{med(x, 0.25)} as p25, {med(x, 0.5)} as p50, {med(x, 0.75)} as p75"


OUTCOMES = f"""outcomes as (
    select l.loan_id, l.accession, f.company_name, f.filed_at as originated_at, l.loan_ref, l.property_type, l.state, uw.v as noi_underwritten, mr.v as noi_trailing,
        p.annualized_noi as noi_actual, amt.v as loan_amount, {SENIOR} as loan_amount_senior, p.noi_start, p.noi_end, p.is_full_year, p.noi_start - f.filed_at as days_after_origination,
        uw.v / nullif(mr.v, 0) - 1 as gap_vs_trailing, uw.v / nullif(p.annualized_noi, 0) - 1 as gap_vs_actual, p.annualized_noi / nullif(mr.v, 0) - 1 as growth_delivered
    from performance p join loans l on l.loan_id = p.loan_id join filings f on f.accession = l.accession
    {fact("uw", "noi_underwritten")} {fact("mr", "noi_most_recent")} {SENIOR_JOINS})"""
POST = "days_after_origination >= 0 and is_full_year and gap_vs_actual is not null"


def canon_sql(column: str, otherwise: str = "Other", classes: tuple = CLASSES) -> str:
    return "case " + " ".join(f"when regexp_matches({column}, '(?i){p}') then '{n}'" for p, n in classes) + f" else '{otherwise}' end"


def standard_sql(column: str) -> str:
    return f"case when {column} is not null then {canon_sql(column, 'Otro', STANDARD_CLASSES)} end"


def shelf_sql(column: str, otherwise: str = "other") -> str:
    return "case " + " ".join(f"when {column} ilike '{p}' then '{n}'" for p, n in SHELF_PATTERNS) + f" else '{otherwise}' end"


def wilson_sql(k: str, n: str, side: int) -> str:
    sign = "+" if side > 0 else "-"
    p = f"({k} * 1.0e0 / {n})"
    return f"case when {n} = 0 then 0.0 else round(least(greatest(({p} + 3.8416e0 / (2 * {n}) {sign} 1.96e0 * sqrt({p} * (1 - {p}) / {n} + 3.8416e0 / (4.0e0 * {n} * {n}))) / (1 + 3.8416e0 / {n}), 0), 1), 6) end"


def stream_sql(seed: int, numbers: str) -> str:
    """CTEs for the fixed random stream: jump_lo and jump_hi (k, a, c: k steps, or k times 1024 steps, at once take s to a * s + c); numbers is a query for how many are needed."""
    return f"""jump_lo(k, a, c) as (
        select 0, cast(1 as hugeint), cast(0 as hugeint) union all select k + 1, a * 1664525 % 4294967296, (c * 1664525 + 1013904223) % 4294967296 from jump_lo where k < 1024),
    jump_hi(k, a, c) as (
        select 0, cast(1 as hugeint), cast(0 as hugeint) union all select h.k + 1, h.a * l.a % 4294967296, (h.c * l.a + l.c) % 4294967296 from jump_hi h, jump_lo l where l.k = 1024 and h.k <= ({numbers}) // 1024),
    jump as (select k, (a * {seed} + c) % 4294967296 as s from jump_hi)"""


#: The t-th number of the stream (from 0), for a relation that has t, joined with the jumps as j and l.
STREAM_JOIN = "join jump j on j.k = (t + 1) // 1024 join jump_lo l on l.k = (t + 1) % 1024"
STREAM_VALUE = "((l.a * j.s + l.c) % 4294967296) / cast(4294967296 as double)"
