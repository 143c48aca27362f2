"""Column expressions that the analyses share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.96
MONTH_DAYS, YEAR_DAYS = 30.44, 365.25
TOLERANCE = 0.01
EVENT_WINDOW_MONTHS = 24
CORE = ("loan_amount", "balance_pari_passu_non_trust", "balance_senior_total")


def num(value: Column | str) -> Column:
    """A metric's text as a number; null for any other text, also for what only looks like one (1.2.3)."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v.rlike(r"^-?[0-9.]+$"), v.try_cast("double"))


def num_nonneg(value: Column | str) -> Column:
    """The same, where the gate lets no sign pass."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v.rlike(r"^[0-9.]+$"), v.try_cast("double"))


def metrics_wide(facts: DataFrame, keys: tuple | list, gate: Callable = num) -> DataFrame:
    """One row per loan with a column per metric: a single grouped pass in place of a join per metric."""
    picked = facts.where(F.col("metric_key").isin(*keys))
    return picked.groupBy("loan_id").agg(*[F.max(F.when(F.col("metric_key") == k, gate("value"))).alias(k) for k in keys])


def loans_wide(c, keys: tuple | list, gate: Callable = num) -> DataFrame:
    return c.loans.join(metrics_wide(c.facts_of(*keys), keys, gate), "loan_id", "left")


def with_filing(c, df: DataFrame) -> DataFrame:
    """Adds company_name, filed_at, vintage."""
    return df.join(c.filings.select("accession", "company_name", "filed_at", F.year("filed_at").alias("vintage")), "accession")


def observed(c, df: DataFrame) -> DataFrame:
    """Loans of deals that have a servicer report."""
    return df.join(c.servicer_reports.select(F.col("deal_accession").alias("accession")).distinct(), "accession", "left_semi")


def senior() -> Column:
    """What is owed in the senior tranche: the published total, else this trust's part and the others' parts."""
    return F.coalesce(F.col("balance_senior_total"), F.col("loan_amount") + F.coalesce(F.col("balance_pari_passu_non_trust"), F.lit(0.0)))


def senior_parts_only() -> Column:
    """The shorter form, which ignores a published total. It gives other answers and is kept apart on purpose."""
    return F.col("loan_amount") + F.coalesce(F.col("balance_pari_passu_non_trust"), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def r6(x: Column) -> Column:
    return F.round(x, 6)


def pct(x: Column, p: float = 0.5) -> Column:
    """Interpolated percentile; quarters of six decimals need eight."""
    return F.round(F.percentile(x, p), 8)


def quartiles(x: Column) -> list[Column]:
    return [pct(x, p).alias(name) for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def share_if(cond: Column) -> Column:
    return r6(count_if(cond) / F.nullif(F.count(F.lit(1)), F.lit(0)))


#: Property classes, first match wins: fixed values.
CLASSES = (
    ("multifamily|cooperative|garden|low rise|mid rise|student", "Multifamily"),
    ("retail|anchored|single tenant", "Retail"),
    ("office|cbd|suburban|medical", "Office"),
    ("industrial|warehouse|flex", "Industrial"),
    ("storage", "Self Storage"),
    ("hospitality|hotel|service|extended stay", "Hospitality"),
    ("mixed", "Mixed Use"),
    ("manufactured", "Manufactured"),
)
#: The classes of the standardised analyses: other patterns in another order, and other names; fixed values.
STANDARD_CLASSES = (
    ("multifamily|cooperative|garden|low rise|mid rise|high rise|student|military", "Multifamily"),
    ("manufactured", "Manufactured Housing"),
    ("retail|anchored|single tenant|shadow", "Retail"),
    ("office|cbd|suburban|medical", "Office"),
    ("industrial|warehouse|flex|distribution", "Industrial"),
    ("self storage|storage", "Self Storage"),
    ("hospitality|hotel|full service|limited service|extended stay", "Hospitality"),
    ("mixed", "Mixed Use"),
)
#: Issuer families by the start of a name: fixed values.
SHELF_PATTERNS = (("BANK5%", "BANK5"), ("BANK %", "BANK"), ("BENCHMARK%", "Benchmark"), ("BBCMS%", "BBCMS"), ("BMO%", "BMO"), ("WELLS%", "Wells"), ("MORGAN%", "MS"), ("MSWF%", "MS"), ("GS %", "GS"))


def canon_type(column: str = "property_type", otherwise: str = "Other", classes: tuple = CLASSES) -> Column:
    out = None
    for pattern, name in classes:
        cond = F.col(column).rlike(f"(?i){pattern}")
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(otherwise)


def standard_type(column: str = "property_type") -> Column:
    """Class of the standardised analyses; no type stays without a class."""
    return F.when(F.col(column).isNotNull(), canon_type(column, "Otro", STANDARD_CLASSES))


def shelf(column: str = "company_name", otherwise: str = "other") -> Column:
    out = None
    for pattern, name in SHELF_PATTERNS:
        cond = F.col(column).ilike(pattern)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(otherwise)


def wilson(k: Column, n: Column, side: int) -> Column:
    """Lower (side -1) or upper (side 1) end of the 95 % interval of a share, within 0 and 1; 0 for no trial."""
    p = k / F.nullif(n, F.lit(0))
    centre = p + Z * Z / (2 * n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    x = (centre + side * half) / (1 + Z * Z / n)
    return r6(F.coalesce(F.least(F.greatest(F.when(n > 0, x), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))


def byar(observed_: Column, expected: Column, side: int) -> Column:
    """Lower or upper end of Byar's interval of observed / expected."""
    o = observed_.cast("double") if side < 0 else observed_ + F.lit(1.0)
    x = o * F.pow(1 - 1 / (9 * o) + side * Z / (3 * F.sqrt(o)), F.lit(3)) / expected
    none = (expected <= 0) | ((observed_ <= 0) if side < 0 else F.lit(False))
    return r6(F.when(none, 0.0).otherwise(x))


def within_window(months: int = EVENT_WINDOW_MONTHS) -> Column:
    """An event after closing and inside the window."""
    days = F.datediff("transfer_date", "filed_at")
    return F.coalesce((days >= 0) & (days <= months * MONTH_DAYS), F.lit(False))
