"""Requests for comparable loans: checked, then answered all at once against every loan.

Loans and requests meet on class, a bin of the amount (a power of two) and a salt, so that a class that holds a third
of all loans is spread over many tasks; the exact conditions follow. Only counts leave the join for each request,
and the values of the metrics that are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The usual width of the amount and of the window, what is tried if they don't suffice, the least number of comparables.
BAND, MONTHS, WIDER, LONGER, LEAST = 0.5, 18, 1.0, 36, 10
MOST_BAND, MOST_MONTHS, MOST_LTV = 3.0, 240, 100.0
#: Parts that the loans of a class and bin are dealt into.
SALTS = 16
RAW = ("state", "kind", "amount", "band", "months", "target_ltv", "national")


def checked_requests(raw: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """raw: request_id and the texts RAW, null where not given -> the typed request with `failures`, codes of all that is wrong with it.

    A target of more than 2 is a percentage. Requests with failures keep their row; their typed columns are null where a text is no number.
    """
    number = lambda k: F.trim(k).try_cast("double")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    given = lambda k: F.col(k).isNotNull()
    state, kind = F.upper(F.trim(F.coalesce("state", F.lit("")))), F.trim(F.coalesce("kind", F.lit("")))
    amount, band, months, ltv = (number(k) for k in ("amount", "band", "months", "target_ltv"))
    wrong = {
        "invalid_state": ~state.rlike("^[A-Z]{2}$"),
        "invalid_type": ~kind.isin(*kinds),
        "invalid_amount": ~F.coalesce(finite(amount) & (amount > 0), F.lit(False)),
        "invalid_band": given("band") & ~F.coalesce(finite(band) & (band > 0) & (band <= MOST_BAND), F.lit(False)),
        "invalid_months": given("months") & ~F.coalesce(finite(months) & (months == F.floor(months)) & months.between(1, MOST_MONTHS), F.lit(False)),
        "invalid_ltv": given("target_ltv") & ~F.coalesce(finite(ltv) & (ltv > 0) & (ltv <= MOST_LTV), F.lit(False)),
    }
    failures = F.array_compact(F.array(*[F.when(cond, code) for code, cond in wrong.items()]))
    return raw.select(
        "request_id", state.alias("state"), kind.alias("kind"), amount.alias("amount"), F.coalesce(band, F.lit(BAND)).alias("band"), F.coalesce(months, F.lit(float(MONTHS))).cast("int").alias("months"),
        F.when(ltv > 2, ltv / 100).otherwise(ltv).alias("target_ltv"), F.coalesce(F.col("national").isin("1", "true"), F.lit(False)).alias("national"), failures.alias("failures"),
    )


def _bin(amount: Column) -> Column:
    return F.floor(F.log2(F.greatest(amount, F.lit(1.0)))).cast("int")


def _candidates(loans: DataFrame, requests: DataFrame) -> DataFrame:
    """Loans near each request in the widest sense, with what holds of each: in_band, in_months, wider, longer, since the newest filing of all loans."""
    newest = loans.agg(F.max("filed_at").alias("newest"))
    most = F.greatest("band", F.lit(WIDER))
    r = requests.where(F.size("failures") == 0).withColumn("bin", F.explode(F.sequence(_bin(F.col("amount") * (1 - most)), _bin(F.col("amount") * (1 + most)))))
    r = r.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed({"state": "asked_state", "amount": "asked"})
    rows = loans.where(F.col("loan_amount") > 0).withColumn("bin", _bin(F.col("loan_amount"))).withColumn("salt", F.pmod(F.hash("loan_id"), F.lit(SALTS)))
    both = rows.join(r, ["kind", "bin", "salt"]).crossJoin(F.broadcast(newest))
    within = lambda band: F.col("loan_amount").between(F.col("asked") * (1 - band), F.col("asked") * (1 + band))
    since = lambda months: F.col("filed_at") >= F.add_months("newest", -months)
    both = both.withColumns({"in_band": within(F.col("band")), "in_months": since(F.col("months")), "wider": within(F.lit(WIDER)), "longer": since(F.lit(LONGER))})
    return both.where((F.col("in_band") | F.col("wider")) & (F.col("in_months") | F.col("longer")))


def answers(loans: DataFrame, requests: DataFrame, divisions: dict[str, tuple[str, ...]], metrics: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """loans: loan_id, kind, state, loan_amount, filed_at and the metrics. Two tables:

    - a row for each valid request: sufficient, scope (state, region, country or null), found (in that scope, else in the state), n_state, n_region (null if
      the state has no region), n_country, wider_band and longer_window (in the country, if the request were relaxed), reached and of (loans at or above the
      target's LTV, among those with one; null without a target or a scope);
    - request_id, metric, base, p25, p50, p75 over the loans in scope, values between 0 and the metric's limit.
    """
    regions = F.create_map(*[F.lit(x) for name, states in divisions.items() for s in states for x in (s, name)])
    near = _candidates(loans, requests).withColumn("region", F.try_element_at(regions, F.col("asked_state")))
    same_state = F.coalesce(F.col("state") == F.col("asked_state"), F.lit(False))
    same_region = F.coalesce(F.try_element_at(regions, F.col("state")) == F.col("region"), F.lit(False))
    near = near.withColumns({"base": F.col("in_band") & F.col("in_months"), "same_state": same_state, "same_region": same_region})
    counts = near.groupBy("request_id").agg(
        F.count_if(F.col("base") & F.col("same_state")).alias("n_state"), F.count_if(F.col("base") & F.col("same_region")).alias("n_region"), F.count_if("base").alias("n_country"),
        F.count_if(F.col("wider") & F.col("in_months")).alias("wider_band"), F.count_if(F.col("in_band") & F.col("longer")).alias("longer_window"),
    )
    valid = requests.where(F.size("failures") == 0).withColumn("region", F.try_element_at(regions, F.col("state")))
    told = valid.join(counts, "request_id", "left").fillna(0, ["n_state", "n_region", "n_country", "wider_band", "longer_window"]).withColumn("n_region", F.when(F.col("region").isNotNull(), F.col("n_region")))
    scope = F.when(F.col("n_state") >= LEAST, "state").when(F.col("n_region") >= LEAST, "region").when(F.col("national") & (F.col("n_country") >= LEAST), "country")
    told = told.withColumn("scope", scope)
    in_scope = F.when(F.col("scope") == "state", F.col("same_state")).when(F.col("scope") == "region", F.col("same_region")).otherwise(F.lit(True))
    mine = near.where("base").join(told.where("scope is not null").select("request_id", "scope"), "request_id").where(in_scope)
    with_ltv = (F.col("ltv") > 0) & (F.col("ltv") <= 2)
    target = mine.where(F.col("target_ltv").isNotNull()).groupBy("request_id").agg(F.count_if(with_ltv & (F.col("ltv") >= F.col("target_ltv"))).alias("reached"), F.count_if(with_ltv).alias("of"))
    found = F.when(F.col("scope") == "region", F.col("n_region")).when(F.col("scope") == "country", F.col("n_country")).otherwise(F.col("n_state"))
    out = told.join(target, "request_id", "left").select("request_id", F.col("scope").isNotNull().alias("sufficient"), "scope", found.alias("found"), "n_state", "n_region", "n_country", "wider_band", "longer_window", "reached", "of")
    by = F.array(*[F.struct(F.lit(k).alias("metric"), F.when((F.col(k) > 0) & (F.col(k) < m), F.col(k)).alias("v")) for k, m in metrics.items()])
    values = mine.select("request_id", F.inline(by)).where(F.col("v").isNotNull())
    parts = values.groupBy("request_id", "metric").agg(F.count(F.lit(1)).alias("base"), *[F.percentile("v", p).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)])
    return out, parts
