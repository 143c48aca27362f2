"""Cells of disclosure tables as typed values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that stand for no value, whole cell, any case: fixed values.
NULL_TOKENS = ("n/a", "na", "nap", "nav", "none", "null", "various", "...")
SERVICER_NULL_TOKENS = ("n/a", "nap", "nav", "not available", "not applicable")
#: Codes and names of the states: fixed values.
STATE_NAMES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE", "DISTRICT OF COLUMBIA": "DC", "FLORIDA": "FL",
    "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD",
    "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ",
    "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI",
    "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY",
    "PUERTO RICO": "PR", "GUAM": "GU", "VIRGIN ISLANDS": "VI",
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_state(x: Column | str) -> Column:
    """Two-letter code of a state's code or name, null for anything else."""
    t = F.upper(F.trim(F.regexp_replace(_c(x), r"[.\s]+", " ")))
    names = F.create_map(*[F.lit(v) for pair in STATE_NAMES.items() for v in pair])
    return F.when(t.isin(*STATE_NAMES.values()), t).otherwise(F.try_element_at(names, t))


def is_null_token(x: Column | str, tokens: tuple = NULL_TOKENS) -> Column:
    t = F.lower(F.trim(_c(x)))
    return t.isNull() | (t == "") | t.isin(*tokens) | t.rlike("^[-–—]+$")


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def parse_value(x: Column | str, unit: Column | str) -> Column:
    """Text of a cell in its unit's form: number as text without trailing zeros, or the trimmed text; null if it has none.

    unit: currency, percent, ratio, count, years or text. Percentages come out as fractions.
    """
    raw, u = F.trim(_c(x)), _c(unit)
    # Most cells are plain numbers: patterns are tried only where a letter that they need is there.
    negative = raw.startswith("(") & raw.rlike(r"^\(.*\)$")
    bare = F.translate(raw, "$,%()", "")
    bare = F.when(F.lower(bare).contains("x"), F.regexp_replace(bare, r"\s*[xX]$", "")).otherwise(bare)
    value = F.when(raw.rlike(r"[0-9]\s+[0-9]"), None).otherwise(F.trim(bare).try_cast("double"))
    value = F.when(negative, -value).otherwise(value)
    share = half_up(F.when(raw.contains("%") | (value > 1.5), value / 100).otherwise(value), 6)
    year = half_up(value)
    number = F.when(u == "percent", share).when(u == "ratio", half_up(value, 4)).when(u == "count", half_up(value)).when(u == "years", F.when(year.between(1700, 2100), year)).otherwise(value)
    plain = F.rtrim(F.rtrim(number.cast("decimal(30,6)").cast("string"), F.lit("0")), F.lit("."))
    return F.when(is_null_token(x), None).when(u == "text", raw).otherwise(plain)


def numeric_cell(x: Column | str) -> Column:
    """A printed number as it stands, without scaling of percentages; null for longer or other text."""
    raw = F.trim(_c(x))
    bare = F.regexp_replace(raw, r"[$,%\s]", "")
    negative = bare.rlike(r"^\(.*\)$")
    inner = F.regexp_replace(bare, r"[()]", "")
    value = F.when((F.length(raw) <= 32) & inner.rlike(r"^-?[0-9]*\.?[0-9]+$"), inner.try_cast("double"))
    return F.when(negative, -value).otherwise(value)


def parse_money(x: Column | str) -> Column:
    raw = F.trim(_c(x))
    bare = F.regexp_replace(raw, r"[$,()\s]", "")
    value = F.when(bare.rlike(r"^-?[0-9]*\.?[0-9]+$"), bare.try_cast("double"))
    return F.when(is_null_token(x, SERVICER_NULL_TOKENS), None).when(raw.rlike(r"^\(.*\)$"), -value).otherwise(value)


def parse_short_date(x: Column | str) -> Column:
    """m/d/yy or m/d/yyyy; two-digit years from 70 on are of the last century; dates that don't exist are null."""
    t = F.trim(_c(x))
    part = lambda i: F.regexp_extract(t, r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", i)
    year = part(3).try_cast("int")
    full = F.when(F.length(part(3)) == 2, F.when(year >= 70, 1900 + year).otherwise(2000 + year)).otherwise(year)
    return F.try_to_date(F.concat_ws("-", F.lpad(full.cast("string"), 4, "0"), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0")), "yyyy-MM-dd")


def days_inclusive(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def loan_prefix(x: Column | str) -> Column:
    """Leading digits of a tranche or loan id, without leading zeros; null if it has none."""
    d = F.regexp_extract(F.trim(_c(x)), r"^0*([0-9]+)", 1)
    return F.when(d != "", d)


def is_aggregate_label(x: Column | str) -> Column:
    """Rows of totals, by the start of a text cell."""
    return F.coalesce(F.lower(F.trim(_c(x))).rlike(r"^(grand\s+)?(sub-?)?(total|totals|average|avg|weighted|min|max|minimum|maximum|median)\b"), F.lit(False))


def confidence(score: Column) -> Column:
    return half_up(F.greatest(0.95 - (1 - score) * 0.3, F.lit(0.5)), 3)


def slug(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
