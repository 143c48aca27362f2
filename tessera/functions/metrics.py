"""The metrics that a disclosure's columns may stand for: key, label, unit, owner, header patterns and exclusions.

A header gets a score from the first of a metric's patterns that it fits; an excluded header gets none. Families
(statement lines by period, measures by level of debt, reserves by way of payment) are made by rules; the rest is
stated one by one. The order of METRICS breaks ties.
"""

from __future__ import annotations

from typing import NamedTuple


class Metric(NamedTuple):
    key: str
    label: str
    unit: str
    owner: str
    patterns: tuple[str, ...]
    exclude: tuple[str, ...] = ()


def _property(key: str, label: str, unit: str, *patterns: str, exclude: tuple[str, ...] = ()) -> Metric:
    return Metric(key, label, unit, "property", patterns, exclude)


def _deal(key: str, label: str, unit: str, *patterns: str, exclude: tuple[str, ...] = ()) -> Metric:
    return Metric(key, label, unit, "deal", patterns, exclude)


# Headers beside the one that is meant.
BESIDE_NOI = (r"dscr", r"debt\s*yield", r"\bdate\b", r"description", r"reserve", r"ff\s*&?\s*e", r"\bti\s*/\s*lc\b", r"cash\s*flow", r"\begi\b", r"expenses?", r"occupancy")
TOTAL_DEBT = r"total\s*(mortgage|secured|combined)?\s*debt(?!\s*service)"
EARLIER = r"\b(second|third|fourth)\s*most\s*recent\b"
SHARE = r"%|percent"


def _earlier(key: str, name: str, word: str, full: str | None, exclude: tuple[str, ...] = ()) -> tuple[Metric, ...]:
    """The third and the second most recent value of a line of the statement."""
    out = []
    for rank in ("third", "second"):
        start = rf"\b{rank}\s*most\s*recent"
        patterns = (rf"{start}\b.*{word}",) + (() if full is None else (rf"{start}\s*{full}",))
        out.append(Metric(f"{key}_{rank}_most_recent", f"{rank.title()} Most Recent {name}", "currency", "property", patterns, exclude))
    return tuple(out)


def _recent(key: str, name: str, word: str, full: str | None) -> Metric:
    patterns = (rf"\bmost\s*recent\b.*{word}",) + (() if full is None else (rf"\bmost\s*recent\s*{full}",))
    return Metric(f"{key}_most_recent", f"Most Recent {name}", "currency", "property", patterns, (EARLIER,))


def _levels(key: str, name: str, unit: str, word: str, both_ways: bool = True, exclude: tuple[str, ...] = ()) -> tuple[Metric, ...]:
    """A measure of the whole loan, and one of all debt; for the latter the measure may have to stand last."""
    debt = r"total\s*(mortgage\s*)?debt"
    whole = (rf"whole\s*loan\b.*{word}", rf"{word}.*whole\s*loan")
    total = (rf"{debt}\b.*{word}",) + ((rf"{word}.*{debt}",) if both_ways else ())
    return _deal(f"{key}_whole_loan", f"Whole Loan {name}", unit, *whole, exclude=exclude), _deal(f"{key}_total_debt", f"Total Debt {name}", unit, *total, exclude=exclude)


def _reserve(key: str, name: str, phrase: str, exclude: tuple[str, ...] = (), upfront: tuple[str, ...] = (), monthly: tuple[str, ...] = ()) -> tuple[Metric, ...]:
    """A reserve paid at closing and one paid monthly; further patterns follow the phrase."""
    first = _deal(f"reserve_{key}_upfront", f"Upfront {name}", "currency", rf"upfront\s*{phrase}", *upfront, exclude=exclude)
    return first, _deal(f"reserve_{key}_monthly", f"Monthly {name}", "currency", rf"monthly\s*{phrase}", *monthly, exclude=exclude)


CAP = r"\bcaps?\b"
TILC = r"ti\s*/?\s*lc"

# What headers are called.
METRICS: tuple[Metric, ...] = (
    *_earlier("noi", "NOI", r"\bnoi\b", r"net\s*operating", exclude=BESIDE_NOI),
    _property("noi_most_recent", "Most Recent NOI", "currency", r"\b(most\s*recent|t-?12|ttm|trailing)\b.*\bnoi\b", r"\bnoi\b.*\b(most\s*recent|t-?12|ttm|trailing)\b", r"\b(most\s*recent|trailing)\s*net\s*operating\s*income", exclude=(*BESIDE_NOI, EARLIER)),
    _property("noi_underwritten", "Underwritten NOI", "currency", r"\b(uw|u/w|underwrit\w*)\b.*\bnoi\b", r"\bnoi\b.*\b(uw|u/w|underwrit\w*)\b", r"\bunderwritten\s*net\s*operating\s*income", r"^\s*noi\b", r"\bnet\s*operating\s*income", exclude=(r"most\s*recent", r"t-?12", r"ttm", r"trailing", r"ncf", *BESIDE_NOI)),
    *_earlier("egi", "EGI", r"\begi\b", r"effective\s*gross"),
    _recent("egi", "EGI", r"\begi\b", r"effective\s*gross"),
    _property("egi_underwritten", "Underwritten EGI", "currency", r"\bunderwritten\b.*\begi\b", r"\bu/?w\b.*\begi\b", r"\bunderwritten\s*effective\s*gross", r"\begi\b", r"effective\s*gross\s*income", exclude=(r"most\s*recent",)),
    *_earlier("expenses", "Expenses", r"expenses?", None),
    _recent("expenses", "Expenses", r"expenses?", None),
    _property("expenses_underwritten", "Underwritten Expenses", "currency", r"\bunderwritten\b.*expenses?", r"\bu/?w\b.*expenses?", r"operating\s*expenses?", r"\bopex\b", r"total\s*expenses?", r"^\s*expenses?\b", r"\bexpenses?\s*\(\$\)", exclude=(r"most\s*recent",)),
    _property("occupancy_economic", "Economic Occupancy", "percent", r"economic\s*occupancy", r"\beconomic\s*occ\b", exclude=(r"\bdate\b",)),
    _property("occupancy", "Occupancy", "percent", r"leased\s*occ", r"physical\s*occ", r"%\s*occupied", r"\boccupied\b.*%", r"\boccupancy\b", exclude=(r"economic", r"\bdate\b", r"\barea\b", r"rentable", r"\bsf\b", r"square", r"(second|third|fourth|fifth)\s+most\s+recent")),
    _property("unit_of_measure", "Unit of Measure", "text", r"unit\s*of\s*measure", r"^\s*measure\b"),
    _property("units", "Units", "count", r"\bnumber\s*of\s*units\b", r"#\s*of\s*units", r"units?\s*/\s*(rooms|pads|beds|keys)", r"^\s*units?\b", r"\b(rooms|keys|pads)\b", exclude=(r"per\s*unit", r"/\s*unit", r"price", r"of\s*measure")),
    _property("square_feet", "Square Feet", "count", r"\bnet\s*rentable\s*area\b", r"\bsquare\s*feet\b", r"\bsq\.?\s*ft\.?\b", r"\bnra\b", r"\bgla\b", r"\bsf\b", exclude=(r"per\s*s(q|f)", r"/\s*s(q|f)", r"price", r"\brent\s+roll\b", r"%", r"percent", r"\bshare\b", r"largest\s*tenant", r"\btenant\s*\d")),
    _property("year_built", "Year Built", "years", r"year\s*built", r"^\s*built\b", r"\byoc\b"),
    _property("year_renovated", "Year Renovated", "years", r"year\s*renovated", r"^\s*renovated\b"),
    _deal(
        "loan_amount", "Loan Amount", "currency", r"cut-?off\s*date\s*(principal\s*)?balance", r"^\s*current\s*balance\b", r"original\s*(principal\s*)?balance", r"\bloan\s*amount\b", r"\boriginal\s*loan\b",
        exclude=(r"per\s*(unit|sf|room|key)", r"/\s*(unit|sf)", r"whole\s*loan", r"pari\s*passu", r"companion", r"subordinate", r"mezzanine", TOTAL_DEBT, r"maturity|ard", SHARE, r"ground\s*lease", r"pool", r"additional\s*debt", r"senior\s*notes?"),
    ),
    _property("appraised_value", "Appraised Value", "currency", r"appraised\s*value", r"appraisal\s*value", r"^\s*value\b", exclude=(r"date", r"\bper\b", r"\btype\b")),
    *_levels("ltv", "LTV", "percent", r"\bltv\b", exclude=(r"maturity", r"\bard\b")),
    _deal("ltv_maturity", "LTV at Maturity", "percent", r"\bltv\b.*\b(maturity|ard|balloon)\b", r"\b(maturity|balloon)\b.*\bltv\b"),
    _deal("ltv", "LTV", "percent", r"cut-?off\s*date\s*ltv", r"\bltv\b", r"loan[-\s]*to[-\s]*value", exclude=(r"maturity", r"balloon", r"\bard\b", r"whole\s*loan", TOTAL_DEBT, r"\bcoop\b")),
    *_levels("dscr", "DSCR", "ratio", r"\bdscr\b"),
    _deal("dscr_ncf", "NCF DSCR", "ratio", r"\bncf\s*dscr\b", r"dscr.*\bncf\b", exclude=(r"whole\s*loan", TOTAL_DEBT)),
    _deal("dscr", "DSCR", "ratio", r"\bnoi\s*dscr\b", r"\bdscr\b", r"debt\s*service\s*coverage", exclude=(r"\bncf\b", r"whole\s*loan", TOTAL_DEBT)),
    *_levels("debt_yield", "Debt Yield", "percent", r"debt\s*yield", both_ways=False),
    _deal("debt_yield_ncf", "NCF Debt Yield", "percent", r"\bncf\s*debt\s*yield", r"debt\s*yield.*\bncf\b", exclude=(r"whole\s*loan", TOTAL_DEBT)),
    _deal("debt_yield", "Debt Yield", "percent", r"\bnoi\s*debt\s*yield", r"debt\s*yield", exclude=(r"\bncf\b", r"whole\s*loan", TOTAL_DEBT, r"most\s*recent", r"\btrailing\b", r"\bt-?12\b", r"\bhistorical\b")),
    _property("net_cash_flow", "Net Cash Flow", "currency", r"\bnet\s*cash\s*flow\b", exclude=(r"dscr", r"debt\s*yield")),
    _property("property_type_detailed", "Detailed Property Type", "text", r"detailed\s*property\s*type", r"property\s*sub-?type"),
    _property("coop_units", "Co-op Units", "count", r"\bcoop\b.*\bcoop\s*units\b", r"^\s*co-?op\s*units\b"),
    _property("coop_sponsor_units", "Co-op Sponsor Units", "count", r"\bcoop\b.*sponsor\s*units", r"co-?op.*sponsor\s*units"),
    _property("coop_rental_value", "Co-op Rental Value", "currency", r"\bcoop\b.*rental\s*value", r"co-?op.*rental\s*value"),
    _deal("coop_ltv_as_rental", "Co-op LTV as Rental", "percent", r"\bcoop\b.*ltv.*rental", r"ltv\s*as\s*rental"),
    _deal("loan_property_flag", "Loan / Property Flag", "text", r"loan\s*/\s*property\s*flag", r"loan\s*or\s*property", r"^\s*loan\s*/\s*prop\.?\s*$", r"^\s*loan\s*$", r"^\s*property\s*flag\s*$", exclude=(r"\bname\b", r"\btype\b", r"\bcount\b", r"#")),
    _deal(
        "loan_id", "Loan ID", "text", r"^\s*loan\s*id\b", r"loan\s*id\s*number", r"mortgage\s*loan\s*number", r"control\s*number", r"^\s*loan\s*#", r"^\s*loan\s*no\.?\s*$", r"^\s*id\s*$",
        exclude=(r"seller", r"rate", r"cross", r"flag", r"\bper\b", r"companion", r"debt\s*service", r"balance", r"amount", SHARE, r"group", r"purpose", r"term", r"type"),
    ),
    _deal("interest_rate_mezzanine", "Mezzanine Interest Rate", "percent", r"mezzanine\b.*(interest\s*)?rate", r"\bmezz\b.*rate"),
    _deal("interest_rate_subordinate", "Subordinate Interest Rate", "percent", r"subordinate\b.*(interest\s*)?rate", r"companion\s*loan\b.*rate", r"\bb-?note\b.*rate"),
    _deal("interest_rate", "Interest Rate", "percent", r"interest\s*rate", r"\bcoupon\b", r"mortgage\s*rate", exclude=(r"type", r"accrual", r"mezzanine", r"\bmezz\b", r"subordinate", r"companion", r"\bb-?note\b")),
    _property("cap_rate", "Cap Rate", "percent", r"\bcap\s*rate\b", r"capitalization\s*rate"),
    _property("property_type", "Property Type", "text", r"general\s*property\s*type", r"property\s*type", r"^\s*type\b", r"asset\s*type", exclude=(r"loan", r"rate", r"sub", r"detailed")),
    _property("loan_seller", "Mortgage Loan Seller", "text", r"mortgage\s*loan\s*seller", r"^\s*loan\s*seller\b", r"\boriginator\b", r"originating\s*(lender|bank)", r"\bseller\b", exclude=(r"count", r"number\s*of", r"#", r"\bpct\b", r"percent", r"%", r"balance", r"amount")),
    _property("property_name", "Property Name", "text", r"property\s*name", r"^\s*property\b", r"loan\s*name", exclude=(r"type", r"address", r"city", r"state")),
    _property("address", "Address", "text", r"\baddress\b", r"^\s*street\b"),
    _property("city", "City", "text", r"^\s*city\b"),
    _property("state", "State", "text", r"^\s*state\b"),
    _property("zip", "Zip", "text", r"\bzip\b", r"postal\s*code"),
    *_reserve("tax", "RE Tax Reserve", r"(re\s*)?tax\s*reserve", upfront=(r"\btax\s*reserve\b.*upfront",)),
    *_reserve("insurance", "Insurance Reserve", r"insurance\s*reserve"),
    _deal("reserve_replacement_cap", "Replacement Reserve Cap", "currency", r"replacement\s*reserve\s*caps?", r"(replacement|ff\s*&?\s*e).*\bcaps?\b", exclude=(r"\bti\s*/?\s*lc\b",)),
    *_reserve("replacement", "Replacement Reserve", r"replacement", (CAP,), upfront=(r"upfront.*\bpip\b",), monthly=(r"monthly.*ff\s*&?\s*e\s*reserve",)),
    _deal("reserve_tilc_cap", "TI/LC Reserve Cap", "currency", rf"\b{TILC}\b.*\bcaps?\b"),
    *_reserve("tilc", "TI/LC Reserve", TILC, (CAP, r"underwritten")),
    _deal("reserve_debt_service_cap", "Debt Service Reserve Cap", "currency", r"debt\s*service\s*reserve\s*caps?"),
    *_reserve("debt_service", "Debt Service Reserve", r"debt\s*service\s*reserve", (CAP,)),
    _deal("reserve_deferred_maintenance", "Upfront Deferred Maintenance Reserve", "currency", r"deferred\s*maintenance"),
    _deal("reserve_other_description", "Other Reserve Description", "text", r"other\s*reserve\s*description"),
    _deal("reserve_other_cap", "Other Reserve Cap", "currency", r"other\s*reserve\s*caps?"),
    *_reserve("other", "Other Reserve", r"other\s*reserve", (CAP, r"description")),
    _property("underwritten_replacement_reserve", "Underwritten Replacement / FF&E Reserve", "currency", r"underwritten\s*replacement", r"underwritten.*ff\s*&?\s*e\s*reserve"),
    _property("underwritten_tilc", "Underwritten TI / LC", "currency", rf"underwritten\s*{TILC}"),
    _deal("debt_service_pi", "Annual Debt Service (P&I)", "currency", r"annual\s*debt\s*service\s*\(?\s*p\s*&?\s*i", r"debt\s*service\s*\(?\s*p\s*&?\s*i", exclude=(r"reserve", r"coverage", r"\bdscr\b")),
    _deal("debt_service_io", "Annual Debt Service (IO)", "currency", r"annual\s*debt\s*service\s*\(?\s*io\b", r"debt\s*service\s*\(?\s*io\b", exclude=(r"reserve", r"coverage", r"\bdscr\b")),
    _deal("amortization_type", "Amortization Type", "text", r"amorti[sz]ation\s*type"),
    _deal("interest_accrual_method", "Interest Accrual Method", "text", r"interest\s*accrual\s*method", r"accrual\s*(method|basis)"),
    _deal("ard_loan", "ARD Loan", "text", r"\bard\s*loan\b"),
    _deal("io_period_original", "Original Interest-Only Period", "count", r"original\s*interest[-\s]*only\s*period", r"original\s*\bio\b\s*period"),
    _deal("io_period_remaining", "Remaining Interest-Only Period", "count", r"remaining\s*interest[-\s]*only\s*period", r"remaining\s*\bio\b\s*period"),
    _deal("amortization_term_original", "Original Amortization Term", "count", r"original\s*amorti[sz]ation\s*term"),
    _deal("amortization_term_remaining", "Remaining Amortization Term", "count", r"remaining\s*amorti[sz]ation\s*term"),
    _deal("term_original", "Original Term To Maturity / ARD", "count", r"original\s*term\s*to\s*maturity", exclude=(r"amorti", r"interest[-\s]*only")),
    _deal("term_remaining", "Remaining Term To Maturity / ARD", "count", r"remaining\s*term\s*to\s*maturity", exclude=(r"amorti", r"interest[-\s]*only")),
    _deal("origination_date", "Origination Date", "text", r"origination\s*date"),
    _deal("first_payment_date", "First Payment Date", "text", r"first\s*payment\s*date"),
    _deal("seasoning_months", "Seasoning", "count", r"\bseasoning\b"),
    _deal("property_count", "# of Properties", "count", r"#\s*of\s*properties", r"number\s*of\s*properties"),
    _deal("holdback_amount", "Holdback / Earnout Amount", "currency", r"holdback\s*/?\s*earnout\s*amount", r"\bearnout\s*amount", exclude=(r"description",)),
    _deal("holdback_description", "Holdback / Earnout Description", "text", r"holdback\s*/?\s*earnout\s*description", r"\bearnout\s*description"),
    _deal("lockbox_type", "Lockbox Type", "text", r"\blockbox\b"),
    _deal("cash_management", "Cash Management", "text", r"cash\s*management"),
    _deal("balance_whole_loan", "Whole Loan Cut-off Date Balance", "currency", r"whole\s*loan\s*cut-?off\s*date\s*balance", r"whole\s*loan\s*balance", exclude=(SHARE, r"ltv", r"dscr", r"debt\s*yield")),
    _deal(
        "balance_senior_total", "Total Senior Notes Cut-off Date Balance", "currency", r"total\s*cut-?off\s*date\s*pari\s*passu\s*debt", r"total\s*current\s*balance\s*pari\s*passu\s*debt", r"total\s*pari\s*passu\s*debt\s*(cut-?off|current)",
        r"total\s*senior\s*notes?\s*cut-?off\s*date\s*balance", r"senior\s*notes?\s*cut-?off\s*date\s*balance", r"total\s*original\s*balance\s*pari\s*passu\s*debt",
        exclude=(SHARE, r"\bltv\b", r"dscr", r"debt\s*yield", r"per\s*(unit|sf)", r"\(y\s*/\s*n\)", r"monthly|annual"),
    ),
    _deal("balance_pari_passu_trust", "Trust Pari Passu Cut-off Date Balance", "currency", r"\btrust\s*pari\s*passu\b.*balance", exclude=(r"non-?\s*trust", SHARE)),
    _deal(
        "balance_pari_passu_non_trust", "Non-Trust Pari Passu Companion Loan Cut-off Date Balance", "currency", r"non-?\s*trust\s*pari\s*passu.*cut-?off\s*date.*balance", r"cut-?off\s*date\s*pari\s*passu(?!.*\btrust\b).*balance",
        r"pari\s*passu\s*companion\s*loan\s*cut-?off.*balance", r"non-?\s*trust\s*pari\s*passu.*balance", r"pari\s*passu\s*companion\s*loan.*balance", r"pari\s*passu\s*piece\s*non-?\s*trust.*balance", r"balance\s*piece\s*non-?\s*trust",
        exclude=(SHARE, r"\(y\s*/\s*n\)", r"control", r"debt\s*service", r"monthly|annual", r"per\s*(unit|sf)"),
    ),
    _deal("balance_subordinate", "Subordinate Companion Loan Cut-off Date Balance", "currency", r"subordinate\s*companion.*balance", r"\bb-?note\b.*balance", exclude=(SHARE,)),
    _deal("balance_mezzanine", "Mezzanine Debt Cut-off Date Balance", "currency", r"mezzanine\s*debt.*balance", r"\bmezz\b.*balance", exclude=(SHARE, r"rate")),
    _deal("balance_total_debt", "Total Debt Cut-off Date Balance", "currency", r"total\s*(mortgage\s*)?debt\s*cut-?off\s*date\s*balance", r"total\s*(mortgage\s*)?debt\s*balance", exclude=(SHARE, r"ltv", r"dscr", r"debt\s*yield", r"\bper\b")),
    _deal("balance_maturity", "Maturity / ARD Balance", "currency", r"maturity\s*/?\s*ard\s*balance", r"balloon\s*balance", exclude=(SHARE, r"ltv")),
    _deal("balance_original", "Original Balance", "currency", r"original\s*balance\s*at\s*securiti[sz]ation", r"balance\s*at\s*origination", r"original\s*(principal\s*)?balance", exclude=(r"whole\s*loan", r"pari\s*passu", r"companion", r"subordinate", r"mezzanine", SHARE, r"cut-?off")),
    _deal("pool_share", "% of Initial Pool Balance", "percent", r"%\s*of\s*initial\s*pool\s*balance", r"%\s*of\s*pool"),
)

BY_KEY = {m.key: m for m in METRICS}
