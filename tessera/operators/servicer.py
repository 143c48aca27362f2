"""Monthly servicer reports: where their tables are, what their rows say, who the parties are.

A report is a set of cells (doc_id, table_idx, row_idx, col_idx, text). A table is recognised by an anchor cell; its
header is spread over the anchor's row and the two above it, which are merged column by column. Only rows with an
anchor are looked at for that, so the joins have a table's row in their key and no table meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import days_inclusive, loan_prefix, parse_money, parse_short_date
from ..sources.stage import staged
from .promotion import annualise

TABLE = ["doc_id", "table_idx"]
HEADER_DEPTH = 3
SAMPLES = 3
LEAST_DAYS = 80
FULL_YEAR_DAYS = 300
GOOD_YIELD = 0.5

# The layouts of the two template families, roles and canonical names.
PROS_ID = r"(?i)^pros\s*id$"
#: kind, family, anchor, columns (name, pattern, pattern that excludes), columns that must be there, pattern that must not be. First match wins.
LAYOUTS = (
    (
        "noi", "computershare", PROS_ID,
        (("fiscal", r"(?i)most\s*recent\s*fiscal\s*noi", None), ("recent", r"(?i)most\s*recent\s*noi", r"(?i)fiscal|date"), ("start", r"(?i)noi\s*start", None), ("end", r"(?i)noi\s*end", None)),
        ("recent", "start", "end"), None,
    ),
    (
        "noi", "citigroup", r"(?i)^omcr$",
        (
            ("fiscal", r"(?i)preceding\s*fiscal\s*year\s*noi", None), ("recent", r"(?i)most\s*recent\s*noi", r"(?i)fiscal|preceding|date"),
            ("start", r"(?i)most\s*recent\s*financial\s*as\s*of\s*start\s*date", None), ("end", r"(?i)most\s*recent\s*financial\s*as\s*of\s*end\s*date", None),
        ),
        ("recent", "start", "end"), None,
    ),
    (
        "delinquency", None, PROS_ID,
        (
            ("paid_through", r"(?i)paid\s*through\s*date", None), ("months", r"(?i)months\s*delinquent", None), ("status", r"(?i)mortgage\s*loan\s*status", None),
            ("transfer", r"(?i)servicing\s*transfer\s*date", None), ("foreclosure", r"(?i)foreclosure\s*date", None), ("reo", r"(?i)^reo\s*date$", None),
        ),
        ("months", "paid_through"), None,
    ),
    (
        "special", None, PROS_ID,
        (("transfer", r"(?i)servicing\s*transfer\s*date", None), ("resolution", r"(?i)resolution\s*strategy", None), ("type", r"(?i)property\s*type", None), ("state", r"(?i)^state$", None)),
        ("transfer",), r"(?i)months\s*delinquent",
    ),
)
FOOTER_LABEL = r"(?i)^totals?$"
FOOTER_TEXT = r"(?i)computershare|all rights reserved|page [0-9]+ of [0-9]+"
#: An identifier with two letters in a row is prose.
PROSE = r"(?i)[a-z]{2,}"
ROLES = (("master servicer", r"(?i)^master\s*servicer\b"), ("special servicer", r"(?i)^special\s*servicer\b"), ("certificate administrator", r"(?i)^certificate\s*administrator\b"), ("trustee", r"(?i)^trustee\b"))
ACCOUNTING = r"(?i)\b(fee|advance|reimburs|expense)"
CONTACT = r"@|https?:|^\(?\d{3}\)?[\s.-]?\d{3}"
CORPORATE = r"(?i)\b(LLC|L\.L\.C|N\.A\.?|National Association|Bank|Banc|Inc\.?|Incorporated|Company|Corp\.?|Corporation|Services|Servicing|Trust Co|LP|L\.P|Ltd|Advisors|Management|Capital)\b"
CANONICAL = (
    (r"(?i)midland", "Midland Loan Services"), (r"(?i)keybank", "KeyBank N.A."), (r"(?i)trimont", "Trimont LLC"), (r"(?i)wells\s*fargo", "Wells Fargo Bank, N.A."),
    (r"(?i)computershare", "Computershare Trust Company, N.A."), (r"(?i)rialto", "Rialto Capital Advisors, LLC"), (r"(?i)k-?star", "K-Star Asset Management LLC"),
    (r"(?i)argentic", "Argentic Services Company LP"), (r"(?i)lnr", "LNR Partners, LLC"), (r"(?i)situs", "Situs Holdings, LLC"), (r"(?i)greystone", "Greystone Servicing Company LLC"),
)
NAME_LENGTH, RAW_LENGTH = 80, 120


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def table_rows(cells: DataFrame) -> DataFrame:
    """doc_id, table_idx, row_idx, cells (column -> text without surplus blanks); empty cells are left out."""
    text = squeezed(F.col("text"))
    filled = cells.select(*TABLE, "row_idx", "col_idx", text.alias("text")).where(F.coalesce(text, F.lit("")) != "")
    return filled.groupBy(*TABLE, "row_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col_idx", "text")))).alias("cells"))


def _entries(name: str = "cells") -> Column:
    return F.map_entries(F.col(name))


def _first_column(entries: Column, pattern: str, exclude: str | None = None) -> Column:
    """The leftmost column whose text matches; entries are (key, value) from left to right."""

    def good(x: Column) -> Column:
        yes = x["value"].rlike(pattern)
        return yes & ~x["value"].rlike(exclude) if exclude else yes

    return F.get(F.filter(entries, good), F.lit(0))["key"]


def merged_headers(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchors (a table's row each) with headers: column -> distinct texts of the row and of the two rows above it, from top to bottom."""
    keys = anchors.select(*TABLE, F.col("row_idx").alias("anchor_row")).distinct()
    above = keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(HEADER_DEPTH - 1))).alias("back")).select(*TABLE, "anchor_row", (F.col("anchor_row") - F.col("back")).alias("row_idx"))
    parts = rows.join(above, [*TABLE, "row_idx"]).select(*TABLE, "anchor_row", "row_idx", F.explode("cells").alias("col_idx", "text"))
    merged = parts.groupBy(*TABLE, "anchor_row", "col_idx").agg(F.array_sort(F.collect_list(F.struct("row_idx", "text"))).alias("parts"))
    text = F.array_join(F.array_distinct(F.transform("parts", lambda x: x["text"])), " ")
    merged = merged.select(*TABLE, "anchor_row", "col_idx", text.alias("text"))
    return merged.groupBy(*TABLE, "anchor_row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col_idx", "text")))).alias("headers"))


def _anchored(rows: DataFrame) -> DataFrame:
    """Rows with an anchor: layout (its place in LAYOUTS), anchor_col."""
    found = F.array(*[F.struct(F.lit(i).alias("layout"), _first_column(_entries(), layout[2]).alias("anchor_col")) for i, layout in enumerate(LAYOUTS)])
    hits = rows.select(*TABLE, "row_idx", F.filter(found, lambda x: x["anchor_col"].isNotNull()).alias("hits")).where(F.size("hits") > 0)
    return hits.select(*TABLE, "row_idx", F.inline("hits"))


def locate(rows: DataFrame) -> DataFrame:
    """doc_id, table_idx, kind (noi, delinquency, special), family, header_row, columns (name -> column, anchor included).

    A table has at most one place of each kind: its first row that has all columns that the layout needs.
    """
    anchored = _anchored(rows)
    heads = merged_headers(rows, anchored).withColumnRenamed("anchor_row", "row_idx")
    found = anchored.join(heads, [*TABLE, "row_idx"])
    entries = _entries("headers")
    columns, good, kind, family = F.lit(None), F.lit(False), F.lit(None), F.lit(None)
    for i, (k, f, _, names, needs, forbids) in enumerate(LAYOUTS):
        at = {name: _first_column(entries, pattern, exclude) for name, pattern, exclude in names}
        mine = F.col("layout") == i
        every = F.create_map(F.lit("anchor"), F.col("anchor_col"), *[x for name, c in at.items() for x in (F.lit(name), c)])
        ok = F.lit(True)
        for name in needs:
            ok = ok & at[name].isNotNull()
        if forbids:
            ok = ok & _first_column(entries, forbids).isNull()
        columns, good, kind, family = F.when(mine, every).otherwise(columns), F.when(mine, ok).otherwise(good), F.when(mine, k).otherwise(kind), F.when(mine, f).otherwise(family)
    found = found.select(*TABLE, F.col("row_idx").alias("header_row"), "layout", kind.alias("kind"), family.alias("family"), columns.alias("columns"), good.alias("good")).where("good")
    best = found.groupBy(*TABLE, "kind").agg(F.min(F.struct("header_row", "layout")).alias("best"))
    out = found.join(best, [*TABLE, "kind"]).where((F.col("header_row") == F.col("best.header_row")) & (F.col("layout") == F.col("best.layout")))
    return out.select(*TABLE, "kind", "family", "header_row", "columns")


def describe_headers(rows: DataFrame) -> DataFrame:
    """doc_id, table_idx, family, header_row, headers (array by column, "" where empty): the first row with a family's anchor in each table."""
    families = [i for i, layout in enumerate(LAYOUTS) if layout[1]]
    first = _anchored(rows).where(F.col("layout").isin(*families)).groupBy(*TABLE).agg(F.min(F.struct("row_idx", "layout")).alias("x")).select(*TABLE, "x.*")
    name = F.element_at(F.array(*[F.lit(layout[1] or "") for layout in LAYOUTS]), F.col("layout") + 1)
    out = first.join(merged_headers(rows, first).withColumnRenamed("anchor_row", "row_idx"), [*TABLE, "row_idx"])
    width = F.array_max(F.map_keys("headers"))
    texts = F.transform(F.sequence(F.lit(0), width), lambda i: F.coalesce(F.try_element_at(F.col("headers"), i), F.lit("")))
    return out.select(*TABLE, name.alias("family"), F.col("row_idx").alias("header_row"), texts.alias("headers"))


def is_footer(cells: Column) -> Column:
    """Rows of totals and of page footers."""
    first = F.coalesce(F.try_element_at(cells, F.lit(0)), F.lit(""))
    return first.rlike(FOOTER_LABEL) | F.array_join(F.transform(F.map_entries(cells), lambda x: x["value"]), " ").rlike(FOOTER_TEXT)


def data_rows(rows: DataFrame, located: DataFrame, kind: str) -> DataFrame:
    """The rows below the header of a kind of table that carry an identifier: pros_id, loan_ref (its leading number, null for none), cells, columns."""
    mine = located.where(F.col("kind") == kind).select(*TABLE, "family", "header_row", "columns")
    out = rows.join(mine, TABLE).where((F.col("row_idx") > F.col("header_row")) & ~is_footer(F.col("cells")))
    out = out.withColumn("pros_id", F.try_element_at("cells", F.col("columns")["anchor"])).where(F.col("pros_id").isNotNull())
    return out.withColumn("loan_ref", loan_prefix("pros_id"))


def _cell(name: str) -> Column:
    return F.try_element_at("cells", F.col("columns")[name])


def noi_lines(rows: DataFrame, located: DataFrame) -> DataFrame:
    """One row for each line of a table of incomes, with its outcome: used, no id, no number, no dates, short period.

    A number without both dates is not reported, whatever it is. Periods from FULL_YEAR_DAYS on count as they
    stand, shorter ones from LEAST_DAYS on are taken to a year.
    """
    out = data_rows(rows, located, "noi")
    out = out.select(
        *TABLE, "row_idx", "family", "pros_id", "loan_ref",
        parse_money(_cell("fiscal")).alias("fiscal_noi"), parse_money(_cell("recent")).alias("noi"), parse_short_date(_cell("start")).alias("noi_start"), parse_short_date(_cell("end")).alias("noi_end"),
    )
    days = days_inclusive(F.col("noi_start"), F.col("noi_end"))
    out = out.withColumn("period_days", F.when(F.col("noi").isNotNull(), days))
    outcome = F.when(F.col("loan_ref").isNull(), "no id").when(F.col("noi").isNull(), "no number").when(F.col("period_days").isNull(), "no dates").when(F.col("period_days") < LEAST_DAYS, "short period")
    out = out.withColumn("outcome", outcome.otherwise("used"))
    used = annualise(out.where("outcome = 'used'"), LEAST_DAYS, FULL_YEAR_DAYS)
    rest = out.where("outcome <> 'used'").withColumns({"is_full_year": F.lit(False), "annualized_noi": F.lit(None).cast("double")})
    return used.unionByName(rest)


def collapse_tranches(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loans and conflicts of lines (of noi_lines): tranches of one loan carry the income of the same property.

    A loan whose tranches differ when rounded is a conflict with its values in order of appearance; any other
    keeps its longest period, the first one among equals, and the number of its tranches.
    """
    used = lines.where("outcome = 'used'").withColumn("whole", F.floor(F.col("annualized_noi") + 0.5))
    place = F.struct(-F.col("period_days"), F.col("table_idx"), F.col("row_idx"))
    facts = F.struct("annualized_noi", "noi_start", "noi_end", "period_days", "is_full_year")
    groups = used.groupBy("doc_id", "loan_ref").agg(
        F.min_by(facts, place).alias("best"),
        F.count(F.lit(1)).alias("tranches"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("table_idx", "row_idx", "whole"))), lambda x: x["whole"])).alias("values"),
    )
    loans = groups.where(F.size("values") == 1).select("doc_id", "loan_ref", "best.*", "tranches")
    return loans, groups.where(F.size("values") > 1).select("doc_id", "loan_ref", "values")


def delinquency_lines(rows: DataFrame, located: DataFrame) -> DataFrame:
    """One row for each line of a table of arrears; dropped marks prose and lines without a number in front."""
    out = data_rows(rows, located, "delinquency")
    dates = {"paid_through": "paid_through", "transfer_date": "transfer", "foreclosure_date": "foreclosure", "reo_date": "reo"}
    return out.select(
        *TABLE, "row_idx", "pros_id", "loan_ref", (F.col("pros_id").rlike(PROSE) | F.col("loan_ref").isNull()).alias("dropped"),
        parse_money(_cell("months")).alias("months_delinquent"), _cell("status").alias("status"), *[parse_short_date(_cell(c)).alias(name) for name, c in dates.items()],
    )


def special_lines(rows: DataFrame, located: DataFrame) -> DataFrame:
    """One row for each line of a table of specially serviced loans; dropped marks prose and lines without a number or a date of transfer."""
    out = data_rows(rows, located, "special")
    out = out.select(
        *TABLE, "row_idx", "pros_id", "loan_ref", parse_short_date(_cell("transfer")).alias("transfer_date"),
        _cell("resolution").alias("resolution_code"), _cell("type").alias("property_type"), _cell("state").alias("state"),
    )
    return out.withColumn("dropped", F.col("pros_id").rlike(PROSE) | F.col("loan_ref").isNull() | F.col("transfer_date").isNull())


def diagnostics(rows: DataFrame, located: DataFrame) -> DataFrame:
    """One row for each report: what was found, what was dropped and why, and the issues worth a look.

    No table of arrears, a table without rows, and rows that were all dropped are three different causes of
    an empty result; delinquency_tables, _data_rows and _dropped tell them apart.
    """
    # Lines are asked for several times below: they meet their tables and are parsed once.
    lines = staged(noi_lines(rows, located).select("doc_id", "table_idx", "row_idx", "loan_ref", "outcome", "annualized_noi", "noi_start", "noi_end", "period_days", "is_full_year"), "report-lines")
    late = staged(delinquency_lines(rows, located).select("doc_id", "table_idx", "row_idx", "pros_id", "loan_ref", "dropped"), "report-late")
    special = special_lines(rows, located)
    loans, conflicts = collapse_tranches(lines)
    is_kind = lambda k: F.count(F.when(F.col("kind") == k, 1))
    had = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    tables = rows.groupBy("doc_id").agg(F.count_distinct("table_idx").alias("tables_scanned"))
    places = located.groupBy("doc_id").agg(is_kind("noi").alias("tables_matched"), is_kind("delinquency").alias("delinquency_tables"), is_kind("special").alias("special_tables"), F.array_sort(F.collect_set("family")).alias("families"))
    noi = lines.groupBy("doc_id").agg((F.count(F.lit(1)) - had("no id")).alias("rows_found"), had("no dates").alias("dropped_no_dates"), had("short period").alias("dropped_short_period"), had("no id").alias("dropped_no_id"))
    kept = loans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("loans"), F.count(F.when(F.col("is_full_year"), 1)).alias("full_year"))
    odd = conflicts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tranche_conflicts"))
    # The first dropped identifiers as they stand tell prose from loans.
    placed = late.where("dropped").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("table_idx", "row_idx"))).where(F.col("n") <= SAMPLES)
    samples = placed.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.substring("pros_id", 1, 60).alias("x")))), lambda s: s["x"]).alias("dropped_samples"))
    arrears = late.groupBy("doc_id").agg(F.count(F.lit(1)).alias("delinquency_data_rows"), F.count(F.when(F.col("dropped"), 1)).alias("delinquency_dropped"))
    known = late.where(~F.col("dropped")).select("doc_id", "loan_ref", F.lit(True).alias("late")).distinct()
    moved = special.join(known, ["doc_id", "loan_ref"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("special_data_rows"), F.count(F.when(~F.col("dropped") & F.col("late").isNull(), 1)).alias("special_only"))
    out = tables
    for part in (places, noi, kept, odd, arrears, samples, moved):
        out = out.join(part, "doc_id", "left")
    counts = [c for c, t in out.dtypes if t == "bigint"]
    out = out.fillna(0, counts).withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("families", "dropped_samples")})
    share = F.when(F.col("loans") > 0, F.col("full_year") / F.col("loans")).otherwise(0.0)
    issues = F.array_compact(
        F.array(
            F.when(F.col("tables_matched") == 0, "no table of incomes"),
            F.when((F.col("tables_matched") > 0) & (F.col("loans") == 0), "no usable income"),
            F.when(F.col("tranche_conflicts") > 0, "tranches disagree"),
            F.when((F.col("loans") > 0) & (share < 0.5), "mostly partial periods"),
        )
    )
    return out.withColumns({"full_year_share": share, "issues": issues})


def canonical_party(name: Column) -> Column:
    """One name for all spellings of a known administrator; others without trailing commas and blanks."""
    out = F.when(F.lit(False), "")
    for pattern, canonical in CANONICAL:
        out = out.when(name.rlike(pattern), canonical)
    return out.otherwise(F.regexp_replace(F.trim(name), r"[,\s]+$", ""))


def parties(rows: DataFrame) -> DataFrame:
    """doc_id, role, name, raw: who administers each trust, from the cells beside and below a role's label.

    Names are looked for in the label's own cell, then to the right, then below, and must have a corporate form;
    a label without such a neighbour is passed over. Of several labels of a role the first with a name counts.
    """
    role = F.lit(None).cast("string")
    for name, pattern in reversed(ROLES):
        role = F.when(F.col("label").rlike(pattern), name).otherwise(role)
    any_role = "|".join(f"(?:{p})" for _, p in ROLES)
    labels = rows.where(F.exists(F.map_values("cells"), lambda x: x.rlike(any_role))).select(*TABLE, "row_idx", "cells", F.explode("cells").alias("col_idx", "label"))
    labels = labels.withColumn("role", role).where(F.col("role").isNotNull() & ~F.col("label").rlike(ACCOUNTING))
    below = rows.select(*TABLE, (F.col("row_idx") - 1).alias("row_idx"), F.col("cells").alias("below"))
    labels = labels.join(below, [*TABLE, "row_idx"], "left")
    own = F.regexp_replace("label", any_role, "")
    right = F.transform(F.filter(_entries(), lambda x: x["key"] > F.col("col_idx")), lambda x: x["value"])
    texts = F.concat(F.array(own), right, F.array(F.coalesce(F.try_element_at("below", F.col("col_idx")), F.lit(""))))
    cleaned = F.transform(texts, lambda s: F.trim(F.regexp_replace(s, r"^[/:\-–\s]+", "")))
    names = F.filter(cleaned, lambda s: (F.length(s) > 2) & ~s.rlike(CONTACT) & ~s.rlike(any_role) & s.rlike(CORPORATE))
    raw = F.substring(F.array_join(F.map_values("cells"), " | "), 1, RAW_LENGTH)
    labels = labels.select("doc_id", "role", F.struct(*TABLE[1:], "row_idx", "col_idx").alias("place"), F.get(names, F.lit(0)).alias("name"), raw.alias("raw")).where(F.col("name").isNotNull())
    first = labels.groupBy("doc_id", "role").agg(F.min_by(F.struct("name", "raw"), "place").alias("x"))
    return first.select("doc_id", "role", F.substring(canonical_party(F.col("x.name")), 1, NAME_LENGTH).alias("name"), "x.raw")


def match_loans(lines: DataFrame, loans: DataFrame) -> DataFrame:
    """lines (accession, loan_ref, ...) with loan_id: the issuance's first loan with that number, null for none.

    loans: accession, loan_id, loan_ref, row_index.
    """
    numbered = loans.select("accession", loan_prefix("loan_ref").alias("loan_ref"), "loan_id", "row_index").where(F.col("loan_ref").isNotNull())
    first = numbered.groupBy("accession", "loan_ref").agg(F.min_by("loan_id", F.struct("row_index", "loan_id")).alias("loan_id"))
    return lines.withColumn("loan_ref", loan_prefix("loan_ref")).join(first, ["accession", "loan_ref"], "left")


def best_report(reports: DataFrame, key: str = "accession", good_yield: float = GOOD_YIELD) -> DataFrame:
    """key, report, attempts: the report that a harvest keeps, and how many it had to read.

    reports: key, place (order of trial), report, rows_found, usable. Reports are tried in order until the one
    in hand gives at least good_yield usable rows a row; another takes its place only if it has more usable
    rows. A trust has a few reports to try, which are folded in one row.
    """
    item = F.struct("place", "report", "rows_found", "usable")
    lists = reports.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("tried"))
    empty = F.struct(F.lit(None).cast(reports.schema["report"].dataType).alias("report"), F.lit(-1).cast("long").alias("usable"), F.lit(0.0).alias("yield"), F.lit(0).alias("attempts"))

    def step(held: Column, x: Column) -> Column:
        rate = F.when(x["rows_found"] > 0, x["usable"] / x["rows_found"]).otherwise(0.0)
        taken = (held["attempts"] == 0) | (x["usable"] > held["usable"])
        new = F.struct(
            F.when(taken, x["report"]).otherwise(held["report"]).alias("report"),
            F.when(taken, x["usable"].cast("long")).otherwise(held["usable"]).alias("usable"),
            F.when(taken, rate).otherwise(held["yield"]).alias("yield"),
            (held["attempts"] + 1).alias("attempts"),
        )
        return F.when((held["attempts"] > 0) & (held["yield"] >= good_yield), held).otherwise(new)

    return lists.select(key, F.aggregate("tried", empty, step).alias("kept")).select(key, "kept.report", "kept.usable", "kept.attempts")


def stock_and_history(reports: DataFrame, events: DataFrame) -> DataFrame:
    """cik, reports, oldest, newest, today, ever, ratio: loans that the newest report lists against all that any report has listed.

    reports: cik, accession, dated, place (1 for the newest); events: report, loan_id, transfer_date; only loans
    with a date of transfer count, each once. ratio is 1 where there never was any, null where all of them have gone.
    """
    base = reports.groupBy("cik").agg(F.count(F.lit(1)).alias("reports"), F.min("dated").alias("oldest"), F.max("dated").alias("newest"))
    met = events.where(F.col("transfer_date").isNotNull()).select("report", "loan_id").join(reports.select("cik", F.col("accession").alias("report"), "place"), "report")
    once = met.groupBy("cik", "loan_id").agg(F.min("place").alias("place"))
    counts = once.groupBy("cik").agg(F.count(F.when(F.col("place") == 1, 1)).alias("today"), F.count(F.lit(1)).alias("ever"))
    out = base.join(counts, "cik", "left").fillna(0, ["today", "ever"])
    ratio = F.when(F.col("today") > 0, F.col("ever") / F.col("today")).when(F.col("ever") == 0, 1.0)
    return out.withColumn("ratio", F.round(ratio, 6))


def fiscal_ratios(lines: DataFrame) -> DataFrame:
    """doc_id, n_both, fiscal_only, median_days, p10, p50, p90, near: does the fiscal year's income measure what the dated period does?

    n_both counts lines that have both incomes. The ratio is of the fiscal income to the dated one taken to a year, on lines (of noi_lines) that have both
    and a period of at least a day; quantiles are values that occur, at place floor(p n). near counts ratios within
    10 % of 1. fiscal_only are lines that have a fiscal income and no dated one.
    """
    has = F.col("fiscal_noi").isNotNull() & (F.col("fiscal_noi") != 0)
    dated = has & F.col("noi").isNotNull() & (F.col("noi") != 0) & (F.col("period_days") >= 1)
    ratio = F.when(dated, F.col("fiscal_noi") / (F.col("noi") * 365 / F.col("period_days")))
    rows = lines.select("doc_id", ratio.alias("ratio"), F.when(dated, F.col("period_days")).alias("days"), (has & F.col("period_days").isNull()).alias("alone"))
    at = lambda c, p: F.element_at(F.col(c), F.least(F.size(c), (F.floor(p * F.size(c)) + 1).cast("int")))
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("ratio")).alias("rs"), F.array_sort(F.collect_list("days")).alias("ds"), F.count(F.when(F.col("alone"), 1)).alias("fiscal_only"))
    lists = lists.where((F.size("rs") > 0) | (F.col("fiscal_only") > 0))
    quantiles = [F.when(F.size("rs") > 0, F.round(at("rs", p), 6)).alias(n) for n, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))]
    near = F.size(F.filter("rs", lambda x: (x > 0.9) & (x < 1.1)))
    return lists.select("doc_id", F.size("rs").alias("n_both"), "fiscal_only", F.when(F.size("ds") > 0, at("ds", 0.5)).alias("median_days"), *quantiles, near.alias("near"))
