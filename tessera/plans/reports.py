"""Monthly reports printed as HTML from the corpus and read back, and the choice of documents to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import picking, promotion
from ..operators import servicer as op
from ..operators.extract import html_rows
from ..sources.bridge import Corpus
from ..sources.stage import staged
from .registry import query

#: Names as the cover prints them, by deal.
MASTERS = ("Midland Loan Services, a Division of PNC Bank, National Association", "KeyBank National Association", "Local Loan Servicing Company, ", "Trimont LLC")
SPECIALS = ("LNR Partners, LLC", "Rialto Capital Advisors, LLC", "nobody in particular")


def _tr(*cells: Column | str) -> Column:
    return F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit("<td>"), F.lit(c) if isinstance(c, str) else F.coalesce(c, F.lit("")), F.lit("</td>"))], F.lit("</tr>"))


def _table(*rows: Column) -> Column:
    return F.concat(F.lit("<table>"), *rows, F.lit("</table>"))


def _date(c: str, long: Column | bool) -> Column:
    return F.coalesce(F.when(F.lit(long) if isinstance(long, bool) else long, F.date_format(c, "MM/dd/yyyy")).otherwise(F.date_format(c, "MM/dd/yy")), F.lit("--"))


def _body(lines: DataFrame, order: list[str], row: Column) -> DataFrame:
    """doc_id, rows: the lines of a document, printed in order; a document has a few hundred at most."""
    printed = lines.select("doc_id", F.struct(*order, row.alias("tr")).alias("x"))
    return printed.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["tr"]), "").alias("rows"))


def printed_reports(c: Corpus) -> DataFrame:
    """doc_id, html: a cover with the parties, incomes in one of two layouts, arrears and special servicing."""
    second = F.col("nat") % 2 == 1
    lines = c.report_lines
    money = F.when(F.col("way") == 10, F.when(second, "Not Available").otherwise("--")).otherwise(F.format_number((F.col("cents").cast("decimal(20,2)") / 100).cast("decimal(20,2)"), 2))
    start, end = (F.when(F.col("way") == 9, F.lit("--")).otherwise(_date(x, second)) for x in ("period_start", "period_end"))
    fiscal = F.concat(F.lit("("), F.col("loan_id").cast("string"), F.lit(".5)"))
    noi = _body(lines, ["ref", "tranche"], F.when(second, _tr(F.concat(F.lit("3280"), F.col("loan_id").cast("string")), F.col("pros_id"), fiscal, money, start, end)).otherwise(_tr(F.col("pros_id"), fiscal, money, start, end)))
    events = c.delinquency.join(c.report_loans.select("loan_id", "doc_id", "ref"), "loan_id")
    late = events.where(F.col("source").isin("delinquency", "both"))
    late = _body(late, ["ref"], _tr(F.concat(F.col("ref").cast("string"), F.lit("-A")), _date("paid_through", False), F.col("months_delinquent").cast("bigint").cast("string"), F.lit("3"), _date("transfer_date", False), _date("foreclosure_date", False), F.lit("--")))
    moved = events.where(F.col("source").isin("special", "both"))
    moved = _body(moved, ["ref"], _tr(F.col("ref").cast("string"), F.lit("Office"), F.lit("NY"), _date("transfer_date", True), F.lit("9")))
    docs = c.report_loans.select("doc_id", "nat").distinct()
    master = F.element_at(F.array(*map(F.lit, MASTERS)), (F.col("nat") % 4 + 1).cast("int"))
    special = F.element_at(F.array(*map(F.lit, SPECIALS)), (F.col("nat") % 3 + 1).cast("int"))
    cover = _table(
        _tr("Trustee Fee", "290.00 Bank"), _tr("Master Servicer", "Return Date"), _tr("Special  Servicer", "Master Servicer"), _tr(special, master), _tr("Certificate Administrator / Computershare Trust Co.", "help@bank.example"),
        _tr("Trustee", "(302) 555-0100 Bank", "Wilmington Trust, National Association,"), _tr("Trustee", "Some Other Bank"),
    )
    title = _tr("Mortgage Loan Detail (Part 2)", "")
    first = F.concat(title, _tr("", "Most Recent", "Most Recent", "NOI", "NOI"), _tr("", "Fiscal", "", "Start", "End"), _tr("Pros ID", "NOI", "NOI", "Date", "Date"))
    other = F.concat(title, _tr("", "", "Preceding Fiscal", "Most Recent", "Most Recent Financial", "Most Recent Financial"), _tr("Loan ID", "OMCR", "Year NOI", "NOI", "As of Start Date", "Asof End Date"))
    end_rows = F.concat(_tr("Totals", "1.00", "2.00"), _tr("Page 1 of 2", "All rights reserved"))
    arrears = F.concat(_tr("", "Paid", "Months", "Mortgage", "Servicing", "", ""), _tr("", "Through", "", "Loan", "Transfer", "Foreclosure", "REO"), _tr("Pros ID", "Date", "Delinquent", "Status", "Date", "Date", "Date"))
    served = _tr("Pros ID", "Property Type", "State", "Servicing Transfer Date", "Resolution Strategy Code")
    notes = F.concat(_tr("1 Mortgage Loan Status", "A"), _tr("n.a.", "B"))
    out = docs.join(noi.withColumnRenamed("rows", "noi"), "doc_id", "left").join(late.withColumnRenamed("rows", "late"), "doc_id", "left").join(moved.withColumnRenamed("rows", "moved"), "doc_id", "left")
    body = lambda x: F.coalesce(F.col(x), F.lit(""))
    return out.select("doc_id", F.concat(cover, _table(F.when(second, other).otherwise(first), body("noi"), end_rows), _table(arrears, body("late"), notes), _table(served, body("moved"), end_rows)).alias("html"))


def _read(c: Corpus) -> tuple[DataFrame, DataFrame]:
    rows = staged(html_rows(printed_reports(c.held()), "doc_id", "html"), "report-rows")
    return rows, staged(op.locate(rows), "report-tables")


DOCS = "docs as (select distinct doc_id, accession, nat from report_loans)"
#: The printed lines as the contract reads them.
LINES = """lines as (
    select *, case when way = 10 then null else cents / 100.0e0 end as noi, case when way in (9, 10) then null else period_end - period_start + 1 end as n_days,
        case way when 10 then 'no number' when 9 then 'no dates' when 8 then 'short period' else 'used' end as outcome,
        case when way in (8, 9, 10) then null when period_end - period_start + 1 >= 300 then cents / 100.0e0 else cents / 100.0e0 * 365 / (period_end - period_start + 1) end as annual
    from report_lines)"""


@query(f"""with {DOCS} select doc_id, 1 as table_idx, 'noi' as kind, case when nat % 2 = 1 then 'citigroup' else 'computershare' end as family, case when nat % 2 = 1 then 2 else 3 end as header_row from docs
    union all select doc_id, 2, 'delinquency', null, 2 from docs union all select doc_id, 3, 'special', null, 0 from docs""")
def report_tables(c: Corpus) -> DataFrame:
    """Which tables of the reports are recognised, and where their headers lie."""
    return _read(c)[1].select("doc_id", "table_idx", "kind", "family", "header_row")


@query(f"""with {DOCS} select doc_id, 1 as table_idx, case when nat % 2 = 1 then 'citigroup' else 'computershare' end as family, case when nat % 2 = 1 then 2 else 3 end as header_row,
    case when nat % 2 = 1 then 'Mortgage Loan Detail (Part 2) Loan ID|OMCR|Preceding Fiscal Year NOI|Most Recent NOI|Most Recent Financial As of Start Date|Most Recent Financial Asof End Date'
    else 'Pros ID|Most Recent Fiscal NOI|Most Recent NOI|NOI Start Date|NOI End Date' end as headers from docs
    union all select doc_id, 2, 'computershare', 2, 'Pros ID|Paid Through Date|Months Delinquent|Mortgage Loan Status|Servicing Transfer Date|Foreclosure Date|REO Date' from docs
    union all select doc_id, 3, 'computershare', 0, 'Pros ID|Property Type|State|Servicing Transfer Date|Resolution Strategy Code' from docs""")
def report_headers(c: Corpus) -> DataFrame:
    """The headers of recognised tables as their three rows read together."""
    rows, _ = _read(c)
    return op.describe_headers(rows).withColumn("headers", F.array_join("headers", "|"))


@query(f"with {LINES} select doc_id, pros_id, cast(ref as varchar) as loan_ref, -(loan_id + 0.5e0) as fiscal_noi, noi, n_days as period_days, annual as annualized_noi, outcome from lines")
def report_noi_lines(c: Corpus) -> DataFrame:
    """Every line of the incomes with what became of it."""
    lines = op.noi_lines(*_read(c))
    return lines.select("doc_id", "pros_id", "loan_ref", "fiscal_noi", "noi", "period_days", "annualized_noi", "outcome")


COLLAPSED = """collapsed as (
    select doc_id, accession, ref, count(*) as tranches, count(distinct floor(annual + 0.5)) as n_values, max(n_days) as period_days, arg_min(annual, 1000 * (400 - n_days) + tranche) as annual,
        string_agg(cast(floor(annual + 0.5) as bigint), ',' order by tranche) as all_values
    from lines where outcome = 'used' group by doc_id, accession, ref)"""


@query(f"""with {LINES}, {COLLAPSED} select doc_id, cast(ref as varchar) as loan_ref, annual as annualized_noi, period_days, period_days >= 300 as is_full_year, tranches, l.loan_id
    from collapsed left join loans l on l.accession = collapsed.accession and l.loan_ref = cast(ref as varchar) where n_values = 1""")
def report_performance(c: Corpus) -> DataFrame:
    """One income for each loan of a report, tranches collapsed, with the corpus loan that it belongs to."""
    loans, _ = op.collapse_tranches(op.noi_lines(*_read(c)))
    found = op.match_loans(loans.withColumn("accession", F.regexp_extract("doc_id", "^R-([^/]+)/", 1)), c.loans)
    return found.select("doc_id", "loan_ref", "annualized_noi", "period_days", "is_full_year", "tranches", "loan_id")


@query(f"""with {LINES}, firsts as (
        select doc_id, ref, v, min(tranche) as t from (select doc_id, ref, tranche, cast(floor(annual + 0.5) as bigint) as v from lines where outcome = 'used') group by all)
    select doc_id, cast(ref as varchar) as loan_ref, string_agg(v, ',' order by t) as vals from firsts group by doc_id, ref having count(*) > 1""")
def report_conflicts(c: Corpus) -> DataFrame:
    """Loans that are left out since their tranches report different incomes."""
    _, conflicts = op.collapse_tranches(op.noi_lines(*_read(c)))
    return conflicts.select("doc_id", "loan_ref", F.array_join("values", ",").alias("vals"))


@query("""select r.doc_id, e.loan_id, case when e.source = 'both' and e.transfer_date is null then 'delinquency' else e.source end as source, case when e.source = 'special' then null else e.months_delinquent * 1.0e0 end as months_delinquent,
    case when e.source = 'special' then null else e.paid_through end as paid_through, e.transfer_date, case when e.transfer_date is null or e.source = 'delinquency' then null else '9' end as resolution_code
    from delinquency e join report_loans r on r.loan_id = e.loan_id join loans l on l.loan_id = e.loan_id where l.loan_ref is not null and (e.source <> 'special' or e.transfer_date is not null)""")
def report_events(c: Corpus) -> DataFrame:
    """Arrears and special servicing of a report as one row for each corpus loan."""
    rows, located = _read(c)
    late = op.delinquency_lines(rows, located).where(~F.col("dropped")).select("doc_id", "loan_ref", "months_delinquent", "paid_through", "transfer_date")
    moved = op.special_lines(rows, located).where(~F.col("dropped")).select("doc_id", "loan_ref", "transfer_date", "resolution_code")

    def matched(lines: DataFrame) -> DataFrame:
        found = op.match_loans(lines.withColumn("accession", F.regexp_extract("doc_id", "^R-([^/]+)/", 1)), c.loans)
        return found.where(F.col("loan_id").isNotNull()).drop("accession", "loan_ref").withColumnRenamed("doc_id", "report_accession")

    out = promotion.merge_event_feeds(matched(late), matched(moved)).withColumnRenamed("report_accession", "doc_id")
    return out.select("doc_id", "loan_id", "source", "months_delinquent", "paid_through", "transfer_date", "resolution_code")


@query(f"""with {DOCS} select doc_id, 'master servicer' as role, case nat % 4 when 0 then 'Midland Loan Services' when 1 then 'KeyBank N.A.' when 2 then 'Local Loan Servicing Company' else 'Trimont LLC' end as name, 'Special Servicer | Master Servicer' as raw from docs
    union all select doc_id, 'special servicer', case nat % 3 when 0 then 'LNR Partners, LLC' else 'Rialto Capital Advisors, LLC' end, 'Special Servicer | Master Servicer' from docs where nat % 3 <> 2
    union all select doc_id, 'certificate administrator', 'Computershare Trust Company, N.A.', 'Certificate Administrator / Computershare Trust Co. | help@bank.example' from docs
    union all select doc_id, 'trustee', 'Wilmington Trust, National Association', 'Trustee | (302) 555-0100 Bank | Wilmington Trust, National Association,' from docs""")
def report_parties(c: Corpus) -> DataFrame:
    """Who administers each trust, one name for each spelling."""
    return op.parties(_read(c)[0])


@query(f"""with {DOCS}, {LINES}, {COLLAPSED},
    late as (select doc_id, count(*) as n from delinquency e join report_loans r on r.loan_id = e.loan_id where source <> 'special' group by doc_id),
    moved as (select doc_id, count(*) as n, count(*) filter (where source = 'special' and transfer_date is not null) as alone from delinquency e join report_loans r on r.loan_id = e.loan_id where source <> 'delinquency' group by doc_id),
    sums as (select doc_id, count(*) as rows_found, count(*) filter (where outcome = 'no dates') as no_dates, count(*) filter (where outcome = 'short period') as short from lines group by doc_id),
    used as (select doc_id, count(*) filter (where n_values = 1) as loans, count(*) filter (where n_values = 1 and period_days >= 300) as full_year, count(*) filter (where n_values > 1) as odd from collapsed group by doc_id)
    select d.doc_id, 4 as tables_scanned, 1 as tables_matched, case when nat % 2 = 1 then 'citigroup' else 'computershare' end as families, coalesce(rows_found, 0) as rows_found, coalesce(no_dates, 0) as dropped_no_dates, coalesce(short, 0) as dropped_short_period,
        coalesce(loans, 0) as loans, coalesce(full_year, 0) as full_year, coalesce(odd, 0) as tranche_conflicts, coalesce(late.n, 0) + 2 as delinquency_data_rows, 2 as delinquency_dropped, '1 Mortgage Loan Status|n.a.' as dropped_samples,
        coalesce(moved.n, 0) as special_data_rows, coalesce(moved.alone, 0) as special_only,
        concat_ws('|', case when coalesce(loans, 0) = 0 then 'no usable income' end, case when odd > 0 then 'tranches disagree' end, case when loans > 0 and full_year < 0.5 * loans then 'mostly partial periods' end) as issues
    from docs d left join late on late.doc_id = d.doc_id left join moved on moved.doc_id = d.doc_id left join sums on sums.doc_id = d.doc_id left join used on used.doc_id = d.doc_id""")
def report_diagnostics(c: Corpus) -> DataFrame:
    """What each report gave and why some of it was dropped."""
    out = op.diagnostics(*_read(c))
    texts = {x: F.array_join(x, "|") for x in ("families", "dropped_samples", "issues")}
    return out.withColumns(texts).drop("delinquency_tables", "special_tables", "dropped_no_id", "full_year_share")


@query("""with recursive t as (select *, case when rows_found > 0 then usable / cast(rows_found as double) else 0 end as yield, row_number() over (partition by accession order by place) as n from trials),
    fold(accession, n, report, usable, yield, attempts) as (
        select accession, n, report, usable, yield, 1 from t where n = 1
        union all
        select t.accession, t.n, case when t.usable > f.usable then t.report else f.report end, greatest(t.usable, f.usable), case when t.usable > f.usable then t.yield else f.yield end, f.attempts + 1
        from fold f join t on t.accession = f.accession and t.n = f.n + 1 where f.yield < 0.5)
    select accession, report, usable, attempts from (select *, row_number() over (partition by accession order by n desc) as last from fold) where last = 1""")
def best_reports(c: Corpus) -> DataFrame:
    """Of several reports of a deal the one that a harvest keeps, read until one yields well."""
    return op.best_report(c.trials)


ANNEX_SCORE = r"""scored as (
    select *, case when not regexp_matches(form, '^(FWP|424B[0-9]?|424H)$') then 0 else round(greatest(0, least(1,
        case when regexp_matches(document_name, 'annex[-_]?a') then 0.55 when regexp_matches(document_name, 'anx\s*a?-?\d?') then 0.5 when document_name like '%annex%' then 0.3 when regexp_matches(document_name, '[-_]a-?1?\.[a-z]+$') then 0.45 else 0 end
        + case when regexp_matches(lower(description), 'annex\s*_?-?a') then 0.2 when lower(description) like '%annex%' then 0.1 else 0 end
        + case when size_bytes > 500000 then 0.2 when size_bytes < 100000 then -0.4 else 0 end)), 6) end as score
    from trust_filings)"""


@query(rf"""with {ANNEX_SCORE}, good as (select *, row_number() over (partition by cik order by score desc, seq) as place from scored where score > 0),
    top as (select cik, accession, document_name, score, place, seq, false as fallback from good where score >= 0.5 and place <= 3),
    spare as (
        select *, row_number() over (partition by cik order by s desc, size_bytes desc, seq) as place
        from (select *, case when form like '424B%' then 0.4 else 0.35 end as s from trust_filings where form in ('424B2', '424H') and size_bytes >= 5000000) where cik not in (select cik from top)),
    picked as (select cik, accession, document_name, score, place, fallback from top union all select cik, accession, document_name, s, place, true from spare where place = 1)
    select p.cik, p.accession, p.document_name, p.score, p.place, p.fallback, coalesce((
        select string_agg(g.document_name || ':' || printf('%.2f', g.score), '|' order by g.place) from (
            select o.*, row_number() over (partition by q.accession order by o.place) as k, q.accession as mine from good o join picked q on q.cik = o.cik and q.accession <> o.accession where o.place <= 6) g
        where g.mine = p.accession and g.k <= 4), '') as alternatives
    from picked p""")
def annex_picks(c: Corpus) -> DataFrame:
    """The filings to read for each trust, with a prospectus where there is no annex."""
    return picking.pick_annexes(c.trust_filings).withColumn("alternatives", F.array_join("alternatives", "|"))


@query(f"with {ANNEX_SCORE} select cik, accession, form, round(score, 2) as score, place from (select *, row_number() over (partition by cik order by seq) as place from scored) where place <= 40")
def recent_filings(c: Corpus) -> DataFrame:
    """The first forty filings of each trust with their scores: a report for a look by hand."""
    return picking.listed(c.trust_filings).select("cik", "accession", "form", "score", "place")


MONTHLY = "monthly as (select *, coalesce(period, filed_at) as dated from trust_filings where form like '10-D%')"


@query(f"""with {MONTHLY} select cik, accession, row_number() over (partition by cik order by case month(dated) when 4 then 1 when 3 then 2 when 5 then 3 when 2 then 4 else 5 end, filed_at desc, accession) as place from monthly""")
def reports_by_month(c: Corpus) -> DataFrame:
    """Monthly filings in the order in which a harvest would try them."""
    return picking.preferred_reports(c.trust_filings).select("cik", "accession", "place")


@query(f"""with recursive {MONTHLY}, r as (select cik, accession, dated, row_number() over (partition by cik order by dated desc, accession) as n from monthly),
    fold(cik, n, last, accession, place) as (
        select cik, n, dated, accession, 1 from r where n = 1
        union all
        select r.cik, r.n, case when f.last - r.dated >= 6 * 30.44 - 10 then r.dated else f.last end, case when f.last - r.dated >= 6 * 30.44 - 10 then r.accession end, case when f.last - r.dated >= 6 * 30.44 - 10 then f.place + 1 else f.place end
        from fold f join r on r.cik = f.cik and r.n = f.n + 1)
    select cik, accession, place from fold where accession is not null""")
def reports_spaced(c: Corpus) -> DataFrame:
    """Monthly filings at least six months apart, from the newest back."""
    return picking.spaced_reports(c.trust_filings, 6).select("cik", "accession", "place")


@query(rf"""with {MONTHLY},
    files as (
        select *, case when not regexp_matches(document_name, '\.(htm|html|txt)$') or regexp_matches(document_name, '_10-?d[-_.]') then 0
            when regexp_matches(document_name, 'ex-?99[._-]?1') then 0.6 when regexp_matches(document_name, 'ex-?99') then 0.4 when regexp_matches(document_name, 'exh?[-_]?99') then 0.35 else 0 end as base,
            case when size_bytes > 200000 then 0.3 when size_bytes > 40000 then 0.2 when size_bytes < 8000 then -0.3 else 0 end as more from filing_files),
    best as (
        select accession, document_name, round(least(1, base + more), 6) as score, row_number() over (partition by accession order by round(least(1, base + more), 6) desc, seq) as k
        from files where base > 0 and round(least(1, base + more), 6) >= 0.5),
    tried as (select cik, accession, row_number() over (partition by cik order by case month(dated) when 4 then 1 when 3 then 2 when 5 then 3 when 2 then 4 else 5 end, filed_at desc, accession) as o from monthly)
    select * from (select cik, t.accession, b.document_name, b.score, row_number() over (partition by cik order by o) as place from tried t join best b on b.accession = t.accession and b.k = 1) where place <= 3""")
def report_picks(c: Corpus) -> DataFrame:
    """The three reports of each trust that a harvest reads, with the file that holds them."""
    files = c.filing_files.select("accession", "seq", F.col("document_name"), "size_bytes")
    candidates = picking.preferred_reports(c.trust_filings).select("cik", "accession", "place")
    return picking.pick_reports(candidates, files, 3).select("cik", "accession", "document_name", "score", "place")


@query(f"""with {LINES}, r as (
        select doc_id, n_days, case when noi <> 0 and n_days >= 1 then -(loan_id + 0.5e0) / (noi * 365 / n_days) end as ratio from lines),
    placed as (select *, row_number() over (partition by doc_id order by ratio nulls last) - 1 as k, count(ratio) over (partition by doc_id) as n_both from r),
    days as (select doc_id, n_days, row_number() over (partition by doc_id order by n_days) - 1 as k, count(*) over (partition by doc_id) as n from r where ratio is not null)
    select p.doc_id, max(n_both) as n_both, count(*) filter (where p.n_days is null) as fiscal_only, (select max(d.n_days) from days d where d.doc_id = p.doc_id and d.k = floor(0.5 * d.n)) as median_days,
        round(max(ratio) filter (where k = floor(0.1 * n_both)), 6) as p10, round(max(ratio) filter (where k = floor(0.5 * n_both)), 6) as p50, round(max(ratio) filter (where k = floor(0.9 * n_both)), 6) as p90,
        count(*) filter (where ratio > 0.9 and ratio < 1.1) as near
    from placed p group by p.doc_id""")
def report_fiscal_ratios(c: Corpus) -> DataFrame:
    """The last fiscal year's income against the dated one of each report."""
    return op.fiscal_ratios(op.noi_lines(*_read(c)))
