"""Tables printed from the corpus and read back: what is read must be what was printed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extract as op
from ..sources.bridge import Corpus
from ..sources.stage import staged
from .registry import query

#: Header row of the printed tables, after two rows of titles.
HEADER_ROW = 2
PRINTED = {
    "Loan ID": "cast(loan_id as string)", "Property Name": "concat('Property ', loan_id)", "Cut-off Date Balance ($)": "concat('$', format_number(amount, 0))",
    "Cut-off Date LTV (%)": "concat(n_ltv div 100, '.', lpad(cast(n_ltv % 100 as string), 2, '0'), '%')", "Interest Rate (%)": "concat(n_rate div 100, '.', lpad(cast(n_rate % 100 as string), 2, '0'), '%')",
    "Original Term To Maturity (mos)": "cast(cast(term as int) as string)", "Broker Code": "cast(loan_id % 1000 as string)",
}


def printed_cells(c: Corpus) -> DataFrame:
    """One table for each issuance: a title, a blank row, headers, a row for each loan and a row of totals."""
    rows = c.held().metrics.select("accession", "loan_id", "amount", "term", F.expr("floor(ltv * 10000 + 0.5)").alias("n_ltv"), F.expr("floor(rate * 10000 + 0.5)").alias("n_rate"))
    body = rows.select(F.col("accession").alias("doc_id"), (F.col("loan_id") + HEADER_ROW + 1).cast("int").alias("row_idx"), F.posexplode(F.array(*[F.expr(x) for x in PRINTED.values()])).alias("col_idx", "text"))
    deals = rows.select(F.col("accession").alias("doc_id")).distinct()
    head = deals.select("doc_id", F.lit(HEADER_ROW).alias("row_idx"), F.posexplode(F.array(*[F.lit(x) for x in PRINTED])).alias("col_idx", "text"))
    title = deals.select("doc_id", F.lit(0), F.lit(0), F.lit("Annex of loans"))
    total = deals.select("doc_id", F.lit(2**31 - 1), F.posexplode(F.array(F.lit("Total"), F.lit("Total"), F.lit("$1"), F.lit("1%"), F.lit("1%"), F.lit("1"), F.lit("1"))))
    cells = title.unionAll(head).unionAll(body).unionAll(total.toDF("doc_id", "row_idx", "col_idx", "text"))
    return cells.toDF("doc_id", "row_idx", "col_idx", "text").withColumn("table_idx", F.lit(0))


def _read(c: Corpus) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells, header rows and mapping; the last two are small, and known to be, so cells are not shuffled to meet them."""
    cells = staged(printed_cells(c), "extract-cells")
    headers = staged(op.header_rows(cells), "extract-headers")
    return cells, headers, staged(op.map_columns(cells, headers), "extract-mapping")


@query("""with p as (select m.loan_id, a.accession, m.amount, m.term, floor(ltv * 10000 + 0.5) as n_ltv, floor(m.rate * 10000 + 0.5) as n_rate from metrics m join amounts a on a.loan_id = m.loan_id)
    select * from (select accession as doc_id, loan_id + 3 as row_idx, 'loan_amount' as metric_key, amount as value, 0.95e0 as confidence, 'Cut-off Date Balance ($)' as source_header from p
    union all select accession, loan_id + 3, 'ltv', n_ltv / 10000.0e0, 0.95e0, 'Cut-off Date LTV (%)' from p
    union all select accession, loan_id + 3, 'interest_rate', n_rate / 10000.0e0, 0.95e0, 'Interest Rate (%)' from p
    union all select accession, loan_id + 3, 'term_original', term, 0.95e0, 'Original Term To Maturity (mos)' from p) where value is not null""")
def extract_observations(c: Corpus) -> DataFrame:
    cells, _, mapping = _read(c)
    found = op.observations(cells, mapping)
    numbers = found.where(~F.col("metric_key").isin("loan_id", "property_name"))
    return numbers.select("doc_id", F.col("row_idx").cast("long").alias("row_idx"), "metric_key", F.col("value").cast("double").alias("value"), "confidence", "source_header")


@query("select accession as doc_id, 'Broker Code' as header, count(*) as n, sum(loan_id % 1000) * 1.0e0 + 1 as total from base group by accession")
def extract_unmapped(c: Corpus) -> DataFrame:
    rest = op.unmapped_cells(*_read(c))
    # The row of totals is a number like any other here.
    return rest.groupBy("doc_id", "header").agg((F.count(F.lit(1)) - 1).alias("n"), F.sum("value").alias("total"))
