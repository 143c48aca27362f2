"""Structure of an annex: headers of several rows, continued and paged tables, tables of one loan each, loans and properties.

Everything works on cells (doc_id, table_idx, row_idx, col_idx, text); only the fold over a document's tables, a few
dozen summaries, runs in Python. Every phase reads the cells before it several times, so write them between phases.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import staged
from .extract import SPECS, TABLE, header_matches

#: Rows scanned for headers, growth of filled cells from a group row to its leaves, share of numbers that makes a row data, score of a leaf that stands for itself: fixed values.
SCAN, GROWTH, NUMERIC, LEAF = 6, 1.4, 0.4, 0.9
#: Share of phantom rows from which none is dropped, fraction that makes a property of a loan's number, largest loan number, overlap of joined tables: fixed values.
PHANTOM, FRACTION, MOST_ID, OVERLAP = 0.15, 0.001, 10_000, 0.5
AREA_MEASURES = r"(?i)^(sf|sq\.?\s*ft\.?|square\s*feet|nra|gla|acres?)$"
ROW = [*TABLE, "row_idx"]


def _filled(x: str = "text") -> Column:
    return F.coalesce(F.trim(x) != "", F.lit(False))


def _number(x: Column) -> Column:
    return F.trim(x).try_cast("double")


def _is_number(x: str = "text") -> Column:
    return F.regexp_replace(x, r"[$,%()\s]", "").try_cast("double").isNotNull()


def merge_headers(cells: DataFrame, specs: tuple = SPECS) -> DataFrame:
    """Joins the header rows at a table's top into the last of them.

    A row leads into the next if that has clearly more filled cells and neither looks like data. A leaf that stands for
    a metric by itself is left alone; else its column's distinct texts are joined. Rows above the leaves go.
    """
    top = cells.where((F.col("row_idx") <= SCAN) & _filled())
    rows = top.groupBy(*ROW).agg(F.count(F.lit(1)).alias("filled"), F.avg(_is_number().cast("int")).alias("numeric"))
    after = rows.select(*TABLE, (F.col("row_idx") - 1).alias("row_idx"), F.col("filled").alias("next_filled"), F.col("numeric").alias("next_numeric"))
    leads = rows.join(after, ROW).where((F.col("row_idx") < SCAN) & (F.col("next_filled") > GROWTH * F.col("filled")) & (F.col("numeric") <= NUMERIC) & (F.col("next_numeric") <= NUMERIC))
    # What holds for a table is written first: it is known to be small then, and cells are not shuffled to meet it.
    until = staged(leads.groupBy(*TABLE).agg((F.max("row_idx") + 1).alias("until")), "annex-until")
    marked = cells.join(until, TABLE, "left")
    head = marked.where(F.col("row_idx") <= F.col("until"))
    leaf = F.max(F.when(F.col("row_idx") == F.col("until"), F.trim("text")))
    parts = F.sort_array(F.collect_list(F.when(_filled(), F.struct("row_idx", F.trim("text").alias("t")))))
    merged = head.groupBy(*TABLE, "until", "col_idx").agg(leaf.alias("leaf"), F.array_join(F.array_distinct(F.transform(parts, lambda p: p["t"])), " ").alias("all"))
    alone = F.exists(header_matches(F.col("leaf"), specs), lambda m: m["score"] >= LEAF)
    merged = merged.select(*TABLE, F.col("until").alias("row_idx"), "col_idx", F.when(F.coalesce(alone, F.lit(False)), F.col("leaf")).otherwise(F.col("all")).alias("text"))
    rest = marked.where(F.col("until").isNull() | (F.col("row_idx") > F.col("until"))).select(*cells.columns)
    return rest.unionByName(merged.where(_filled()))


def _adopt(tables: pd.DataFrame) -> pd.DataFrame:
    """A document's table summaries -> owner of each table: its own number, or that of the table it continues."""
    owner, out, width, column, last = None, [], 0, None, float("-inf")
    for t in tables.sort_values("table_idx").to_dict("records"):
        ids = {c["col_idx"]: (c["lo"], c["hi"]) for c in t["ids"]}
        if t["header"]:
            owner, width = t["table_idx"], t["width"]
            column = None if pd.isna(t["loan_col"]) else int(t["loan_col"])
            last = ids[column][1] if column in ids else float("-inf")
        elif owner is None or not width or abs(t["width"] - width) > 1:
            continue
        elif column is not None:
            if column not in ids or ids[column][0] <= last:
                continue
            last = max(last, ids[column][1])
        out.append((t["doc_id"], t["table_idx"], owner))
    return pd.DataFrame(out, columns=["doc_id", "table_idx", "owner"])


def attach_continuations(cells: DataFrame, headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Tables without a header become rows of the table that they continue: as wide but for one column, and with higher loan numbers.

    Tables that continue nothing go.
    """
    loan_col = mapping.where(F.col("metric_key") == "loan_id").select(*TABLE, F.col("col_idx").alias("loan_col"))
    known = cells.join(headers, TABLE, "left").where(F.col("header_row").isNull() | (F.col("row_idx") > F.col("header_row")))
    widths = known.where(F.col("text").isNotNull()).groupBy(*ROW).agg(F.count(F.lit(1)).alias("w")).groupBy(*TABLE, "w").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first"))
    widths = widths.groupBy(*TABLE).agg(F.max_by("w", F.struct("n", -F.col("first"))).alias("width"))
    n = _number(F.col("text"))
    ids = known.where((n > 0) & (n < MOST_ID)).groupBy(*TABLE, "col_idx").agg(F.min(n).alias("lo"), F.max(n).alias("hi"))
    ids = ids.groupBy(*TABLE).agg(F.collect_list(F.struct("col_idx", "lo", "hi")).alias("ids"))
    every = cells.groupBy(*TABLE).agg((F.max("row_idx") + 1).alias("rows"))
    summary = every.join(headers, TABLE, "left").join(loan_col, TABLE, "left").join(widths, TABLE, "left").join(ids, TABLE, "left")
    summary = summary.select(*TABLE, F.col("header_row").isNotNull().alias("header"), "loan_col", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("ids", F.array().cast(ids.schema["ids"].dataType)).alias("ids"))
    owners = summary.groupBy("doc_id").applyInPandas(_adopt, "doc_id string, table_idx int, owner int")
    offset = F.coalesce(F.sum("rows").over(Window.partitionBy("doc_id", "owner").orderBy("table_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = staged(owners.join(every, TABLE).withColumn("offset", offset.cast("int")), "annex-placed")
    return cells.join(placed, TABLE).select("doc_id", F.col("owner").alias("table_idx"), (F.col("row_idx") + F.col("offset")).alias("row_idx"), "col_idx", "text")


def stack_pages(cells: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables with the same headers become one, in the order of their pages; cells and header rows of what is left."""
    head = cells.join(headers, TABLE).where("row_idx = header_row").where(_filled())
    texts = F.transform(F.sort_array(F.collect_list(F.struct("col_idx", F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("t")))), lambda x: x["t"])
    pages = head.groupBy(*TABLE, "header_row").agg(F.array_join(texts, "|").alias("signature"))
    same = Window.partitionBy("doc_id", "signature")
    pages = pages.withColumn("owner", F.min("table_idx").over(same))
    rows = cells.groupBy(*TABLE).agg((F.max("row_idx") + 1).alias("rows"))
    before = same.orderBy("table_idx").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.join(rows, TABLE).withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("int")).drop("signature")
    pages = staged(pages, "annex-pages")
    kept = cells.join(pages, TABLE).where((F.col("table_idx") == F.col("owner")) | (F.col("row_idx") > F.col("header_row")))
    out = kept.select("doc_id", F.col("owner").alias("table_idx"), (F.col("row_idx") + F.col("offset")).alias("row_idx"), "col_idx", "text")
    return out, pages.where("table_idx = owner").select(*TABLE, "header_row")


def loan_key(x: Column) -> Column:
    """`3.00` and `3` are one loan; other texts stand for themselves in small letters."""
    n = _number(x)
    return F.when(F.trim(x) == "", None).when(n.isNotNull(), F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))).otherwise(F.lower(F.trim(x)))


def join_tables(cells: DataFrame, headers: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One table for each document: the one with most metrics, widened by the columns that others have for its loans.

    A header counts once: the best table that has it gives its columns. A table joins if its loans cover half of the
    smaller table. A document with fewer than two tables that name loans keeps its best table.
    """
    scores = mapping.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("score"), F.max(F.when(F.col("metric_key") == "loan_id", F.col("col_idx"))).alias("loan_col"))
    body = cells.join(headers, TABLE).where("row_idx > header_row")
    # Every row counts, also one of a single cell.
    n_rows = body.groupBy(*TABLE).agg(F.count_distinct("row_idx").alias("rows"))
    tables = scores.join(n_rows, TABLE).withColumn("named", F.col("loan_col").isNotNull().cast("int"))
    tables = tables.withColumn("several", F.sum("named").over(Window.partitionBy("doc_id")) >= 2)
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.when(F.col("several"), F.col("named")).otherwise(0)), F.desc("score"), "table_idx")
    tables = tables.withColumn("place", F.row_number().over(order)).where((F.col("place") == 1) | (F.col("several") & (F.col("named") == 1)))
    tables = staged(tables, "annex-tables")
    keys = body.join(tables.where("named = 1").select(*TABLE, "loan_col", "place", "rows"), TABLE).where("col_idx = loan_col").select(*TABLE, "row_idx", "place", "rows", loan_key(F.col("text")).alias("k")).where(F.col("k").isNotNull())
    base = keys.where("place = 1").groupBy("doc_id", "k").agg(F.max("row_idx").alias("base_row"), F.first("rows").alias("base_rows"))
    met = keys.where("place > 1").join(base, ["doc_id", "k"])
    enough = met.groupBy(*TABLE, "place", "rows", "base_rows").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= OVERLAP * F.least("rows", "base_rows")).select(*TABLE, "place")
    first = tables.where("place = 1").select(*TABLE, "place")
    # The first table in order that has a header owns it.
    head = cells.join(headers, TABLE).where("row_idx = header_row").where(_filled()).join(first.unionByName(enough), TABLE)
    head = head.withColumn("name", F.lower(F.trim("text"))).withColumn("owner", F.min("place").over(Window.partitionBy("doc_id", "name")))
    owned = head.where("place = owner").select(*TABLE, "place", "col_idx", F.col("text").alias("header"))
    owned = owned.withColumn("new_col", F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "col_idx")) - 1)
    owned = staged(owned, "annex-columns")
    top = owned.select("doc_id", F.lit(0).alias("table_idx"), F.lit(0).alias("row_idx"), F.col("new_col").alias("col_idx"), F.col("header").alias("text"))
    first_row = body.join(first.select(*TABLE), TABLE).select("doc_id", "row_idx", "col_idx", "text")
    mine = first_row.join(owned.where("place = 1").select("doc_id", "col_idx", "new_col"), ["doc_id", "col_idx"]).select("doc_id", "row_idx", "new_col", "text")
    last = met.groupBy(*TABLE, "k", "base_row").agg(F.max("row_idx").alias("row_idx"))
    theirs = body.join(last, ROW).join(owned.where("place > 1").select(*TABLE, "col_idx", "new_col"), [*TABLE, "col_idx"]).select("doc_id", F.col("base_row").alias("row_idx"), "new_col", "text")
    rows = mine.unionByName(theirs).select("doc_id", F.lit(0).alias("table_idx"), (F.col("row_idx") + 1).alias("row_idx"), F.col("new_col").alias("col_idx"), "text")
    return top.unionByName(rows), first.select("doc_id", F.lit(0).alias("table_idx"), F.lit(0).alias("header_row"))


def split_rows(cells: DataFrame, headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """doc_id, table_idx, row_idx, kind of every row below the header: loan, property, unknown or phantom.

    A phantom has neither a name nor an amount, or no letter at all; where they are more than a few, or the table has
    neither column, none is. A flag column tells properties; without one, a fraction in the loan's number does.
    """
    at = mapping.groupBy(*TABLE).agg(*[F.max(F.when(F.col("metric_key") == k, F.col("col_idx"))).alias(k) for k in ("property_name", "loan_amount", "loan_id", "loan_property_flag")])
    at = staged(at, "annex-places")
    body = cells.join(headers, TABLE).where("row_idx > header_row").join(at, TABLE, "left")
    has = lambda k, cond: F.coalesce(F.bool_or((F.col("col_idx") == F.col(k)) & cond), F.lit(False))
    text = lambda k: F.trim(F.max(F.when(F.col("col_idx") == F.col(k), F.col("text"))))
    rows = body.groupBy(*ROW).agg(
        (F.first("property_name").isNotNull() | F.first("loan_amount").isNotNull()).alias("judged"),
        F.first("loan_property_flag").isNotNull().alias("flagged"),
        ((has("property_name", _filled()) | has("loan_amount", F.col("text").rlike("[0-9]"))) & F.coalesce(F.bool_or(F.col("text").rlike("[a-zA-Z]")), F.lit(False))).alias("real"),
        F.lower(text("loan_property_flag")).alias("flag"),
        text("loan_id").alias("id"),
    )
    share = F.avg((~F.col("real")).cast("int")).over(Window.partitionBy(*TABLE))
    n = F.col("id").try_cast("double")
    by_id = F.when(n.isNull(), "unknown").when(F.abs(n - F.round(n)) > FRACTION, "property").otherwise("loan")
    by_flag = F.when(F.col("flag").isin("loan", "property"), F.col("flag")).otherwise("unknown")
    kind = F.when(F.col("judged") & ~F.col("real") & (share <= PHANTOM), "phantom").when(F.col("flagged"), by_flag).otherwise(by_id)
    return rows.select(*ROW, kind.alias("kind"))


def loan_cells(cells: DataFrame, headers: DataFrame, kinds: DataFrame) -> DataFrame:
    """Headers, and the rows that are neither properties nor phantoms."""
    out = cells.join(headers, TABLE).join(kinds, ROW, "left")
    return out.where((F.col("row_idx") <= F.col("header_row")) | F.col("kind").isin("loan", "unknown")).select(*cells.columns)


def properties(observations: DataFrame, cells: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row for each property: its number, its loan's, and what is observed of it.

    The number's column is the one that looks like numbers of properties in most rows, if in more than half of them.
    """
    rows = kinds.where("kind = 'property'").select(*ROW)
    own = cells.join(rows, ROW)
    looks = own.where(F.trim("text").rlike(r"^[0-9]+\.[0-9]+$")).groupBy(*TABLE, "col_idx").agg(F.count(F.lit(1)).alias("n"))
    total = rows.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("total"))
    column = looks.join(total, TABLE).where(F.col("n") > F.col("total") / 2).groupBy(*TABLE).agg(F.max_by("col_idx", F.struct("n", -F.col("col_idx"))).alias("ref_col"))
    ref = own.join(column, TABLE).where("col_idx = ref_col").select(*ROW, F.trim("text").alias("property_ref"))
    keys = ("property_name", "address", "city", "state", "zip", "property_type")
    seen = observations.join(rows, ROW, "left_semi").groupBy(*ROW).agg(*[F.max(F.when(F.col("metric_key") == k, F.col("value"))).alias(k) for k in keys])
    number = F.col("property_ref").try_cast("double")
    return rows.join(ref, ROW, "left").join(seen, ROW, "left").withColumn("loan_ref", F.when(number.isNotNull(), F.floor(number).cast("string")))


def with_loan(props: DataFrame, loans: DataFrame) -> DataFrame:
    """Adds loan_id to properties by their loan's whole number; loans: doc_id, loan_id, loan_ref."""
    key = F.floor(F.col("loan_ref").try_cast("double")).cast("string")
    first = loans.where(key.isNotNull()).groupBy("doc_id", key.alias("loan_ref")).agg(F.min("loan_id").alias("loan_id"))
    return props.join(first, ["doc_id", "loan_ref"], "left")


def route_units(observations: DataFrame) -> DataFrame:
    """Units whose measure is an area are square feet; where a row has those already, such units go."""
    row = Window.partitionBy(*ROW)
    is_ = lambda k: F.col("metric_key") == k
    area = F.coalesce(F.bool_or(is_("unit_of_measure") & F.trim("value").rlike(AREA_MEASURES)).over(row), F.lit(False))
    out = observations.withColumns({"__area": area, "__own": F.bool_or(is_("square_feet")).over(row)})
    out = out.where(~(is_("units") & F.col("__area") & F.col("__own")))
    return out.withColumn("metric_key", F.when(is_("units") & F.col("__area"), "square_feet").otherwise(F.col("metric_key"))).drop("__area", "__own")


#: Metrics whose values don't repeat in many loans, and ideas that most rows have: fixed values.
CONTINUOUS = ("interest_rate", "noi_underwritten", "loan_amount", "appraised_value")
CORE_IDEAS = {"NOI": ("noi_underwritten", "noi_most_recent"), "occupancy": ("occupancy", "occupancy_economic"), "loan_amount": ("loan_amount",)}


def sanity_issues(observations: DataFrame) -> DataFrame:
    """doc_id, severity, metric, bad, n: what can't be right in a document's observations."""
    o = observations.withColumn("v", F.col("value").try_cast("double"))

    def outside(metric: str, bad: Column, severity: Column, when: Column) -> DataFrame:
        rows = o.where((F.col("metric_key") == metric) & F.col("v").isNotNull()).groupBy("doc_id").agg(F.count_if(bad).alias("bad"), F.count(F.lit(1)).alias("n"))
        return rows.where((F.col("bad") > 0) & when).select("doc_id", severity.alias("severity"), F.lit(metric).alias("metric"), "bad", "n")

    v, share, always = F.col("v"), F.col("bad") / F.col("n"), F.lit(True)
    error, warning = F.lit("error"), F.lit("warning")
    found = [
        outside("occupancy", (v < 0) | (v > 1), error, always),
        outside("ltv", (v <= 0) | (v > 1.2), warning, share > 0.1),
        outside("dscr", (v <= 0) | (v > 10), warning, always),
        outside("interest_rate", (v < 0.01) | (v > 0.2), F.when(share > 0.2, "error").otherwise("warning"), always),
        outside("cap_rate", (v < 0.02) | (v > 0.15), warning, always),
        outside("units", v > 5000, warning, share > 0.2),
    ]
    repeats = o.where(F.col("metric_key").isin(*CONTINUOUS) & (F.col("value") != "")).groupBy("doc_id", "metric_key", "value").agg(F.count(F.lit(1)).alias("k")).groupBy("doc_id", "metric_key").agg(F.max("k").alias("bad"), F.sum("k").alias("n"))
    found.append(repeats.where((F.col("n") >= 20) & (F.col("bad") / F.col("n") > 0.15)).select("doc_id", error.alias("severity"), F.col("metric_key").alias("metric"), "bad", "n"))
    upper = lambda k: F.element_at(F.sort_array(F.collect_list(F.when(F.col("metric_key") == k, v))), (F.floor(F.count(F.when(F.col("metric_key") == k, v)) / 2) + 1).cast("int"))
    pair = o.where(F.col("metric_key").isin("noi_underwritten", "loan_amount") & v.isNotNull()).groupBy("doc_id")
    counts = pair.agg(F.count_if(F.col("metric_key") == "noi_underwritten").alias("a"), F.count_if(F.col("metric_key") == "loan_amount").alias("b")).where("a > 0 and b > 0").select("doc_id")
    crossed = o.join(counts, "doc_id", "left_semi").where(F.col("metric_key").isin("noi_underwritten", "loan_amount") & v.isNotNull()).groupBy("doc_id").agg(upper("noi_underwritten").alias("noi"), upper("loan_amount").alias("loan"), F.count(F.lit(1)).alias("n"))
    found.append(crossed.where("noi > loan").select("doc_id", error.alias("severity"), F.lit("noi_underwritten").alias("metric"), F.col("n").alias("bad"), "n"))
    rows = o.select("doc_id", "table_idx", "row_idx").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    by_metric = o.groupBy("doc_id", "metric_key").agg(F.count_distinct("table_idx", "row_idx").alias("k"))
    for idea, keys in CORE_IDEAS.items():
        best = by_metric.where(F.col("metric_key").isin(*keys)).groupBy("doc_id").agg(F.max("k").alias("k"))
        low = rows.join(best, "doc_id", "left").withColumn("k", F.coalesce("k", F.lit(0))).where(F.col("k") / F.col("n") < 0.5)
        found.append(low.select("doc_id", warning.alias("severity"), F.lit(idea).alias("metric"), (F.col("n") - F.col("k")).alias("bad"), "n"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def header_ties(cells: DataFrame, headers: DataFrame, specs: tuple = SPECS) -> DataFrame:
    """doc_id, metric_key, score, headers, winner: metrics for which the order of columns alone decided.

    cells and headers are those of the joined table, where columns of all blocks compete. Headers that differ in
    blanks or case only are the same column of two blocks, and no tie. headers stand from left to right.
    """
    named = cells.join(headers, TABLE).where("row_idx = header_row").where(_filled())
    scored = named.select("doc_id", "col_idx", F.col("text").alias("header"), F.explode(header_matches(F.col("text"), specs)).alias("m")).select("doc_id", "col_idx", "header", "m.metric_key", "m.score")
    best = scored.withColumn("best", F.max("score").over(Window.partitionBy("doc_id", "metric_key"))).where("score = best")
    once = best.groupBy("doc_id", "metric_key", "score", F.lower(F.regexp_replace("header", r"\s+", "")).alias("k")).agg(F.min(F.struct("col_idx", "header")).alias("x"))
    ties = once.groupBy("doc_id", "metric_key", "score").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["header"]).alias("headers"))
    return ties.where(F.size("headers") > 1).withColumn("winner", F.get("headers", F.lit(0)))


def explain_headers(cells: DataFrame, headers: DataFrame, mapping: DataFrame, metric: str, like: str, specs: tuple = SPECS) -> DataFrame:
    """doc_id, table_idx, header, verdict, taken_by, score: for headers that `like` matches, why they stand for `metric` or don't.

    Verdicts: mapped, excluded, no pattern, taken (its column stands for another metric), not assigned (it fits, but
    another column was better).
    """
    place, (_, _, patterns, exclude) = next((i, s) for i, s in enumerate(specs) if s[0] == metric)
    named = cells.join(headers, TABLE).where("row_idx = header_row").where(_filled() & F.col("text").rlike(like))
    t = F.lower(F.trim("text"))
    own = mapping.select(*TABLE, "col_idx", F.col("metric_key").alias("taken_by"))
    found = named.join(own, [*TABLE, "col_idx"], "left")
    score = F.get(F.filter(header_matches(F.col("text"), specs), lambda m: m["spec"] == place), F.lit(0))["score"]
    fits = t.rlike("|".join(f"(?:{p})" for p in patterns))
    killed = t.rlike(exclude) if exclude else F.lit(False)
    verdict = F.when(F.col("taken_by") == metric, "mapped").when(killed, "excluded").when(~fits, "no pattern").when(F.col("taken_by").isNotNull(), "taken").otherwise("not assigned")
    return found.select(*TABLE, F.col("text").alias("header"), verdict.alias("verdict"), "taken_by", F.coalesce(score, F.lit(0.0)).alias("score"))
