"""Which documents of a trust to read: scores of file names, best filings with a fallback, reports by month or spaced in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_SCORE = 0.5
MOST_PICKS = 3
ALTERNATIVES = 4
#: Months whose reports carry closed years, best first.
PREFERRED_MONTHS = (4, 3, 5, 2)
MONTH_DAYS, SLACK_DAYS = 30.44, 10

# Forms, name and description patterns with their weights, sizes in bytes.
ANNEX_FORMS = r"(?i)^(FWP|424B[0-9]?|424H)$"
PROSPECTUS_FORMS = r"(?i)^(424B[0-9]?|424H)$"
ANNEX_NAMES = ((r"annex[-_]?a", 0.55), (r"anx\s*a?-?\d?", 0.5), (r"annex", 0.3), (r"[-_]a-?1?(?=\.[a-z]+$)", 0.45))
ANNEX_TEXTS = ((r"annex\s*_?-?a", 0.2), (r"annex", 0.1))
EXHIBIT_NAMES = ((r"ex-?99[._-]?1(?![0-9])", 0.6), (r"ex-?99", 0.4), (r"exh?[-_]?99", 0.35))
ANNEX_LARGE, ANNEX_SMALL = 500_000, 100_000
EXHIBIT_LARGE, EXHIBIT_FAIR, EXHIBIT_SMALL = 200_000, 40_000, 8_000
PROSPECTUS_LEAST = 5_000_000


def _first_weight(text: Column, patterns: tuple) -> Column:
    out = F.when(F.lit(False), 0.0)
    for pattern, weight in patterns:
        out = out.when(text.rlike(pattern), weight)
    return out.otherwise(0.0)


def _clamped(score: Column) -> Column:
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 6)


def _lower(x: str) -> Column:
    return F.lower(F.coalesce(F.col(x), F.lit("")))


def annex_score(form: str = "form", name: str = "document_name", text: str = "description", size: str = "size_bytes") -> Column:
    """How much a filing looks like the annex of loans, 0 to 1: its name above all, its description, its size."""
    size_c = F.coalesce(F.col(size), F.lit(0))
    by_size = F.when(size_c > ANNEX_LARGE, 0.2).when(size_c < ANNEX_SMALL, -0.4).otherwise(0.0)
    score = _clamped(_first_weight(_lower(name), ANNEX_NAMES) + _first_weight(_lower(text), ANNEX_TEXTS) + by_size)
    return F.when(F.coalesce(F.col(form), F.lit("")).rlike(ANNEX_FORMS), score).otherwise(0.0)


def prospectus_score(form: str = "form", size: str = "size_bytes") -> Column:
    """A prospectus as a stand-in: only large ones hold a pool, final ones are better than preliminary ones."""
    f = F.coalesce(F.col(form), F.lit(""))
    large = F.coalesce(F.col(size), F.lit(0)) >= PROSPECTUS_LEAST
    return F.when(f.rlike(PROSPECTUS_FORMS) & large, F.when(f.rlike("(?i)424b"), 0.4).otherwise(0.35)).otherwise(0.0)


def exhibit_score(name: str = "document_name", size: str = "size_bytes") -> Column:
    """How much a file of a monthly filing looks like the servicer's report, 0 to 1."""
    n, s = _lower(name), F.coalesce(F.col(size), F.lit(0))
    base = _first_weight(n, EXHIBIT_NAMES)
    by_size = F.when(s > EXHIBIT_LARGE, 0.3).when(s > EXHIBIT_FAIR, 0.2).when(s < EXHIBIT_SMALL, -0.3).otherwise(0.0)
    usable = n.rlike(r"\.(htm|html|txt)$") & ~n.rlike(r"_10-?d[-_.]") & (base > 0)
    return F.when(usable, _clamped(base + by_size)).otherwise(0.0)


def _top(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each trust, with their place; Spark drops the others before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("cik").orderBy(*order))).where(F.col("place") <= k)


def pick_annexes(filings: DataFrame, least: float = LEAST_SCORE, most: int = MOST_PICKS, fallback: bool = True) -> DataFrame:
    """cik, accession, document_name, score, place, fallback, alternatives: the filings to read for each trust.

    filings: cik, seq (order in the trust's list), accession, form, document_name, description, size_bytes.
    Those that score at least `least` count, at most `most` a trust, equal scores in the list's order. A trust
    without any gets its best prospectus (score, then size, then order). alternatives are the best-scored
    other filings with their scores, as "name:score" texts.
    """
    scored = filings.withColumn("score", annex_score())
    good = scored.where(F.col("score") > 0)
    picked = _top(good.where(F.col("score") >= least), [F.desc("score"), F.col("seq")], most).withColumn("fallback", F.lit(False))
    if fallback:
        rest = filings.withColumn("score", prospectus_score()).where(F.col("score") > 0)
        rest = rest.join(picked.select("cik").distinct(), "cik", "left_anti")
        rest = _top(rest, [F.desc("score"), F.desc("size_bytes"), F.col("seq")], 1).withColumn("fallback", F.lit(True))
        picked = picked.unionByName(rest)
    # A trust's pick can take at most one of these places, so one more than is shown is enough.
    others = _top(good, [F.desc("score"), F.col("seq")], ALTERNATIVES + 1)
    others = others.groupBy("cik").agg(F.array_sort(F.collect_list(F.struct("place", "accession", F.concat("document_name", F.lit(":"), F.format_string("%.2f", "score")).alias("text")))).alias("others"))
    left = F.filter("others", lambda x: x["accession"] != F.col("accession"))
    texts = F.transform(F.slice(F.coalesce(left, F.array().cast("array<struct<place:int,accession:string,text:string>>")), 1, ALTERNATIVES), lambda x: x["text"])
    return picked.join(others, "cik", "left").select("cik", "accession", "document_name", "score", "place", "fallback", texts.alias("alternatives"))


def listed(filings: DataFrame, limit: int = 40) -> DataFrame:
    """The first filings of each trust's list with their scores, for a look by hand."""
    return _top(filings.withColumn("score", F.round(annex_score(), 2)), [F.col("seq")], limit)


def _monthly(filings: DataFrame, since: str | None) -> DataFrame:
    out = filings.where(F.col("form").rlike("^10-D"))
    out = out.where(F.col("filed_at") >= F.lit(since).cast("date")) if since else out
    return out.withColumn("dated", F.coalesce("period", "filed_at"))


def preferred_reports(filings: DataFrame, months: tuple = PREFERRED_MONTHS, since: str | None = None) -> DataFrame:
    """Monthly filings (cik, accession, form, filed_at, period) with their place: by month preferred, then the newest first."""
    out = _monthly(filings, since)
    rank = F.array_position(F.array(*map(F.lit, months)), F.month("dated"))
    order = [F.when(rank > 0, rank).otherwise(len(months) + 1), F.desc("filed_at"), F.col("accession")]
    return _top(out, order, 2**31 - 1)


def spaced_reports(filings: DataFrame, every_months: int, since: str | None = None) -> DataFrame:
    """Monthly filings with their place: the newest, then each next one that is far enough from the last one kept.

    The distance is between dates, not places, since trusts skip months. The fold needs a trust's dates
    together: some hundred, one a month; filings of one date compete by accession.
    """
    out = _monthly(filings, since).where(F.col("dated").isNotNull())
    lists = out.groupBy("cik").agg(F.array_sort(F.collect_list(F.struct((-F.unix_date("dated")).alias("back"), "accession"))).alias("all"))
    nothing = F.array().cast("array<struct<back:int,accession:string>>")

    def step(kept: Column, x: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)["back"]
        far = x["back"] - last >= every_months * MONTH_DAYS - SLACK_DAYS
        return F.when(last.isNull() | far, F.concat(kept, F.array(x))).otherwise(kept)

    kept = lists.select("cik", F.posexplode(F.aggregate("all", nothing, step)).alias("at", "x")).select("cik", F.col("x.accession").alias("accession"), (F.col("at") + 1).alias("place"))
    return out.join(kept, ["cik", "accession"])


def pick_reports(candidates: DataFrame, files: DataFrame, most: int = 1, least: float = LEAST_SCORE) -> DataFrame:
    """The first reports of each trust that have a usable file, with that file.

    candidates: cik, accession, place (of preferred_reports or spaced_reports). files: accession, seq, document_name,
    size_bytes. A filing without a file that scores at least `least` is passed over; of its files the best one
    counts, the first among equals.
    """
    scored = files.withColumn("score", exhibit_score()).where(F.col("score") >= least)
    best = scored.groupBy("accession").agg(F.min_by(F.struct("document_name", "size_bytes", "score"), F.struct(-F.col("score"), F.col("seq"))).alias("file"))
    return _top(candidates.drop("place").join(best, "accession").join(candidates.select("accession", F.col("place").alias("order")), "accession"), [F.col("order")], most).select("*", "file.*").drop("file", "order")
