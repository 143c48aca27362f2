"""Quality rules with a hashed n-gram log-likelihood ratio, with DataFrame functions only.

Two multinomials over hashed word n-grams are counted for each length: one over all of the corpus, one over a
bounded sample of trusted documents. A document's score is the mean over its n-grams of log p(trusted) - log p(corpus),
that of the length for which it is lowest, so that pairs can only add to what single words reject. Every
document whose score is below a fixed threshold is rejected, besides those that fail the base rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, durable, text_or_empty

#: Hash buckets of single words; the weight table has one row for each bucket, so it may be broadcast.
BUCKETS = 1 << 14
#: So many times more buckets for each longer n-gram, which has buckets of its own.
LONGER = 16
#: Lengths of the n-grams in words, if none are asked for.
ORDERS = (1,)
#: Those of the query and of the pipeline: pairs tell text from the same words in another order.
WORDS_AND_PAIRS = (1, 2)
#: Mean log-likelihood ratio that a document must reach.
THRESHOLD = -0.35
#: The trusted multinomial is fitted on at most so many labelled documents, those with the smallest hashes.
TRUSTED_DOCS = 20_000
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"


def bucket_counts(orders: tuple, n: int) -> list[int]:
    """Buckets of each order; they follow each other."""
    return [n if k == 1 else n * LONGER for k in orders]


def word_hashes(words: Column) -> Column:
    """Array of one hash for each word; n-grams and windows are hashed from these, so that each word is read once."""
    return F.transform(words, lambda w: F.xxhash64(F.lit(1), w))


def buckets(hashes: Column, orders: tuple = ORDERS, n: int = BUCKETS) -> Column:
    """Array of the hashed n-grams of an array of words' hashes."""
    counts = bucket_counts(orders, n)

    def of(o: int, k: int) -> Column:
        place = lambda h: (F.pmod(h, F.lit(counts[o])) + sum(counts[:o])).cast("int")
        if k == 1:
            return F.transform(hashes, place)
        starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (k - 1), F.lit(0)))
        return F.transform(starts, lambda h, i: place(F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, k)])))

    return F.concat(*[of(o, k) for o, k in enumerate(orders)])


def with_repeated_words(rows: DataFrame) -> DataFrame:
    """Turns windows (hashes of the 3-word windows, in order) into n_repeat_words: words in a window found twice or more.

    Windows are sorted with their positions; those equal to a neighbour are repeated. Each covers three words,
    less what the next repeated window covers too. Every step is a column of its own, so that lambdas refer to
    a value and not to an expression that is worked out again for each element.
    """
    windows, by_hash, at = F.col("windows"), F.col("by_hash"), F.col("at")
    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    same_as = lambda x, i: F.coalesce(F.get(by_hash, i)["h"] == x["h"], F.lit(False))
    out = rows.withColumn("by_hash", F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.array_sort(pairs)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    out = out.withColumn("at", F.array_sort(F.transform(F.filter(by_hash, lambda x, i: same_as(x, i - 1) | same_as(x, i + 1)), lambda x: x["i"])))
    steps = F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(3)), F.lit(3)))
    return out.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0), lambda a, b: a + b).cast("long")).drop("windows", "by_hash", "at")


def base_columns(rows: DataFrame) -> DataFrame:
    """Adds hashes (of the words), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed to rows with a non-null text."""
    t, words, hashes = F.col("text"), F.col("words"), F.col("hashes")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    out = rows.withColumn("words", F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1))).withColumn("hashes", word_hashes(words))
    out = out.select(
        "*",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2))).alias("windows"),
    )
    out = out.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    out = with_repeated_words(out.drop("lines", "words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def ngram_weights(docs: DataFrame, labels: DataFrame, orders: tuple = ORDERS, n: int = BUCKETS, trusted_docs: int = TRUSTED_DOCS) -> DataFrame:
    """bucket, weight: log-likelihood ratio of each bucket that the corpus has.

    Each order is a multinomial of its own. The corpus counts get one added each; the trusted counts are smoothed towards the corpus, by a prior worth
    one n-gram a bucket, so that words that a small trusted sample happens to lack don't count against a text.

    Weights are null if no trusted document is found: then there is no verdict to give.
    """
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select(F.col("doc_id").alias("good_id")).distinct()
    good = good.orderBy(F.xxhash64("good_id"), "good_id").limit(trusted_docs)
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("words", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    rows = rows.join(F.broadcast(good), rows["doc_id"] == good["good_id"], "left")
    rows = rows.select(F.col("good_id").isNotNull().cast("long").alias("good"), word_hashes(F.col("words")).alias("hashes"))
    grams = rows.select("good", F.explode(buckets(F.col("hashes"), orders, n)).alias("bucket"))
    # Written once, one row a bucket: totals and weights are both read from it.
    counts = durable(grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good")), "ngrams")
    order, size, start = F.lit(0), F.lit(n), 0
    for o, m in enumerate(bucket_counts(orders, n)):
        mine = F.col("bucket") >= start
        order, size, start = F.when(mine, o).otherwise(order), F.when(mine, m).otherwise(size), start + m
    counts = counts.withColumns({"order": order, "n": size})
    totals = counts.groupBy("order").agg(F.sum("raw").alias("raw_total"), F.sum("good").alias("good_total"))
    both = counts.join(F.broadcast(totals), "order")
    p_raw = (F.col("raw") + 1) / (F.col("raw_total") + F.col("n"))
    weight = F.log((F.col("good") + F.col("n") * p_raw) / (F.col("good_total") + F.col("n"))) - F.log(p_raw)
    return both.select("bucket", F.when(F.col("good_total") > 0, weight).alias("weight"))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, orders: tuple = ORDERS, n: int = BUCKETS, carry: tuple = ()) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.

    Null text is empty: no words, base_failed. `carry` names further columns of docs to keep, as "in_<name>".
    Rows with a null doc_id are judged like others (they can't be trusted samples); repeated rows are judged
    each. Without any trusted document the method gives no verdict and the base rules alone decide. An empty
    table gives an empty result.
    """
    weights = ngram_weights(docs, labels, orders, n)
    kept_in = [F.col(c).alias(f"in_{c}") for c in carry]
    # The n-grams of a row are summed in the task that explodes them; a row number tells repeated rows apart.
    rows = base_columns(docs.select("doc_id", text_or_empty().alias("text"), *kept_in)).withColumn("row", F.monotonically_increasing_id())
    base = ["doc_id", *[f"in_{c}" for c in carry], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    flat = rows.select("row", *base, F.explode_outer(buckets(F.col("hashes"), orders, n)).alias("bucket"))
    scored = flat.join(F.broadcast(weights), "bucket", "left")
    means, start = [], 0
    for m in bucket_counts(orders, n):
        means.append(F.avg(F.when((F.col("bucket") >= start) & (F.col("bucket") < start + m), F.col("weight"))))
        start += m
    scored = scored.groupBy("row", *base).agg((F.least(*means) if len(means) > 1 else means[0]).alias("llr"))
    return scored.select(*base, (~F.col("base_failed") & (F.coalesce(F.round("llr", 9), F.lit(math.inf)) >= threshold)).alias("kept"), "llr")
