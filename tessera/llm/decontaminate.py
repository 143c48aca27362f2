"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

An item's windows are sets of word shingles. As a window occurs only where all its shingles do, a prefix of one shingle
is necessary, and the rarest one in the documents is taken. Documents that have a prefix are joined with these prefixes;
a match tells where a window would have to start, which must lie within the document, and the words there are compared
with the window's. Windows with a shingle that no document has are not searched for at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, text_or_empty, with_group_totals

#: Words are runs of digits, letters a-z in any case, and whatever is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: Words of a shingle; a shorter window is one shingle.
SHINGLE = 5
#: Words of a text that go on together, besides what their windows reach into the neighbours.
BLOCK = 512
#: What one broadcast may hold: rows, and bytes of windows. A larger benchmark is searched for in parts.
PART_ROWS = 1_000_000
PART_BYTES = 128 << 20
#: Texts that are named in a broadcast because they have a prefix (8 bytes each); beyond it all texts are read again.
LIKELY_ROWS = 4_000_000
#: Shingle and offset of the row that stands for a document itself.
SELF, NOWHERE = 0, -1


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_hashes(words: Column) -> Column:
    """One hash a word; words that differ in case only share it, so it finds all that lower_ascii makes equal, and some more."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def shingles(hashes: Column, size: int) -> Column:
    """Array of the hashes of all runs of so many words: for the few words of windows."""
    starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (size - 1), F.lit(0)))
    return F.transform(starts, lambda h, i: F.xxhash64(F.lit(size), h, *[F.get(hashes, i + j) for j in range(1, size)]))


def exploded(rows: DataFrame, sizes: list[int], own: Column | None = None) -> DataFrame:
    """rows (with hashes) with pos and shingle for every shingle of each size, and one row with shingle SELF and pos NOWHERE for each row of rows where `own` is not false.

    Positions are exploded and hashed row by row, which Spark compiles; lambdas over arrays it does not.
    """
    n = F.size("hashes")
    flat = rows.select("*", F.posexplode(F.concat("hashes", F.array(F.lit(0).cast("long")))).alias("pos", "h"))
    mine = F.col("pos") == n

    def shingle(size: int) -> Column:
        return F.when(F.col("pos") + size <= n, F.xxhash64(F.lit(size), F.col("h"), *[F.get("hashes", F.col("pos") + j) for j in range(1, size)]))

    every = [shingle(size) for size in sizes]
    if own is not None:
        first = F.when(mine & own, F.lit(SELF).cast("long"))
        every = [F.coalesce(first, every[0]), *every[1:]] if every else [first]
    out = flat.withColumn("shingle", every[0] if len(every) == 1 else F.explode(F.array(*every)))
    return out.where(F.col("shingle").isNotNull()).withColumn("pos", F.when(mine, NOWHERE).otherwise(F.col("pos"))).drop("h")


def blocks(rows: DataFrame, window: int, block: int) -> DataFrame:
    """rows with words cut into blocks: base (first word's number), left (words before it), ws (with both neighbours' words).

    A text without words has one block without words.
    """
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    begin = F.sequence(F.lit(0), F.greatest(F.col("n_words").cast("int") - 1, F.lit(0)), F.lit(block))
    cut = F.transform(begin, lambda b: F.struct(b.alias("base"), F.least(b, F.lit(window - 1)).alias("left"), F.slice(F.col("words"), b + 1 - F.least(b, F.lit(window - 1)), F.lit(block + window - 1) + F.least(b, F.lit(window - 1))).alias("ws")))
    kept = [c for c in rows.columns if c != "words"]
    return rows.select(*kept, F.explode(cut).alias("cut")).select(*kept, "cut.*")


def item_windows(items: DataFrame, window: int, block: int = BLOCK) -> DataFrame:
    """text (words in lower case, joined by blanks), k (their number), items: distinct windows with their sorted item ids.

    An item's ids are one text in the result, so a window's list of them is no longer than that.
    """
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(lower_ascii(F.col("text"))).alias("words"))
    rows = blocks(rows.where(F.size("words") > 0), window, block).withColumn("k", F.least(F.col("n_words"), F.lit(window)).cast("int"))
    last = F.least(F.col("left") + (block - 1), F.size("ws") - F.col("k"))
    starts = F.when(last >= F.col("left"), F.sequence(F.col("left"), last)).otherwise(F.array().cast("array<int>"))
    each = rows.select("item_id", "ws", "k", F.explode(starts).alias("at"))
    each = each.select("item_id", "k", F.array_join(F.slice("ws", F.col("at") + 1, F.col("k")), " ").alias("text"))
    return each.groupBy("text", "k").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def window_shingles(windows: DataFrame) -> DataFrame:
    """wid, k, at, shingle: the shingles of every window."""
    rows = windows.select("wid", "k", word_hashes(F.split("text", " ")).alias("hashes"))
    every = [F.when(F.col("k") == s, shingles(F.col("hashes"), s)) for s in range(1, SHINGLE)]
    return rows.select("wid", "k", F.posexplode(F.coalesce(*every, shingles(F.col("hashes"), SHINGLE))).alias("at", "shingle"))


def sizes_of(windows: DataFrame) -> list[int]:
    """The sizes of shingles that windows have: at most SHINGLE numbers."""
    return sorted(r["s"] for r in windows.select(F.least("k", F.lit(SHINGLE)).alias("s")).distinct().collect())


def parts_of(n: int, size: int = 0) -> int:
    return max(1, -(-n // PART_ROWS), -(-size // PART_BYTES))


def seen_shingles(texts: DataFrame, asked: DataFrame, sizes: list[int], parts: int) -> DataFrame:
    """shingle, key, doc_id, n_words: an occurrence of an asked shingle in a text (shingle and key), or a text (the others and key).

    texts: doc_id, key, words.
    """
    texts = texts.withColumns({"hashes": word_hashes(F.col("words")), "n_words": F.size("words").cast("long")}).drop("words")
    out = None
    for p in range(parts):
        mine = asked.where(F.pmod("shingle", F.lit(parts)) == p)
        if p == 0:
            mine = mine.unionByName(texts.sparkSession.range(1).select(F.lit(SELF).cast("long").alias("shingle"))).distinct()
        # Texts that all have the same words are one kind of row: nothing but the key tells them apart.
        met = exploded(texts, sizes, F.lit(p == 0)).join(F.broadcast(mine), "shingle")
        whole = F.col("pos") == NOWHERE
        met = met.select(F.when(~whole, F.col("shingle")).alias("shingle"), "key", F.when(whole, F.col("doc_id")).alias("doc_id"), F.when(whole, F.col("n_words")).alias("n_words"))
        out = met if out is None else out.unionByName(met)
    return out


def rarest(windows: DataFrame, per_window: DataFrame, counts: DataFrame) -> DataFrame:
    """windows with shingle and at: the shingle that the documents have least often, of windows whose shingles they all have."""
    each = per_window.join(counts, "shingle", "left")
    best = each.groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "at")).alias("best"))
    return windows.join(best.where(F.col("best.n") > 0), "wid").select("text", "k", "set_id", F.col("best.shingle").alias("shingle"), F.col("best.at").alias("at"))


def occurrences(rows: DataFrame, prefixes: DataFrame, sizes: list[int], window: int, block: int, with_self: bool) -> DataFrame:
    """rid, doc_id, n_words, start, k, set_id: where windows occur in rows (rid, doc_id, words).

    With with_self every row has one more record, without start, that holds its doc_id and n_words. Both
    joins are broadcasts of prefixes (at most PART_ROWS rows), and a document's words are read in blocks, so
    that a match holds a block's words and not the document's.
    """
    spark = rows.sparkSession
    myself = spark.range(1).select(F.lit("").alias("text"), F.lit(0).alias("k"), F.lit(None).cast("long").alias("set_id"), F.lit(SELF).cast("long").alias("shingle"), F.lit(NOWHERE).alias("at"))
    if with_self:
        prefixes = prefixes.unionByName(myself)
    spots = prefixes.groupBy("shingle").agg(F.collect_set(F.struct("at", "k")).alias("spots"))
    cut = blocks(rows, window, block).withColumn("hashes", word_hashes(F.col("ws")))
    flat = exploded(cut, sizes, (F.col("base") == 0) if with_self else F.lit(False))
    flat = flat.where((F.col("pos") == NOWHERE) | ((F.col("pos") >= F.col("left")) & (F.col("pos") < F.col("left") + block)))
    met = flat.select("rid", "doc_id", "n_words", "base", "left", "ws", "pos", "shingle").join(F.broadcast(spots), "shingle")
    met = met.select("*", F.explode("spots").alias("spot")).select("*", F.col("spot.at").alias("at"), F.col("spot.k").alias("k"))
    start = F.col("pos") - F.col("at")
    whole = (F.col("pos") == NOWHERE) & (F.col("at") == NOWHERE)
    fits = (F.col("pos") >= 0) & (F.col("at") >= 0) & (start >= 0) & (start + F.col("k") <= F.size("ws"))
    met = met.where(whole | fits).withColumn("text", F.when(whole, F.lit("")).otherwise(lower_ascii(F.array_join(F.slice("ws", F.greatest(start, F.lit(0)) + 1, F.col("k")), " "))))
    found = met.join(F.broadcast(prefixes), ["text", "k", "shingle", "at"])
    at_word = F.when(F.col("pos") != NOWHERE, F.col("base") - F.col("left") + start)
    return found.select("rid", F.when(whole, F.col("doc_id")).alias("doc_id"), F.when(whole, F.col("n_words")).alias("n_words"), at_word.cast("long").alias("start"), "k", "set_id")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    docs has doc_id and text, items item_id and text; other columns are ignored, whatever their names. A null
    or empty text has no words and no windows. An item id that stands in several rows is one item with the windows
    of all; the windows of items without an id hit words, but count as no item. Rows with a null or repeated
    doc_id are judged each for themselves. An empty items table leaves every document clean; an empty docs table
    gives an empty result. Very long texts are read in blocks of words. The sorted item ids of one document are
    one value, as its digest needs them together.
    """
    # Distinct windows, and the distinct sets of items that share one.
    listed = durable(item_windows(items, window).withColumn("wid", F.monotonically_increasing_id()), "windows")
    sets = durable(listed.groupBy("items").agg(F.min("wid").alias("set_id")), "item-sets")
    windows = listed.join(sets, "items").select("wid", "text", "k", "set_id")
    per_window = window_shingles(windows)
    asked = durable(per_window.select("shingle").distinct(), "shingles")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64(text_or_empty()).alias("key"))
    words = words_of(F.col("text")).alias("words")
    seen = durable(seen_shingles(texts.select("doc_id", "key", words), asked, sizes_of(windows), parts_of(asked.count())), "seen-shingles")
    counts = seen.where("n_words is null").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    prefixes = durable(rarest(windows, per_window, counts), "prefixes")
    size = prefixes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    parts = parts_of(size["n"], size["size"])
    # Only texts with a prefix are read again; where they are too many to name, all are.
    likely = seen.where("n_words is null").join(prefixes.select("shingle").distinct(), "shingle", "left_semi").select("key").distinct()
    likely = durable(likely, "texts-with-prefix")
    clean = seen.where("n_words is not null").select("doc_id", "n_words", "key")
    if likely.limit(LIKELY_ROWS + 1).count() <= LIKELY_ROWS:
        texts = texts.join(F.broadcast(likely), "key", "left_semi")
        clean = clean.join(F.broadcast(likely), "key", "left_anti")
    else:
        clean = clean.limit(0)
    rows = texts.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id())
    if parts > 1:  # The parts must agree on the rows' numbers.
        rows = durable(rows, "numbered")
    rows = rows.select("rid", "doc_id", words)
    found = None
    for p in range(parts):
        mine = occurrences(rows, prefixes.where(F.pmod("shingle", F.lit(parts)) == p), sizes_of(prefixes), window, block, p == 0)
        found = mine if found is None else found.unionByName(mine)
    found = durable(found, "occurrences")
    before = "max(start + k) over (partition by rid order by start, k rows between unbounded preceding and 1 preceding)"
    fresh = found.withColumn("upto", F.expr(before)).withColumn("fresh", F.greatest(F.lit(0), F.col("start") + F.col("k") - F.greatest("start", F.coalesce("upto", F.lit(0)))))
    per = fresh.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.coalesce(F.sum("fresh"), F.lit(0)).alias("n_hit"), F.array_sort(F.collect_set("set_id")).alias("met"))
    per = durable(per.drop("rid"), "documents-hit")
    # Documents that met the same sets of items share their list.
    lists = per.where(F.size("met") > 0).select("met").distinct()
    lists = lists.select("met", F.explode("met").alias("set_id")).join(sets, "set_id").select("met", F.explode_outer("items").alias("item")).groupBy("met").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    lists = lists.select("met", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    out = with_group_totals(per, "met", lists)
    discard(listed, sets, asked, prefixes, found)
    none = F.sha2(F.lit(""), 256)
    clean = clean.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast("long").alias("n_items"), F.lit(None).cast("string").alias("items_sha256"))
    out = out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256").unionByName(clean)
    return out.select("doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
