"""Language identification with language bitmasks in bit-sliced Bloom filters.

Each learned language has a Bloom filter of the character n-grams that are typical of it. The filters are stored
bit-sliced: cell j holds one bit for every language, so the AND of an n-gram's cells is the bitmask of all
languages that (may) contain it. For a text, the set bits of every language are counted over all n-grams and
corrected for the filter's false positives; the language with the largest corrected share wins.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import durable, small_batches, text_or_empty

GRAM = 4
#: A filter is fitted on at most so many documents of its language, those with the smallest hashes of the id.
DOCS_PER_LANG = 400
#: Typical n-grams kept for each language.
GRAMS_PER_LANG = 20_000
#: A kept n-gram is at least so many times as frequent in the language as in the others taken together.
LIFT = 2.0
HASHES = 3
#: log2 of the cells: 2**18 cells for 20,000 n-grams in each slice give about 1 % false positives.
CELL_BITS = 18
LANGS_PER_WORD = 64
#: Characters that go through numpy at once.
CHUNK = 1 << 20
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


@functools.cache
def _letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, the number of each one's text, and whether each text has a letter.

    Texts are lower-cased; what is no letter becomes a blank; n-grams of blanks alone or over a text's end are
    left out.
    """
    # Each text has a zero behind it, and GRAM - 1 more stand at the end; texts may hold zeros of their own.
    lower = [x.lower() for x in texts]
    flat = np.frombuffer(("\x00".join([*lower, ""]) + "\x00" * (GRAM - 1)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.array([len(x) + 1 for x in lower], dtype=np.int64)
    text = np.append(np.repeat(np.arange(len(texts)), size), np.full(GRAM - 1, len(texts)))
    end = np.zeros(len(flat), dtype=bool)
    end[np.cumsum(size) - 1] = True
    end[len(flat) - GRAM + 1 :] = True
    letter = _letter_table()[flat]
    has = np.zeros(len(texts), dtype=bool)
    has[text[letter]] = True
    code = np.where(letter, flat, 32).astype(np.uint64)
    n = len(flat) - GRAM + 1
    h = np.zeros(n, dtype=np.uint64)
    some = np.zeros(n, dtype=bool)
    over = np.zeros(n, dtype=bool)
    for k in range(GRAM):
        h = (h ^ code[k : n + k]) * _MULTIPLIERS[3]
        h ^= h >> np.uint64(29)
        some |= letter[k : n + k]
        over |= end[k : n + k]
    ok = some & ~over
    return h[ok], text[:n][ok], has


def _cells(h: np.ndarray, k: int) -> np.ndarray:
    return (h * _MULTIPLIERS[k] >> np.uint64(64 - CELL_BITS)).astype(np.int64)


class SlicedFilters:
    """cells[w, j]: bitmask of languages 64 w to 64 w + 63 that set cell j."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], fallback: str | None):
        self.langs, self.fallback = langs, fallback
        self.cells = np.zeros((max(1, -(-len(langs) // LANGS_PER_WORD)), 1 << CELL_BITS), dtype=np.uint64)
        for i, h in enumerate(grams):
            bit = np.uint64(1) << np.uint64(i % LANGS_PER_WORD)
            for k in range(HASHES):
                self.cells[i // LANGS_PER_WORD, _cells(h, k)] |= bit
        full = np.array([np.count_nonzero(self.cells[i // LANGS_PER_WORD] >> np.uint64(i % LANGS_PER_WORD) & np.uint64(1)) for i in range(len(langs))])
        self.false_rate = (full / (1 << CELL_BITS)) ** HASHES

    def masks(self, h: np.ndarray) -> np.ndarray:
        """Bitmasks of the languages that contain each n-gram, one row for each 64 languages."""
        out = self.cells[:, _cells(h, 0)]
        for k in range(1, HASHES):
            out &= self.cells[:, _cells(h, k)]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        h, text, has = gram_hashes(texts)
        n, m = len(texts), len(self.langs)
        if not m:
            return ["und"] * n, [0.0] * n
        mask = self.masks(h)
        grams = np.bincount(text, minlength=n)[:n]
        hits = np.empty((m, n))
        for i in range(m):
            bit = mask[i // LANGS_PER_WORD] >> np.uint64(i % LANGS_PER_WORD) & np.uint64(1)
            hits[i] = np.bincount(text[bit != 0], minlength=n)[:n]
        rate = self.false_rate[:, None]
        true = np.maximum((hits - grams * rate) / np.maximum(1 - rate, 1e-9), 0)
        best, total = true.argmax(axis=0), true.sum(axis=0)
        top = true.max(axis=0)
        lang, score = [], []
        for j in range(n):
            if not has[j]:
                lang.append("und")
                score.append(0.0)
            elif top[j] <= 0:
                lang.append(self.fallback)
                score.append(0.0)
            else:
                lang.append(self.langs[best[j]])
                score.append(float(min(1.0, top[j] / total[j])))
        return lang, score


def _train_rows(batches) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n) within the task."""
    for b in batches:
        langs = np.array(b.column(0).to_pylist(), dtype=object)
        texts = b.column(1).to_pylist()
        for lang in dict.fromkeys(langs.tolist()):
            mine = [x for x, y in zip(texts, langs.tolist(), strict=True) if y == lang]
            h, _, _ = gram_hashes(mine)
            grams, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(train: DataFrame, docs_per_lang: int = DOCS_PER_LANG, grams_per_lang: int = GRAMS_PER_LANG) -> SlicedFilters:
    """train: doc_id, text, lang. Fits on a bounded number of documents for each language.

    Frequencies of n-grams are counted by Spark; at most grams_per_lang hashes of each language come to the driver.
    """
    small_batches(train.sparkSession)
    rows = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return SlicedFilters([], [], None)
    # A threshold on the hash takes about docs_per_lang rows of each language without ranking them.
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1 << 20)) / float(1 << 20)
    wanted = functools.reduce(lambda c, x: c.when(F.col("lang") == x, F.lit(docs_per_lang / sizes[x])), langs, F.when(F.lit(False), F.lit(0.0)))
    sample = train.where(F.col("text").isNotNull() & (share < wanted)).select("lang", "text")
    # Written once: totals, frequencies and the other languages' shares are all read from it.
    counts = durable(sample.mapInArrow(_train_rows, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    freq = counts.join(F.broadcast(totals), "lang").select("lang", "gram", "n", (F.col("n") / F.col("total")).alias("f"))
    others = freq.groupBy("gram").agg(F.sum("f").alias("all"), F.count(F.lit(1)).alias("in_langs"))
    typical = freq.join(others, "gram").where((F.col("f") >= LIFT * (F.col("all") - F.col("f")) / max(1, len(langs) - 1)) & ((F.col("n") > 1) | (F.col("in_langs") == 1)))
    top = typical.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("f", "gram")), asc=False), 1, grams_per_lang)["gram"].alias("grams")).collect()
    grams = {r["lang"]: np.array(r["grams"], dtype=np.int64).view(np.uint64) for r in top}
    none = np.zeros(0, dtype=np.uint64)
    return SlicedFilters(langs, [grams.get(x, none) for x in langs], max(langs, key=lambda x: (sizes[x], x)))


def _predict(batches, filters) -> Iterator[pa.RecordBatch]:
    model: SlicedFilters = filters.value
    for b in batches:
        texts = b.column(1).to_pylist()
        lang: list[str] = []
        score: list[float] = []
        at = 0
        while at < len(texts):
            part, size = [], 0
            while at < len(texts) and (not part or size + len(texts[at]) < CHUNK):
                part.append(texts[at])
                size += len(texts[at])
                at += 1
            x, y = model.predict(part)
            lang += x
            score += y
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang).

    Learns only from rows that aren't held out and have both text and lang; a null doc_id isn't held out. Null
    text, or text without a letter, gives `und` with score 0. Text with letters but no known n-gram gives the
    language with most rows, score 0. Without any row to learn from every text gives `und`. Ties go to the
    language that sorts first. Repeated rows are rows like any other; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = fit(docs.where(~held_out()).select("doc_id", "text", F.col("lang").cast(StringType()).alias("lang")))
    filters = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), held_out().alias("held_out"))
    return rows.mapInArrow(functools.partial(_predict, filters=filters), "doc_id long, held_out boolean, lang_pred string, score double")
