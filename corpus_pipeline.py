"""From raw documents to token ids: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import durable, read_table, text_or_empty
from tessera.llm.line_dedup import line_dedup
from tessera.llm.mixing import mix
from tessera.llm.near_dedup import near_dedup
from tessera.llm.piece_bpe import piece_digests
from tessera.llm.quality_rules import WORDS_AND_PAIRS, quality_rules
from tessera.llm.queries import piece_model

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose 5-word shingles agree by this share or more are near copies.
NEAR_PERCENT = 80


def _with_hash(docs: DataFrame) -> DataFrame:
    """Rows with one id and one text hash have one verdict."""
    return docs.select(*COLUMNS, F.xxhash64(text_or_empty()).alias("th"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts are rejected, and equal rows share their verdict. An empty table stays empty."""
    rows = _with_hash(docs)
    verdict = quality_rules(rows, read_table(spark, sf_dir, "labels"), orders=WORDS_AND_PAIRS, carry=("th",))
    bad = verdict.where(~F.col("kept")).select(F.col("doc_id").alias("bad_id"), F.col("in_th").alias("bad_th")).distinct()
    kept = rows.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("th") == F.col("bad_th")), "left_anti")
    return kept.select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that documents share stay in one of them; n_chars is that of the text left."""
    out = line_dedup(docs, carry=("lang", "source"))
    return out.select("doc_id", "text", F.col("in_lang").alias("lang"), F.col("in_source").alias("source"), F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id; rows with a null id stay."""
    copies = near_dedup(docs, percent=NEAR_PERCENT).where(~F.col("kept")).select(F.col("doc_id").alias("copy_id")).distinct()
    return docs.select(*COLUMNS).join(copies, F.col("doc_id") == F.col("copy_id"), "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: a document stays once, twice or not at all. A null source is one of its own; of equal rows one stands for all."""
    rows = _with_hash(docs)
    keys = ("doc_id", "source", "in_th")
    taken = mix(rows.select("doc_id", "text", "source", "th"), carry=("th", "source"))
    taken = taken.select("doc_id", F.col("in_source").alias("source"), "in_th", "copies")
    taken = taken.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where(F.col("copies") > 0)
    taken = taken.select(*[F.col(k).alias(f"m_{k}") for k in keys], "copies", "rows")
    same = F.col("doc_id").eqNullSafe(F.col("m_doc_id")) & F.col("source").eqNullSafe(F.col("m_source")) & (F.col("th") == F.col("m_in_th"))
    once = rows.join(taken.where(F.col("rows") == 1), same).select(*COLUMNS, "copies")
    # Equal rows share their copies, so one of them stands for all.
    equal = rows.join(taken.where(F.col("rows") > 1), same).dropDuplicates(["doc_id", "source", "th"]).select(*COLUMNS, "copies")
    out = once.unionAll(equal)
    return out.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text that they decode to."""
    return piece_digests(docs, piece_model(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("mixing", mixture),
    ("token ids", tokens),
]

#: Mixing solves for its rates by Newton's method and near-duplicates need components, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
