"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each source has a token target. Document rates r = 2 / (1 + exp(-lambda * x)) are the solution of the
bounded-entropy balancing problem with one token constraint per source: an exponential tilt of the uniform
rate 1 along x, held below 2 copies; x is the mean size of the document's size class over the source's mean.
Newton iterations on the convex dual, each a pass of Spark over all sources' size classes, find lambda for every
source; a source has at most a few hundred classes whatever its size. Systematic rounding along
size classes turns rates into 0, 1 or 2 copies; of several phases of the rounding each source takes the one
that comes nearest its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, text_or_empty

SHARE = 1.5
MOST_COPIES = 2
WEIGHTS = (3, 1, 2)
#: Iterations at most, and the step at which they end.
NEWTON_STEPS = 40
CLOSE = 1e-7
#: Size classes for each doubling of the size.
CLASSES = 8
PHASES = 16
#: Rows of one size class in one source are ranked in so many separate blocks.
BLOCKS = 256
STEEPEST = 60.0


def sizes(docs: DataFrame, carry: tuple = ()) -> DataFrame:
    kept = [F.col(c).alias(f"in_{c}") for c in carry]
    return docs.select("doc_id", "source", *kept, F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text_or_empty()).alias("__th"))


def source_targets(by_source: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS) -> DataFrame:
    """by_source: source, source_size -> with target.

    Sources fill up in the order of (cap / weight): with the sources before k full, the level of the others is
    (total - caps before) / (weights from k on); the first source whose cap is not below its level's share ends
    the full ones. This is where resharing the excess ends. Sources are ordered in one task, a row each.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    one = Window.partitionBy(F.lit(1))
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    t = by_source.withColumn("w", w).withColumn("cap", (MOST_COPIES * F.col("source_size")).cast("double"))
    t = t.withColumn("total", share * F.sum("source_size").over(one)).withColumn("all_w", F.sum("w").over(one))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("level", level)
    t = t.withColumn("place", F.row_number().over(filling))
    t = t.withColumn("stop", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("place", "level"))).over(one)["level"])
    return t.select("source", "source_size", F.least("cap", F.coalesce(F.col("stop") * F.col("w"), F.col("cap"))).alias("target"))


def _rate(lam: Column, x: Column) -> Column:
    return MOST_COPIES / (1 + F.exp(-lam * x))


def tilts(hist: DataFrame, targets: DataFrame) -> DataFrame:
    """hist: source, bin, n, tokens; targets: source, source_size, target -> targets with mean, lam.

    Every Newton iteration is one pass of Spark over the size classes: it joins each source's lambda to its classes,
    sums gradient and curvature by source and writes the next lambdas. The dual's gradient is tokens(lam) - target,
    rising in lam. Steps stay inside a bracket that shrinks with every evaluation, so that Newton can't run away where
    the curve is flat. One number comes to the driver each time: the largest step. A source whose target is its limit
    needs no tilt and stays at 0.
    """
    own = hist.where(F.col("tokens") > 0).groupBy("source").agg((F.sum("tokens") / F.sum("n")).alias("mean"))
    state = _join_source(targets, own)
    free = F.col("mean").isNotNull() & (F.col("target") < MOST_COPIES * F.col("source_size"))
    classes = _join_source(hist.where(F.col("tokens") > 0), state.where(free).select("source", "mean"))
    classes = durable(classes.where(F.col("mean").isNotNull()).select("source", (F.col("tokens") / F.col("n") / F.col("mean")).alias("x"), F.col("tokens").cast("double").alias("tokens")), "classes")
    state = durable(state.select("*", F.lit(0.0).alias("lam"), F.lit(-STEEPEST).alias("lo"), F.lit(STEEPEST).alias("hi"), F.lit(0.0).alias("moved")), "tilts")
    for _ in range(NEWTON_STEPS):
        at = _join_source(classes, state.select("source", "lam"))
        at = at.withColumn("r", _rate(F.col("lam"), F.col("x")))
        slope = F.col("tokens") * F.col("x") * F.col("r") * (1 - F.col("r") / MOST_COPIES)
        sums = at.groupBy("source").agg(F.sum(F.col("tokens") * F.col("r")).alias("g"), F.sum(slope).alias("h"))
        step = _join_source(state, sums).withColumn("over", F.col("g") - F.col("target"))
        step = step.withColumns({"lo": F.when(F.col("over") < 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("over") < 0, F.col("hi")).otherwise(F.col("lam"))})
        newton = F.col("lam") - F.col("over") / F.greatest(F.col("h"), F.lit(1e-12))
        step = step.withColumn("next", F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2))
        done = F.col("g").isNull()
        state = durable(step.select("source", "source_size", "target", "mean", F.when(done, 0.0).otherwise(F.col("next")).alias("lam"), "lo", "hi", F.when(done, 0.0).otherwise(F.abs(F.col("next") - F.col("lam"))).alias("moved")), "tilts")
        if (state.agg(F.max("moved")).first()[0] or 0.0) < CLOSE:
            break
    return state.select("source", "source_size", "target", "mean", "lam")


def _join_source(left: DataFrame, right: DataFrame) -> DataFrame:
    return _join_keys(left, right, ["source"])


def mix(docs: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, carry: tuple = ()) -> DataFrame:
    """doc_id, size, source_size, target (its source's), taken, copies, rate for every row of docs.

    Null text has size 0; a null source is a source of its own, the last. Rows of size 0 take no words (copies 0
    or more). Repeated rows and null ids are rows like any other, rounded in a fixed order of (size class, hash
    of id and text, size, id, hash of the text), so reruns agree, also where ids repeat. An empty table gives an empty result. `carry` names further columns
    of docs to keep, as "in_<name>".
    """
    kept = [f"in_{c}" for c in carry]
    rows = sizes(docs, carry).withColumn("bin", F.floor(CLASSES * F.log2(F.col("size") + 1)).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "__th"), F.lit(BLOCKS)).cast("int"))
    rows = durable(rows, "sizes")
    fine = rows.groupBy("source", "bin", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens"))
    hist = fine.groupBy("source", "bin").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    targets = source_targets(hist.groupBy("source").agg(F.sum("tokens").alias("source_size")), share, weights)
    lam = durable(tilts(hist, targets), "tilts")
    at = _join_source(hist, lam)
    rate = F.when(F.col("mean").isNull() | (F.col("tokens") == 0), 0.0)
    rate = rate.when(F.col("target") >= MOST_COPIES * F.col("source_size"), float(MOST_COPIES)).otherwise(_rate(F.col("lam"), F.col("tokens") / F.col("n") / F.col("mean")))
    at = at.withColumn("rate", rate)
    # Running sum of rates along the classes, then along the blocks of one class, then along the rows of one block.
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("start", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(run), F.lit(0.0)))
    per = _join_keys(fine, at.select("source", "bin", "rate", "start"), ["source", "bin"])
    within = Window.partitionBy("source", "bin").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("start", F.col("start") + F.col("rate") * F.coalesce(F.sum("n").over(within), F.lit(0)))
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("source", "bin", "block").orderBy("size", "doc_id", "__th")))
    placed = _join_keys(ranked, per.select("source", "bin", "block", "rate", "start"), ["source", "bin", "block"])

    def copies(phase: float) -> Column:
        upto = lambda k: F.floor(F.col("start") + k * F.col("rate") + F.lit(phase))
        return F.least(upto(F.col("k")) - upto(F.col("k") - 1), F.lit(MOST_COPIES)).cast("long")

    placed = durable(placed.select("doc_id", *kept, "source", "bin", "block", "size", "rate", F.array(*[copies((p + 0.5) / PHASES) for p in range(PHASES)]).alias("rounded")), "rounded")
    sums = placed.groupBy("source").agg(*[F.sum(F.col("rounded")[p] * F.col("size")).alias(f"t{p}") for p in range(PHASES)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{p}") - F.col("target")), F.lit(p).alias("p")) for p in range(PHASES)]))["p"]
    chosen = _join_source(lam, sums).select("source", "source_size", "target", best.alias("phase"))
    # Joined block by block: by source alone, all rows of a source would meet in one task.
    blocks = _join_source(fine.select("source", "bin", "block"), chosen)
    taken = F.get("rounded", F.col("phase"))
    out = _join_keys(placed, blocks, ["source", "bin", "block"])
    return out.select("doc_id", *kept, "size", "source_size", "target", (taken * F.col("size")).alias("taken"), taken.alias("copies"), "rate")


def _join_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys, where null equals null."""
    r = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, "left").drop(*[f"__{k}" for k in keys])
