"""Mixing sources to target weights by subset-sum budget fitting.

Every source has a word budget. Whole passes over it come first; what is left
is a subset-sum problem over its documents. Its documents are counted by exact
length, and bounded-knapsack dynamic programming over the counts finds the sum
nearest to the budget, from either side. Where the budget is longer than
``KNAPSACK`` words, a proportional share of each length is taken first, and as
much of it kept back as leaves the knapsack about half its table to fit. Which
documents of a length are taken follows a seeded order.

Only counts by (source, length, salt) meet in one task, never documents: the
salts grow with the table, so that about ``SALT_ROWS`` documents of one length
are ranked in a task however many rows share it. Sources are ranked by range
partitions, and their water level is found by sums, so their number has no bound.

Defined results: a null source is a source of its own, ordered last; a null or
wordless text has size 0 and takes 0 words; repeated doc_ids are told apart by
their text, and equal rows share what is taken for them in a fixed order; an
empty table gives an empty result. A source of few and long documents may have
no sum near its target: it gets the nearest there is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import discard, materialise, n_tasks, own_columns, read

SALT_ROWS = 100_000
SEED = 17
WEIGHTS = (3, 1, 2)
WORDS = r"[^\x20\x09-\x0D]+"
#: Words that the knapsack fits. Its table has twice as many sums, or twice the longest text's.
KNAPSACK = 1 << 19


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size -> also target: ``share`` of all sizes by repeating weights, none over ``most`` times its source's size.

    The excess of a capped source goes to the others by weight until none is
    above its cap: targets are min(cap, level * weight), and the level rises
    with what the capped ones leave, until no other source is above its cap.
    """
    spark = sizes.sparkSession
    # Strings are ordered by their UTF-8 bytes, so by code point. Ranges are written, so that ranks and offsets see the same ones.
    ranged = materialise(sizes.select("source", "source_size").repartitionByRange(n_tasks(spark), F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "mix-ranges")
    before, offsets = 0, []
    for r in ranged.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect():  # a row a task
        offsets.append((r["range"], before))
        before += r["n"]
    starts = spark.createDataFrame(offsets, "range int, start long")
    rank = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("start")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = materialise(ranged.join(F.broadcast(starts), "range").withColumn("w", weight).withColumn("cap", F.col("source_size") * most).select("source", "source_size", "w", "cap"), "mix-weights")
    discard(ranged)
    total, level = float(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share, -1.0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("w")
        capped, open_ = ranked.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        if not open_:
            level = float("inf")
            break
        now = (total - (capped or 0.0)) / open_
        if now <= level:
            break
        level = now
    return ranked.select("source", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, limit: int = KNAPSACK) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to ``budget``; of two as near, the lower sum.

    Up to ``limit`` words the sum is the nearest of all there are. Beyond it, a
    proportional share of each length is taken but for about half of ``limit``,
    then whole documents, longest first, down to ``limit``; the rest is fitted
    to the documents that are left.
    """
    taken, order = np.zeros_like(counts), np.argsort(-lengths, kind="stable")
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget > limit:
        taken = (counts * ((budget - limit // 2) / total)).astype(np.int64)
    left, rest = counts - taken, budget - int((taken * lengths).sum())
    for i in order:
        if rest <= limit:
            break
        n = min(int(left[i]), (rest - limit // 2) // int(lengths[i])) if lengths[i] else 0
        taken[i] += n
        left[i] -= n
        rest -= n * int(lengths[i])
    # A sum over twice the rest is farther from it than none. Counts are split into 1, 2, 4, ... documents, so each item is taken once or not.
    reached = np.zeros(2 * rest + 1, bool)
    reached[0] = True
    via, items = np.full(2 * rest + 1, -1, np.int32), []
    for i in order:
        n, step = min(int(left[i]), 2 * rest // int(lengths[i])) if lengths[i] else 0, 1
        while n > 0 and not reached[rest]:
            k, weight = min(step, n), min(step, n) * int(lengths[i])
            fresh = np.flatnonzero(reached[:-weight] & ~reached[weight:]) + weight
            via[fresh] = len(items)
            reached[fresh] = True
            items.append((i, k))
            n, step = n - k, 2 * step
    sums = np.flatnonzero(reached)
    at = int(sums[np.abs(sums - rest).argmin()])
    while at > 0:
        i, k = items[via[at]]
        taken[i] += k
        at -= k * int(lengths[i])
    return taken


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target and copies (0 to ``most``) that the mix takes of it."""
    base = own_columns(docs, "doc_id", "source", "text").select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    base = materialise(base, "mix-sizes")
    salts = base.count() // SALT_ROWS + 1
    base = base.withColumn("salt", F.pmod(F.col("h"), F.lit(salts)))
    counts = materialise(base.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "mix-counts")
    goal = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = materialise(goal.withColumn("passes", passes).withColumn("budget", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")), "mix-targets")

    def spend(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size")
        return frame.assign(take=fit(frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64), int(frame["budget"].iloc[0])))[["source", "size", "take"]]

    same = lambda a, b, *names: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    # A group is the lengths of a source: as many rows as its texts have different sizes.
    histogram = counts.groupBy("source", "size").agg(F.sum("n").alias("n")).alias("c").join(goal.alias("g"), same("c", "g", "source")).select("c.source", "c.size", "c.n", "g.budget")
    plan = histogram.groupBy("source").applyInPandas(spend, "source string, size long, take long")
    earlier = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    share_of = before.alias("b").join(plan.alias("p"), same("b", "p", "source", "size")).select("b.source", "b.size", "b.salt", (F.col("p.take") - F.col("b.before")).alias("room"))
    # Inside a salt, the documents in seeded order take what room its length leaves it.
    rank = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("h", "doc_id"))
    ranked = base.withColumn("rank", rank).alias("d").join(share_of.alias("s"), same("d", "s", "source", "size", "salt"))
    return ranked.join(goal.alias("g"), same("d", "g", "source")).select("d.doc_id", "d.source", "d.size", "g.source_size", "g.target", (F.col("g.passes") + (F.col("rank") <= F.col("room")).cast("long")).alias("copies"))


def op2_mixing_sources(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).alias("taken"))


def mixing_targets(spark, sf_dir: str) -> DataFrame:
    """What of ``op2_mixing_sources`` SQL can express."""
    return op2_mixing_sources(spark, sf_dir).drop("taken")


#: The level at which uncapped sources stand: the highest of those that the sources still under their cap allow, in the order in which caps are reached.
TARGETS_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS n, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source
), o AS (
  SELECT *, (1.5 * sum(n) OVER () - coalesce(sum(2 * n) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (SELECT max(level) FILTER (WHERE level * w < 2 * n) AS level FROM o)
SELECT doc_id, size, n::BIGINT AS source_size, coalesce(least(2 * n, level * w), 2 * n)::DOUBLE AS target
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, t
"""
