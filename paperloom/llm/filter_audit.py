"""Filter interaction audit by the multilinear extension.

What a set S of filters removes is how many documents fail one of S at least.
Extended to probabilities x of each filter's being on, that is a polynomial,
linear in each x: a document that fails the filters of a mask m adds
``1 - prod(1 - x_i for i in m)``. So a part of the table needs no more than the
number of its documents for each mask, 32 for five filters, and

* at a corner (each x 0 or 1) the polynomial is what those filters remove, from
  which all orders and steps follow;
* a filter's Shapley value is its partial derivative integrated along the
  diagonal, in exact rationals; times the number of orders it is an integer: what
  the filter removes, summed over all orders.

Documents are counted by mask in Spark; a task then has one part's counts. A
text's copies share its mask and are told by their SHA-256: they are counted
together, a task at a time, before they meet, so a text that very many documents
share sends a few rows a task.

Defined results: a null text is empty and a null part is the empty string; of rows
with the smallest doc_id of a text none is a copy, and a row with a null doc_id
neither is one nor makes others one; labels of a doc_id count if any of its rows
has them; rows without doc_id have none; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import own_columns, read

WORD = r"[^\x20\x09-\x0D]+"
COPY = "E"
Polynomial = dict[frozenset, int]


def text_filters(text: Column) -> dict[str, Column]:
    """Filters by the text alone, with what fails them: few words (A), repeated words (B), capitals (C), symbols (D)."""

    def judged(w: Column) -> Column:
        n = F.size(w)
        return F.struct((n < 100).alias("A"), (100 * F.size(F.array_distinct(w)) < 80 * n).alias("B"))

    by_words = F.element_at(F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), judged), 1)
    return {"A": by_words["A"], "B": by_words["B"], "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text), "D": text.rlike("[#$%&*|]")}


def polynomial(counts: dict[frozenset, int]) -> Polynomial:
    """Coefficients of the removal polynomial by their variables, from the number of documents that fail just the filters of each mask."""
    out: Polynomial = {}
    for mask, n in counts.items():
        for size in range(1, len(mask) + 1):
            for term in itertools.combinations(sorted(mask), size):
                key = frozenset(term)
                out[key] = out.get(key, 0) + (n if size % 2 else -n)
    return out


def corner(poly: Polynomial, on: Iterable) -> int:
    """What the filters of ``on`` remove together."""
    on = frozenset(on)
    return sum(c for term, c in poly.items() if term <= on)


def shapley(poly: Polynomial, name) -> Fraction:
    """The partial derivative by ``name``, integrated from 0 to 1 along the diagonal: a term of n variables is t ** (n - 1) there."""
    return sum((Fraction(c, len(term)) for term, c in poly.items() if name in term), Fraction(0))


def orders(total: int, names: str, poly: Polynomial, good: Polynomial, toxic: Polynomial) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each order of the filters and each step."""
    values = {x: int(shapley(poly, x) * math.factorial(len(names))) for x in names}
    fails = {x: corner(poly, x) for x in names}
    alone = {x: corner(poly, names) - corner(poly, set(names) - {x}) for x in names}
    sets = [frozenset(c) for size in range(len(names) + 1) for c in itertools.combinations(names, size)]
    gone, lost, rid = ({s: corner(p, s) for s in sets} for p in (poly, good, toxic))
    out = []
    for order in itertools.permutations(names):
        for step, x in enumerate(order, 1):
            before, now = frozenset(order[: step - 1]), frozenset(order[:step])
            removed = gone[now] - gone[before]
            out.append(("".join(order), step, total - gone[now], removed, fails[x] - removed, alone[x], lost[now] - lost[before], rid[now] - rid[before], values[x]))
    return out


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> tuple[DataFrame, str]:
    """part, mask (bit i: fails the i-th filter), n, good, toxic; and the filters' names in order."""
    text = F.coalesce("text", F.lit(""))
    filters = text_filters(text)
    names = "".join(filters) + COPY
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    rows = own_columns(docs, "doc_id", "text", part).select("doc_id", F.coalesce(part, F.lit("")).alias("part"), bits.alias("mask"), F.sha2(text, 256).alias("same"))
    known = own_columns(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    named = rows.where("doc_id is not null").join(known, "doc_id", "left").fillna(0, ["good", "toxic"])
    # A row for each document, as rows may repeat; then one for each text and what its documents have in common, made in each task before texts meet.
    alike = ["same", "part", "mask", "good", "toxic"]
    of_docs = named.groupBy("doc_id", *alike).agg(F.count("*").alias("n"))
    of_texts = of_docs.groupBy(*alike).agg(F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"), F.sum("n").alias("n"))
    least = of_texts.groupBy("same").agg(F.min("first").alias("least"))
    own = F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    split = F.array(F.struct("mask", own.alias("n")), F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), (F.col("n") - own).alias("n")))
    judged = of_texts.join(least, "same").select("part", "good", "toxic", F.explode(split).alias("m")).select("part", "m.mask", "m.n", "good", "toxic")
    nameless = rows.where("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    counted = judged.union(nameless).where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    return counted, names


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Per part, order of all filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley (over all orders)."""
    counted, names = mask_counts(docs, labels, part)

    def of_part(frame: pd.DataFrame) -> pd.DataFrame:
        masks = [frozenset(x for i, x in enumerate(names) if m >> i & 1) for m in frame["mask"]]
        polys = [polynomial(dict(zip(masks, map(int, frame[c]), strict=True))) for c in ("n", "good", "toxic")]
        rows = [(frame["part"].iloc[0], *row) for row in orders(int(frame["n"].sum()), names, *polys)]
        return pd.DataFrame(rows, columns=["part", "filter_order", "step", *COUNTS])

    # A part has at most one row a mask.
    return counted.groupBy("part").applyInPandas(of_part, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_interaction(spark, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: By walking all orders over the counts of what each document fails.
OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents
), known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS failed
  FROM texts LEFT JOIN known USING (doc_id)
), counted AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), walks AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND a.x <> e.x AND b.x <> c.x AND b.x <> d.x AND b.x <> e.x AND c.x <> d.x AND c.x <> e.x AND d.x <> e.x
), steps AS (SELECT filter_order, step, filter_order[step] AS x, filter_order[1:step - 1] AS earlier FROM walks, range(1, 6) AS r(step)
), walked AS (
  SELECT part, filter_order, step, x, failed, n, good, toxic, contains(failed, x) AS fails_it, translate(failed, earlier, '') <> failed AS gone FROM steps, counted
), sums AS (
  SELECT part, filter_order, step::INT AS step, x, sum(n) FILTER (NOT gone AND NOT fails_it) AS kept, sum(n) FILTER (fails_it AND NOT gone) AS removed, sum(n) FILTER (fails_it AND gone) AS redundant,
    sum(n) FILTER (failed = x) AS unique_fails, sum(good) FILTER (fails_it AND NOT gone) AS good_lost, sum(toxic) FILTER (fails_it AND NOT gone) AS toxic_lost FROM walked GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, x), 0)::BIGINT AS shapley
FROM sums
"""
