"""LM scoring by a weighted backoff automaton that is kept in tables.

Unigrams are counted over all training documents and smoothed by add-one.
Bigrams and trigrams of all words that occur at least ``MINIMUM`` times, at any
size of the corpus, are arcs with a discounted probability. Each context has a
failure arc with its backoff weight to its suffix; the weights are normalised,
so that the probabilities of all tokens after any context sum to one.

Scoring runs each text through the automaton from left to right (``traverse``):
the state is the longest kept suffix of what was read, at most a bigram; a token
takes the state's arc, or else its failure arc, and so on down to the empty state.
The automaton is never in one place: documents are dealt into shares of about
``SHARE`` bytes; each share asks for the arcs that its texts can meet, each of its
distinct n-grams once, by one join with the table of arcs, which is bucketed by
key, and is traversed in one task with what it was given. ``BATCHES`` groups of
shares go one after the other, so that a group's n-grams are on disk at a time. A
frequent n-gram is thus one row a share; words of at least one in ``VOCABULARY``
tokens are broadcast and never asked for. Counts and arcs grow with the corpus and
stay in tables.

Tokens are 64-bit hashes of lower-cased words. Defined results: null texts are
empty, of the end token only; a null doc_id is not held out; without training
documents every token is unknown, N and V are 0; repeated rows each count and
each get a row; further columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import batch, discard, materialise, n_tasks, own_columns, read, shared_dir, signed, slices, words

VOCABULARY = 10_000
MINIMUM = 2
DISCOUNT = 0.5
END = 0x5EED0FE0D0C5E11D
COUNT_SLICE = 4 << 20
SHARE = 4 << 20
BATCHES = 8
#: Trigrams are counted in so many parts of their hashes, one after the other.
COUNTS = 2
#: Tokens whose weights are Python objects at a time.
PIECE = 1 << 17


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of a run of rows with END after each row, bounds of the rows)."""
    w = words(data, offsets)
    bounds = w.first + np.arange(len(w.first))
    out = np.empty(bounds[-1], np.uint64)
    ends = bounds[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = w.hash, END
    return out, bounds


def word_counts(training: DataFrame) -> DataFrame:
    """token, c over all training texts."""
    schema = pa.schema([("token", pa.int64()), ("c", pa.int64())])

    def count(batches):
        for b in batches:
            for _, _, data, offsets in slices(b.column(0), COUNT_SLICE):
                token, n = np.unique(tokens(data, offsets)[0], return_counts=True)
                yield batch(schema, signed(token), n)

    return training.select("text").mapInArrow(count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _ids(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """1 + the place in the sorted vocabulary; 0 for other words."""
    if not len(vocabulary):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at + 1, 0)


def _rotated(h: np.ndarray, bits: int) -> np.ndarray:
    return h << np.uint64(bits) | h >> np.uint64(64 - bits)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of two long columns."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = np.uint64(42)
    for x in (a, b):
        h = (h + p5 + np.uint64(8)) ^ _rotated(x * p2, 31) * p1
        h = _rotated(h, 27) * p1 + p4
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        h ^= h >> np.uint64(32)
    return h


def _ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, their rows, bigrams' keys by their first place, whether a row goes on after each place) of a run of rows."""
    h, bounds = tokens(data, offsets)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return h, row, pair_hash(h[:-1], h[1:]), row[1:] == row[:-1]


#: What tells an n-gram: the two words of a bigram; the keys of a trigram's two bigrams. Its key is their hash.
PARTS = {2: ("t0", "t1"), 3: ("t01", "t12")}


def ngram_counts(training: DataFrame, n: int, part: int = 0, parts: int = 1) -> DataFrame:
    """The parts and c of the n-grams of one part of all hashes that occur at least MINIMUM times in all training texts."""
    names = PARTS[n]
    schema = pa.schema([(t, pa.int64()) for t in [*names, "c"]])

    def count(batches):
        for b in batches:
            for _, _, data, offsets in slices(b.column(0), COUNT_SLICE):
                h, _, two, on = _ngrams(data, offsets)
                a, z = (h[:-1][on], h[1:][on]) if n == 2 else (two[:-1][on[:-1] & on[1:]], two[1:][on[:-1] & on[1:]])
                key = pair_hash(a, z)
                if parts > 1:
                    mine = key % np.uint64(parts) == part
                    key, a, z = key[mine], a[mine], z[mine]
                _, first, c = np.unique(key, return_index=True, return_counts=True)
                yield batch(schema, signed(a[first]), signed(z[first]), c)

    counted = training.select("text").mapInArrow(count, ", ".join(f"{t} long" for t in [*names, "c"]))
    return counted.groupBy(*names).agg(F.sum("c").alias("c")).where(F.col("c") >= MINIMUM)


def arcs(training: DataFrame, counts: DataFrame, floor: float) -> tuple[DataFrame, DataFrame]:
    """The automaton: (token, c, p, back) of words, (key, p, back) of kept bigrams and trigrams; back is the failure arc of the state that an arc leads to."""
    p1 = lambda c: F.log10(c + 1.0) - floor
    p2, p3 = F.log10((F.col("c") - DISCOUNT) / F.col("c0")), F.log10((F.col("c") - DISCOUNT) / F.col("c01"))
    two = ngram_counts(training, 2).join(counts.select(F.col("token").alias("t0"), F.col("c").alias("c0")), "t0").join(counts.select(F.col("token").alias("t1"), F.col("c").alias("c1")), "t1")
    two = materialise(two.select("t0", "t1", "c", "c0", "c1"), "lm-bigrams")
    # Of a context: what its arcs leave to others, over what their words have below it.
    left = (F.col("c0") - F.sum("c") + DISCOUNT * F.count("*")) / F.col("c0")
    fail1 = two.groupBy("t0", "c0").agg(F.log10(left / F.greatest(1 - F.sum(F.pow(F.lit(10.0), p1(F.col("c1")))), F.lit(1e-12))).alias("back")).drop("c0")
    counted = [materialise(ngram_counts(training, 3, i, COUNTS), f"lm-triples-{i}") for i in range(COUNTS)]
    triples = functools.reduce(DataFrame.union, counted)
    key = F.xxhash64("t0", "t1")
    suffix = two.select(key.alias("t12"), F.col("c").alias("c12"), F.col("c0").alias("c1"))
    three = triples.join(suffix, "t12").join(two.select(key.alias("t01"), F.col("c").alias("c01")), "t01")
    context = Window.partitionBy("t01")
    over = lambda all_of, c: (F.col(all_of) - F.sum(c).over(context) + DISCOUNT * F.count("*").over(context)) / F.col(all_of)
    three = three.withColumn("back", F.log10(over("c01", "c") / over("c1", "c12")))
    three = materialise(three.select("t01", F.xxhash64("t01", "t12").alias("key"), "back", p3.alias("p")), "lm-trigrams")
    for table in counted:
        discard(table)
    fail2 = three.groupBy(F.col("t01").alias("key")).agg(F.max("back").alias("back"))
    of_two = two.select(key.alias("key"), p2.alias("p")).join(fail2, "key", "left").select("key", "p", F.coalesce("back", F.lit(0.0)).alias("back"))
    of_grams = materialise(of_two.union(three.select("key", "p", F.lit(0.0).alias("back"))), "lm-arcs")
    of_words = counts.join(fail1.withColumnRenamed("t0", "token"), "token", "left").select("token", "c", p1(F.col("c")).alias("p"), F.coalesce("back", F.lit(0.0)).alias("back"))
    of_words = materialise(of_words, "lm-word-arcs")
    discard(two)
    discard(three)
    return of_words, of_grams


def bucketed(automaton: DataFrame) -> tuple[str, DataFrame]:
    """The arcs in a table bucketed by key (its name, the table): each group of shares is joined to it without shuffling it."""
    spark, name = automaton.sparkSession, f"lm_arcs_{uuid.uuid4().hex}"
    n = n_tasks(spark)
    path = f"{shared_dir(spark)}/paperloom/{name}"
    automaton.repartition(n, "key").write.bucketBy(n, "key").option("path", path).option("compression", "zstd").saveAsTable(name)
    return name, spark.table(name)


def dealt(marked: DataFrame) -> DataFrame:
    """doc_id, held_out, text and share: the number of a run of rows with about SHARE bytes of text. Written once, so that a share is the same in every job."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string()), ("share", pa.int64())])

    def deal(batches):
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for row, upto, _, _ in slices(b.column(2), SHARE):
                number += 1
                yield batch(schema, *[b.column(i).slice(row, upto - row) for i in range(3)], np.full(upto - row, number))

    return materialise(marked.select("doc_id", "held_out", "text").mapInArrow(deal, "doc_id long, held_out boolean, text string, share long"), "lm-shares", "zstd")


def asked(shares: DataFrame, known) -> DataFrame:
    """share, key: the distinct n-grams of each share, but for the words of the broadcast vocabulary."""
    schema = pa.schema([("share", pa.int64()), ("key", pa.int64())])

    def emit(batches):
        for b in batches:
            share = b.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(share, prepend=share[:1] - 1, append=share[-1:] + 1)) if len(share) else []
            for a, z in zip(edges[:-1], edges[1:]):
                for _, _, data, offsets in slices(b.column(1).slice(a, z - a), SHARE):
                    h, _, two, on = _ngrams(data, offsets)
                    rare = (_ids(h, known.value[0]) == 0) & (h != np.uint64(END))
                    three = on[:-1] & on[1:]
                    key = pd.unique(np.concatenate([h[rare], two[on], pair_hash(two[:-1][three], two[1:][three])]))
                    yield batch(schema, np.full(len(key), share[a]), signed(key))

    return shares.select("share", "text").mapInArrow(emit, "share long, key long")


def traverse(begins: np.ndarray, word: np.ndarray, word_back: np.ndarray, two: np.ndarray, two_back: np.ndarray, three: np.ndarray) -> list[float]:
    """The log10 probabilities of texts, read from left to right.

    Per token: whether a text begins, the arc from the empty state and the
    failure arc of the state that it leads to, the same of the arc from the state
    of the word before, and the arc from that of the two words before; NaN where
    there is no such arc. ``depth`` and the two failure arcs are the state.
    """
    out, total, depth, back1, back2 = [], 0.0, 0, 0.0, 0.0
    for at in range(0, len(word), PIECE):
        for begin, w, wb, t, tb, z in zip(*[x[at : at + PIECE].tolist() for x in (begins, word, word_back, two, two_back, three)]):
            if begin:
                out.append(total)
                total, depth = 0.0, 0
            if depth == 2:
                if z == z:
                    total += z
                    back1, back2 = wb, tb
                    continue
                total += back2  # down to the last word's state
                depth = 1
            if depth == 1:
                if t == t:
                    total += t
                    depth, back1, back2 = 2, wb, tb
                    continue
                total += back1
            total += w
            depth, back1 = 1, wb
    return [*out[1:], total] if out else []


def traversed(shares: DataFrame, given: DataFrame, known, floor: float) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and score of each document, by its share's arcs (share, key, p, back)."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        vocabulary, p_of, back_of = known.value
        keys, first = np.unique(found.column("key").to_numpy(), return_index=True)
        p, back = (np.append(found.column(c).to_numpy()[first], np.nan) for c in ("p", "back"))
        index = pd.Index(keys)
        look = lambda h: index.get_indexer(signed(h))  # noqa: E731  (-1, the NaN, where there is none)
        docs, parts = docs.combine_chunks(), []
        for row, upto, data, offsets in slices(docs.column("text"), SHARE):
            h, of, two, on = _ngrams(data, offsets)
            begins = np.diff(of, prepend=-1) > 0
            ids = _ids(h, vocabulary)
            word, word_back = p_of[ids], back_of[ids]
            other = np.flatnonzero(ids == 0)
            at = look(h[other])
            word[other], word_back[other] = np.where(at < 0, -floor, p[at]), np.where(at < 0, 0.0, back[at])
            seen = ids > 0
            seen[other] = at >= 0
            arc = np.full((3, len(h)), np.nan)
            on3 = on[:-1] & on[1:]
            at = look(two[on])
            arc[0, 1:][on], arc[1, 1:][on] = p[at], back[at]
            arc[2, 2:][on3] = p[look(pair_hash(two[:-1][on3], two[1:][on3]))]
            edges = np.flatnonzero(begins)
            base, n_known = np.add.reduceat(word, edges), np.add.reduceat(seen.astype(np.int64), edges)
            parts.append(batch(schema, *[docs.column(c).slice(row, upto - row).combine_chunks() for c in ("doc_id", "held_out")], np.bincount(of), n_known, base, traverse(begins, word, word_back, *arc)))
        return pa.Table.from_batches(parts, schema)

    return shares.groupBy("share").cogroup(given.groupBy("share")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, held_out) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; ``held_out`` is a condition."""
    spark = docs.sparkSession
    shares = dealt(own_columns(docs, "doc_id", "text").withColumn("held_out", F.coalesce(held_out, F.lit(False))))
    training = shares.where("not held_out")
    counts = materialise(word_counts(training), "lm-words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    floor = math.log10(total + distinct + 1)
    of_words, of_grams = arcs(training, counts, floor)
    end = np.array([END], np.uint64).view(np.int64)[0]
    frequent = (F.col("c") * VOCABULARY >= total) | (F.col("token") == F.lit(int(end)))
    rows = of_words.where(frequent).collect()  # at most VOCABULARY + 1
    rows.sort(key=lambda r: r["token"] % (1 << 64))
    vocabulary = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    known = spark.sparkContext.broadcast((vocabulary, *[np.array([x, *[r[c] for r in rows]]) for c, x in (("p", -floor), ("back", 0.0))]))
    automaton = of_grams.union(of_words.where(~frequent).select(F.col("token").alias("key"), "p", "back"))
    name, by_key = bucketed(automaton)
    for table in (of_words, of_grams, counts):
        discard(table)

    parts = []
    for i in range(BATCHES):
        mine = shares.where(F.pmod(F.xxhash64("share"), F.lit(BATCHES)) == i)
        given = asked(mine, known).join(by_key.hint("shuffle_hash"), "key").select("share", "key", "p", "back")
        parts.append(materialise(traversed(mine, given, known, floor), f"lm-scores-{i}"))
    discard(by_key)
    discard(shares)
    spark.sql(f"DROP TABLE {name}")
    columns = ("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
    return functools.reduce(DataFrame.union, parts).select(*columns)


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def base_scores(spark, sf_dir: str) -> DataFrame:
    """What of ``op6_lm_scoring`` SQL can express."""
    return op6_lm_scoring(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 4))


#: The crc32 of an id's digits is a fold over its bytes and their bits.
BASE_SQL = r"""
WITH bytes AS (
  SELECT doc_id, list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)) AS b FROM documents
), held AS (
  SELECT DISTINCT doc_id, xor(list_reduce(b, lambda acc, x: list_reduce(list_prepend(xor(acc, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 7 = 2 AS held_out FROM bytes
), d AS (
  SELECT doc_id, held_out, unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '')) AS token FROM documents JOIN held USING (doc_id)
), counts AS (SELECT token, count(*) AS c FROM d WHERE NOT held_out GROUP BY token
), totals AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM counts)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(c)::BIGINT AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) AS base_score
FROM d LEFT JOIN counts USING (token), totals GROUP BY doc_id, held_out
"""
