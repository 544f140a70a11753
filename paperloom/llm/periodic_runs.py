"""Periodic run detection on a harmonic grid.

A run of period p that holds ``REPEATS`` periods covers that many consecutive
multiples of p. So for each p up to a ``REPEATS``-th of a text's words only the
pairs jp, (j+1)p of the grid are looked at, n/p of them: how far the text agrees
from both places on (forward LCE) and before them (backward LCE) gives the run
through the pair, if there is one.

LCE queries are range minima over the LCP array of the text's suffix array, and
of that of the reversed text. A pair whose words differ lies in no run, nor does
one that isn't among ``REPEATS`` - 1 neighbouring pairs of equal words on its
grid; such pairs are left out before any query, and texts without pairs need no
suffix array. Texts of a slice are sorted together, each in its own range of
ranks, so that no match crosses a text.

A run found at a multiple of its smallest period has the same ends there (both
lie in each other's extension), so of equal ends the smallest period is kept.

Words are compared as bytes, exactly. Work is local to a document; a text of n
words takes O(n log n) time and some 250 bytes a word.

Defined results: null and wordless texts have no runs and an empty collapsed
text; rows with equal or null doc_ids are looked at one by one; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import map_arrow, own_columns, read, slices

#: A run has so many periods at least, and so many words.
REPEATS, LEAST = 4, 6
#: Texts of so many bytes are looked at together.
SLICE = 1 << 19
#: Pairs of the grid that are made at once.
BLOCK = 1 << 19
WORD = r"[^\x20\x09-\x0D]+"
RUN = "struct<start long, length long, period long>"


def dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.zeros(len(keys), np.int32)
    new[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(new)
    return out


class Suffixes:
    """The suffix array of texts side by side, as ranks, with the minima of its LCP array. ids[first[t]:first[t+1]] are the words of text t."""

    def __init__(self, ids: np.ndarray, first: np.ndarray) -> None:
        n, sizes = len(ids), np.diff(first)
        text, end = np.repeat(np.arange(len(sizes)), sizes), np.repeat(first[1:], sizes)
        # Prefix doubling: ranks by the first 1, 2, 4, ... words, until no two suffixes share one. A suffix that ends is before those that go on.
        ranks = [dense(text * (int(ids.max(initial=0)) + 1) + ids)]
        while n and int(ranks[-1].max()) < n - 1:
            now, at = ranks[-1], np.arange(n) + (1 << len(ranks) - 1)
            after = np.where(at < end, now[np.minimum(at, n - 1)] + 1, 0)
            ranks.append(dense(now.astype(np.int64) * (n + 1) + after))
        self.rank = ranks[-1]
        order = np.empty(n, np.int32)
        order[self.rank] = np.arange(n, dtype=np.int32)
        # The LCP of neighbours, by halving: equal ranks at a level are as many equal words, as a shorter suffix has a rank of its own.
        a, b, lcp = order[:-1].astype(np.int64), order[1:].astype(np.int64), np.zeros(max(n - 1, 0), np.int32)
        for level in reversed(range(len(ranks))):
            x, y = a + lcp, b + lcp
            same = (x < n) & (y < n) & (ranks[level][np.minimum(x, n - 1)] == ranks[level][np.minimum(y, n - 1)])
            lcp += same.astype(np.int32) << level
            ranks.pop()
        self.minima = [lcp]
        while len(self.minima[-1]) > (half := 1 << len(self.minima) - 1):
            self.minima.append(np.minimum(self.minima[-1][:-half], self.minima[-1][half:]))

    def lce(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words agree from x and from y on; x and y differ."""
        i, j = np.minimum(self.rank[x], self.rank[y]), np.maximum(self.rank[x], self.rank[y])
        level = np.frexp((j - i).astype(float))[1] - 1
        out = np.empty(len(x), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.minima[k][i[at]], self.minima[k][j[at] - (1 << k)])
        return out


def grid(ids: np.ndarray, first: np.ndarray, repeats: int = REPEATS, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, p): the grid's pairs x, x + p that ``repeats`` - 1 neighbouring pairs of equal words begin with, about ``block`` pairs at a time."""
    n = np.diff(first)
    periods = n // repeats
    start = np.repeat(first[:-1], periods)
    p = np.arange(len(start)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    pairs = (np.repeat(n, periods) - 1) // p
    ends, a = np.cumsum(pairs), 0
    while a < len(p):
        done = int(ends[a] - pairs[a])
        z = max(a + 1, int(np.searchsorted(ends, done + block, "right")))
        m = pairs[a:z]
        step, lane = np.repeat(p[a:z], m), np.repeat(np.arange(z - a, dtype=np.int32), m)
        x = np.repeat(start[a:z], m) + (np.arange(len(step)) - np.repeat(ends[a:z] - m - done, m)) * step
        same = ids[x] == ids[x + step]
        kept = same[: len(x) - repeats + 2] & (lane[: len(x) - repeats + 2] == lane[repeats - 2 :])
        for k in range(1, repeats - 1):
            kept &= same[k : len(x) - repeats + 2 + k]
        at = np.flatnonzero(kept)
        yield x[at], step[at]
        a = z


def runs(ids: np.ndarray, first: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> np.ndarray:
    """(start, end, period) of all runs of the texts, by start and period."""
    size = np.diff(first)
    marked = np.zeros(len(size), bool)
    for x, _ in grid(ids, first, repeats):
        marked[np.searchsorted(first, x, "right") - 1] = True
    found = [np.zeros((0, 3), np.int64)]
    if marked.any():
        own = ids[np.repeat(marked, size)]
        bounds = np.concatenate([[0], np.cumsum(size[marked])])
        shift = first[:-1][marked] - bounds[:-1]
        n, ahead, back = len(own), Suffixes(own, bounds), Suffixes(own[::-1], len(own) - bounds[::-1])
        for x, p in grid(own, bounds, repeats):
            text = np.searchsorted(bounds, x, "right") - 1
            after, before = ahead.lce(x, x + p), np.zeros(len(x), np.int64)
            inner = np.flatnonzero(x > bounds[text])
            before[inner] = back.lce(n - x[inner], n - x[inner] - p[inner])
            start, end = x - before, x + p + after
            long = end - start >= np.maximum(least, repeats * p)
            found.append(np.unique(np.stack([start + shift[text], end + shift[text], p], 1)[long], axis=0))
    out = np.unique(np.concatenate(found), axis=0)
    if len(out):  # by start, end and period: of equal ends the first has the smallest
        out = out[np.concatenate([[True], (out[1:, :2] != out[:-1, :2]).any(axis=1)])]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words, but for those that a run holds after its first period."""
    if not found:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, end, period in found:
        depth[start + period] += 1
        depth[end] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, repeats: int = REPEATS, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length and period of each, in words, by start and period) and collapsed (the words that no run repeats, joined by spaces)."""
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(item)), ("collapsed", pa.string())])

    def find(batches):
        for b in batches:
            for row, upto, data, offsets in slices(b.column(1), SLICE):
                number: dict[bytes, int] = {}
                raw = data.tobytes()
                # bytes.split() parts at \x20 and \x09 to \x0D.
                texts = [raw[s:e].split() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                ids = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, int(first[-1]))
                found = runs(ids, first, repeats, least)
                bounds = np.searchsorted(found[:, 0], first)
                own = found - np.repeat(first[:-1], np.diff(bounds))[:, None] * [1, 1, 0]
                left = [collapsed(t, own[s:e].tolist()) for t, s, e in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                rows = pa.StructArray.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1] - own[:, 0]), pa.array(own[:, 2])], fields=list(item))
                columns = [b.column(0).slice(row, upto - row), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows), pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return map_arrow(own_columns(docs, "doc_id", "text"), find, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def looped(text: Column, doc_id: Column) -> Column:
    """The text whose words repeat from some word on, for ids whose crc32 ends in 0; the others' own."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def turned(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(again, " ")).otherwise(F.lit(""))

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return F.when(h % 10 == 0, F.element_at(F.transform(F.array(words), turned), 1)).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(docs.select("doc_id", looped(F.col("text"), F.col("doc_id")).alias("text")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))
    # The greatest length; of equal ones the smallest start, then period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return out.withColumn("exponent_milli", F.floor(F.lit(1000).cast("long") * F.col("length") / F.col("period")).cast("long"))


#: Streaks of words that equal those q words on, found by joining equal words of a document.
OP11_SQL = r"""
WITH bytes AS (
  SELECT doc_id, list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)) AS b FROM documents
), hashed AS (
  SELECT DISTINCT doc_id, xor(list_reduce(b, lambda acc, x: list_reduce(list_prepend(xor(acc, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) AS h FROM bytes
), texts AS (
  SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents JOIN hashed USING (doc_id)
), planned AS (
  SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a, 3 + g % 8 AS d FROM texts
), numbered AS (
  SELECT doc_id, n, i, w[CASE WHEN i < coalesce(a, n) THEN i ELSE a + (i - a) % (1 + (n - a) // d) END + 1] AS word FROM planned, unnest(range(n)) AS t(i)
), same AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM numbered x JOIN numbered y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), streaks AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM streaks WHERE length >= greatest(6, 4 * q) GROUP BY ALL
), listed AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256,
    arg_min({'s': start, 'l': length, 'p': period}, {'l': -length, 's': start, 'p': period}) AS best FROM runs GROUP BY doc_id
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM numbered ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period, (1000 * best.l // best.p)::BIGINT AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

