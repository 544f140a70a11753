"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all items form one automaton: a state stands for the word
sequences that end at the same places of the items. A document's words stream
through it once, each step keeping the state and the length of the longest
suffix that some item contains; where that length reaches ``window`` words (or
a whole shorter item), the matched words are hit.

The benchmark is streamed to the driver in blocks of at most ``BLOCK_WORDS``
words (or one longer item). One block's automaton is there at a time: it is
built, broadcast, used for one scan of the documents and destroyed, before the
next is built, so memory is bounded by a block (about 500 bytes a word), however
large the benchmark is. A benchmark of one block needs no shuffle; otherwise each
scan writes the hit word ranges of the rows that have any, and these are united
by row.

Defined results: a null or wordless text has no words, no hits and isn't
contaminated; a null or wordless item has no window; repeated document rows
each get a row; further columns are ignored by ``contamination`` and kept by
``decontaminate``; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import NOT_ALNUM, flat, materialise, own_columns, read, slices, words

WINDOW = 13
BLOCK_WORDS = 300_000
_BITS = 32


class Automaton:
    """Suffix automaton over several word sequences; arcs: state << 32 | word -> state."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.window = window
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        self.arcs: dict[int, int] = {}
        self.length, self.link = [0], [-1]
        out: list[dict[int, int]] = [{}]
        coded = [(name, np.searchsorted(self.vocabulary, h).tolist()) for name, h in items if len(h)]
        for _, ids in coded:
            last = 0
            for word in ids:
                last = self._extend(out, last, word)
        for state, arcs in enumerate(out):
            for word, target in arcs.items():
                self.arcs[state << _BITS | word] = target
        self.shortest = min([window, *(len(ids) for _, ids in coded)], default=window)
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        #: The state of the suffixes of at least window words that are shortest, from each state on along its links.
        self.at_window = [0] * len(self.length)
        for state in by_length:
            self.at_window[state] = self.at_window[self.link[state]] if self.length[self.link[state]] >= window else state
        #: Items by the state whose sequences include a window of theirs; whole shorter items by state, with their length.
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, ids in coded:
            state = 0
            for n, word in enumerate(ids, 1):
                state = self.arcs[state << _BITS | word]
                if n >= window:
                    self.items.setdefault(self.at_window[state], set()).add(name)
            if len(ids) < window:
                while self.length[self.link[state]] >= len(ids):
                    state = self.link[state]
                self.short.setdefault(state, []).append((len(ids), name))
        #: The nearest state with whole shorter items, from each state on along its suffix links; shorter sequences come first.
        self.short_of = [0] * len(self.length)
        for state in by_length if self.short else ():
            self.short_of[state] = state if state in self.short else self.short_of[self.link[state]]

    def _new(self, out, length: int, link: int, arcs: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        out.append(arcs)
        return len(out) - 1

    def _split(self, out, state: int, word: int, target: int) -> int:
        """The state for what ``state`` followed by ``word`` ends in, taken out of ``target`` where that holds longer sequences too."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(out, self.length[state] + 1, self.link[target], dict(out[target]))
        self.link[target] = copy
        while state >= 0 and out[state].get(word) == target:
            out[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, out, last: int, word: int) -> int:
        if (target := out[last].get(word)) is not None:
            return self._split(out, last, word, target)
        new, state = self._new(out, self.length[last] + 1, 0, {}), last
        while state >= 0 and word not in out[state]:
            out[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(out, state, word, out[state][word])
        return new

    def scan(self, ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end position, words to mark, state) of each match, from the longest matching suffix at each word."""
        arcs, link, length, state, n = self.arcs, self.link, self.length, 0, 0
        for i, word in enumerate(ids):
            while (target := arcs.get(state << _BITS | word)) is None and state:
                state = link[state]
                n = length[state]
            if target is None:
                n = 0
                continue
            state, n = target, n + 1
            if n >= self.shortest:
                yield i, n, state

    def matches(self, ids: list[int], found: set[str]) -> Iterator[tuple[int, int]]:
        """(end position, hit words up to it); ``found`` gathers the items."""
        for i, n, state in self.scan(ids):
            most = n if n >= self.window else 0
            if most:
                found |= self.items.get(self.at_window[state], set())
            at = self.short_of[state]  # at most window - 1 states: whole items of different lengths
            while at:
                reach = n if at == state else self.length[at]
                for m, name in self.short[at]:
                    if m <= reach:
                        found.add(name)
                        most = max(most, m)
                at = self.short_of[self.link[at]]
            if most:
                yield i, most


def _scanned(column: pa.Array, automaton: Automaton | None) -> Iterator[tuple[np.ndarray, set[str], np.ndarray, np.ndarray]]:
    """For each row: the word ranges that are hit (ends by start), the items, and where its words start and end in its bytes."""
    vocabulary = automaton.vocabulary if automaton else np.zeros(0, np.uint64)
    for _, _, data, offsets in slices(column):
        w = words(data, offsets, NOT_ALNUM)
        at = np.minimum(np.searchsorted(vocabulary, w.hash), max(len(vocabulary) - 1, 0))
        known = vocabulary[at] == w.hash if len(vocabulary) else np.zeros(len(w.hash), bool)
        for row in range(len(offsets) - 1):
            a, b = w.first[row], w.first[row + 1]
            ends, lengths, found = [], [], set()
            edges = np.flatnonzero(np.diff(np.concatenate([[0], known[a:b].view(np.int8), [0]])))
            for start, end in zip(edges[::2], edges[1::2], strict=True):
                if end - start >= automaton.shortest:
                    for i, n in automaton.matches(at[a + start : a + end].tolist(), found):
                        ends.append(start + i + 1)
                        lengths.append(n)
            ends = np.array(ends, np.int64)
            yield united(ends - np.array(lengths, np.int64), ends, int(b - a)), found, w.start[a:b] - offsets[row], w.end[a:b] - offsets[row]


def united(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """The maximal runs among n places that some range covers, as rows of (start, end)."""
    edge = np.zeros(n + 2, np.int64)
    np.add.at(edge, starts + 1, 1)
    np.add.at(edge, ends + 1, -1)
    inside = np.cumsum(edge) > 0
    return np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)


def blocks(benchmark: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[list[tuple[str, np.ndarray]]]:
    """The items' words as hashes, at most ``limit`` words (or one item) at a time, streamed a partition at a time."""
    block, n = [], 0
    for row in own_columns(benchmark, "item_id", "text").where("text is not null and item_id is not null").toLocalIterator():
        data, offsets = flat(pa.array([row["text"]]))
        h = words(data, offsets, NOT_ALNUM).hash
        if block and n + len(h) > limit:
            yield block
            block, n = [], 0
        block.append((str(row["item_id"]), h))
        n += len(h)
    yield block


def _with_hits(docs: DataFrame, benchmark: DataFrame, window: int, limit: int):
    """(rows, scan): the documents, and a function from their Arrow batches to what ``_scanned`` tells of each row.

    With one block the scan runs its automaton. With several, the rows carry two
    more columns at their end: the hit ranges and the items that the blocks' own
    scans have found.
    """
    spark, width, at = docs.sparkSession, len(docs.columns), docs.columns.index("text")
    one, tables, before = None, [], None
    for block in blocks(benchmark, limit):
        if before is not None:
            tables.append(_block_hits(docs, before, window))
        before = block
    if not tables:
        one = spark.sparkContext.broadcast(Automaton(before, window))
        return docs, lambda b: _scanned(b.column(at), one.value)
    tables.append(_block_hits(docs, before, window))
    every = tables[0]
    for t in tables[1:]:
        every = every.union(t)
    every = every.groupBy(F.col("doc_id").alias("__doc"), F.col("h").alias("__h")).agg(F.flatten(F.collect_list("ranges")).alias("__ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("__items"))
    rows = docs.join(every, F.col("doc_id").eqNullSafe(F.col("__doc")) & F.xxhash64("text").eqNullSafe(F.col("__h")), "left").select(*[docs[f"`{c}`"] for c in docs.columns], "__ranges", "__items")

    def scan(b):
        for (_, _, start, end), ranges, items in zip(_scanned(b.column(at), None), b.column(width), b.column(width + 1), strict=True):
            ranges = ranges.values.to_numpy().reshape(-1, 2) if ranges.is_valid else np.zeros((0, 2), np.int64)
            yield united(ranges[:, 0], ranges[:, 1], len(start)), set(items.as_py() or ()), start, end

    return rows, scan


def _block_hits(docs: DataFrame, block: list, window: int) -> DataFrame:
    """doc_id, h (a hash of the text), ranges and items of the rows that one block of items hits, written."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(block, window))
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("ranges", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def scan(batches):
        for b in batches:
            rows = [{"doc_id": i, "h": h, "ranges": ranges.ravel(), "items": sorted(found)} for i, h, (ranges, found, _, _) in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _scanned(b.column(2), shared.value), strict=True) if found]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    hits = own_columns(docs, "doc_id", "text").select("doc_id", F.xxhash64("text"), "text").mapInArrow(scan, "doc_id long, h long, ranges array<long>, items array<string>")
    out = materialise(hits.dropDuplicates(["doc_id", "h"]), "contamination-hits")
    shared.destroy()
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = 20, limit: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted item ids), contaminated (hit words are at least 1/coverage of all) and spans (byte ranges of runs of hit words)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    rows, hits = _with_hits(own_columns(docs, "doc_id", "text"), benchmark, window, limit)

    def scan(batches):
        for b in batches:
            found = [{"doc_id": i, "n_words": len(start), "n_hit": int((runs[:, 1] - runs[:, 0]).sum()), "items": sorted(items), "spans": [{"start": int(start[x]), "end": int(end[y - 1])} for x, y in runs]} for i, (runs, items, start, end) in zip(b.column(0).to_pylist(), hits(b), strict=True)]
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    out = rows.mapInArrow(scan, "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(coverage) * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = 20, action: str = "drop", limit: int = BLOCK_WORDS) -> DataFrame:
    """The documents without the contaminated ones (action "drop"), or with the hit spans cut out of those (action "cut"); all others stay as they are. Columns stay as they are too."""
    rows, hits = _with_hits(docs, benchmark, window, limit)
    at, width = docs.columns.index("text"), len(docs.columns)

    def clean(batches):
        for b in batches:
            keep, texts = [], []
            for text, (runs, _, start, end) in zip(b.column(at).to_pylist(), hits(b), strict=True):
                bad = len(runs) > 0 and coverage * int((runs[:, 1] - runs[:, 0]).sum()) >= len(start)
                keep.append(not (bad and action == "drop"))
                if bad and action == "cut":
                    raw = text.encode()
                    mask = np.ones(len(raw), bool)
                    for x, y in runs:
                        mask[start[x] : end[y - 1]] = False
                    text = np.frombuffer(raw, np.uint8)[mask].tobytes().decode()
                texts.append(text)
            out = b.select(range(width))
            if action == "cut":
                out = out.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield out.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(clean, docs.schema)


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


#: Words and windows by position, joined on the window's words.
OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS s
  FROM items, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS t(i) WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT m FROM windows
), grams AS (
  SELECT doc_id, i, m, array_to_string(ws[i : i + m - 1], ' ') AS s
  FROM w, sizes, unnest(range(1, len(ws) - m + 2)) AS t(i)
), found AS (
  SELECT doc_id, i, grams.m, item_id FROM grams JOIN windows ON grams.m = windows.m AND grams.s = windows.s
), hits AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM found) GROUP BY doc_id
), names AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(names.n, 0)::BIGINT AS n_items,
  sha256(coalesce(names.items, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hits ON w.doc_id = hits.doc_id LEFT JOIN names ON w.doc_id = names.doc_id
"""
