"""Suffix-array dedup: removes every byte covered by a string of ``length`` bytes that also starts in a document with a smaller doc_id.

The suffix array is sparse. Every string of ``length`` bytes contains the least
seed (a run of ``SEED`` bytes, in hashed order) of its own seeds, wherever it
stands, so only suffixes at such least seeds ("anchors", about one byte in
eighteen) are sorted:

1. Anchors are counted by seed; those whose seed only one document has are let go.
2. The suffixes that are left, with the bytes before them that a match can reach,
   are range-partitioned by their leading ``length`` bytes: Spark samples the
   splitters. Suffixes of a seed that very many documents share are spread over
   as many buckets as they need.
3. A bucket sorts its suffixes by multikey quicksort over eight-byte keys. Runs
   with a common prefix of a seed at least are groups. Inside a group the strings
   of ``length`` bytes around the anchor are compared and those that a smaller
   doc_id also has are marked.
4. Groups at the ends of a block of sorted suffixes may go on in the next: of
   their strings the least doc_id of each block is compared across boundaries.
5. Marked strings are joined to the documents by doc_id, and their bytes removed.

Strings of one group, which share sixteen bytes, are told apart by 64-bit hashes:
the chance that two different ones of n are taken for equal is below n * n / 2**65.

Copies of a whole text need none of this: all but the first lose every byte.
Seeds that several documents of one slice share are settled there but for two,
and equal surroundings but for the first, before anything is shuffled: a passage
that a third of all documents hold sends some rows a slice.

Defined results: null texts are empty; texts shorter than ``length`` lose
nothing; a row with a null doc_id neither loses bytes nor makes others lose
any; rows with the same doc_id don't count as smaller than each other; further
columns are kept by ``dedup`` and ignored by ``removals``; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import batch, flat, materialise, mix, n_tasks, own_columns, powers, prefix_hash, read, signed, slices

LENGTH = 50
SEED = 16
#: Contexts that a bucket compares at once.
BLOCK = 40_000
#: Runs of suffixes so short are sorted at once.
SHORT_RUN = 2048


def _sliding(values: np.ndarray, width: int, function) -> np.ndarray:
    """function over each run of ``width`` values, by doubling."""
    out, done = values, 1
    while done * 2 <= width:
        out = function(out[:-done], out[done:])
        done *= 2
    return function(out[: len(out) - (width - done)], out[width - done :]) if width > done else out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(position, seed hash) of the seeds that are least in some string of ``length`` bytes inside a row."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = prefix_hash(data)
    h = mix((prefix[seed:] - prefix[:-seed]) * powers(len(prefix))[1][: len(prefix) - seed])
    width = length - seed + 1
    least = _sliding(h, width, np.minimum)
    starts = np.zeros(len(least) + 1, np.int64)
    n = np.diff(offsets)
    full = n >= length
    np.add.at(starts, offsets[:-1][full], 1)
    np.add.at(starts, offsets[:-1][full] + n[full] - length + 1, -1)
    least[np.cumsum(starts[:-1]) == 0] = 0  # a string that crosses rows has no least seed
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero((_sliding(padded, width, np.maximum) == h) & (h != 0))
    return at, h[at]


def _seeds(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """seed, doc, pos of all anchors; sure: other documents of the same slice have the seed too, as two rows that aren't sure tell."""
    schema = pa.schema([("seed", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32()), ("sure", pa.bool_())])

    def find(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for row, _, data, offsets in slices(b.column(1)):
                at, h = anchors(data, offsets, length, seed)
                r = np.searchsorted(offsets, at, "right") - 1
                doc, pos = ids[row + r], at - offsets[r]
                order = np.lexsort((doc, h))
                h, doc, pos = h[order], doc[order], pos[order]
                new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
                last = np.concatenate([new[1:], [True]]) if len(h) else new
                group = np.cumsum(new) - 1
                many = (doc[last] != doc[new])[group]
                yield batch(schema, signed(h), doc, pos.astype(np.int32), many & ~new & ~last)

    return docs.mapInArrow(find, "seed long, doc long, pos int, sure boolean")


def _shared(found: DataFrame) -> DataFrame:
    """doc, pos of the anchors whose seed several documents have."""
    schema = pa.schema([("doc", pa.int64()), ("pos", pa.int32())])

    def several(batches):
        parts = [[], [], [], []]
        for b in batches:
            for p, c in zip(parts, b.columns, strict=True):
                p.append(c.to_numpy(zero_copy_only=False))
        if not parts[0]:
            return
        h, doc, pos, sure = (np.concatenate(p) for p in parts)
        del parts
        order = np.lexsort((doc, h))
        h, doc, pos, sure = h[order], doc[order], pos[order], sure[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        last = np.concatenate([new[1:], [True]])
        keep = sure | (doc[last] != doc[new])[np.cumsum(new) - 1]
        yield batch(schema, doc[keep], pos[keep])

    key = F.when(F.col("sure"), F.xxhash64("doc", "pos")).otherwise(F.col("seed"))
    return found.repartition(n_tasks(found.sparkSession), key).select("seed", "doc", "pos", "sure").mapInArrow(several, "doc long, pos int")


def _suffixes(placed: DataFrame, length: int, seed: int) -> DataFrame:
    """doc, h, pos, lo and hi (how far the bytes around an anchor reach) and around; or mask, for those that an equal row of the same slice settles."""
    schema = pa.schema([("doc", pa.int64()), ("h", pa.int64()), ("pos", pa.int32()), ("lo", pa.int16()), ("hi", pa.int16()), ("around", pa.binary()), ("mask", pa.int64())])
    back = length - seed

    def cut(batches):
        for b in batches:
            ids, hs = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            positions, bounds = b.column(3).flatten().to_numpy(), np.concatenate([[0], np.cumsum(b.column(3).value_lengths().to_numpy(zero_copy_only=False))])
            for row, upto, data, offsets in slices(b.column(2), 1 << 18):
                r = np.repeat(np.arange(upto - row), np.diff(bounds[row : upto + 1]))
                pos = positions[bounds[row] : bounds[upto]].astype(np.int64)
                n = np.diff(offsets)[r]
                fits = pos + seed <= n
                r, pos, n = r[fits], pos[fits], n[fits]
                lo, hi = np.minimum(pos, back), np.minimum(n - pos, length)
                long = lo + hi >= length
                r, pos, lo, hi = r[long], pos[long], lo[long], hi[long]
                if not len(r):
                    continue
                grid = np.arange(-back, length)
                around = np.where((grid >= -lo[:, None]) & (grid < hi[:, None]), np.concatenate([data, np.zeros(1, np.uint8)])[np.clip((offsets[r] + pos)[:, None] + grid, 0, len(data))], 0).astype(np.uint8)
                h = mix((around.astype(np.uint64) + np.uint64(1)) @ powers(length + back)[0] + mix((lo * 64 + hi).astype(np.uint64)))
                doc = ids[row + r]
                order = np.lexsort((doc, h))
                new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
                least = np.empty(len(r), np.int64)
                least[order] = doc[order][new][np.cumsum(new) - 1]
                settled = doc > least
                shown = pa.array([x.tobytes() for x in around[~settled]], pa.binary()).take(pa.array(np.where(settled, -1, np.cumsum(~settled) - 1), pa.int64(), mask=settled)) if (~settled).any() else pa.nulls(len(r), pa.binary())
                every = _mask(np.ones((len(r), back + 1), bool) & _inside(lo, hi, back, length))
                yield batch(schema, doc, hs[row + r], pos.astype(np.int32), lo.astype(np.int16), hi.astype(np.int16), shown, pa.array(every, pa.int64(), mask=~settled))

    return placed.mapInArrow(cut, "doc long, h long, pos int, lo short, hi short, around binary, mask long")


def _inside(lo: np.ndarray, hi: np.ndarray, back: int, length: int) -> np.ndarray:
    """Which strings around an anchor lie in its document: the o-th starts back - o bytes before it."""
    o = np.arange(back + 1)
    return (back - o <= lo[:, None]) & (o - back + length <= hi[:, None])


def _mask(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.int64) << np.arange(bits.shape[1], dtype=np.int64)).sum(axis=1)


def multikey_quicksort(keys: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their keys, the first first: each run is parted by a pivot of one key into less, equal and greater, and the equal part goes on with the next key."""
    order = np.arange(len(keys[0]))
    runs = [(0, len(order), 0)]
    while runs:
        a, z, d = runs.pop()
        if z - a < 2 or d == len(keys):
            continue
        rows = order[a:z]
        if z - a <= SHORT_RUN:
            order[a:z] = rows[np.lexsort([k[rows] for k in keys[d:][::-1]])]
            continue
        key = keys[d][rows]
        pivot = np.sort(key[:: max(1, len(key) // 9)])[4]
        less, equal = key < pivot, key == pivot
        parts = rows[less], rows[equal], rows[~(less | equal)]
        order[a:z] = np.concatenate(parts)
        m, n = a + len(parts[0]), a + len(parts[0]) + len(parts[1])
        runs += [(a, m, d), (m, n, d + 1), (n, z, d)]
    return order


def _compared(suffixes: DataFrame, length: int, seed: int, block: int = BLOCK) -> DataFrame:
    """doc, h, pos, mask: which strings around each anchor a smaller doc_id has too. A partition holds a range of suffixes.

    Rows with a key are strings (mask has its bit) of groups at the ends of
    blocks, with the least doc_id that the block knows for them.
    """
    schema = pa.schema([("doc", pa.int64()), ("h", pa.int64()), ("pos", pa.int32()), ("mask", pa.int64()), ("key", pa.int64())])
    back = length - seed
    up, down = powers(length + back + 1)

    def compare(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables).combine_chunks()
        doc, h, pos, lo, hi = (t.column(i).to_numpy() for i in range(5))
        around = flat_rows(t.column(5), back + length)
        keys = [np.ascontiguousarray(around[:, back + i : back + i + 8]).view(">u8")[:, 0].astype(np.uint64) for i in range(0, length - 7, 8)]
        order = multikey_quicksort(keys)
        group = mix(keys[0] ^ mix(keys[1] + np.uint64(1)))
        for a in range(0, len(order), block):
            at = order[a : a + block]
            prefix = np.zeros((len(at), back + length + 1), np.uint64)
            np.cumsum((around[at].astype(np.uint64) + np.uint64(1)) * up[:-1], axis=1, out=prefix[:, 1:])
            strings = mix((prefix[:, length : length + back + 1] - prefix[:, : back + 1]) * down[: back + 1] + group[at][:, None])
            inside = _inside(lo[at].astype(np.int64), hi[at].astype(np.int64), back, length)
            s, d = strings[inside], np.broadcast_to(doc[at][:, None], inside.shape)[inside]
            by = np.argsort(s, kind="stable")
            new = np.concatenate([[True], s[by][1:] != s[by][:-1]])
            least = np.empty(len(s), np.int64)
            least[by] = np.minimum.reduceat(d[by], np.flatnonzero(new))[np.cumsum(new) - 1]
            bits = np.zeros(inside.shape, bool)
            bits[inside] = least < d
            some = bits.any(axis=1)
            n = int(some.sum())
            yield batch(schema, doc[at][some], h[at][some], pos[at][some], _mask(bits[some]), pa.nulls(n, pa.int64()))
            edge = (group[at] == group[at[0]]) | (group[at] == group[at[-1]])
            row, bit = np.nonzero(inside & ~bits & edge[:, None])
            yield batch(schema, doc[at][row], h[at][row], pos[at][row], np.int64(1) << bit, signed(strings[row, bit]))

    return suffixes.mapInArrow(compare, "doc long, h long, pos int, mask long, key long")


def _across(compared: DataFrame) -> DataFrame:
    """doc, h, pos, mask of what blocks have marked, and of the strings at their ends that another block knows from a smaller doc_id."""
    ends = compared.where("key is not null")
    least = ends.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    marked = ["doc", "h", "pos", "mask"]
    return compared.where("key is null").select(marked).union(ends.join(least, "key").where("least < doc").select(marked))


def flat_rows(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A binary column whose values have ``width`` bytes each, as a table of bytes."""
    parts = [flat(c.cast(pa.large_binary()).view(pa.large_string()))[0] for c in column.chunks]
    return np.concatenate(parts).reshape(-1, width)


def marks(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc, h (a hash of the text), places and masks: the strings to remove, as in ``_compared``; or whole, for texts that a smaller doc_id has too."""
    spark = docs.sparkSession
    keyed = docs.where("doc_id is not null").select("doc_id", F.crc32("text").alias("h"), "text")
    copies = docs.where("doc_id is not null").select("doc_id", F.crc32("text").alias("h"), F.octet_length("text").alias("n"), F.xxhash64("text").alias("x")).where(F.col("n") >= length)
    first = copies.groupBy("h", "n", "x").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")).where("k > 1").drop("k")
    whole = materialise(copies.join(first, ["h", "n", "x"]).where("doc_id > least").select(F.col("doc_id").alias("doc"), "h").distinct(), "suffix-copies")
    shared = _shared(_seeds(docs.where("doc_id is not null").select("doc_id", "text"), length, seed))
    # Each step's table is written before the next begins, so that its shuffle files can go.
    places = materialise(shared.groupBy("doc").agg(F.collect_list("pos").alias("places")), "suffix-anchors")
    placed = keyed.join(places, F.col("doc") == F.col("doc_id")).drop("doc").join(whole.withColumnRenamed("doc", "doc_id"), ["doc_id", "h"], "left_anti")
    suffixes = _suffixes(placed.select("doc_id", "h", "text", "places"), length, seed)
    lead = F.expr(f"substring(around, {length - seed + 1}, {length})")
    open_ = suffixes.where("mask is null").drop("mask").repartitionByRange(n_tasks(spark), lead)
    settled = suffixes.where("mask is not null").select("doc", "h", "pos", "mask", F.lit(None).cast("long").alias("key"))
    found = _across(materialise(_compared(open_, length, seed).union(settled), "suffix-compared"))
    marked = materialise(found.groupBy("doc", "h").agg(F.collect_list("pos").alias("places"), F.collect_list("mask").alias("masks"), F.lit(False).alias("whole")), "suffix-marks")
    return marked.union(whole.select("doc", "h", F.array().cast("array<int>"), F.array().cast("array<bigint>"), F.lit(True)))


def removed(n: int, places: np.ndarray, masks: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Which of n bytes the marked strings cover."""
    back = length - seed
    i, o = np.nonzero((masks[:, None] >> np.arange(back + 1)) & 1)
    starts = np.unique(places[i] + o - back)
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def _with_marks(docs: DataFrame, length: int, seed: int) -> DataFrame:
    found = marks(own_columns(docs, "doc_id", "text"), length, seed)
    return docs.join(found.withColumnsRenamed({"doc": "__doc", "h": "__h", "places": "__places", "masks": "__masks", "whole": "__whole"}), (F.col("__doc") == F.col("doc_id")) & (F.col("__h") == F.crc32("text")), "left").drop("__doc", "__h")


def _kept(b: pa.RecordBatch, text: int, length: int, seed: int):
    """For each row: its bytes and which of them go (None: none)."""
    names = b.schema.names
    whole, places, masks = (b.column(names.index(n)) for n in ("__whole", "__places", "__masks"))
    for i in range(b.num_rows):
        raw = (b.column(text)[i].as_py() or "").encode()
        if not whole[i].is_valid:
            yield raw, None
        elif whole[i].as_py():
            yield raw, np.ones(len(raw), bool)
        else:
            yield raw, removed(len(raw), places[i].values.to_numpy().astype(np.int64), masks[i].values.to_numpy(), length, seed)


def removals(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256 of the bytes that stay."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def digest(batches):
        for b in batches:
            rows = []
            for raw, gone in _kept(b, 1, length, seed):
                kept = raw if gone is None else np.frombuffer(raw, np.uint8)[~gone].tobytes()
                spans = 0 if gone is None else int((np.diff(np.concatenate([[False], gone]).view(np.int8)) == 1).sum())
                rows.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            yield batch(schema, b.column(0), *(zip(*rows, strict=True) if rows else [[]] * 4))

    return _with_marks(own_columns(docs, "doc_id", "text"), length, seed).mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """The documents with repeated strings removed from their texts, and without those of which nothing is left; n_chars, if there, follows. A character that loses some of its bytes goes."""
    columns = docs.columns
    at = columns.index("text")

    def clean(batches):
        for b in batches:
            texts, keep = [], []
            for i, (raw, gone) in enumerate(_kept(b, at, length, seed)):
                if gone is None:
                    texts.append(b.column(at)[i].as_py())
                else:
                    texts.append(np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore"))
                keep.append(gone is None or bool(texts[-1].strip()))
            out = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type)).select(columns)
            if "n_chars" in columns:
                i = columns.index("n_chars")
                out = out.set_column(i, out.schema.field(i), pa.array([None if t is None else len(t) for t in texts], out.schema.field(i).type))
            yield out.filter(pa.array(keep, pa.bool_()))

    return _with_marks(docs, length, seed).mapInArrow(clean, docs.schema)


def op8_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return removals(read(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH b AS (
  SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), h AS (SELECT doc_id, hex(t) AS x, n FROM b
), s AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 100)) AS g FROM h, unnest(range(0, n - 49)) AS u(i)
), covered AS (
  SELECT doc_id, i, g, min(doc_id) OVER (PARTITION BY g) AS first_doc FROM s
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM covered WHERE first_doc < doc_id
), spans AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE NOT after) AS n_spans FROM (
    SELECT doc_id, j, coalesce(lag(j) OVER (PARTITION BY doc_id ORDER BY j) = j - 1, false) AS after FROM gone) GROUP BY doc_id
), runs AS (
  SELECT doc_id, r, min(j) AS a, max(j) AS z FROM (SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS r FROM gone) GROUP BY doc_id, r
), pieces AS (
  SELECT h.doc_id, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept FROM (
    SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a) + 1, 0) AS p FROM (
      SELECT doc_id, a, z FROM runs UNION ALL SELECT doc_id, n AS a, n AS z FROM h)) q JOIN h USING (doc_id) GROUP BY h.doc_id
)
SELECT h.doc_id, h.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM h JOIN pieces USING (doc_id) LEFT JOIN spans USING (doc_id)
"""
