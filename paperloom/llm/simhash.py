"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has one bit for each bit of the shingles' hashes: 1 where more than
half of the hashes have it. Fingerprints that differ in at most ``BITS`` of their
64 bits differ in at most as many of their eight bytes: they share at least six
positional bytes (a byte's value at its place). That minimum is the count filter.

A posting list of one positional byte holds a 256th of all fingerprints, so that
tallies of pairs over those lists would grow as the square of the table. The
index is therefore kept by what a pair that reaches the minimum must have in
common: the lists of six of the eight places, intersected. A fingerprint stands
in all 28 of them, a pair's tally reaches six exactly where both stand in one of
them, and as only sixteen bits are free in a list, it never has more than 65,536
fingerprints, whatever the table. Inside a list each fingerprint is verified
against those that differ in one or two of the free bits, by looking them up, so
that a list's work is linear; what is linked there is given as links to the
least of each group. No pair is lost and no list is expanded into its pairs.

Equal fingerprints are one class before anything is indexed, so copies of a text,
however many, stand in the index once.

Defined results: null, empty and wordless texts have fingerprint zero, which links
like any other; fewer words than a shingle's make one shingle of the whole
sequence; rows with equal doc_ids each have their own fingerprint; a row with a
null doc_id links nothing and has the component of the rows with an equal
fingerprint, null if there are none; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import discard, flat, map_arrow, materialise, own_columns, read
from paperloom.llm.components import components

SHINGLE, SEED, BITS = 3, 42, 2
PLACES = 8
#: Texts are split into words in stretches of about so many bytes.
STRETCH = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"


def stretches(text: bytes, size: int = STRETCH) -> Iterator[list[bytes]]:
    """The words of a text, a stretch of it at a time; a stretch ends at white space."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        while end < len(text) and text[end] not in SPACES:
            end += 1
        yield text[start:end].split()
        start = end


def hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """The XXH64 of a text's shingles, A-Z lower-cased, in runs; of the whole sequence where it has fewer words."""
    before: list[bytes] = []
    some = False
    for more in stretches(text.lower()):
        words = before + more
        if len(words) >= shingle:
            some = True
            joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
            yield np.fromiter(map(xxhash.xxh64_intdigest, joined, itertools.repeat(seed)), np.uint64, len(words) - shingle + 1)
        before = words[max(0, len(words) - shingle + 1) :]
    if before and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(before), seed)], np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The bits that more than half of the hashes have; zero without hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes(text, shingle, seed):
        for part in np.array_split(h, len(h) // 65_536 + 1):
            ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            data, offsets = flat(b.column(1))
            raw = memoryview(data)
            values = np.array([fingerprint(bytes(raw[s:e]), shingle, seed) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.view(np.int64))], schema=schema)

    return map_arrow(own_columns(docs, "doc_id", "text"), run, "doc_id long, fp long")


def flips(bits: int, free: int) -> np.ndarray:
    """The differences of at most ``bits`` of ``free`` bits, but for none."""
    return np.array([sum(1 << i for i in c) for k in range(1, bits + 1) for c in itertools.combinations(range(free), k)], np.int64)


def least_linked(values: np.ndarray, near: np.ndarray, space: int) -> np.ndarray:
    """For each of distinct values the place of the first one that it can reach by differences in ``near``. ``space``: values are below it."""
    at = np.full(space, -1, np.int64)
    at[values] = np.arange(len(values))
    other = at[values[:, None] ^ near]
    other = np.where(other < 0, np.arange(len(values))[:, None], other)
    label = np.arange(len(values))
    while True:
        new = np.minimum(label, label[other].min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def index_links(classes: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b) links of fingerprints (``fp``, distinct) that differ in at most ``bits`` bits: each to the least of its group in each list that joins it to others."""
    missing = list(itertools.combinations(range(PLACES), bits))
    masks = [sum(255 << 8 * i for i in range(PLACES) if i not in out) for out in missing]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    posted = F.array(*[F.struct(F.lit(i).cast("short").alias("places"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for i, m in enumerate(masks)])
    lists = classes.select("fp", F.explode(posted).alias("p")).groupBy("p").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    near, schema = flips(bits, 8 * bits), pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches):
        for b in batches:
            a, z = [], []
            for places, members in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                fp = members.values.to_numpy().view(np.uint64)
                free = sum(((fp >> np.uint64(8 * i)) & np.uint64(255)).astype(np.int64) << 8 * k for k, i in enumerate(missing[places]))
                label = least_linked(free, near, 1 << 8 * bits)
                other = np.flatnonzero(label != np.arange(len(fp)))
                a.append(fp[other])
                z.append(fp[label[other]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*x, np.zeros(0, np.uint64)]).view(np.int64)) for x in (a, z)], schema=schema)

    return map_arrow(lists.select(F.col("p.places").alias("places"), "members"), verify, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """doc_id, fp and component_id: the least doc_id that links of fingerprints reach."""
    marked = materialise(fingerprints(docs, shingle, seed), "simhash-fingerprints")
    classes = materialise(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    labels = components(index_links(classes, bits)).withColumnRenamed("node", "fp")
    least = labels.join(classes, "fp").groupBy("label").agg(F.min("first").alias("component"))
    grouped = labels.join(least, "label").select("fp", "component")
    of = materialise(classes.join(grouped, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id")), "simhash-components")
    discard(labels)
    discard(classes)
    # A fingerprint that very many rows share is a skewed key of this join alone, which Spark splits.
    return marked.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def op12_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
