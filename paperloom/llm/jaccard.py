"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of word shingles
is at least ``percent``/100. Sets are put into one global order, shingles of
many documents last. Similar sets of size n share at least m of the first
``n - ceil(percent * n / 100) + m`` shingles, for every m up to the overlap that
they must have. Each document chooses its own m, up to ``MATCHES``: a longer
prefix meets more posting lists but asks for more shared shingles, and the m of
least estimated cost is taken. A pair is verified when it shares as many prefix
shingles as the smaller m of the two asks for, and when parity sketches of the
two sets don't already rule it out: the bits in which they differ are at most as
many as the shingles that only one of the two has.

Equal sets are one class from the start, whose least document stands for it.
``join`` finds every link between different classes, so a group of near copies
costs as much as it has links, the square of its size. Where only the components
are asked for, ``groups`` takes fewer pairs: first every document is verified
against the leaders of its posting lists, the verified links are contracted, and
only pairs between different components remain. It has no links to give, but the
same components.

Defined results: a null or wordless text has an empty set, links with nothing
and is its own component; fewer words than a shingle's make one shingle of the
whole sequence; equal rows share their class; a row with a null doc_id has the
component of the rows with an equal set, null if there are none, and no links;
doc_ids are taken to be unique, and rows that repeat one are linked where any of them is;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import batch, materialise, mix, own_columns, read, settled, shingles, signed, slices, words
from paperloom.llm.components import components

SIZE = 4
PERCENT = 85
MATCHES = 4
#: What verifying a candidate costs, in posting-list entries.
VERIFY_COST = 16
#: At most so many shingles count as frequent. It bounds what is broadcast; the order of the others is by hash, and any order gives the same links.
FREQUENT = 100_000
#: 64-bit words of a parity sketch: bit i says whether an odd number of a set's shingles hash to i.
PARITY = 8
HOT_SLICE = 2 << 20
SKETCH = [f"p{i}" for i in range(PARITY)]
#: What tells a set: its signature and size.
CLASS = ["sig1", "sig2", "n"]


def sets(column: pa.Array, size: int, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct (row, hash) of a run of rows, bounds of its rows)."""
    for row, upto, data, offsets in slices(column, limit):
        h, at = shingles(words(data, offsets), size)
        bounds = np.searchsorted(at, np.arange(upto - row + 1))
        parts = [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield row, np.concatenate(parts) if parts else h, np.cumsum([0, *map(len, parts)])


def frequent(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles that many documents have, by counts of what repeats within slices of rows; at most ``FREQUENT`` of them."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for b in batches:
            for _, h, bounds in sets(b.column(0), size, HOT_SLICE):
                token, n = np.unique(h, return_counts=True)
                keep = n >= max(4, (len(bounds) - 1) // 500)
                yield batch(schema, signed(token[keep]), n[keep])

    counted = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    return np.sort(np.array([r["token"] for r in top], np.int64).view(np.uint64))


def needed(n, percent: int):
    """The least overlap that a set of n can have with a similar one."""
    return -(-percent * n // 100)


def prefixes(docs: DataFrame, size: int, percent: int, matches: int) -> DataFrame:
    """Per row: doc_id, n, a 128-bit signature of the set, its parity sketch and its longest prefix in the global order."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig1", pa.int64()), ("sig2", pa.int64()), *[(f"p{i}", pa.int64()) for i in range(PARITY)], ("tokens", pa.list_(pa.int64()))])
    hot = docs.sparkSession.sparkContext.broadcast(frequent(docs, size))

    def cut(batches):
        for b in batches:
            ids, last = b.column(0), hot.value
            for row, h, bounds in sets(b.column(1), size):
                n = np.diff(bounds)
                sig = [_sums(mix(h ^ np.uint64(salt)), bounds) for salt in (0x51ED270B0A1F39C1, 0xA24BAED4963EE407)]
                at = np.minimum(np.searchsorted(last, h), max(len(last) - 1, 0))
                key = mix(h) >> np.uint64(1) | (last[at] == h).astype(np.uint64) << np.uint64(63) if len(last) else mix(h) >> np.uint64(1)
                take = np.minimum(n - needed(n, percent) + np.minimum(matches, needed(n, percent)), n)
                heads = [h[a:z][_first(key[a:z], k)] for a, z, k in zip(bounds[:-1], bounds[1:], take.tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]), pa.int32()), pa.array(signed(np.concatenate([*heads, h[:0]])), pa.int64()))
                yield batch(schema, ids.slice(row, len(n)), n, signed(sig[0]), signed(sig[1]), *parity(h, bounds).T, lists)

    sketch = ", ".join(f"p{i} long" for i in range(PARITY))
    return docs.mapInArrow(cut, f"doc_id long, n long, sig1 long, sig2 long, {sketch}, tokens array<long>")


def parity(h: np.ndarray, bounds: np.ndarray, rows: int = 2048) -> np.ndarray:
    """The parity sketches of the sets in h, one a row, ``rows`` of them at a time."""
    bits, out = 64 * PARITY, np.zeros((len(bounds) - 1, PARITY), np.int64)
    for at in range(0, len(out), rows):
        ends = bounds[at : at + rows + 1]
        n = len(ends) - 1
        place = (mix(h[ends[0] : ends[-1]] ^ np.uint64(0x3C6EF372FE94F82B)) % np.uint64(bits)).astype(np.int64)
        odd = np.bincount(np.repeat(np.arange(n), np.diff(ends)) * bits + place, minlength=n * bits) & 1
        out[at : at + n] = np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1, bitorder="little").view(np.int64)
    return out


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _first(key: np.ndarray, k: int) -> np.ndarray:
    """The places of the k smallest keys, in order."""
    if k < len(key):
        near = np.argpartition(key, k - 1)[:k] if k else np.zeros(0, np.int64)
        return near[np.argsort(key[near])]
    return np.argsort(key)


def postings(reps: DataFrame, percent: int, matches: int) -> DataFrame:
    """token, at (the first place), met (how many before it other prefixes have), doc, n, m, w and the parity sketch: the prefixes of the classes at the m that each chooses, without shingles that no other prefix has.

    Shingles with the same documents stand together as one token of weight w:
    the copies of one passage meet once, not once a shingle.
    """
    listed = reps.select(F.col("rep").alias("doc"), "n", F.posexplode("tokens").alias("at", "token"))
    lists = listed.groupBy("token").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("doc")).alias("docs")).where("df > 1")
    shared = materialise(listed.join(lists, "token").select("doc", "n", "at", "df", F.xxhash64("docs", "df").alias("token")), "jaccard-postings")
    need = F.ceil(F.lit(percent) * F.col("n") / 100)
    spare = F.col("n") - need
    costs = [F.sum(F.when(F.col("at") < spare + m, F.col("df") - 1).otherwise(0)) for m in range(1, matches + 1)]
    cost = shared.groupBy("doc").agg(F.first("n").alias("n"), *[c.alias(f"c{m}") for m, c in enumerate(costs, 1)])
    # The estimate of the candidates at m is the posting entries met over m; a prefix longer than the overlap allows is no option.
    options = [F.when(need >= m, F.struct((F.col(f"c{m}") * (1 + VERIFY_COST / m)).alias("cost"), F.lit(m).alias("m"))) for m in range(1, matches + 1)]
    chosen = cost.select("doc", F.array_min(F.filter(F.array(*options), lambda o: o.isNotNull()))["m"].alias("m"))
    before = F.row_number().over(Window.partitionBy("doc").orderBy("at")) - 1
    kept = shared.withColumn("met", before).join(chosen, "doc").where(F.col("at") < spare + F.col("m"))
    return kept.groupBy("token", "doc").agg(F.min("at").alias("at"), F.min("met").alias("met"), F.first("n").alias("n"), F.first("m").alias("m"), F.count("*").alias("w")).join(reps.select(F.col("rep").alias("doc"), *SKETCH), "doc")


def _may_link(percent: int, matches: int):
    """Whether a shingle that a and b share counts for the pair.

    The sizes alone may rule the pair out; otherwise they give the overlap that
    this very pair must have, and with it the prefixes in which the smaller m of
    the two must be shared: shorter ones than each document's own.

    The shingle's places bound the overlap: what follows it, and what is shared
    before it. A shingle before it that no other prefix has can't be shared if
    it comes so early that it would lie in the other's prefix too.
    """
    overlap = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / (100 + percent))
    spare = F.least("ma", "mb") - overlap
    need = lambda n: F.ceil(F.lit(percent) * F.col(n) / 100)
    before = lambda x, y: F.when(F.col(f"at{x}") <= F.least(F.lit(matches), need(f"n{y}")) + overlap - need(f"n{y}"), F.col(f"met{x}")).otherwise(F.col(f"at{x}"))
    reach = F.least(before("a", "b"), before("b", "a")) + F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    # Of na + nb shingles, overlap in both, so many at most are in one set alone.
    differing = sum(F.bit_count(F.col(f"{p}a").bitwiseXOR(F.col(f"{p}b"))) for p in SKETCH)
    return (differing <= F.col("na") + F.col("nb") - 2 * overlap) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("ata") < F.col("na") + spare) & (F.col("atb") < F.col("nb") + spare) & (reach >= overlap)


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by their whole sets."""
    pairs = materialise(pairs, "jaccard-pairs")
    texts = materialise(whole_sets(docs, pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), size), "jaccard-sets")
    sides = pairs.join(texts.select(F.col("doc").alias("a"), F.col("set").alias("set_a")), "a").join(texts.select(F.col("doc").alias("b"), F.col("set").alias("set_b")), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def same(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_())).cast(schema)

    return sides.select("a", "b", "set_a", "set_b").mapInArrow(same, "a long, b long")


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """doc, set: the sorted hashes of all shingles, as bytes, of the wanted documents."""
    schema = pa.schema([("doc", pa.int64()), ("set", pa.binary())])

    def pack(batches):
        for b in batches:
            for row, h, bounds in sets(b.column(1), size):
                yield batch(schema, b.column(0).slice(row, len(bounds) - 1), pa.array([h[a:z].tobytes() for a, z in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()))

    # The ids are as many as there are pairs: never broadcast.
    return docs.join(wanted.withColumnRenamed("doc", "doc_id").hint("merge"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(pack, "doc long, set binary")


def _labelled(posted: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The postings with their documents' components so far, without shingles whose documents are all in one."""
    if labels is None:
        return posted.withColumn("label", F.col("doc"))
    now = posted.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    mixed = now.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    return now.join(mixed, "token")


def _sides(labelled: DataFrame, *further: str) -> tuple[DataFrame, DataFrame]:
    return tuple(labelled.select("token", F.col("doc").alias(x), *[F.col(c).alias(c + x) for c in ("n", "m", "at", "met", "w", "label", *SKETCH, *further)]) for x in "ab")


def leader_pairs(labelled: DataFrame, percent: int, matches: int) -> DataFrame:
    """Each document with the two leaders that it shares most prefix shingles with; the leader of a shingle is the least of its documents."""
    x, y = _sides(labelled)
    leaders = y.groupBy("token").agg(F.min(F.struct("b", "nb", "mb", "atb", "metb", "wb", "labelb", *[f"{p}b" for p in SKETCH])).alias("l")).select("token", "l.*")
    met = x.join(leaders, "token").where((F.col("labela") != F.col("labelb")) & _may_link(percent, matches))
    enough = met.groupBy("a", "b").agg(F.sum(F.least("wa", "wb")).alias("c"), F.first(F.least("ma", "mb")).alias("m")).where("c >= m")
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), "b"))
    return enough.withColumn("r", best).where("r <= 2").select("a", "b")


def all_pairs(labelled: DataFrame, percent: int, matches: int) -> DataFrame:
    """All pairs across what is labelled apart that share as many prefix shingles as the smaller m asks for.

    A pair is made once, at the first token that both prefixes have: each row
    carries its document's prefix, where a token of weight w is w entries.
    """
    prefix = F.array_sort(F.collect_list(F.struct("at", "token", "w")).over(Window.partitionBy("doc")))
    entries = F.flatten(F.transform(prefix, lambda t: F.transform(F.sequence(F.lit(1), F.least(t["w"], F.lit(matches)).cast("int")), lambda i: F.xxhash64(t["token"], i))))
    x, y = _sides(labelled.withColumn("entries", entries), "entries")
    common = F.array_intersect("entriesa", "entriesb")
    first = F.get(common, F.lit(0)) == F.xxhash64("token", F.lit(1))
    apart = (F.col("a") < F.col("b")) & (F.col("labela") != F.col("labelb"))
    return x.join(y, "token").where(apart & _may_link(percent, matches) & first & (F.size(common) >= F.least("ma", "mb"))).select("a", "b")


def _classed(docs: DataFrame, size: int, percent: int, matches: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The prefixes of all documents; the classes of equal sets (sig1, sig2, n, rep and k, how many documents); the postings of their representatives."""
    cut = materialise(prefixes(docs, size, percent, matches), "jaccard-prefixes")
    classes = cut.where("n > 0").groupBy(*CLASS).agg(F.min("doc_id").alias("rep"), F.count("doc_id").alias("k"))
    reps = cut.where("n > 0").join(classes.withColumn("doc_id", F.col("rep")), [*CLASS, "doc_id"]).select("rep", "n", *SKETCH, "tokens")
    return cut, classes, settled(lambda: postings(reps, percent, matches), "jaccard-chosen")


def _labels_of(cut: DataFrame, classes: DataFrame, labels: DataFrame, *further: str) -> DataFrame:
    """doc_id, n_shingles and component_id of all documents, and the further columns of their classes."""
    of_class = classes.join(labels, F.col("node") == F.col("rep"), "left").select(*CLASS, F.coalesce("label", "rep").alias("component"), *further)
    return cut.select("doc_id", *CLASS).join(of_class, CLASS, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), *further)


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, matches: int = MATCHES) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id reachable by links) and n_links (how many other documents it links with)."""
    docs = own_columns(docs, "doc_id", "text")
    cut, classes, posted = _classed(docs, size, percent, matches)
    links = settled(lambda: verified(all_pairs(_labelled(posted, None), percent, matches), docs, size, percent), "jaccard-links")
    sizes = classes.select(F.col("rep").alias("other"), F.col("k").alias("of_other"))
    ends = links.union(links.select("b", "a")).toDF("linked", "other").distinct()
    number = ends.join(sizes, "other").groupBy("linked").agg(F.sum("of_other").alias("others"))
    counted = classes.join(number, F.col("linked") == F.col("rep"), "left").withColumn("in_class", F.col("k") - 1 + F.coalesce("others", F.lit(0)))
    joined = _labels_of(cut, counted, components(links), "in_class")
    return joined.withColumn("n_links", F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("in_class", F.lit(0))).cast("long")).drop("in_class")


def groups(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, matches: int = MATCHES, rounds: int = 1) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id as ``join`` has them, from as many links as connect the components."""
    docs = own_columns(docs, "doc_id", "text")
    cut, classes, posted = _classed(docs, size, percent, matches)
    links, labels = None, None
    for turn in range(rounds + 1):
        now = _labelled(posted, labels)
        pairs = leader_pairs(now, percent, matches) if turn < rounds else all_pairs(now, percent, matches)
        found = settled(lambda pairs=pairs: verified(pairs, docs, size, percent), "jaccard-links")
        links = found if links is None else links.union(found)
        labels = components(links)
    return _labels_of(cut, classes, labels)


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_links(spark, sf_dir).drop("n_links")


def jaccard_links(spark, sf_dir: str) -> DataFrame:
    """``op3_jaccard_join`` with the number of links of each document."""
    return join(read(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + 3], ' ')) AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS t(i) WHERE len(ws) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b
), least_of AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, least_of.component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id JOIN least_of ON least_of.a = d.doc_id
"""

LINKS_SQL = rf"""
WITH joined AS ({OP3_SQL}), t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + 3], ' ')) AS g FROM t, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS u(i) WHERE len(ws) > 0
), met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), number AS (
  SELECT a, count(*) AS n_links FROM met JOIN joined p ON p.doc_id = a JOIN joined q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n_shingles + q.n_shingles - c) GROUP BY a
)
SELECT joined.*, coalesce(n_links, 0)::BIGINT AS n_links FROM joined LEFT JOIN number ON a = doc_id
"""
