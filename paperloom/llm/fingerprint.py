"""Document fingerprints: a threshold-scaled sketch of word shingles, in DataFrame functions only.

A sketch keeps every shingle hash that lies below a fixed fraction of the hash
range, so that sketches of very unequal documents stay comparable: they can be
merged, and containment and likeness of the documents are estimated by those of
the sketches. Of at most ``SMALL`` shingles a sketch keeps all, and says so by
``FULL`` as its first entry. Two sketches are compared over what both know:
all hashes where both are full, else those below the fraction. A larger
document none of whose hashes lies below the fraction keeps its least one, for
its fingerprint alone: estimates leave it out.

Defined results: null texts are empty; a text without words has the empty
fingerprint, and two empty fingerprints have likeness 1; fewer words than a
shingle's make one shingle; where neither sketch has a hash that both know,
likeness is 1 for equal sketches and 0 for others, and containment is null (1 for
an empty sketch). Rows with a null doc_id stand outside the order: they have no
next document, so their edited text loses its last quarter only and near_next is
null. Of rows with the same doc_id the next is the one whose text sorts next. An
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import n_tasks, own_columns, read

SIZE = 5
#: One hash in FRACTION is kept. Hashes have 48 bits: 12 hex digits each in the fingerprint.
FRACTION = 4
BITS = 48
LIMIT = (1 << BITS) // FRACTION
#: Up to so many shingles a sketch keeps all.
SMALL = 512
FULL = -1


def _let(value: Column, body) -> Column:
    """body(value) with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, size: int = SIZE) -> Column:
    """FULL and the sorted hashes of all of a text's distinct word shingles if they are few, else the hashes below LIMIT, or else the least of all."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        whole = F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(w, " ")), 64 - BITS))
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.element_at(w, i + j) for j in range(size)]), 64 - BITS))
        return F.when(F.size(w) >= size, runs).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return _let(F.array_distinct(_let(words, hashes)), lambda h: F.when(F.size(h) == 0, h).when(F.size(h) <= SMALL, F.array_sort(F.concat(F.array(F.lit(FULL).cast("long")), h))).otherwise(_below(h)))


def _below(hashes: Column) -> Column:
    return _let(_within(hashes), lambda h: F.when(F.size(h) > 0, F.array_sort(h)).otherwise(F.array(F.array_min(F.filter(hashes, lambda x: x >= 0)))))


def _within(hashes: Column) -> Column:
    """Those that every sketch knows of."""
    return F.filter(hashes, lambda x: (x >= 0) & (x < LIMIT))


def _full(a: Column) -> Column:
    return F.coalesce(F.get(a, F.lit(0)) == FULL, F.lit(False))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two documents together."""
    both = F.array_union(a, b)
    few = _full(a) & _full(b) & (F.size(both) <= SMALL + 1)
    return F.when(F.size(a) == 0, b).when(F.size(b) == 0, a).when(few, F.array_sort(both)).otherwise(_let(both, _below))


def _known(a: Column, b: Column) -> Column:
    """struct<a, b>: the hashes of each that both sketches know of."""
    full = _full(a) & _full(b)
    of = lambda x: F.when(full, F.filter(x, lambda h: h >= 0)).otherwise(_within(x))
    return F.struct(of(a).alias("a"), of(b).alias("b"))


def containment(a: Column, b: Column) -> Column:
    """The estimated share of a's shingles that b has too; 1 if a has none, null if b's sketch can't tell."""
    shared = lambda k: F.when(F.size(k["a"]) > 0, F.size(F.array_intersect(k["a"], k["b"])) / F.size(k["a"]))
    return F.when(F.size(a) == 0, 1.0).otherwise(_let(_known(a, b), shared))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity, by the hashes that both sketches know of."""
    def shared(k: Column) -> Column:
        n, m = F.size(F.array_intersect(k["a"], k["b"])), F.size(k["a"]) + F.size(k["b"])
        return F.when(m == 0, F.when(a == b, 1.0).otherwise(0.0)).otherwise(n / (m - n))

    return _let(_known(a, b), shared)


def fingerprint(sketched: Column) -> Column:
    """A sketch as a string: "f" if it is full, and its hashes in order, 12 hex digits each."""
    digits = F.array_join(F.transform(F.filter(sketched, lambda x: x >= 0), lambda x: F.lower(F.lpad(F.hex(x), BITS // 4, "0"))), "")
    return F.concat(F.when(_full(sketched), "f").otherwise(""), digits)


def _place(cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most doc_id, by binary search in one constant."""
    known = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    # Past the end the search meets null, which is no step either.
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text and further columns), and next: a struct of all of them, that of the next document in ascending doc_id, of the first one after the last.

    The ids are cut into ranges at quantiles that are ids themselves, and the
    rows at a cut stand in the range before it, too, behind its own: a window
    inside each range gives every row's next. Null texts are empty.
    """
    ranges = 4 * n_tasks(docs.sparkSession)
    ids = docs.where("doc_id is not null")
    found = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(ranges)], 10 * ranges).alias("q"), F.min("doc_id").alias("m")).first()
    cuts = sorted({*(found["q"] or ()), found["m"]} - {None}) or [0]
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    at = F.coalesce(_place(cuts), F.pmod(F.xxhash64("text"), F.lit(ranges)).cast("int") * -1)
    placed = docs.select(F.struct(*docs.columns).alias("own"), at.alias("at"), "doc_id", "text")
    cut = F.coalesce(F.element_at(F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>"), F.greatest("at", F.lit(1))) == F.col("doc_id"), F.lit(False))
    before = F.when(F.col("at") == 1, len(cuts)).otherwise(F.col("at") - 1)
    places = F.when(cut, F.array(F.struct(F.col("at").alias("range"), F.lit(False).alias("extra")), F.struct(before.alias("range"), F.lit(True).alias("extra")))).otherwise(F.array(F.struct(F.col("at").alias("range"), F.lit(False).alias("extra"))))
    rows = placed.select("own", "doc_id", "text", F.explode(places).alias("place")).select("own", "doc_id", "text", "place.*")
    led = rows.withColumn("next", F.lead("own").over(Window.partitionBy("range").orderBy("extra", "doc_id", "text")))
    return led.where("not extra").select("own.*", F.when(F.col("doc_id").isNotNull(), F.col("next")).alias("next"))


def op4_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The operator over ``documents`` and over their edited texts; only the ids' quantiles are gathered. The next text is sketched again, which is cheaper than to shuffle its sketch."""
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.coalesce(F.substring("next.text", F.lit(1), quarter), F.lit("")))
    docs = with_next(own_columns(read(spark, sf_dir, "documents"), "doc_id", "text"))
    sketched = docs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), sketch(F.col("text")).alias("a"), sketch(edited).alias("b"), sketch(F.col("next.text")).alias("c"), F.col("next").isNotNull().alias("has_next"))
    return sketched.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("a")).alias("fingerprint"),
        fingerprint(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        F.when(F.col("has_next"), likeness(F.col("a"), F.col("c"))).alias("near_next"),
    )


def edited_texts(spark, sf_dir: str) -> DataFrame:
    """What of ``op4_document_fingerprints`` SQL can express."""
    return op4_document_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITED_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first(coalesce(text, '')) OVER (ORDER BY doc_id)) AS nxt FROM documents
)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(left(t, length(t) - length(t) // 4) || left(nxt, length(t) // 4)) AS edited_sha256 FROM t
"""
