"""Exact vector search, retrieval and diversity re-ranking.

A stated set of queries meets all vectors block by block: both are cut into blocks
of about ``BLOCK`` rows by a hash of their ids, each block of queries is joined with
each block of vectors in a task of its own, by matrix products of ``ROWS`` queries
at a time, and the best k of each query there are merged over the blocks. A task
holds two blocks, nothing is sent to all tasks or through the driver, and a lost
executor's block pairs are done again elsewhere. A vector is shuffled once for each
block of queries: with the queries a twentieth of n vectors, n / 20 / ``BLOCK`` times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import rules as R

#: Rows of a block: 100 MB of 384 dimensions.
BLOCK = 1 << 15
ROWS = 256
Embedder = Callable[[list[str]], np.ndarray]


def hashed_embedder(dim: int = 384) -> Embedder:
    """A stand-in model: signed counts of word hashes, of unit length. Real models are injected in its place."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                row[h % dim] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return embed


def encoded(df: DataFrame, text: str, embed: Embedder, out: str = "embedding") -> DataFrame:
    """Adds vectors of a text column; the model is made once a worker."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embed(texts.fillna("").tolist())))

    return df.withColumn(out, run(text))


def unit(vector: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(F.struct(vector.alias("v"), norm.alias("n"))["v"], lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def pooled(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """key, pos, value: the mean vector of each key at unit length, a row for each dimension."""
    mean = df.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    norm = F.sqrt(F.sum(F.col("mean") * F.col("mean")).over(Window.partitionBy(key)))
    return mean.select(key, "pos", F.when(norm > 0, F.col("mean") / norm).otherwise(F.col("mean")).alias("value"))


def document_vectors(chunks: DataFrame, embed: Embedder) -> DataFrame:
    """doc_id, embedding, chunk_count, text_length: the chunks of a document encoded, pooled and normalised (text: one row a document)."""
    from paperloom.operators.chunks import char_chunks

    parts = encoded(chunks.select("doc_id", F.char_length("text").alias("text_length"), F.explode(char_chunks(F.col("text"))).alias("part")), "part", embed)
    mean = parts.select("doc_id", "text_length", F.posexplode("embedding").alias("pos", "x")).groupBy("doc_id", "text_length", "pos").agg(F.avg("x").alias("x"), F.count("*").alias("chunk_count"))
    rows = mean.groupBy("doc_id", "text_length", "chunk_count").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))  # as many entries as dimensions
    return rows.select("doc_id", unit(F.col("v")).alias("embedding"), F.col("chunk_count").cast("int"), "text_length")


def best_of(scores: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest finite scores of each row, of equal ones those of smaller docs; rows in order, best first."""
    if scores.shape[1] > k:  # what is below a row's k-th greatest needs no sorting
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, [scores.shape[1] - k]]
        row, column = np.nonzero((scores >= least) & np.isfinite(scores))
    else:
        row, column = np.nonzero(np.isfinite(scores))
    order = np.lexsort((docs[column], -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column, a row each."""
    return np.asarray(column.combine_chunks().flatten()).astype(float).reshape(len(column), -1)


def _dealt(df: DataFrame, id_: str, vector: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
    """id, vector, own and other: each vector in its block, once for each block of the other side."""
    known = df.where(F.col(vector).isNotNull() & F.col(id_).isNotNull())
    placed = known.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("vector"), F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int").alias(own))
    return placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))


def search(queries: DataFrame, vectors: DataFrame, k: int = R.TOP_K, qid: str = "vec_id", vid: str = "vec_id", vector: str = "embedding", without_self: bool = False, block: int = BLOCK) -> DataFrame:
    """query_id, doc_id, score, rank: the k vectors of highest inner product with each query, of equal ones the smaller id.

    Ids are integers, those of queries distinct (rows that share one are one
    query). Rows without an id or a vector are left out; without queries or vectors
    there are no rows.
    """
    tasks = vectors.sparkSession.sparkContext.defaultParallelism
    n_queries, n_vectors = queries.count(), vectors.count()
    q_blocks = max(1, -(-n_queries // block))
    # Small tables are cut finer, for as many blocks as there are tasks.
    v_blocks = max(1, -(-n_vectors // block), min(-(-tasks // q_blocks), n_vectors // ROWS))
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table([[], [], []], schema=schema)]
        if left.num_rows and right.num_rows:
            asked, docs = left["id"].to_numpy(), right["id"].to_numpy()
            q, v = matrix(left["vector"]), matrix(right["vector"])
            for at in range(0, len(asked), ROWS):
                part = slice(at, at + ROWS)
                # Equal vectors have equal scores wherever they stand in a product.
                scores = np.round(q[part] @ v.T, 12)
                if without_self:
                    scores[asked[part, None] == docs] = -np.inf
                row, column = best_of(scores, docs, k)
                out.append(pa.table([asked[part][row], docs[column], scores[row, column]], schema=schema))
        return pa.concat_tables(out)

    sides = [_dealt(queries, qid, vector, "q", q_blocks, "v", v_blocks), _dealt(vectors, vid, vector, "v", v_blocks, "q", q_blocks)]
    left, right = (s.select("q", "v", "id", "vector").groupBy("q", "v") for s in sides)
    found = left.cogroup(right).applyInArrow(best, "query_id long, doc_id long, score double")
    # Each task keeps the best k of a query before any is shuffled.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def matches(document_type: Column, tags: Column, needle: str | None) -> Column:
    """Whether the type or a tag holds the needle, whatever their case; every document matches no needle or an empty one."""
    if not needle:
        return F.lit(True)
    low = needle.lower()
    return F.coalesce(F.contains(F.lower(document_type), F.lit(low)), F.lit(False)) | F.coalesce(F.exists(tags, lambda t: F.contains(F.lower(t), F.lit(low))), F.lit(False))


def with_metadata(hits: DataFrame, metadata: DataFrame) -> DataFrame:
    """Hits with document_type, tags and cleaned_text, or their defaults where a document has none."""
    return hits.join(metadata.select("doc_id", "document_type", "tags", "cleaned_text"), "doc_id", "left").fillna({"document_type": "unknown", "cleaned_text": ""}).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def diverse(candidates: DataFrame, k: int = R.TOP_K, balance: float = R.BALANCE) -> DataFrame:
    """Per query the k candidates picked greedily by relevance less likeness to those picked: query_id, doc_id, pick.

    ``candidates``: query_id, doc_id, rank, score, embedding; a query has at
    most POOL * k of them. Ties go to the earlier candidate.
    """

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        m = np.stack(frame["embedding"].to_numpy()).astype(float)
        relevance, likeness = frame["score"].to_numpy(float), np.full(len(frame), -np.inf)
        chosen: list[int] = []
        free = np.ones(len(frame), bool)
        while len(chosen) < min(k, len(frame)):
            value = relevance if not chosen else balance * relevance - (1 - balance) * likeness
            i = int(np.where(free, np.round(value, 12), -np.inf).argmax())
            chosen.append(i)
            free[i] = False
            likeness = np.maximum(likeness, m @ m[i])
        out = frame.iloc[chosen][["query_id", "doc_id"]]
        return out.assign(pick=np.arange(1, len(out) + 1, dtype=np.int32))

    return candidates.select("query_id", "doc_id", "rank", "score", "embedding").groupBy("query_id").applyInPandas(pick, "query_id long, doc_id long, pick int")


@dataclass(frozen=True)
class Retriever:
    """Retrieval with its settings: the nearest POOL * k vectors first, then the filter, then re-ranking, so that fewer than k may be left."""

    vectors: DataFrame
    metadata: DataFrame
    k: int = R.TOP_K
    doc_filter: str | None = None

    def candidates(self, queries: DataFrame) -> DataFrame:
        hits = with_metadata(search(queries, self.vectors, R.POOL * self.k, qid="query_id", vid="doc_id"), self.metadata)
        return hits.where(matches(F.col("document_type"), F.col("tags"), self.doc_filter)).join(self.vectors.select("doc_id", "embedding"), "doc_id")

    def retrieve(self, queries: DataFrame) -> DataFrame:
        """query_id, pick, doc_id, document_type, tags, page_content, source."""
        return diverse(self.candidates(queries), self.k).transform(lambda d: with_metadata(d, self.metadata)).select("query_id", "pick", "doc_id", "document_type", "tags", F.col("cleaned_text").alias("page_content"), F.col("doc_id").cast("string").alias("source"))


def checked_top_k(k: int) -> int:
    if not 1 <= k <= R.MAX_K:
        raise ValueError(f"top_k must be between 1 and {R.MAX_K}")
    return k
