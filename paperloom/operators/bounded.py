"""Exact vector search that leaves out groups of vectors that can't have a hit.

An index deals vectors out to their nearest centroids and keeps each group's radius,
the largest distance of a vector from its centroid. For a query q and a group with
centroid c and radius r no inner product is above ``q . c + |q| * r``. So a query is
first compared with the groups nearest to it, until they hold k vectors; the k-th
best score there is a floor, and of the other groups only those whose bound reaches
it are looked at. What is left out can't be among the k best: results are those of
the full scan.

There are at most ``GROUPS`` centroids, so that what is sent to all tasks (centroids,
radii and sizes) is bounded; a group of very many vectors is cut into blocks, each
joined with the group's queries in a task of its own.

Defined results are those of ``vectors.search``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import rules as R
from paperloom.operators.vectors import BLOCK, ROWS, best_of, matrix

GROUPS = 1024
#: Bounds are raised by this share of their size, more than products of floating-point numbers can be off.
SLACK = 1e-9
HITS = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])


@dataclass(frozen=True)
class Index:
    """vectors: id, vector, group, part; and by group centroid, radius and number of vectors."""

    vectors: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    number: np.ndarray
    block: int = BLOCK


def index(vectors: DataFrame, groups: int | None = None, vid: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> Index:
    """Groups vectors by their nearest centroid. Centroids are vectors drawn by a hash of their ids; by default as many as the square root of their number, ``GROUPS`` at most."""
    known = vectors.where(F.col(vector).isNotNull() & F.col(vid).isNotNull()).select(F.col(vid).cast("long").alias("id"), F.col(vector).alias("vector"))
    groups = min(groups or max(1, int(known.count() ** 0.5)), GROUPS)
    drawn = known.groupBy("id").agg(F.first("vector").alias("vector")).orderBy(F.xxhash64("id"), "id").limit(groups).collect()
    centroids = np.unique(np.array([r["vector"] for r in drawn], float), axis=0) if drawn else np.zeros((0, 1))
    schema = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float64())), ("group", pa.int32()), ("distance", pa.float64())])

    def assign(batches):
        for b in batches:
            if b.num_rows:
                v = matrix(pa.chunked_array([b.column(1)]))
                nearest = ((centroids**2).sum(axis=1) - 2 * v @ centroids.T).argmin(axis=1)
                distance = np.linalg.norm(v - centroids[nearest], axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(schema.field(1).type), pa.array(nearest.astype(np.int32)), pa.array(distance)], schema=schema)

    grouped = known.mapInArrow(assign, "id long, vector array<double>, group int, distance double")
    of = {r["group"]: r for r in grouped.groupBy("group").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).collect()}  # a row a group
    radius, number = (np.array([of[g][c] if g in of else 0 for g in range(len(centroids))], kind) for c, kind in (("radius", float), ("n", np.int64)))
    parts = F.element_at(F.lit(_parts(number, block) or [1]), F.col("group") + 1)
    return Index(grouped.select("id", "vector", "group", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part")), centroids, radius, number, block)


def _parts(number: np.ndarray, block: int) -> list[int]:
    return np.maximum(1, -(-number // block)).tolist()


def _visits(queries: DataFrame, idx: Index, k: int) -> DataFrame:
    """id, vector, group, bound, first: the bound of each query in each group; first: one of the nearest groups that together hold k vectors (and the query itself)."""
    centroids, radius, number = idx.centroids, idx.radius, idx.number
    schema = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float64())), ("groups", pa.list_(pa.int32())), ("bounds", pa.list_(pa.float64())), ("near", pa.int32())])

    def look(batches):
        for b in batches:
            if not b.num_rows or not len(centroids):
                continue
            q = matrix(pa.chunked_array([b.column(1)]))
            product = q @ centroids.T
            size = np.linalg.norm(q, axis=1)[:, None]
            bound = product + size * radius
            bound += SLACK * (np.abs(product) + size * (radius + np.linalg.norm(centroids, axis=1)))
            order = np.argsort(-product, axis=1, kind="stable")
            near = (np.cumsum(number[order], axis=1) < k + 1).sum(axis=1) + 1
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * len(centroids), pa.int32()), pa.array(x.ravel(), kind))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(schema.field(1).type), lists(order.astype(np.int32), pa.int32()), lists(np.take_along_axis(bound, order, 1), pa.float64()), pa.array(near.astype(np.int32))], schema=schema)

    return queries.mapInArrow(look, "id long, vector array<double>, groups array<int>, bounds array<double>, near int")


def _hits(asked: DataFrame, idx: Index, k: int, without_self: bool) -> DataFrame:
    """query_id, doc_id, score: the best k of each part of each group that a query (id, vector, group) asks."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table([[], [], []], schema=HITS)]
        if left.num_rows and right.num_rows:
            ids, docs = left["id"].to_numpy(), right["id"].to_numpy()
            q, v = matrix(left["vector"]), matrix(right["vector"])
            for at in range(0, len(ids), ROWS):
                part = slice(at, at + ROWS)
                scores = np.round(q[part] @ v.T, 12)
                if without_self:
                    scores[ids[part, None] == docs] = -np.inf
                row, column = best_of(scores, docs, k)
                out.append(pa.table([ids[part][row], docs[column], scores[row, column]], schema=HITS))
        return pa.concat_tables(out)

    parts = F.element_at(F.lit(_parts(idx.number, idx.block) or [1]), F.col("group") + 1)
    spread = asked.select("id", "vector", "group", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return spread.groupBy("group", "part").cogroup(idx.vectors.select("id", "vector", "group", "part").groupBy("group", "part")).applyInArrow(best, "query_id long, doc_id long, score double")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def search(queries: DataFrame, idx: Index, k: int = R.TOP_K, qid: str = "vec_id", vector: str = "embedding", without_self: bool = False) -> DataFrame:
    """query_id, doc_id, score, rank, and looked_at: the share of vectors that the query was compared with."""
    known = queries.where(F.col(vector).isNotNull() & F.col(qid).isNotNull()).select(F.col(qid).cast("long").alias("id"), F.col(vector).alias("vector"))
    visits = _visits(known, idx, k)
    pairs = lambda v: v.select("id", "vector", F.explode("chosen").alias("group"))
    first = visits.withColumn("chosen", F.slice("groups", F.lit(1), F.col("near")))
    found = _ranked(_hits(pairs(first), idx, k, without_self), k)
    floor = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    # A bound that equals the floor may still hide an equal score of a smaller id.
    open_ = F.filter(F.slice(F.arrays_zip(F.col("groups").alias("g"), F.col("bounds").alias("b")), F.col("near") + 1, F.size("groups")), lambda x: F.col("floor").isNull() | (x["b"] >= F.col("floor") - SLACK))
    second = visits.join(floor, "id", "left").withColumn("chosen", F.transform(open_, lambda x: x["g"]))
    total = max(int(idx.number.sum()), 1)
    sizes = F.lit(idx.number.tolist() or [0])
    seen = lambda groups: F.aggregate(groups, F.lit(0).cast("long"), lambda n, g: n + F.element_at(sizes, g + 1))
    looked = second.select(F.col("id").alias("query_id"), ((seen(F.slice("groups", F.lit(1), F.col("near"))) + seen(F.col("chosen"))) / total).alias("looked_at"))
    both = found.drop("rank").union(_hits(pairs(second), idx, k, without_self))
    return _ranked(both, k).join(looked.dropDuplicates(["query_id"]), "query_id")
