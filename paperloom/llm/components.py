"""Connected components of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import discard, materialise, settled


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> a table of node, label: the smallest node that each can reach.

    Alternates two contractions until nothing changes: every node with its
    neighbours is linked to the least of them (the large star, for neighbours
    above the node; the small star, for those below). Links stay as many as
    they are or get fewer, and the rounds grow with the logarithm of the
    longest path. A node with very many links costs no more than they do: the
    least neighbour is a pre-aggregated minimum, joined back on the node.
    Whether a round has changed the links is told by their number and two
    64-bit sums over them, not by comparing the tables.
    """

    def contract() -> DataFrame:
        now = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
        before = _digest(now)
        while True:
            large = _star(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), above=True)
            nxt = materialise(_star(large, above=False).distinct(), "links")
            after = _digest(nxt)
            discard(now)
            now = nxt
            if after == before:
                return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
            before = after

    return settled(contract, "labels")


def _digest(links: DataFrame) -> tuple:
    wide = F.xxhash64("v", "u").cast("decimal(20,0)")
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(wide)).first())


def _star(edges: DataFrame, above: bool) -> DataFrame:
    """For each node u: its neighbours (those above u, or those not above it with u itself) to the least of u and all of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = edges.join(least, "u")
    if above:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v")
