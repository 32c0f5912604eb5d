"""Connected components of a graph of any size, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node that can be reached, and is not listed
    under itself.

    Each round points every node's larger neighbours at the smallest one (large star), then every node and its
    smaller neighbours at the smallest of those (small star); the number of rounds grows with the logarithm of the
    graph. Minima are aggregated before anything is shuffled, so a node with very many links is no hot group, and
    the joins back are such as adaptive execution can split. Null and repeated links and loops are ignored.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = checkpoint(e)
    state = _state(e)
    while True:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.union(least).where(F.col("u") != F.col("v")).toDF("u", "v").distinct())
        state, before = _state(e), state
        if state == before:
            return e.toDF("node", "root")
