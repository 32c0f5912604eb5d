"""Connected components of a graph of any size, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the smallest node that can be reached; roots are not listed.

    Each round hangs every node's larger neighbours on the smallest one it knows, then every node on the smallest of
    its smaller neighbours; rounds grow with the logarithm of the longest chain. Minima are aggregated before the
    shuffle, so hubs are no hot groups.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = None
    while True:
        e = checkpoint(e)
        before, state = state, e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return e.toDF("node", "root")
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.union(low).toDF("u", "v").where("u <> v").distinct()
