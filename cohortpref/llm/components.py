"""Connected components of a graph of links, by alternating star contraction with DataFrame operations only.

Large star links every neighbour larger than a node to the smallest of the node's neighbourhood, small star links the
smaller neighbours and the node itself to the smallest one; repeated until nothing changes, every node is linked to the
smallest node of its component. Minima are aggregated before they are joined back, so a node with many links is one row
on one side of the join. Each round is written to the shared folder, which ends its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortpref.session import snapshot


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    met = both.where("v > u").join(least, F.col("u") == F.col("n"))
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
    met = edges.join(least, F.col("u") == F.col("n")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """node, component (the smallest node that can be reached), one row per node that is not the smallest of its
    component. Null ends and links of a node to itself are ignored."""
    known = links.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    edges = known.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    edges = snapshot(edges.where("u > v").distinct(), "links")
    state = _checksum(edges)
    while state[0]:
        edges = snapshot(_small_star(_large_star(edges)), "stars")
        new = _checksum(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _checksum(edges: DataFrame) -> tuple:
    """Number of edges and two sums of their hashes: equal for equal sets."""
    low = F.xxhash64("u", "v") % 1_000_000_007
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(low), F.sum(F.hash("u", "v").cast("long"))).first())
