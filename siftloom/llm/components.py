"""Connected components of a links table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.session import cut_lineage


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u > v)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (x, y) but the least of each component.

    Each round writes its edges, so a lost executor reads files again; the rounds grow
    with the logarithm of the longest chain.  Only counts and check sums reach the driver.
    """
    edges = cut_lineage(links.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    last = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 16)).alias("h")).first()
        if not state.n or (state.n, state.h) == last:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        last = (state.n, state.h)
        edges = cut_lineage(_stars(edges))
