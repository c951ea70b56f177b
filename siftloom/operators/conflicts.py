"""Rows that name two keys (a content hash and a storage key, or a URL and a hash).

Rows that share a key, directly or through other rows, affect each other when they are
recorded one after the other.  ``labels`` cuts a batch into such components, and
``first_claims`` decides in rounds which rows come first for all their keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.operators.skew import attach_per_key, join_present
from siftloom.session import cut_lineage

#: Edges that one task connects; more are connected in rounds.
FEW_EDGES = 100_000

def filled(value: Column) -> Column:
    """The value, null when it is empty."""
    return F.nullif(value, F.lit(""))


def _star(links: DataFrame) -> DataFrame:
    """Edges (u > v) after hooking the neighbours of each node, then the node, to the least of them."""
    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = least(both).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = least(large)
    small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    hooked = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
    return hooked.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of a few edges in one task, by union-find."""
    parent: dict[str, str] = {}

    def root(node: str) -> str:
        while parent.setdefault(node, node) != node:
            parent[node] = node = parent[parent[node]]
        return node

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            low, high = sorted((root(u), root(v)))
            parent[high] = low
    nodes = list(parent)
    yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.string()), "label": pa.array([root(n) for n in nodes], pa.string())})


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, label) of every node of ``edges`` (u, v): the least node it is connected to.

    At most ``few`` edges are settled by one task.  More go through rounds of star steps,
    which grow with the logarithm of the longest path and end when no node that others hook
    to is hooked itself.
    """
    if edges.count() <= few:
        return cut_lineage(edges.select("u", "v").coalesce(1).mapInArrow(_forest, "node string, label string"))
    links = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    while True:
        links = cut_lineage(_star(links))
        several = links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        if links.join(links.select(F.col("u").alias("v")), "v", "left_semi").select("u").unionByName(several).isEmpty():
            break
    named = links.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return named.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def labels(rows: DataFrame, a: str, b: str, spread: str) -> DataFrame:
    """``rows`` with ``label``: equal for rows of one component; null without both keys.

    Most values of one key meet a single value of the other.  Such leaves take the label of
    that partner from an aggregate alone; only values that meet several on both sides enter
    the rounds of ``components``.
    """
    pairs = cut_lineage(rows.select(F.concat(F.lit("a"), filled(F.col(a))).alias("a"), F.concat(F.lit("b"), filled(F.col(b))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")))
    linked = pairs.where("a is not null and b is not null")

    def degrees(mine: str, other: str) -> DataFrame:
        return pairs.where(f"{mine} is not null").groupBy(mine).agg(
            F.count(other).alias(f"of_{mine}"), F.min(other).alias(f"only_{mine}"), F.sum("n").alias(f"n_{mine}"))

    of_a, of_b = degrees("a", "b"), degrees("b", "a")
    core = cut_lineage(linked.join(of_a.where("of_a > 1").select("a"), "a", "left_semi").join(of_b.where("of_b > 1").select("b"), "b", "left_semi"))
    tangled = None if core.isEmpty() else components(core.select(F.col("a").alias("u"), F.col("b").alias("v")))

    def named(own: DataFrame, mine: str, other_table: DataFrame, other: str) -> DataFrame:
        """(value, label, _n) of the values of one key."""
        table = own.join(other_table.select(F.col(other).alias(f"only_{mine}"), F.col(f"of_{other}").alias("back")), f"only_{mine}", "left")
        # a leaf belongs to its partner; a pair of leaves to its first key
        leaf = (F.col(f"of_{mine}") == 1) & ((F.col("back") > 1) | F.lit(mine == "b"))
        home = F.when(leaf, F.col(f"only_{mine}")).otherwise(F.col(mine))
        out = table.select(F.col(mine).alias("value"), home.alias("home"), F.col(f"n_{mine}").alias("_n"))
        if tangled is None:
            return out.select("value", F.col("home").alias("label"), "_n")
        return out.join(tangled, F.col("home") == F.col("node"), "left").select("value", F.coalesce("label", "home").alias("label"), "_n")

    every = named(of_a, "a", of_b, "b").unionByName(named(of_b, "b", of_a, "a"))
    value = F.coalesce(F.concat(F.lit("a"), filled(F.col(a))), F.concat(F.lit("b"), filled(F.col(b))))
    return attach_per_key(rows.withColumn("value", value), every, ["value"], [spread]).drop("value")


def first_claims(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``order`` of the rows that a replay in that order admits.

    A row is admitted unless an admitted row before it has one of its keys (null keys are
    shared by nobody).  In each round the rows that come first for all their keys are
    admitted and those they rule out leave; what remains was held back by a row that itself
    has left, and goes through another round.
    """
    left = rows.select(order, *keys)
    admitted = None
    while True:
        held = left
        for key in keys:
            first = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(f"_first_{key}"))
            held = join_present(held, first, key, order)
        wins = F.lit(True)
        for key in keys:
            wins = wins & (F.coalesce(f"_first_{key}", order) == F.col(order))
        judged = cut_lineage(held.select(order, *keys, wins.alias("_wins")))
        won = judged.where("_wins").select(order, *keys)
        admitted = won if admitted is None else admitted.unionByName(won)
        rest = judged.where("not _wins").drop("_wins")
        for key in keys:
            rest = join_present(rest, won.where(F.col(key).isNotNull()).select(key, F.lit(True).alias(f"_taken_{key}")), key, order)
            rest = rest.where(F.col(f"_taken_{key}").isNull()).drop(f"_taken_{key}")
        left = cut_lineage(rest)
        if left.isEmpty():
            return admitted.select(order)
