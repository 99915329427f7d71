"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node, root for every node of edges (a, b) that isn't itself a root; root is the smallest node reachable.

    A round links every node to the smallest of its neighbours, first from larger ones, then from smaller ones. It
    moves as many rows as there are edges, and rounds grow with the logarithm of the longest chain. Rounds end when
    every node has one root and no root is a node. Each round is written to the shared folder, so lineage stays short.
    """
    now = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")
    )
    now = scratch.table(now.distinct(), f"{name}_0")
    i = 0
    while not _open(now).isEmpty():
        i += 1
        both = now.select("node", F.col("root").alias("other")).union(now.select("root", "node"))
        least = both.groupBy("node").agg(F.min("other").alias("low"))
        least = least.select("node", F.least("node", "low").alias("low"))
        large = both.join(least, "node").where(F.col("other") > F.col("node"))
        large = scratch.table(large.select(F.col("other").alias("node"), F.col("low").alias("root")).distinct(), f"{name}_{i}a")
        least = large.groupBy("node").agg(F.min("root").alias("low"))
        rest = large.join(least, "node").where(F.col("root") != F.col("low")).select(F.col("root").alias("node"), F.col("low").alias("root"))
        small = rest.union(least.select("node", F.col("low").alias("root"))).where(F.col("node") != F.col("root"))
        now = scratch.table(small.distinct(), f"{name}_{i}")
        scratch.drop(f"{name}_{i - 1}", f"{name}_{i}a")
    return now


def _open(now: DataFrame) -> DataFrame:
    """The nodes that have several roots, or are a root themselves; rows of `now` are distinct."""
    ends = now.select("node", F.lit(1).alias("up")).union(now.select("root", F.lit(0)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 1 or (up = 1 and n > 1)")
