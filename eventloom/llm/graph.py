"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """`links` has nodes a and b (long, not null). One row per linked node: node, root; the root is the smallest node.

    Every step links the neighbours of each node to the smallest of them, first the larger neighbours and then the
    smaller ones, until nothing changes; the steps grow with the logarithm of a component, not with its diameter. Each
    step is an aggregate that combines before its shuffle and a join that adaptive execution splits at a hub; both are
    written to the shared folder. Links of a node to itself don't count; an empty table has no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    edges = stored(edges.distinct(), "links")
    before = None
    while (now := mark(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        lowest = both.groupBy("node").agg(F.min("root").alias("low"))
        lowest = stored(lowest.select("node", F.least("node", "low").alias("low")), "lowest")
        large = both.where("root > node").join(lowest, "node").select(F.col("root").alias("node"), F.col("low").alias("root"))
        large = stored(large.distinct(), "links")
        lowest = stored(large.groupBy("node").agg(F.min("root").alias("low")), "lowest")
        paired = large.join(lowest, "node")
        small = paired.where("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root"))
        edges = stored(small.union(lowest.select("node", F.col("low").alias("root"))).distinct(), "links")
    return edges


def mark(edges: DataFrame) -> tuple:
    """Two tables of the same links have the same mark."""
    code = F.xxhash64("node", "root")
    return tuple(edges.agg(F.count("*"), F.sum(code % (1 << 40)), F.bit_xor(code)).first())
