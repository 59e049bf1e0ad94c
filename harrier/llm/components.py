"""Connected components of a table of links, as repeated joins and minima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.llm.common import Scratch, checkpoint


def reshuffled(key: str) -> Column:
    """The same number under no known partitioning: a join on it deals its side out anew, so that a crowded key may be split."""
    return F.col(key) + F.lit(0)


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component), the component being its smallest node, from links (a, b) of long.

    Alternates between linking every larger neighbour of a node to the smallest one and every
    smaller neighbour likewise, until each node points to the smallest of its component; that takes
    a number of rounds that grows with the logarithm of the nodes. No node's neighbours meet in one
    task but for their minimum. Links of a node with itself are allowed; nodes without a link have no row.
    """
    scratch = Scratch(links.sparkSession)
    edges = scratch.keep("edges", links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    alone = links.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    edges = edges.where("u > v")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).select(reshuffled("u").alias("k"), "m")
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep("large", large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least.select(reshuffled("u").alias("k"), "m"), F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.keep("edges", moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        roots = edges.select(F.col("v").alias("u")).distinct()
        if roots.join(edges.select("u").distinct(), "u").isEmpty():
            break
    tree = edges.groupBy("u").agg(F.min("v").alias("component"))
    found = tree.select(F.col("u").alias("node"), "component").unionByName(tree.select(F.col("component").alias("node"), "component").distinct())
    out = checkpoint(found.unionByName(alone).groupBy("node").agg(F.min("component").alias("component")))
    scratch.close()
    return out
