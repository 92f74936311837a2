"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.tables import cut


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each node points to one root, and no root points on."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    found = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return found.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; ``links`` has columns u and v.

    Each round replaces the edges by stars around smaller nodes; the number of
    rounds is logarithmic in the longest path.  Minima are aggregates joined
    back, so a node with very many links is split like any skewed join key.
    Only the answer whether the stars are settled reaches the driver.
    """
    u, v = F.col("u"), F.col("v")
    edges = cut(links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
                .distinct(), "edges")
    while not _settled(edges):
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).where(u != v)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges = cut(small, "edges")
    return (edges.select(u.alias("node"), v.alias("root"))
            .unionByName(edges.select(v.alias("node"), v.alias("root")).distinct()))
