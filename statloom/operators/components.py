"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.session import cut


def _least_neighbour(links: DataFrame) -> DataFrame:
    """links (u, v) with least: the smallest of u and all its neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("__m")).select(F.col("u").alias("__u"), F.least("u", "__m").alias("least"))
    return links.join(least, F.col("u") == F.col("__u")).drop("__u")


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one smaller node linked to it, or is only linked to larger ones."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def connected_components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label): each node that has a link with the smallest node of its component. Null ends are no links.

    Rounds of two steps on the links themselves, until they are stars: every larger neighbour of a node is linked to the smallest one around it,
    then every smaller one. Both keep components as they are, and the links of a component end as a star round its smallest node, in
    a number of rounds that grows with the logarithm of the longest chain. A step is one partial aggregation and one join, so a
    node with very many links is neither gathered in a row nor in a task.
    """
    whole = links.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    loops = whole.filter("u = v").select(F.col("u").alias("node"), F.col("v").alias("label"))
    now = cut(whole.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")), "links")
        down = _least_neighbour(large)
        small = down.filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(down.select("u", F.col("least").alias("v")))
        now = cut(small.distinct(), "links")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).unionByName(loops).groupBy("node").agg(F.min("label").alias("label"))
