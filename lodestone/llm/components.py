"""Connected components by alternating large-star and small-star (Kiveris et al., 2014).

Each star is a grouped minimum and a join, so a node with very many links is summed in the tasks that hold them and
its join is split by AQE; no list of neighbours is ever gathered. Links and components stay on the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.cluster import beside, cut


def _large_star(links: DataFrame, rows: int) -> DataFrame:
    """Each larger neighbour of u gets a link to the least of u and its neighbours. rows: links counted."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = beside(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "m", 2 * rows)
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a > b")


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    """u and its smaller neighbours get a link to the least of them. links: a > b, at most so many rows."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(beside(least, "m", rows), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one link to a smaller node, or none and only links to it."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node of links (a, b); component is its least reachable node.

    Self links and repeated links don't matter; rows with a null end are left out; without links the result is empty.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut(links)
    while not _are_stars(links):
        rows = links.count()
        links = cut(_small_star(_large_star(links, rows), rows).distinct())
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
