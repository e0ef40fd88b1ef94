"""Connected components of a graph given as a table of links, by alternating large-star and small-star steps.

Both steps replace links by links to the smallest node seen nearby and keep the components as they are. When nothing
changes, every node is linked to the smallest of its component. Each round is written to the shared folder, so a lost
executor costs a re-read. Only one checksum row a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import join_groups
from recordloom.session import stage


def _star(links: DataFrame, kept: str) -> DataFrame:
    """Link every neighbour that ``kept`` picks, and the node itself, to the smallest node among node and neighbours.

    ``links`` has (a, b). The smallest is found by partial aggregation; nodes with a large share of all links, as the centre
    of a large component is after the first round, are broadcast, so their links stay where they are.
    """
    least = links.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("degree"))
    least = stage(least.withColumn("least", F.least("least", "a")), "least_neighbours")
    met = join_groups(links, least, "a", "degree", links.count())
    return met.where(kept).select(F.col("b").alias("a"), F.col("least").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node of its component."""
    links = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = links.union(links.select("b", "a"))
        # Large star: larger neighbours of a node move to the smallest one.
        large = _star(both, "b > a").where("a <> b").distinct()
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        # Small star: a node and its smaller neighbours move to the smallest one.
        large = stage(large, "large_star")
        small = _star(large, "true").union(large.groupBy("a").agg(F.min("b").alias("b")))
        links = stage(small.where("a <> b").distinct(), "small_star")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = now
