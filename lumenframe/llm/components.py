"""Connected components of a table of links, by alternating large-star and small-star rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import stage


def _stars(links: DataFrame) -> bool:
    """Whether links (u > v, none twice) are stars: no node has two lesser neighbours, or a lesser and a greater one."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    of_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not of_node.agg(F.max((F.col("up") > 0) & (F.col("up") + F.col("down") > 1)).alias("open")).first()["open"]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the least node that can be reached) for every node of links (columns a, b; long). Isolated nodes aren't listed.

    No task gathers a node's neighbours: only minima are grouped, and joins stream a hot node's links. The result of each round is
    staged, so lineage stays short. The driver keeps a record of every task, however small, so a round shuffles as seldom as it can, and
    none is run on what are stars already. Links with a null end are ignored; an empty table gives no rows."""
    now = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(most_rounds):
        if _stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: a node's greater neighbours go to the least of its neighbours and itself. Links may repeat now, but are no more than before.
        least = both.groupBy(F.col("u").alias("v")).agg(F.min(F.least("u", "v")).alias("m"))
        large = stage(now.join(least, "v").select("u", F.col("m").alias("v")), "large-star")
        # Small star: a node's lesser neighbours and itself go to the least of these; the node takes the place of that one's link.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        up = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        now = stage(large.join(least, "u").select(up.alias("u"), F.col("m").alias("v")).distinct(), "small-star")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
