"""Connected components of a table of links, by alternating large and small stars (Kiveris et al., 2014).

Each round is a grouped minimum and a join; rounds are written to the shared folder, so that a lost
executor costs one round at most. Nothing of the graph reaches the driver but whether it is stars only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node reachable. Links of a node with itself count as none."""
    edges = written(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        sides = both.groupBy("u").agg(F.sum(F.when(F.col("u") > F.col("v"), 1).otherwise(0)).alias("up"), F.sum(F.when(F.col("u") < F.col("v"), 1).otherwise(0)).alias("down"))
        if sides.where("up > 1 or (up > 0 and down > 0)").isEmpty():  # stars only
            break
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "stars")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
