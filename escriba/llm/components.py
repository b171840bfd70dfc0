"""Connected components of a link table, by alternating large-star and small-star steps on DataFrames.

Every step groups links by one end (a minimum, so Spark combines before it shuffles) and joins back; a hub with very many
links is a skewed join that adaptive execution splits. Nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import compact


def _large_star(links: DataFrame, parts: int) -> DataFrame:
    """Each neighbour greater than u is linked to the least of u and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(parts).distinct().coalesce(parts)


def _small_star(links: DataFrame, parts: int) -> DataFrame:
    """u (the greater end) and all its smaller neighbours are linked to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").coalesce(parts).distinct().coalesce(parts)


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable), for every node of links (columns u and v, long); a node alone has no row."""
    now = compact(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:  # the rounds grow as a logarithm of the nodes
        state = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        parts = now.rdd.getNumPartitions()  # as many as the links need
        now = compact(_small_star(_large_star(now, parts), parts))
    # at rest every link leads straight to the least node of its component
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
