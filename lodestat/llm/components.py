"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.stored import stored


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).head()
    return row.n, row.x


def _star(links: DataFrame, both_ways: bool) -> DataFrame:
    """One contraction: neighbours of each node are linked to the least of them.

    ``links`` have u > v. Both ways: the larger neighbours of every node move to its least neighbour. One
    way: a node and its smaller neighbours do. The least neighbour is summed up per node and joined back, so a
    node with very many neighbours is never gathered in one place.
    """
    sides = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else links
    least = stored(sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    if both_ways:
        moved = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select("u", F.col("m").alias("v"))
        moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return stored(moved.where("u <> v").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v); the root is the least node of its component."""
    links = stored(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = _state(links)
    while before[0]:
        links = _star(_star(links, True), False)
        now = _state(links)
        if now == before:
            break
        before = now
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
