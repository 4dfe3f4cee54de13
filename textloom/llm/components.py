"""Connected components of a table of links.

Alternating stars: every node hands its larger neighbours its smallest neighbour,
then its smaller ones; the links shrink to stars around the smallest node of each
component after a number of rounds that grows with the logarithm of its size. Each
round is two partial aggregations and two joins; a star with very many nodes is a
skewed side of a join whose other side has one row per key, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.tables import saved


def _all_stars(links: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none itself: neither of
    the two steps would change such links."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("below")), F.struct(F.col("v").alias("node"), F.lit(0).alias("below")))
    met = links.select(F.inline(ends)).groupBy("node").agg(F.sum("below").alias("below"), F.min("below").alias("_least"))
    return met.where("below > 1 OR below > 0 AND _least = 0").isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # a table of its own: Spark can then split the rows of a star in the join
    least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    inner = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reached) for every node with a link to
    another; ``links`` has two columns of one type, in any order and repeated."""
    a, b = links.columns
    oriented = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    current = saved(oriented)
    while not _all_stars(current):
        current = saved(_small_star(_large_star(current)))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
