"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlake.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of its component for every node of an edge (a, b) of longs but that smallest one.

    Each round points every node and its larger neighbours to the smallest
    neighbour; rounds end when the edges are stars.  Edges stay distributed;
    the joins are merge joins, so that no round sends a list through the driver.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _are_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node points to one other at most, and to none if another points to it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("met")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("met").alias("met")).where("out > 1 or out + met > 1").isEmpty()
