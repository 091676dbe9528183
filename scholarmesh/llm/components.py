"""Connected components by alternating large-star and small-star rounds on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarmesh.llm.common import cut_lineage, parts_for


def _large_star(edges: DataFrame) -> DataFrame:
    """Every edge (u > v) from its smaller end: u now hangs on the least of v and the neighbours of v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
    return edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge (u > v) from its larger end: v now hangs on the least smaller neighbour m of u; the row with m keeps u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                         F.col("m").alias("v"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node that hangs on another one hangs on that one only and bears none; no round changes such edges."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """u, v: every linked node with the least node of its component (itself left out). links: u, v of any sortable type.

    Neighbours are never collected; a hub's rows meet its minimum in joins that Spark can split. All edges have u > v.
    A round starts only where it changes something, and its edges stay in as many partitions as their number needs.
    """
    edges = cut_lineage(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    parts = parts_for(edges)
    edges = edges.coalesce(parts)
    while not _are_stars(edges):
        edges = cut_lineage(_small_star(_large_star(edges)).distinct().coalesce(parts))
    return edges
