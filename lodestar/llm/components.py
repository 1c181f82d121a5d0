"""Connected components by alternating large-star and small-star steps over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.tables import dropped, written


def large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node goes to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    out = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    dropped(least)
    return out


def small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, go to the smallest of them."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
    moved = edges.join(least.where("n > 1"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = written(least.select("u", F.col("m").alias("v")).unionByName(moved).distinct())
    dropped(least)
    return out


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node that can be reached) of every node of a link; nodes are longs.

    Links may repeat or join a node with itself; no links give no rows. Each step is a table, so a lost executor
    costs its own tasks; the number of steps grows with the logarithm of the longest path.
    """
    loops = links.where(F.col(a) == F.col(b)).select(F.col(a).alias("node"), F.col(a).alias("component"))
    edges = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        large = large_star(edges)
        small = small_star(large)
        dropped(edges, large)  # a step is a table of its own, so what it was made from can go
        edges = small
        state = edges.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("u").alias("nodes")).first()
        if state["rows"] == state["nodes"] and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return found.unionByName(loops.join(found, "node", "left_anti").distinct())
