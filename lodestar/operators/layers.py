"""Values of nodes from those of their successors, layer by layer from the nodes without any.

A node's layer is the longest path from it. Nodes that reach a cycle have none: no longest path is left for them once cycles
may be walked round, so callers deal with them apart. There are as many rounds as the longest path has edges, however many paths there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.traverse import closure_of, shortened, united
from lodestar.plans.tables import materialized, near

#: Numbers of walks can exceed a long: they end at the largest one, and products of two of these have 38 digits.
WIDE, LARGEST = "decimal(38,0)", 2**63 - 1


def below(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """a, b: the distinct edges (src_id, dst_id) that the starts (column id) reach."""
    steps = materialized(edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")).repartition("a").distinct())
    first = materialized(steps.join(starts.select(F.col("id").alias("a")).distinct(), "a", "left_semi").select("a", "b"))
    # What is reached after the first step has a step in, and of such nodes there are mostly few.
    entered = near(materialized(steps.select(F.col("b").alias("a")).distinct()))
    lower = materialized(steps.join(entered, "a", "left_semi").select("a", "b"))
    reached = closure_of(lower, first.select(F.col("b").alias("id"))).select(F.col("id").alias("a"))
    more = lower.join(reached, "a", "left_semi").join(starts.select(F.col("id").alias("a")), "a", "left_anti")
    return materialized(first.unionByName(more.select("a", "b")))


def layered_below(edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """below() and the layers of its ends and of the starts."""
    steps = below(edges, starts)
    return steps, materialized(layers(steps, ends(steps, starts)))


#: After so many rounds steps to finished nodes are left out of the table that rounds read.
TRIM = 8


def layers(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, layer of the nodes (column id, all ends of steps among them) that reach no cycle. steps: a table of a, b, distinct.

    Each round is one table: the nodes that aren't finished, with how many steps to unfinished nodes they have left.
    """
    left = steps
    count = left.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    open_ = materialized(nodes.select("id").distinct().join(count, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")))
    out, layer = [], 0
    ready = materialized(open_.where("n = 0").select("id"))
    entered = near(materialized(left.select(F.col("b").alias("id")).distinct()))  # others free nothing, however many they are
    while not ready.isEmpty():
        out.append(ready.select("id", F.lit(layer).cast("long").alias("layer")))
        open_ = open_.where("n > 0")
        if open_.isEmpty():
            break
        if len(out) > TRIM:  # steps to what has just been finished are still to be counted
            left = materialized(left.join(united(out[:-1]).select(F.col("id").alias("b")), "b", "left_anti").select("a", "b"))
            out = [materialized(united(out[:-1])), out[-1]]
        freed = left.join(near(materialized(ready.join(entered, "id", "left_semi"))).withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("k"))
        open_ = materialized(open_.join(freed, "id", "left").select("id", (F.col("n") - F.coalesce("k", F.lit(0))).alias("n")))
        ready, layer = materialized(open_.where("n = 0").select("id")), layer + 1
    return united(out) if out else nodes.select("id", F.lit(0).cast("long").alias("layer")).limit(0)


def ends(steps: DataFrame, starts: DataFrame) -> DataFrame:
    return starts.select("id").unionByName(steps.select(F.col("a").alias("id"))).unionByName(steps.select(F.col("b").alias("id"))).distinct()


def walks(steps: DataFrame, layered: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, count, weight, cost of the nodes that have a layer, for the walk that visits a node, then each successor's walk in
    the order of ids.

    nodes: id, f (0 or 1), w. count is how many nodes with f the walk visits, weight the sum of w over its visits, and cost
    the sum of w times (1 + how many nodes with f came before in the walk). A walk that starts after k such nodes costs k
    times the weight more, so a node's cost follows from its successors' three numbers.
    """
    own = layered.join(nodes, "id", "left").select("id", "layer", F.coalesce("f", F.lit(0)).cast(WIDE).alias("f"), F.coalesce("w", F.lit(0)).cast(WIDE).alias("w"))
    own = materialized(own)
    known = [materialized(own.where("layer = 0").select("id", F.col("f").alias("count"), F.col("w").alias("weight"), F.col("w").alias("cost")))]
    last = own.agg(F.max("layer")).first()[0] or 0
    entered = near(materialized(steps.select(F.col("b").alias("id")).distinct()))  # only these are joined to
    met = [materialized(known[0].join(entered, "id", "left_semi"))]
    before = Window.partitionBy("id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    capped = lambda c: F.least(c.cast(WIDE), F.lit(LARGEST).cast(WIDE))
    for n in range(1, last + 1):
        now = own.where(F.col("layer") == n).select("id", "f", "w")
        rows = now.join(steps.select(F.col("a").alias("id"), "b").join(near(materialized(united(met))).withColumnRenamed("id", "b"), "b"), "id")
        rows = rows.withColumn("earlier", capped(F.col("f") + F.coalesce(F.sum("count").over(before), F.lit(0))))
        rows = rows.withColumn("late", capped(F.col("cost") + F.col("weight") * F.col("earlier")))
        sums = rows.groupBy("id").agg(F.max("f").alias("f"), F.max("w").alias("w"), *[F.sum(c).alias(f"s_{c}") for c in ("count", "weight", "late")])
        found = sums.select("id", capped(F.col("f") + F.col("s_count")).alias("count"), capped(F.col("w") + F.col("s_weight")).alias("weight"), capped(F.col("w") + F.col("s_late")).alias("cost"))
        now = materialized(found)
        known, met = shortened([*known, now]), shortened([*met, materialized(now.join(entered, "id", "left_semi"))])
    return united(known)
