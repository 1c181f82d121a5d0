"""Labels of nodes that answer most questions "does a path lead from u to v?" from two rows.

Cycles are one node each. In what is left, a node's labels are

* its layer (the longest path from it): what u reaches has a smaller one;
* for SEEDS orders of the nodes by hash, the least and the largest hash among all that it reaches: u's span holds v's;
* its place in a spanning forest (its tree, and from where to where its subtree is numbered): a subtree is reached;
* whether its subtree is all that it reaches.

The first two say no, the third one yes, the last one no to all others. For pairs that none of them decides there are two
searches. From fewer goals than sources, it goes back from the goals, one row for a goal and a node on the way, as high as
the sources' layers. Otherwise it goes on from u through nodes whose labels leave v possible, until the forest says yes or
nothing is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.layers import layers
from lodestar.operators.traverse import cycles_of, shortened, united
from lodestar.plans.tables import materialized, near

SEEDS = 4


def label(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members (id, c), labels (c, layer, tree, first, end, least_k, most_k, whole), steps (a, b between components, l_a: a's
    layer) of edges (src_id, dst_id)."""
    own = materialized(edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")).repartition("a").distinct())
    nodes = own.select(F.col("a").alias("id")).unionByName(own.select(F.col("b").alias("id"))).distinct()
    rings = materialized(cycles_of(own).select(F.col("node").alias("id"), F.col("component").alias("k")))
    if rings.isEmpty():
        members = materialized(nodes.select("id", F.col("id").alias("c")))
        steps = materialized(own.where("a <> b"))
    else:
        ring = near(rings)
        members = materialized(nodes.join(ring, "id", "left").select("id", F.coalesce("k", "id").alias("c")))
        of = lambda x: ring.select(F.col("id").alias(x), F.col("k").alias(f"k_{x}"))
        ends = own.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("k_a", "a").alias("a"), F.coalesce("k_b", "b").alias("b"))
        steps = materialized(ends.where("a <> b").repartition("a").distinct())
    layered = materialized(layers(steps, members.select(F.col("c").alias("id")).distinct()).withColumnRenamed("id", "c"))
    up = materialized(steps.join(layered.select(F.col("c").alias("a"), F.col("layer").alias("l_a")), "a").repartition("a").select("a", "b", "l_a"))
    # The parent is one of least layer, of these one of least hash: both in a long, which needs no sorting of strings.
    keyed = up.withColumn("k", F.shiftleft(F.least("l_a", F.lit(2**18)), 44) + F.xxhash64("a").bitwiseAND(F.lit(2**44 - 1)))
    least = near(materialized(keyed.groupBy("b").agg(F.min("k").alias("k"))))
    parents = materialized(keyed.join(least, ["b", "k"]).groupBy("b").agg(F.min("a").alias("a")))
    tallest = layered.agg(F.max("layer")).first()[0] or 0

    hashes = [F.xxhash64(F.lit(k), F.col("c")) for k in range(SEEDS)]
    spans = [f"{w}_{k}" for w in ("least", "most") for k in range(SEEDS)]
    own_span = layered.select("c", "layer", *[h.alias(f"least_{k}") for k, h in enumerate(hashes)], *[h.alias(f"most_{k}") for k, h in enumerate(hashes)], F.lit(1).cast("long").alias("size"), F.lit(1).alias("whole"))
    own_span = materialized(own_span)
    done = [materialized(own_span.where("layer = 0").drop("layer"))]
    tree = parents.withColumnRenamed("b", "c").withColumnRenamed("a", "p")
    for n in range(1, tallest + 1):
        known = united(done)
        below = near(known.drop("size").withColumnRenamed("c", "b").join(tree.select(F.col("c").alias("b"), "p"), "b", "left"))
        on = up.where(F.col("l_a") == n).join(below, "b").withColumn("whole", F.when(F.col("p") == F.col("a"), F.col("whole")).otherwise(0))
        under = on.groupBy(F.col("a").alias("c")).agg(*[(F.min if s.startswith("least") else F.max)(s).alias(f"u_{s}") for s in spans], F.min("whole").alias("u_whole"))
        sizes = tree.join(known.select("c", "size"), "c").groupBy(F.col("p").alias("c")).agg(F.sum("size").alias("u_size"))
        now = own_span.where(F.col("layer") == n).drop("whole").join(under, "c").join(sizes, "c", "left")
        pick = [(F.least if s.startswith("least") else F.greatest)(s, f"u_{s}").alias(s) for s in spans]
        done = shortened([*done, materialized(now.select("c", *pick, (F.col("size") + F.coalesce("u_size", F.lit(0))).alias("size"), F.col("u_whole").alias("whole")))])
    spanned = materialized(united(done))

    # Numbers go down the forest: a child's subtree comes after its smaller sisters'.
    sisters = Window.partitionBy("p").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    places = materialized(tree.join(spanned.select("c", "size"), "c").select("c", "p", "size", (F.coalesce(F.sum("size").over(sisters), F.lit(0)) + 1).alias("after")))
    roots = spanned.join(tree.select("c"), "c", "left_anti").select("c", F.col("c").alias("tree"), F.lit(0).cast("long").alias("first"), F.col("size").alias("end"))
    frontier = materialized(roots)
    numbered = [frontier]
    while not frontier.isEmpty():
        on = places.join(frontier.select(F.col("c").alias("p"), "tree", F.col("first").alias("f")), "p")
        frontier = materialized(on.select("c", "tree", (F.col("f") + F.col("after")).alias("first"), (F.col("f") + F.col("after") + F.col("size")).alias("end")))
        numbered = shortened([*numbered, frontier])
    return members, materialized(spanned.drop("size").join(united(numbered), "c").join(layered, "c")), up


def prefixed(labels: DataFrame, p: str) -> DataFrame:
    return labels.select(*[F.col(c).alias(f"{p}_{c}") for c in labels.columns])


def surely(u: str, v: str) -> Column:
    return (F.col(f"{u}_tree") == F.col(f"{v}_tree")) & (F.col(f"{u}_first") <= F.col(f"{v}_first")) & (F.col(f"{v}_first") < F.col(f"{u}_end"))


def perhaps(u: str, v: str) -> Column:
    out = F.col(f"{u}_layer") > F.col(f"{v}_layer")
    for k in range(SEEDS):
        out = out & (F.col(f"{u}_least_{k}") <= F.col(f"{v}_least_{k}")) & (F.col(f"{u}_most_{k}") >= F.col(f"{v}_most_{k}"))
    return out


def answer(pairs: DataFrame, members: DataFrame, labels: DataFrame, steps: DataFrame, looked: list[int] | None = None) -> DataFrame:
    """src, dst, found for distinct pairs (src, dst), from what label() gives. A pair of one id has a path, known or not; an
    unknown id has no other. `looked` takes the number of pairs that were searched and the rows of each round."""
    asked = pairs.select("src", "dst").repartition("src").distinct()
    marked = members.join(labels, "c")
    goals = near(materialized(prefixed(marked, "v").join(asked.select(F.col("dst").alias("v_id")).distinct(), "v_id", "left_semi")))
    full = asked.join(prefixed(marked, "u"), F.col("src") == F.col("u_id"), "left").join(goals, F.col("dst") == F.col("v_id"), "left")
    sure = F.when(F.col("src") == F.col("dst"), True).when(F.col("u_c").isNull() | F.col("v_c").isNull(), False)
    sure = sure.when((F.col("u_c") == F.col("v_c")) | surely("u", "v"), True).when(~perhaps("u", "v") | (F.col("u_whole") == 1), False)
    judged = materialized(full.select("src", "dst", F.col("u_c").alias("u"), F.col("v_c").alias("v"), F.col("u_layer").alias("top"), sure.alias("found")))
    open_ = judged.where("found is null")
    if looked is not None:
        looked.append(open_.select("u", "v").distinct().count())
    decided = judged.where("found is not null").select("src", "dst", "found")
    if open_.isEmpty():
        return decided
    n = open_.agg(F.approx_count_distinct("u").alias("u"), F.approx_count_distinct("v").alias("v")).first()
    reached = (upward(open_, steps, looked) if n["v"] < n["u"] else onward(open_, labels, steps, looked)).withColumn("y", F.lit(True))
    return decided.unionByName(open_.join(reached, ["u", "v"], "left").select("src", "dst", F.coalesce("y", F.lit(False)).alias("found")))


def upward(open_: DataFrame, steps: DataFrame, looked: list[int] | None) -> DataFrame:
    """u, v: of the pairs (u, v, u's layer top) those with a path, by what lies before each v."""
    frontier = materialized(open_.groupBy("v").agg(F.max("top").alias("top")).select(F.col("v").alias("w"), "v", "top"))
    wanted, seen, yes = open_.select("u", "v").distinct(), [frontier], []
    while not frontier.isEmpty():
        on = steps.join(near(frontier).withColumnRenamed("w", "b"), "b").where("l_a <= top")
        yes = shortened([*yes, materialized(on.select(F.col("a").alias("u"), "v").distinct().join(wanted, ["u", "v"], "left_semi"))])
        higher = on.where("l_a < top").select(F.col("a").alias("w"), "v", "top").distinct()
        frontier = materialized(higher.join(united(seen).select("w", "v"), ["w", "v"], "left_anti"))
        seen = shortened([*seen, frontier])
        if looked is not None:
            looked.append(frontier.count())
    return united(yes).distinct()


def onward(open_: DataFrame, labels: DataFrame, steps: DataFrame, looked: list[int] | None) -> DataFrame:
    """u, v: of the pairs (u, v) those with a path, by what lies after each u, for one v at a time."""
    open_ = materialized(open_.select("u", "v").distinct().withColumn("w", F.col("u")))
    yes, seen = [], [open_]
    goals = materialized(prefixed(labels, "v").withColumnRenamed("v_c", "v").join(open_.select("v").distinct(), "v", "left_semi"))
    there = prefixed(labels, "w").withColumnRenamed("w_c", "w")
    while not open_.isEmpty():
        on = open_.withColumnRenamed("w", "a").join(steps, "a").select("u", "v", F.col("b").alias("w")).distinct().join(united(seen), ["u", "v", "w"], "left_anti")
        sure = surely("w", "v") | (F.col("w") == F.col("v"))
        found = on.join(there, "w").join(goals, "v").select("u", "v", "w", sure.alias("yes"), (perhaps("w", "v") & (F.col("w_whole") == 0)).alias("maybe"))
        found = materialized(found.where("yes or maybe"))
        hit = materialized(found.where("yes").select("u", "v").distinct())
        yes = shortened([*yes, hit])
        open_ = materialized(found.where("not yes").select("u", "v", "w").join(hit, ["u", "v"], "left_anti"))
        seen = shortened([*seen, open_])
        if looked is not None:
            looked.append(found.count())
    return united(yes).distinct()
