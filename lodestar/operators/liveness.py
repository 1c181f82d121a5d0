"""What entry points reach, kept up to date under inserts and deletes.

The state is a table of the live nodes with a depth each: an entry point has 0, and every other live node has a step from a
live node of smaller depth, its support. So a node stays live for as long as one support is left, however many paths end,
and cycles can't hold themselves up.

An update first suspends the nodes whose last support is gone, and what hung on these alone, then brings back those that
what stayed still reaches, and what new steps and entries reach. Chains of single supports are passed by doubling, nodes that
support no other are looked at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.traverse import along, doubled, shortened, united
from lodestar.plans.tables import NEAR_ROWS, materialized, near


@dataclass
class Update:
    """live: id, depth after the update; touched: how many nodes were suspended, brought back or found."""

    live: DataFrame
    suspended: int
    found: int


def steps_of(edges: DataFrame) -> DataFrame:
    """a, b: the edges (src_id, dst_id)."""
    return edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"))


def least(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("id").agg(F.min("depth").cast("long").alias("depth"))


#: Rounds with small frontiers after which the steps to nodes that are found leave the table that rounds read.
TRIM = 6


def spread(steps: DataFrame, seeds: DataFrame) -> DataFrame:
    """id, depth of the seeds (id, depth) and of what they reach by steps (a, b; a table), each deeper than a node before it.

    Steps to nodes that are found are left out once many were found, so rounds read less and less.
    """
    frontier = materialized(least(seeds))
    levels, new = [frontier], [frontier]
    while True:
        rows = frontier.count()
        if rows == 0:
            return united(levels)
        if rows > NEAR_ROWS or len(new) > TRIM or len(levels) == 1:
            steps, new = materialized(steps.join(near(materialized(united(new))).select(F.col("id").alias("b")), "b", "left_anti").select("a", "b")), []
        on = steps.join(near(frontier).withColumnRenamed("id", "a"), "a")
        for x in new:
            on = on.join(near(x).select(F.col("id").alias("b")), "b", "left_anti")
        frontier = materialized(on.groupBy(F.col("b").alias("id")).agg((F.min("depth") + 1).alias("depth")))
        levels, new = shortened([*levels, frontier]), [*new, frontier]


def start(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """id, depth: the state over edges (src_id, dst_id) from entries (column id)."""
    return materialized(spread(materialized(steps_of(edges)), entries.select("id", F.lit(0).alias("depth"))))


def update(live: DataFrame, before: DataFrame, after: DataFrame, entries_before: DataFrame, entries_after: DataFrame, gone: DataFrame | None = None) -> Update:
    """The state after the edges (src_id, dst_id) and the entries (column id) have changed; before and after are all of them.

    gone: nodes (column id) that are no more, whatever still points at them. Parallel edges are one step. What was before
    need not be compared with what is after: the state has a support for each node, so nodes without any have lost it.
    """
    return settled(live, materialized(steps_of(after)), entries_after, gone, None)


def changed(live: DataFrame, steps: DataFrame, removed: DataFrame, added: DataFrame, entries: DataFrame, left: DataFrame, gone: DataFrame | None = None) -> Update:
    """update() for who knows the changes: steps are all steps (a, b; a table) after it, removed and added the changed ones,
    entries all entries after it, left those that are entries no more."""
    return settled(live, steps, entries, gone, removed.select(F.col("b").alias("id")).unionByName(left.select("id")))


def settled(live: DataFrame, steps: DataFrame, entries: DataFrame, gone: DataFrame | None, doubtful: DataFrame | None) -> Update:
    """The state over steps (a, b; a table) from entries. doubtful: those among which all nodes are that have lost a support
    or were entries (None: any)."""
    entries = materialized(entries.select("id").distinct())
    named = lambda c: live.select(F.col("id").alias(c), F.col("depth").alias(f"d_{c}"))
    known = materialized(steps.join(named("a"), "a", "left").join(named("b"), "b", "left"))
    supports = materialized(known.where("d_a < d_b").select("a", "b").join(entries.withColumnRenamed("id", "b"), "b", "left_anti"))
    asked = live.select("id") if doubtful is None else live.select("id").join(doubtful.distinct(), "id", "left_semi")
    lost = asked.join(entries, "id", "left_anti").join(supports.select(F.col("b").alias("id")), "id", "left_anti")
    out = suspended(supports, lost if gone is None else lost.unionByName(live.select("id").join(gone.select("id"), "id", "left_semi")))
    stayed = materialized(live.join(out, "id", "left_anti").select("id", F.col("depth").cast("long").alias("depth")))
    ends = known.where("d_b is null").unionByName(known.join(near(out).withColumnRenamed("id", "b"), "b", "left_semi"))
    ends = ends if gone is None else ends.join(gone.select(F.col("id").alias("b")), "b", "left_anti")
    ends = materialized(ends.join(near(out).withColumn("o", F.lit(True)), F.col("a") == F.col("id"), "left").select("a", "b", "d_a", (F.col("d_a").isNotNull() & F.col("o").isNull()).alias("stayed")))
    more = entries.join(stayed, "id", "left_anti").select("id", F.lit(0).cast("long").alias("depth"))
    more = more if gone is None else more.join(gone.select("id"), "id", "left_anti")
    seeds = ends.where("stayed").select(F.col("b").alias("id"), (F.col("d_a") + 1).alias("depth")).unionByName(more)
    found = materialized(spread(ends.where("not stayed").select("a", "b"), seeds))
    return Update(materialized(stayed.unionByName(found)), out.count(), found.count())


def suspended(supports: DataFrame, lost: DataFrame) -> DataFrame:
    """id: the lost nodes (column id) and those all of whose supports (a, b; a table, without cycles) are among what is given."""
    out = materialized(lost.distinct())
    if out.isEmpty():
        return out
    # Nodes that support no other are left for the last. Of the rest, one with a single support goes with it.
    inner = materialized(supports.join(supports.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
    degree = materialized(inner.groupBy("b").agg(F.min("a").alias("a"), F.max("a").alias("most")))
    jumps, several = doubled(degree.where("a = most").select("a", "b")), degree.where("a <> most").select("b")

    def fallen(supports: DataFrame, fresh: DataFrame, out: DataFrame) -> DataFrame:
        hit = materialized(supports.join(near(fresh).withColumnRenamed("id", "a"), "a", "left_semi").select("b").distinct())
        held = supports.join(near(hit), "b", "left_semi").join(near(out).withColumnRenamed("id", "a"), "a", "left_anti").select("b")
        return hit.join(held, "b", "left_anti").select(F.col("b").alias("id")).join(out, "id", "left_anti")

    out = fresh = materialized(along(out, jumps))
    forks = None if several.isEmpty() else materialized(inner.join(several, "b", "left_semi"))
    while forks is not None:
        fresh = materialized(along(materialized(fallen(forks, fresh, out)), jumps).join(out, "id", "left_anti"))
        if fresh.isEmpty():
            break
        out = materialized(out.unionByName(fresh))
    return materialized(out.unionByName(fallen(supports, out, out)).distinct())


def dead(nodes: DataFrame, live: DataFrame) -> DataFrame:
    """id: nodes (column id) that are not live."""
    return nodes.select("id").join(live.select("id"), "id", "left_anti")
