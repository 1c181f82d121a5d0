"""Traversals: rounds of joins from a frontier, each round a table, until nothing new is reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.plans.pattern import UNBOUNDED
from lodestar.plans.tables import materialized, near


def one_way(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b) steps in the direction of travel, as often as there are edges."""
    there = edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"))
    back = edges.select(F.col("dst_id").alias("a"), F.col("src_id").alias("b"))
    return there if direction == "forward" else back if direction == "backward" else there.unionByName(back)


def turned(edges: DataFrame, direction: str) -> DataFrame:
    """Distinct (a, b) steps in the direction of travel."""
    return one_way(edges, direction).distinct()


def reach(edges: DataFrame, starts: DataFrame, most: int = UNBOUNDED, direction: str = "forward", with_start: bool = False, with_parent: bool = False, kept: bool = False) -> DataFrame:
    """start, node, depth: each node reached from each start (column id) by at least one edge, at its least depth.

    A start counts as reached by a cycle, unless with_start, which gives it at depth 0 instead. with_parent adds parent: the
    smallest node one edge before, of those at the depth before (null for a start at depth 0). kept: the edges are a table already.
    """
    # Rounds drop repeated rows anyway, so steps may repeat.
    steps = one_way(edges, direction)
    steps = steps if kept or most <= 0 else materialized(steps)
    first = starts.select(F.col("id").alias("start")).distinct()
    more = [F.when(F.lit(False), F.col("start")).alias("parent")] if with_parent else []
    frontier = materialized(first.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), *more))
    levels = [frontier if with_start else frontier.limit(0)]
    depth = 0
    while depth < most:
        depth += 1
        grown = frontier.select("start", F.col("node").alias("a")).join(steps, "a").withColumnRenamed("b", "node")
        found = grown.groupBy("start", "node").agg(F.min("a").alias("parent")) if with_parent else grown.select("start", "node").distinct()
        visited = united([x.select("start", "node") for x in levels])
        frontier = materialized(found.join(visited, ["start", "node"], "left_anti").select("start", "node", F.lit(depth).alias("depth"), *(["parent"] if with_parent else [])))
        if frontier.isEmpty():
            break
        levels = shortened([*levels, frontier])
    return united(levels)


def reach_both(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node, parent, depth, forward: what reach() gives both ways (forward: whether by steps as they point) without a
    bound, with parents. edges: a table of distinct src_id, dst_id; starts: column id.

    Nodes at depth 1 are the edges. Those further on in a line (see lines()) come from places, so each pair is made once, by
    one join, whatever the line's length. Rounds are taken only from starts with a step to another node that has steps on.
    """
    numbered = lambda df, c, *n: df.select(F.col(c).alias("id"), *[F.lit(x).alias(k) for k, x in zip(("outs", "ins", "asked"), n, strict=True)])
    ends = united([numbered(edges, "src_id", 1, 0, 0), numbered(edges, "dst_id", 0, 1, 0), numbered(starts, "id", 0, 0, 1)])
    nodes = ends.groupBy("id").agg(F.sum("outs").alias("outs"), F.sum("ins").alias("ins"), F.max("asked").alias("asked"))
    nodes = materialized(nodes.where("outs + ins > 0 and (outs <= 1 and ins <= 1 or outs > 0 and ins > 0 or asked = 0)"))
    line = lines(edges, nodes.where("outs <= 1 and ins <= 1"))
    through = materialized(nodes.where("outs > 0 and ins > 0").select("id").join(line, "id", "left_anti"))
    asked = None if nodes.where("asked = 0").isEmpty() else materialized(starts.select(F.col("id").alias("a")).distinct())
    deeper = not through.isEmpty()
    found = [along_lines(line)]
    for way in ("forward", "backward"):
        steps = one_way(edges, way)
        first = steps if asked is None else steps.join(asked, "a", "left_semi")
        first = first.select(F.col("a").alias("start"), F.col("b").alias("node"), F.col("a").alias("parent"), F.lit(1).alias("depth"))
        if deeper:
            deep = materialized(first.join(through.withColumnRenamed("id", "node"), "node", "left_semi").select(F.col("start").alias("id")).distinct())
            near_by = steps.join(through.unionByName(deep).withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("a").alias("src_id"), F.col("b").alias("dst_id"))
            rounds = reach(near_by, deep, with_parent=True).select("start", "node", "parent", "depth")
            first = first.join(deep.withColumnRenamed("id", "start"), "start", "left_anti").unionByName(rounds)
        found.append(first.withColumn("forward", F.lit(way == "forward")))
    return united(found)


def lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """line, n, at, id, before, after, asked: the nodes of each line of n nodes, with their places, from 0 at the end without a step on.

    A line is a whole component of three nodes or more that have one step in and one step out at most, without a cycle; line
    is the id at its end. nodes: a table of all nodes with so few steps, with their numbers (outs, ins) and whether they are
    asked for. By pointer doubling: as many rounds as the longest line's length has bits.
    """
    ids = nodes.select("id").hint("shuffle_hash")  # so that edges aren't sorted
    links = edges.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    links = materialized(links.select(F.col("src_id").alias("id"), F.col("dst_id").alias("after")))
    at = nodes.join(links, "id", "left")
    at = materialized(at.select("id", F.coalesce("after", "id").alias("to"), F.col("after").isNotNull().cast("int").alias("at"), F.col("after").isNotNull().alias("open")))
    n, span = at.count(), 1
    while span <= 2 * n and not at.where("open").isEmpty():  # a round after all have come to their ends only cycles are left
        further = at.select(F.col("id").alias("to"), F.col("to").alias("then"), F.col("at").alias("more"))
        at = materialized(at.join(further, "to").select("id", F.col("then").alias("to"), (F.col("at") + F.col("more")).alias("at"), (F.col("more") > 0).alias("open")))
        span *= 2
    placed = materialized(at.where("not open").select("id", F.col("to").alias("line"), "at").join(nodes, "id"))
    # Of a line's n nodes all but one have a step in and all but one a step out; one more is a step from or to a node with several.
    whole = placed.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.sum("ins").alias("i"), F.sum("outs").alias("o")).where("n > 2 and i = n - 1 and o = n - 1")
    line = placed.join(whole.select("line", "n"), "line").join(links, "id", "left").join(links.select(F.col("after").alias("id"), F.col("id").alias("before")), "id", "left")
    return materialized(line.select("line", "n", "at", "id", "before", "after", "asked"))


#: Places of a line that one task pairs with all others of it.
TILE = 256


def along_lines(line: DataFrame) -> DataFrame:
    """start, node, parent, depth, forward: the nodes two steps or more from each node that is asked for, on its line. line: what lines() gives.

    Starts of a long line are dealt in tiles to several tasks. Rows here are few and short against those that they make, so
    the number of partitions is the session's and isn't lowered by their size.
    """
    parts = int(line.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = line.where("asked = 1").select("line", (F.col("at") / TILE).cast("int").alias("tile"), F.col("id").alias("start"), F.col("at").alias("x"))
    tiles = F.sequence(F.lit(0), ((F.col("n") - 1) / TILE).cast("int"))
    other = line.select("line", F.explode(tiles).alias("tile"), F.col("id").alias("node"), "before", "after", F.col("at").alias("y"))
    pairs = own.repartition(parts, "line", "tile").join(other.repartition(parts, "line", "tile"), ["line", "tile"]).where("abs(x - y) > 1")
    forward = F.col("y") < F.col("x")
    return pairs.select("start", "node", F.when(forward, F.col("before")).otherwise(F.col("after")).alias("parent"), F.abs(F.col("x") - F.col("y")).alias("depth"), forward.alias("forward"))


#: Steps that one round of closure() takes at most; each round is a table and a look at whether it is empty.
HOPS = 4


def closure(edges: DataFrame, starts: DataFrame, direction: str = "forward") -> DataFrame:
    """id: every node reached from any of the starts, these included. Rounds take 1, 2, 3, then HOPS steps."""
    return closure_of(materialized(turned(edges, direction)), starts)


def closure_of(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """What closure() gives, by steps (a, b; a table)."""
    levels = [materialized(starts.select("id").distinct())]
    frontier, hops = levels[0], 1
    while True:
        at, found = frontier, []
        for _ in range(hops):
            at = at.select(F.col("id").alias("a")).join(steps, "a").select(F.col("b").alias("id")).distinct()
            found.append(at)
        seen = united(levels)
        fresh = found[0] if len(found) == 1 else united(found).distinct()
        frontier, hops = materialized(fresh.join(seen, "id", "left_anti")), min(hops + 1, HOPS)
        if frontier.isEmpty():
            return seen
        levels = [materialized(seen), frontier] if len(levels) > 12 else [*levels, frontier]


def chained(steps: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """What lies 1, 2, 4, ... links on (a, b each), and the steps out of nodes with several ones (None: there are none).

    steps: a table of a, b, that may repeat. Those to nodes without steps out don't count. Of the rest, a node with one step
    out is a link of a chain.
    """
    inner = materialized(steps.join(steps.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
    degree = materialized(inner.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("most")))
    forks = degree.where("b <> most").select("a")
    return doubled(degree.where("b = most").select("a", "b")), None if forks.isEmpty() else materialized(inner.join(forks, "a", "left_semi"))


def doubled(jump: DataFrame) -> list[DataFrame]:
    """The links (a, b; a table), then what lies 2, 4, ... links on."""
    jumps, links = [], jump.count()
    while not jump.isEmpty() and 1 << len(jumps) <= links:  # beyond that many links only cycles go on
        jumps.append(jump)
        jump = materialized(jump.withColumnRenamed("b", "m").join(jump.select(F.col("a").alias("m"), "b"), "m").select("a", "b"))
    return jumps


def along(nodes: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """id: the nodes and all that lies on from them by links, of which `jumps` holds what doubled() gives."""
    for n, x in enumerate(jumps):
        nodes = nodes.unionByName(nodes.join(x.withColumnRenamed("a", "id"), "id").select(F.col("b").alias("id"))).distinct()
        nodes = materialized(nodes) if n % 3 == 2 else nodes
    return nodes


def closure_of_chains(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """What closure() gives forward, for graphs with long chains.

    Nodes without steps out are left for one last step. What lies 1, 2, 4, ... links of a chain on is found by doubling, so a
    chain is passed in as many joins as its length has bits, whatever hangs on its links. Rounds are only taken over nodes
    with several steps.
    """
    steps = materialized(one_way(edges, "forward"))
    jumps, forks = chained(steps)
    seen = materialized(along(starts.select("id").distinct(), jumps))
    fresh = seen
    while forks is not None:
        on = fresh.withColumnRenamed("id", "a").join(forks, "a").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        fresh = materialized(along(materialized(on), jumps).join(seen, "id", "left_anti"))
        if fresh.isEmpty():
            break
        seen = materialized(seen.unionByName(fresh))
    last = seen.withColumnRenamed("id", "a").join(steps, "a").select(F.col("b").alias("id"))
    return seen.unionByName(last).distinct()


def paths(edges: DataFrame, starts: DataFrame, most: int | None = None, ends: DataFrame | None = None) -> DataFrame:
    """start, node, path: the simple paths of 1 to `most` edges (None: of any length); with `ends` (column id) those that stop at the first end."""
    steps = materialized(edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")))
    frontier = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path"))
    out = [frontier.limit(0)]
    depth = 0
    while most is None or depth < most:
        depth += 1
        grown = frontier.withColumnRenamed("node", "a").join(steps, "a").where(~F.expr("array_contains(path, b)"))
        frontier = materialized(grown.select("start", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path")))
        if frontier.isEmpty():
            break
        level = frontier
        if ends is not None:
            stop = ends.select(F.col("id").alias("node")).distinct()
            level = frontier.join(stop, "node", "left_semi")
            frontier = frontier.join(stop, "node", "left_anti")
        out = shortened([*out, level])
    return united(out).select("start", "node", "path")


def successors(edges: DataFrame) -> DataFrame:
    """a, b: each node's first successor, the smallest id."""
    return edges.groupBy(F.col("src_id").alias("a")).agg(F.min("dst_id").alias("b"))


def united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out


def shortened(tables: list[DataFrame]) -> list[DataFrame]:
    """The tables, merged into one where they are many, so that the plan stays small."""
    return [materialized(united(tables))] if len(tables) > 12 else tables


def chains(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, chain, has_cycle: along each node's first successor to the end, or up to a node met before.

    By pointer doubling: as many rounds as the longest chain's length has bits. Starts that run into a cycle have no end
    to double to and are walked node by node.
    """
    jump = materialized(successors(edges))
    n = jump.count()
    jumps = []
    while not jump.isEmpty() and 1 << len(jumps) <= n:  # jumps[k] goes 2^k nodes on; beyond n nodes only cycles are left
        jumps.append(jump)
        jump = materialized(jump.withColumnRenamed("b", "m").join(jump.select(F.col("a").alias("m"), "b"), "m").select("a", "b"))
    first = materialized(starts.select(F.col("id").alias("start")))
    steps = jumps[0] if jumps else jump
    endless = materialized(first.distinct().join(jump.select(F.col("a").alias("start")), "start", "left_semi"))
    links = materialized(first.distinct().join(endless, "start", "left_anti").select("start", F.lit(0).cast("long").alias("i"), F.col("start").alias("node")))
    found = [links]  # each link is written once
    for k in reversed(range(len(jumps))):
        on = united(found).join(jumps[k].withColumnRenamed("a", "node"), "node").select("start", (F.col("i") + (1 << k)).alias("i"), F.col("b").alias("node"))
        found.append(materialized(on))
    straight = united(found).groupBy("start").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "node"))), lambda x: x.node).alias("chain")).select("start", "chain", F.lit(False).alias("has_cycle"))
    found = straight.unionByName(walked(steps, endless)).withColumnRenamed("start", "s")
    return first.join(found, F.col("start").eqNullSafe(F.col("s"))).select("start", "chain", "has_cycle")


def walked(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """start, chain, has_cycle: every walk by steps (a, b) from each start (column start), node by node, to its end or up to a node met before."""
    open_ = materialized(starts.select("start", F.array("start").alias("chain")))
    done = [open_.limit(0).withColumn("has_cycle", F.lit(False))]
    while not open_.isEmpty():
        grown = materialized(open_.join(steps, F.element_at("chain", -1) == F.col("a"), "left").withColumn("loops", F.col("b").isNotNull() & F.expr("array_contains(chain, b)")))
        done = shortened([*done, grown.where("b is null or loops").select("start", "chain", F.col("loops").alias("has_cycle"))])
        open_ = grown.where("b is not null and not loops").select("start", F.concat("chain", F.array("b")).alias("chain"))
    return united(done)


def all_chains(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, chain, has_cycle: every maximal path; one that would come back to itself ends there."""
    steps = materialized(edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")).distinct())
    return walked(steps, starts.select(F.col("id").alias("start"))).distinct()


def shortest_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """start, node, path: one shortest path for each pair, of equal ones the lexicographically first; a pair of one node has the path of it alone."""
    steps = materialized(turned(edges, "forward"))
    frontier = materialized(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path")).distinct())
    levels = [frontier]
    while not frontier.isEmpty():
        grown = frontier.withColumnRenamed("node", "a").join(steps, "a").select("start", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        seen = united([x.select("start", "node") for x in levels])
        frontier = materialized(grown.groupBy("start", "node").agg(F.min("path").alias("path")).join(seen, ["start", "node"], "left_anti"))
        levels = shortened([*levels, frontier])
    return united(levels).join(ends.select(F.col("id").alias("node")), "node", "left_semi").select("start", "node", "path")


def has_path(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, dst, found: whether each pair (src, dst) is joined by a path; a pair of one id always is, known or not."""
    asked = pairs.select("src", "dst").distinct()
    reached = reach(edges, asked.where("src <> dst").select(F.col("src").alias("id")).distinct()).select(F.col("start").alias("src"), F.col("node").alias("dst"), F.lit(True).alias("__f"))
    return asked.join(reached, ["src", "dst"], "left").select("src", "dst", F.coalesce("__f", F.col("src") == F.col("dst")).alias("found"))


def trimmed(steps: DataFrame) -> DataFrame:
    """Steps (a, b) between nodes that have steps in and out, round by round; no other can be on a cycle."""
    left = materialized(steps)
    while True:
        ends = left.select(F.col("a").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(left.select(F.col("b").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        inner = near(materialized(ends.groupBy("id").agg(F.max("o").alias("o"), F.max("i").alias("i")).where("o = 1 and i = 1").select("id")))
        kept = left.join(inner.withColumnRenamed("id", "a"), "a", "left_semi").join(inner.withColumnRenamed("id", "b"), "b", "left_semi")
        kept = materialized(kept.select("a", "b"))
        if kept.count() == left.count():
            return kept
        left = kept


def cycles(edges: DataFrame) -> DataFrame:
    """component, node: strongly connected components of two nodes or more; component is the smallest id.

    By colours: every node takes the largest id that reaches it, until nothing changes; what reaches a colour's own node
    within the colour is that node's component. Components found are taken out and the rest goes round again. Rounds
    carry one row a node, so no pairs of nodes are made.
    """
    return cycles_of(turned(edges, "forward"))


def cycles_of(steps: DataFrame) -> DataFrame:
    """What cycles() gives, of distinct steps (a, b)."""
    left = trimmed(steps.where("a <> b"))
    out = None
    while not left.isEmpty():
        colours = materialized(left.select(F.col("a").alias("id")).distinct().withColumn("c", F.col("id")))
        while True:
            sent = left.join(colours.select(F.col("id").alias("a"), "c"), "a").select(F.col("b").alias("id"), "c")
            grown = materialized(colours.select("id", "c", F.lit(1).alias("own")).unionByName(sent.withColumn("own", F.lit(0))).groupBy("id").agg(F.max("c").alias("c"), F.max(F.when(F.col("own") == 1, F.col("c"))).alias("old")))
            done = grown.where("c <> old").isEmpty()
            colours = grown.select("id", "c")
            if done:
                break
        inside = left.join(colours.select(F.col("id").alias("a"), F.col("c").alias("x")), "a").join(colours.select(F.col("id").alias("b"), F.col("c").alias("y")), "b").where("x = y").select(F.col("a").alias("src_id"), F.col("b").alias("dst_id"))
        found = materialized(closure(inside, colours.where("id = c").select("id"), "backward"))
        own = materialized(colours.join(found, "id", "left_semi"))
        sizes = own.groupBy("c").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1")
        members = own.join(sizes, "c").select("component", F.col("id").alias("node"))
        out = members if out is None else out.unionByName(members)
        gone = own.select("id")
        left = trimmed(left.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"))
    return out if out is not None else left.select(F.col("a").alias("component"), F.col("b").alias("node"))
