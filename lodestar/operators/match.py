"""Execution of patterns: one row for each complete binding of a chain, or one for each start of a star."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.traverse import one_way, reach
from lodestar.plans.pattern import NodePattern, Pattern, StepPattern, parse
from lodestar.schema import Graph

#: Labels of patterns; any other label matches nothing.
LABELS = ("Function", "Class", "Interface", "Variable", "Method", "Module", "Namespace", "Enum", "Property", "Field", "Parameter", "Constant")
KEYS = {"name": "name", "id": "id", "file": "file_path", "file_path": "file_path"}


def condition(node: NodePattern, labels: tuple[str, ...] | None = LABELS) -> Column:
    """What a symbol must fulfil. labels: the labels that there are, or None for every kind."""
    out = F.lit(True)
    if node.label is not None:
        out = out & (F.col("kind") == node.label if labels is None or node.label in labels else F.lit(False))
    for f in node.filters:
        c = F.col(KEYS[f.key]) if f.key in KEYS else None
        ops = {"equals": lambda c, v: c == v, "contains": lambda c, v: c.contains(v), "starts_with": lambda c, v: c.startswith(v), "ends_with": lambda c, v: c.endswith(v), "regex": lambda c, v: c.rlike(v)}
        out = out & (ops[f.op](c, f.value) if c is not None else F.lit(False))
    return out


def step_edges(g: Graph, step: StepPattern) -> DataFrame:
    return (g.edges if step.kinds is None else g.edges.where(F.col("kind").isin(*step.kinds))).select("src_id", "dst_id")


def match(g: Graph, pattern: str | Pattern, labels: tuple[str, ...] | None = LABELS) -> DataFrame:
    """One column for each node (its variable, or n0, n1, ...) with the id bound to it; distinct bindings.

    A step of exactly one edge is one join. A longer one binds what is reached in its range of edges, the start not
    counting as reached.
    """
    p = parse(pattern) if isinstance(pattern, str) else pattern
    names = [n.variable or f"n{i}" for i, n in enumerate(p.nodes)]
    ids = [g.symbols.where(condition(n, labels)).select("id") for n in p.nodes]
    out = ids[0].select(F.col("id").alias(names[0]))
    for i, step in enumerate(p.steps):
        last, name = names[i], names[i + 1]
        ends = ids[i + 1].select(F.col("id").alias("__b"))
        if (step.least, step.most) == (1, 1):
            # The ends are filtered before equal edges are made one, so only what can match is moved.
            hop = one_way(step_edges(g, step), step.direction).select(F.col("a").alias("__a"), F.col("b").alias("__b")).join(ends, "__b", "left_semi")
            hop = (hop if i else hop.join(out.select(F.col(last).alias("__a")), "__a", "left_semi")).select("__a", "__b").distinct()
        else:
            found = reach(step_edges(g, step), out.select(F.col(last).alias("id")), step.most, step.direction, with_start=True)
            hop = found.where(F.col("depth") >= step.least).select(F.col("start").alias("__a"), F.col("node").alias("__b")).join(ends, "__b", "left_semi")
        # The first step's edges start at nodes that fit already.
        joined = out.join(hop, F.col(last) == F.col("__a")).drop("__a") if i or (step.least, step.most) != (1, 1) else hop.withColumnRenamed("__a", last)
        out = joined.where(F.col(name) == F.col("__b")).drop("__b") if name in joined.columns else joined.withColumnRenamed("__b", name)
    return out


def match_star(g: Graph, pattern: str | Pattern) -> DataFrame:
    """start, bound: a start for which every relationship, each taken from the start, reaches something; bound holds
    for each relationship the sorted ids. The start counts as reached by a cycle."""
    p = parse(pattern) if isinstance(pattern, str) else pattern
    out = g.symbols.where(condition(p.nodes[0])).select(F.col("id").alias("start"))
    for i, step in enumerate(p.steps):
        ends = g.symbols.where(condition(p.nodes[i + 1])).select(F.col("id").alias("node"))
        found = reach(step_edges(g, step), out.select(F.col("start").alias("id")), step.most, "forward" if step.direction == "both" else step.direction)
        hits = found.where(F.col("depth") >= step.least).select("start", "node")
        if step.least == 0:
            hits = hits.unionByName(out.select("start", F.col("start").alias("node"))).distinct()
        sets = hits.join(ends, "node", "left_semi").groupBy("start").agg(F.array_join(F.sort_array(F.collect_set("node")), ",").alias(f"bound{i}"))
        out = out.join(sets, "start")
    return out
