"""Analyses of the whole graph: hierarchies, dead code, complexity, public interfaces, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators import layers, traverse
from lodestar.operators.filters import ENTRY_NAMES, TYPE_KINDS, is_entry
from lodestar.plans.tables import NEAR_ROWS, materialized, near
from lodestar.schema import Graph

DIRECTIONS = {"incoming": "incoming", "callers": "incoming", "outgoing": "outgoing", "callees": "outgoing", "full": "full", "both": "full"}
#: Weights of the importance score.
KIND_WEIGHTS = {"Module": 2.0, "Package": 2.0, "Class": 1.8, "Interface": 1.8, "Trait": 1.8, "Function": 1.5, "Method": 1.5, "Struct": 1.4, "Enum": 1.4, "TypeAlias": 1.2, "Variable": 1.0, "Constant": 1.0}
VISIBILITY_WEIGHTS = {"Public": 1.0, "Protected": 0.5, "Internal": 0.3, "Private": 0.1}


def calls(g: Graph, roots: DataFrame, direction: str = "outgoing", most: int = 5) -> DataFrame:
    """root, node, parent, depth: who calls (or is called), at the least depth, by the smallest parent of the depth before."""
    way = DIRECTIONS[direction]
    if way == "full":
        return full_calls(g, roots, most).drop("direction")
    turn = "forward" if way == "outgoing" else "backward"
    found = traverse.reach(g.of_kind("Reference"), roots, most, turn, with_parent=True)
    return found.select(F.col("start").alias("root"), "node", "parent", "depth")


def full_calls(g: Graph, roots: DataFrame, most: int = 5) -> DataFrame:
    """root, node, parent, depth, direction (incoming or outgoing): callers and callees of each root, at most `most` calls away
    (traverse.UNBOUNDED: all)."""
    if most >= traverse.UNBOUNDED:
        e = materialized(g.of_kind("Reference").where("src_id is not null and dst_id is not null").distinct())
        found = traverse.reach_both(e, roots)
        return found.select(F.col("start").alias("root"), "node", "parent", "depth", F.when(F.col("forward"), "outgoing").otherwise("incoming").alias("direction"))
    e = materialized(g.of_kind("Reference"))
    found = lambda turn: traverse.reach(e, roots, most, turn, with_parent=True, kept=True)
    rows = [found(turn).select(F.col("start").alias("root"), "node", "parent", "depth", F.lit(x).alias("direction")) for x, turn in (("incoming", "backward"), ("outgoing", "forward"))]
    return rows[0].unionByName(rows[1])


def call_paths(g: Graph, pairs: DataFrame, most: int = 5, grown: list[int] | None = None) -> DataFrame:
    """src, dst, path: the simple paths of Reference edges, at most `most` long, that end where they first meet dst; a
    pair of one id has the path of it alone. pairs: src, dst.

    What is at most `most` edges before each dst is found first, with its distance. Paths from src then grow by edges only
    after which the distance still fits, so every row of a round can end at its dst but for nodes met twice. `grown`
    takes the number of rows of each round.
    """
    same = pairs.where("src = dst").select("src", "dst", F.array("src").alias("path")).distinct()
    far = materialized(pairs.where("src <> dst").select("src", "dst").distinct())
    e = materialized(g.of_kind("Reference"))
    steps = e.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"))  # may repeat; what grows by them may not
    ways = materialized(traverse.reach(e, far.select(F.col("dst").alias("id")).distinct(), most, "backward", with_start=True, kept=True).select(F.col("start").alias("dst"), F.col("node").alias("b"), "depth"))
    open_ = far.join(ways.where("depth > 0").select("dst", F.col("b").alias("src")), ["dst", "src"], "left_semi").select("src", "dst", F.col("src").alias("a"), F.array("src").alias("path"))
    done = [open_.select("src", "dst", "path").limit(0)]
    for n in range(1, most + 1):
        on = open_.join(steps, "a").where(~F.expr("array_contains(path, b)")).join(ways.where(F.col("depth") <= most - n).select("dst", "b"), ["dst", "b"], "left_semi")
        on = materialized(on.select("src", "dst", F.col("b").alias("a"), F.concat("path", F.array("b")).alias("path")).distinct())
        if grown is not None:
            grown.append(on.count())
        done = traverse.shortened([*done, on.where("a = dst").select("src", "dst", "path")])
        open_ = on.where("a <> dst")
        if open_.isEmpty():
            break
    return traverse.united(done).unionByName(same)


def dead(g: Graph, entries: DataFrame | None = None) -> DataFrame:
    """id: symbols that no entry point reaches by Reference or Definition."""
    start = g.symbols.where(is_entry()).select("id") if entries is None else entries
    return g.symbols.select("id").join(traverse.closure_of_chains(g.of_kind("Reference", "Definition"), start), "id", "left_anti")


def fan(g: Graph) -> DataFrame:
    """id, fan_in, fan_out of every symbol, by Reference edges."""
    e = g.of_kind("Reference")
    into, out = (e.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias(n)) for c, n in (("dst_id", "fan_in"), ("src_id", "fan_out")))
    return g.symbols.select("id").join(into, "id", "left").join(out, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def coupling(g: Graph) -> DataFrame:
    """id, coupling: d / (d + 1) for d distinct targets in other files by Import or Reference."""
    files = g.symbols.select("id", "file_path")
    e = g.of_kind("Import", "Reference").distinct().join(files.select(F.col("id").alias("src_id"), F.col("file_path").alias("f")), "src_id").join(files.select(F.col("id").alias("dst_id"), F.col("file_path").alias("t")), "dst_id").where("f <> t")
    d = e.groupBy(F.col("src_id").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    return g.symbols.select("id").join(d, "id", "left").select("id", (F.coalesce("d", F.lit(0)) / (F.coalesce("d", F.lit(0)) + 1)).alias("coupling"))


def cyclomatic(g: Graph, roots: DataFrame) -> DataFrame:
    """id, cyclomatic: max(0, E - N) + 2 over what each root contains."""
    # What inner nodes (those that something contains) reach is found once; a root that nothing contains is joined to it.
    e = materialized(g.of_kind("Contains").repartition("src_id").groupBy("src_id", "dst_id").agg(F.count(F.lit(1)).alias("k")))
    outs = e.groupBy(F.col("src_id").alias("node")).agg(F.sum("k").alias("k"))
    asked = roots.select("id").distinct()
    own = materialized(asked.join(outs.withColumnRenamed("node", "id"), "id"))
    inner = e.select(F.col("dst_id").alias("id")).distinct()
    lower = near(materialized(inner.join(outs.withColumnRenamed("node", "id"), "id").select("id")))
    steps = e.join(lower.withColumnRenamed("id", "src_id"), "src_id", "left_semi")
    reached = traverse.reach(steps, inner, with_start=True).select("start", "node").join(outs, "node", "left").select(F.col("start").alias("dst_id"), "node", F.coalesce("k", F.lit(0)).alias("k"))
    reached = near(materialized(reached))
    nodes = e.join(own.select(F.col("id").alias("src_id")), "src_id", "left_semi").join(reached.withColumnRenamed("k", "n_k"), "dst_id").where("node <> src_id")
    sums = nodes.groupBy("src_id", "node").agg(F.max("n_k").alias("k")).groupBy(F.col("src_id").alias("id")).agg(F.sum(F.col("k") - 1).alias("below"))
    more = own.join(sums, "id").select("id", (F.col("k") - 1 + F.col("below")).alias("more"))
    return asked.join(more, "id", "left").select("id", (F.greatest(F.lit(0).cast("long"), F.coalesce("more", F.lit(0).cast("long"))) + 2).alias("cyclomatic"))


def nesting(g: Graph, roots: DataFrame) -> DataFrame:
    """id, depth: the longest simple path by Contains. By layers; only from roots that reach a cycle are paths listed."""
    e = g.of_kind("Contains")
    return _nesting(e, roots.select("id").distinct(), *layers.layered_below(e, roots))


def _nesting(e: DataFrame, asked: DataFrame, steps: DataFrame, layered: DataFrame) -> DataFrame:
    found = materialized(layered.join(asked, "id", "left_semi").select("id", F.col("layer").alias("depth")))
    rest = materialized(asked.join(found, "id", "left_anti"))
    if rest.isEmpty():
        return found
    listed = traverse.paths(e, rest).groupBy(F.col("start").alias("id")).agg(F.max(F.size("path") - 1).cast("long").alias("depth"))
    return found.unionByName(rest.join(listed, "id", "left").select("id", F.coalesce("depth", F.lit(0)).cast("long").alias("depth")))


def cognitive(g: Graph, roots: DataFrame) -> DataFrame:
    """id, cognitive: in the order of a walk down Contains by id, a node with b > 1 outgoing Reference or Definition
    edges adds (b - 1) * (1 + the functions and methods met before it); the largest long at most.

    A node that is contained twice is met twice. Walks are not listed but counted by layers; only those from roots that
    reach a cycle are listed, each node once on its way. Roots that are no symbols have 0.
    """
    e = g.of_kind("Contains")
    return _cognitive(g, roots.select("id").distinct(), *layers.layered_below(e, roots))


def _cognitive(g: Graph, asked: DataFrame, steps: DataFrame, layered: DataFrame) -> DataFrame:
    branches = g.of_kind("Reference", "Definition").groupBy(F.col("src_id").alias("id")).agg(F.count(F.lit(1)).alias("b"))
    nodes = g.symbols.select("id", F.col("kind").isin("Function", "Method").cast("int").alias("f")).join(branches, "id", "left").select("id", "f", F.greatest(F.coalesce("b", F.lit(0)) - 1, F.lit(0)).alias("w"))
    found = materialized(layers.walks(steps, layered, nodes).join(asked, "id", "left_semi").select("id", F.col("cost").cast("long").alias("cognitive")))
    rest = materialized(asked.join(found, "id", "left_anti"))
    return found if rest.isEmpty() else found.unionByName(_listed_cognitive(g.of_kind("Contains").distinct(), nodes, rest))


def _listed_cognitive(e: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    walk = traverse.paths(e, roots).unionByName(roots.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path")))
    rows = walk.join(nodes.withColumnRenamed("id", "node"), "node")
    before = F.coalesce(F.sum("f").over(Window.partitionBy("start").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("c", F.col("w") * (before + 1)).groupBy(F.col("start").alias("id")).agg(F.sum("c").cast("long").alias("cognitive"))


def metrics(g: Graph) -> DataFrame:
    """id, cyclomatic, cognitive, depth, fan_in, fan_out, coupling of every function and method."""
    roots = g.symbols.where(F.col("kind").isin("Function", "Method")).select("id")
    g = Graph(g.symbols, materialized(g.edges))
    e, asked, out = g.of_kind("Contains"), roots.distinct(), roots
    below = layers.layered_below(e, roots)
    for m in (cyclomatic(g, roots), _cognitive(g, asked, *below), _nesting(e, asked, *below), fan(g), coupling(g)):
        out = out.join(m, "id", "left")
    return out.select("id", F.coalesce("cyclomatic", F.lit(1)).alias("cyclomatic"), F.coalesce("cognitive", F.lit(0)).alias("cognitive"), "depth", "fan_in", "fan_out", "coupling")


def rank_by_complexity(g: Graph, most: int) -> DataFrame:
    roots = g.symbols.where(F.col("kind").isin("Function", "Method")).select("id")
    return cyclomatic(g, roots).orderBy(F.desc("cyclomatic"), "id").limit(most)


def type_hierarchy(g: Graph, roots: DataFrame) -> DataFrame:
    """root_id, bucket (parent, child, sibling), symbol_id: by Definition among symbols of a type kind."""
    # Only symbols at these edges count, so all the others of a type kind are dropped where they are read, once.
    e = materialized(g.of_kind("Definition").distinct())
    ends = e.select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct()
    ends = F.broadcast(ends) if e.count() <= NEAR_ROWS // 2 else ends
    types = near(materialized(g.symbols.where(F.col("kind").isin(*TYPE_KINDS)).select("id").join(ends, "id", "left_semi")))
    e = materialized(e.join(types.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(types.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").select("src_id", "dst_id"))
    starts = materialized(roots.select("id").join(types, "id", "left_semi").distinct())
    up = traverse.reach(e, starts, kept=True)
    # What is below roots and below their parents is found together: parents are often roots too.
    below = traverse.reach(e, starts.unionByName(up.select(F.col("node").alias("id"))), direction="backward", kept=True)
    down = below.join(starts.withColumnRenamed("id", "start"), "start", "left_semi")
    below = below.select(F.col("start").alias("p"), F.col("node").alias("s"))
    siblings = up.select("start", F.col("node").alias("p")).join(below, "p").where("s <> start").select("start", F.col("s").alias("node")).distinct()
    rows = [(up, "parent"), (down, "child"), (siblings, "sibling")]
    out = None
    for df, bucket in rows:
        x = df.select(F.col("start").alias("root_id"), F.lit(bucket).alias("bucket"), F.col("node").alias("symbol_id"))
        out = x if out is None else out.unionByName(x)
    return out


def type_references(g: Graph, roots: DataFrame, most: int) -> DataFrame:
    """start, node, depth: what refers to each root by Reference or Definition, up to `most` + 1 edges away."""
    return traverse.reach(g.of_kind("Reference", "Definition"), roots, most + 1, "backward").where("start <> node")


def type_relations(g: Graph, roots: DataFrame, most: int = 1) -> DataFrame:
    """root_id, bucket, n: what points at each root or at what reached it within `most` edges, by kind."""
    return related_symbols(g, roots, most).groupBy("root_id", "bucket").agg(F.count(F.lit(1)).alias("n"))


def related_symbols(g: Graph, roots: DataFrame, most: int = 1) -> DataFrame:
    """root_id, bucket, symbol_id: a row for each edge that points at a root or at what reached it within `most` edges."""
    types = g.symbols.where(F.col("kind").isin(*TYPE_KINDS)).select("id")
    seen = traverse.reach(g.edges.select("src_id", "dst_id"), roots.join(types, "id", "left_semi"), max(most - 1, 0), "backward", with_start=True)
    users = seen.select("start", F.col("node").alias("dst_id")).join(g.edges, "dst_id").join(g.symbols.select(F.col("id").alias("src_id"), F.col("kind").alias("k")), "src_id")
    bucket = F.when(F.col("k").isin("Variable", "Parameter"), "users").when(F.col("k").isin("Class", "Interface"), F.when(F.col("kind") == "Definition", "extensions").otherwise("implementations")).when(F.col("k") == "Method", "methods").when(F.col("k").isin("Property", "Field"), "members")
    return users.withColumn("bucket", bucket).where("bucket is not null").select(F.col("start").alias("root_id"), "bucket", F.col("src_id").alias("symbol_id"))


def relation_groups(g: Graph) -> DataFrame:
    """id, bucket, n: edges of each symbol by direction and kind, and its incoming references by the source's kind."""
    e = g.edges.where(F.col("kind").isin("Definition", "Reference"))
    kinds = g.symbols.select(F.col("id").alias("src_id"), F.col("kind").alias("k"))
    rows = e.select(F.col("dst_id").alias("id"), F.concat(F.lit("in_"), F.lower("kind")).alias("bucket"))
    rows = rows.unionByName(e.select(F.col("src_id").alias("id"), F.concat(F.lit("out_"), F.lower("kind")).alias("bucket")))
    rows = rows.unionByName(e.where("kind = 'Reference'").join(kinds, "src_id").select(F.col("dst_id").alias("id"), F.concat(F.lit("referenced_by_"), F.lower("k")).alias("bucket")))
    return rows.groupBy("id", "bucket").agg(F.count(F.lit(1)).alias("n"))


def importance(visibility: Column, exported: Column, refs: Column) -> Column:
    weights = lambda table, c, rest: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], F.lit(rest))
    return (weights(VISIBILITY_WEIGHTS, visibility, 0.1) + F.when(exported, 2.0).otherwise(0.0) + F.log1p(refs)) * weights(KIND_WEIGHTS, F.col("kind"), 0.8)


def public_api(g: Graph, visibility: Column) -> DataFrame:
    """id, name, visibility, is_exported, reference_count, importance_score of what is public or exported; ranked_api()
    puts them in order."""
    refs = g.of_kind("Reference").groupBy(F.col("dst_id").alias("id")).agg(F.count(F.lit(1)).alias("r"))
    exports = g.of_kind("Export").select(F.col("src_id").alias("id")).distinct().withColumn("x", F.lit(True))
    rows = g.symbols.join(refs, "id", "left").join(exports, "id", "left").withColumn("visibility", visibility).withColumn("is_exported", F.coalesce("x", F.lit(False))).withColumn("reference_count", F.coalesce("r", F.lit(0)))
    return rows.where((F.col("visibility") == "Public") | F.col("is_exported")).select("id", "name", "visibility", "is_exported", "reference_count", F.round(importance(F.col("visibility"), F.col("is_exported"), F.col("reference_count")), 4).alias("importance_score"))


def ranked_api(api: DataFrame, most: int | None = None) -> DataFrame:
    """The most important first, then by id."""
    out = api.orderBy(F.desc("importance_score"), "id")
    return out if most is None else out.limit(most)


def entry_points(g: Graph) -> DataFrame:
    """id: by name, or exported functions that nothing refers to."""
    named = g.symbols.where(F.col("name").isin(*ENTRY_NAMES)).select("id")
    exported = g.of_kind("Export").select(F.col("src_id").alias("id"))
    free = g.symbols.where("kind = 'Function'").select("id").join(exported, "id", "left_semi").join(g.of_kind("Reference").select(F.col("dst_id").alias("id")), "id", "left_anti")
    return named.unionByName(free).distinct()


def counts(symbols: DataFrame, by: str, most: int | None = 10) -> DataFrame:
    out = symbols.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by)
    return out if most is None else out.limit(most)


def totals(symbols: DataFrame) -> DataFrame:
    return symbols.agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("file_path").alias("files"))


def crawl(file_edges: DataFrame, starts: DataFrame, most_depth: int = 3, most_files: int = 100) -> DataFrame:
    """file, depth: files reached from the starts (column id) by dependencies, nearest first, the first `most_files` by path."""
    found = traverse.reach(file_edges.select(F.col("src_file").alias("src_id"), F.col("dst_file").alias("dst_id")), starts, most_depth, with_start=True)
    return found.groupBy(F.col("node").alias("file")).agg(F.min("depth").alias("depth")).orderBy("depth", "file").limit(most_files)
