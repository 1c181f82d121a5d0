"""Operators over small hand-built graphs with known results."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import analytics, filters, lookup, match, navigate, traverse
from lodestar.plans.pattern import PatternError, PropertyFilter, parse
from lodestar.schema import EDGES, SYMBOLS, Graph


def build(spark, nodes, edges):
    """nodes: id -> kind or (kind, name, file, detail); edges: (src, kind, dst)."""
    rows = []
    for i, (ident, v) in enumerate(nodes.items()):
        kind, name, path, detail = v if isinstance(v, tuple) else (v, ident, "src/a.rs", None)
        rows.append((ident, kind, name, path, i * 10, 0, i * 10 + 5, 20, None, detail))
    return Graph(spark.createDataFrame(rows, SYMBOLS), spark.createDataFrame([(a, b, k) for a, k, b in edges], EDGES))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def logger(spark):
    nodes = {"ILogger": "Interface", "Console": "Class", "File": "Class", "log": "Function", "logger": "Variable", "config": "Variable"}
    return build(spark, nodes, [("Console", "Definition", "ILogger"), ("File", "Definition", "ILogger"), ("logger", "Reference", "Console"), ("log", "Reference", "logger"), ("config", "Reference", "File")])


@pytest.fixture(scope="module")
def ring(spark):
    return build(spark, {x: "Class" for x in "abcde"}, [("a", "Reference", "b"), ("b", "Reference", "c"), ("c", "Reference", "a"), ("c", "Reference", "d"), ("e", "Reference", "e")])


def one(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_parser():
    p = parse("(a:Class {name: 'x', file ^= 'src'})-[r:Reference|Import*1..3]->(b)<-[:Contains]-(:Enum)--()<-[*2]->(c)")
    assert [n.label for n in p.nodes] == ["Class", None, "Enum", None, None] and p.nodes[0].filters == [PropertyFilter("name", "equals", "x"), PropertyFilter("file", "starts_with", "src")]
    assert [(s.kinds, s.least, s.most, s.direction) for s in p.steps] == [(("Reference", "Import"), 1, 3, "forward"), (("Contains",), 1, 1, "backward"), (None, 1, 1, "forward"), (None, 2, 2, "both")]
    assert [(s.least, s.most > 1000) for t in ("*", "*2..", "*..4") for s in parse(f"(a)-[{t}]->(b)").steps] == [(1, True), (2, True), (1, False)]
    assert parse("(a)-[:Nonsense]->(b)").steps[0].kinds is None
    for bad in ("", "a", "(a", "(a)-(b", "(a)-[:X->(b)", "(a)-->", "(a)x(b)", "(a)-[*3..1]->(b)", "(a {b})"):
        with pytest.raises(PatternError):
            parse(bad)


def test_matches(logger):
    assert rows(match.match(logger, "(impl:Class)-[:Definition]->(i:Interface)")) == [("Console", "ILogger"), ("File", "ILogger")]
    assert match.match(logger, "(v:Variable)-[:Reference]->(c:Class)").count() == 2
    assert match.match(logger, "(n)-[]->(i:Interface)").count() == 2
    assert rows(match.match(logger, "(f:Function)-[:Reference*1..2]->(c:Class)")) == [("log", "Console")]
    assert rows(match.match(logger, "(i:Interface)<-[:Definition]-(c)<-[:Reference]-(v)")) == [("ILogger", "Console", "logger"), ("ILogger", "File", "config")]
    assert match.match(logger, "(s:Struct)-->(x)").count() == 0
    assert rows(match.match(logger, "(f:Function)-[*0..1]->(x)")) == [("log", "log"), ("log", "logger")]
    assert rows(match.match(logger, "(x {name =~ '^l.*r$'})-->(y)")) == [("logger", "Console")]


def test_cycles_in_matches(ring):
    assert rows(match.match(ring, "(x:Class {name: 'a'})-[:Reference*]->(y)")) == [("a", "b"), ("a", "c"), ("a", "d")]
    assert rows(match.match(ring, "(x {name: 'a'})-[:Reference]->(y)-[:Reference]->(z)-[:Reference]->(x)")) == [("a", "b", "c")]
    assert rows(match.match_star(ring, "(x:Class)-[:Reference*3]->(y:Class)")) == [("a", "a,d"), ("b", "b"), ("c", "c")]


def test_navigation(spark, logger):
    assert rows(navigate.references(logger)) == [("Console", "logger"), ("File", "config"), ("logger", "log")]
    assert rows(navigate.first_definition(logger)) == [("ILogger", "Console")]
    assert rows(navigate.implementations(logger)) == [] == rows(navigate.overrides(logger))
    spots = spark.createDataFrame([("src/a.rs", 0, 0), ("src/a.rs", 45, 20), ("src/a.rs", 45, 21), ("src/a.rs", 8, 0), ("x", 0, 0)], "file_path string, line int, char int")
    assert rows(navigate.at_positions(logger.symbols, spots)) == [("src/a.rs", 0, 0, "ILogger"), ("src/a.rs", 45, 20, "logger")]
    assert rows(navigate.definition_at(logger, spots)) == [("src/a.rs", 0, 0, "ILogger"), ("src/a.rs", 45, 20, "Console")]
    places = spark.createDataFrame([("/home/src/a.rs", 43, 2), ("a.rs", 1, 1), ("b.rs", 1, 1), ("xa.rs", 1, 1), ("xsrc/a.rs", 1, 1)], "path string, line int, char int")
    assert rows(navigate.at_location(logger.symbols, places)) == [("/home/src/a.rs", 43, 2, "logger"), ("a.rs", 1, 1, "ILogger"), ("xsrc/a.rs", 1, 1, "ILogger")]
    assert navigate.parse_location("a/b.rs:3:9") == ("a/b.rs", 3, 9) and navigate.parse_location("a.rs") == ("a.rs", 1, 1)
    refs = spark.createDataFrame([("src/a.rs", 31, "Console"), ("src/a.rs", 41, "logger"), ("src/a.rs", 999, "x")], "file_path string, line int, target string")
    assert rows(navigate.reference_edges(logger.symbols, refs)) == [("log", "Console", "Reference")]


def test_lookups(spark, logger):
    far = Graph(logger.symbols.withColumn("file_path", F.when(F.col("id") == "config", "src/b.rs").otherwise(F.col("file_path"))), logger.edges.unionByName(spark.createDataFrame([("File", "Console", "Override"), ("log", "File", "Reference")], EDGES)))
    assert rows(lookup.symbol(far.symbols, "File").select("id")) == [("File",)] and [r["id"] for r in lookup.in_file(far.symbols, "src/a.rs").collect()] == ["ILogger", "Console", "File", "log", "logger"]
    assert rows(lookup.references_with(far, one(spark, "File", "Console"), "a.rs")) == [("Console", "logger", "src/a.rs"), ("File", "log", "src/a.rs")]
    assert rows(lookup.references_with(far, one(spark, "File"), limit=1)) == [("File", "log", "src/a.rs")]
    assert rows(lookup.references_by_file(far)) == [("File", "src/b.rs", 1)] and rows(navigate.overrides(far)) == [("Console", "File")]
    places = spark.createDataFrame([("log", "src/b.rs", 52), ("log", "src/a.rs", 2), ("config", "src/a.rs", 2)], "id string, file_path string, line int")
    assert rows(lookup.cross_file_references(far.symbols, places)) == [("log", "config", "Reference")]
    at = spark.createDataFrame([("a.rs", 1, 1)], "path string, line int, char int")
    assert [r["definition"] for r in lookup.definition_of(far, at).collect()] == ["Console"]
    assert rows(traverse.has_path(far.of_kind("Reference"), spark.createDataFrame([("log", "Console"), ("Console", "log"), ("zz", "zz")], "src string, dst string"))) == [("Console", "log", False), ("log", "Console", True), ("zz", "zz", True)]


def test_holders_of_long_symbols(spark):
    rows_of = [("file", 0, 100_000), ("one", 70, 70), ("two", 60, 130)]
    symbols = spark.createDataFrame([(i, "Class", i, "f", a, 0, b, 9, None, None) for i, a, b in rows_of], SYMBOLS)
    points = spark.createDataFrame([("f", n) for n in (0, 64, 70, 128, 131, 100_000, 100_001)], "file_path string, line int")
    held = rows(navigate.held(symbols, points).select("line", "id"))
    assert held == sorted((n, i) for n in (0, 64, 70, 128, 131, 100_000) for i, a, b in rows_of if a <= n <= b)


def test_build_drops_unknown_ends_and_repeated_ids(spark, logger):
    more = spark.createDataFrame([("log", "nowhere", "Reference"), ("gone", "log", "Import")], EDGES)
    g = Graph.build(logger.symbols.unionByName(logger.symbols.withColumn("start_line", F.lit(900))), logger.edges.unionByName(more))
    assert g.symbols.count() == 6 and g.edges.count() == 5 and g.symbols.where("start_line = 900").count() == 0
    left = g.remove_symbols(one(spark, "ILogger"))
    assert left.symbols.count() == 5 and left.edges.count() == 3


def test_chains(spark):
    line = build(spark, {x: "Class" for x in "abcd"}, [("a", "Definition", "b"), ("a", "Definition", "c"), ("b", "Definition", "d"), ("c", "Definition", "d")])
    e = line.of_kind("Definition")
    assert rows(traverse.all_chains(e, one(spark, "a"))) == [("a", ["a", "b", "d"], False), ("a", ["a", "c", "d"], False)]
    assert rows(traverse.chains(e, one(spark, "a", "d"))) == [("a", ["a", "b", "d"], False), ("d", ["d"], False)]
    assert rows(traverse.shortest_paths(e.unionByName(spark.createDataFrame([("a", "d")], "src_id string, dst_id string")), one(spark, "a"), one(spark, "d", "a"))) == [("a", "a", ["a"]), ("a", "d", ["a", "d"])]
    loop = build(spark, {x: "Class" for x in "abc"}, [("a", "Definition", "b"), ("b", "Definition", "c"), ("c", "Definition", "a")])
    assert rows(traverse.chains(loop.of_kind("Definition"), one(spark, "a"))) == [("a", ["a", "b", "c"], True)] == rows(traverse.all_chains(loop.of_kind("Definition"), one(spark, "a")))


def test_long_chains_end(spark):
    n = 1300
    line = [(f"n{i:04}", f"n{i + 1:04}") for i in range(n)]
    tail = [("t0", "t1"), ("t1", "c0"), ("c0", "c1"), ("c1", "c2"), ("c2", "c0")]
    e = spark.createDataFrame(line + tail, "src_id string, dst_id string")
    names = [a for a, _ in line] + [line[-1][1]]
    found = {r["start"]: r for r in traverse.chains(e, one(spark, "n0000", "n0007", names[-1], "t0", "c1", "x")).collect()}
    assert all(found[names[i]]["chain"] == names[i:] and not found[names[i]]["has_cycle"] for i in (0, 7, n))
    assert (found["t0"]["chain"], found["c1"]["chain"], found["x"]["chain"]) == (["t0", "t1", "c0", "c1", "c2"], ["c1", "c2", "c0"], ["x"])
    assert found["t0"]["has_cycle"] and found["c1"]["has_cycle"] and not found["x"]["has_cycle"] and len(found) == 6


def test_deep_nesting(spark):
    g = build(spark, {f"n{i:02}": "Function" for i in range(56)}, [(f"n{i:02}", "Contains", f"n{i + 1:02}") for i in range(55)])
    assert rows(analytics.nesting(g, one(spark, "n00"))) == [("n00", 55)]


def test_paths_and_cycles(spark, ring):
    e = ring.of_kind("Reference")
    assert rows(traverse.reach(e, one(spark, "a"))) == [("a", "a", 3), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]
    assert rows(traverse.reach(e, one(spark, "d"), direction="backward", most=2)) == [("d", "b", 2), ("d", "c", 1)]
    assert rows(traverse.paths(e, one(spark, "a"), 5, one(spark, "d"))) == [("a", "d", ["a", "b", "c", "d"])]
    assert rows(traverse.cycles(e)) == [("a", "a"), ("a", "b"), ("a", "c")]
    assert rows(traverse.closure(e, one(spark, "d", "e"))) == [("d",), ("e",)]


def test_calls(spark):
    g = build(spark, {x: "Function" for x in ("main", "calculate", "add")}, [("main", "Reference", "calculate"), ("calculate", "Reference", "add")])
    assert rows(analytics.calls(g, one(spark, "main"), "callees", 2)) == [("main", "add", "calculate", 2), ("main", "calculate", "main", 1)]
    assert rows(analytics.calls(g, one(spark, "add"), "callers", 2)) == [("add", "calculate", "add", 1), ("add", "main", "calculate", 2)]
    assert analytics.calls(g, one(spark, "calculate"), "both").count() == 2
    assert rows(analytics.dead(g)) == [] and rows(analytics.dead(g, one(spark, "calculate"))) == [("main",)]


def test_complexity(spark):
    g = build(spark, {"f": "Function", "g": "Method", "x": "Variable", "y": "Variable", "z": "Class"}, [("f", "Contains", "g"), ("g", "Contains", "x"), ("g", "Reference", "y"), ("g", "Reference", "z"), ("x", "Reference", "y"), ("x", "Reference", "z"), ("x", "Definition", "z")])
    assert rows(analytics.metrics(g)) == [("f", 2, 8, 2, 0, 0, 0.0), ("g", 2, 5, 1, 0, 2, 0.0)]
    assert rows(analytics.cognitive(g, one(spark, "f", "g", "y"))) == [("f", 8), ("g", 5), ("y", 0)]
    assert rows(analytics.cyclomatic(g, one(spark, "f"))) == [("f", 2)] and rows(analytics.nesting(g, one(spark, "f", "x"))) == [("f", 2), ("x", 0)]
    assert rows(analytics.fan(g).where("id = 'z'")) == [("z", 2, 0)]


def test_types(spark):
    g = build(spark, {"Base": "Class", "User": "Class", "Admin": "Class", "I": "Interface", "v": "Variable", "save": "Method", "Other": "Class"}, [("Base", "Definition", "I"), ("User", "Definition", "Base"), ("Admin", "Definition", "User"), ("Other", "Definition", "Base"), ("v", "Reference", "User"), ("save", "Reference", "User")])
    assert rows(analytics.type_hierarchy(g, one(spark, "User", "v"))) == sorted([("User", "parent", "Base"), ("User", "parent", "I"), ("User", "child", "Admin"), ("User", "sibling", "Admin"), ("User", "sibling", "Base"), ("User", "sibling", "Other")])
    assert rows(analytics.type_relations(g, one(spark, "User", "v"))) == [("User", "extensions", 1), ("User", "methods", 1), ("User", "users", 1)]
    assert rows(analytics.type_references(g, one(spark, "Base"), 1).where("depth = 1")) == [("Base", "Other", 1), ("Base", "User", 1)]
    assert rows(analytics.relation_groups(g).where("id = 'User'")) == [("User", "in_definition", 1), ("User", "in_reference", 2), ("User", "out_definition", 1), ("User", "referenced_by_method", 1), ("User", "referenced_by_variable", 1)]


def test_api_and_filters(spark):
    nodes = {"pub": ("Function", "run", "a.rs", "pub fn run(x: Vec<T>) -> Result"), "priv": ("Function", "_hid", "a.rs", "fn _hid()"), "mod": ("Module", "m", "b.rs", "pub mod"), "s": ("Struct", "S", "b.rs", "struct S: Show"), "c": ("Class", "C", "b.rs", None), "d": ("Class", "Showy", "b.rs", None), "fd": ("Field", "n", "b.rs", "std::String")}
    g = build(spark, nodes, [("mod", "Export", "pub")] + [("c", "Reference", "pub")] * 5 + [("c", "Implementation", "d"), ("d", "Contains", "fd")])
    from lodestar.functions.source import visibility

    api = {r["id"]: r for r in analytics.public_api(g, visibility("rust", F.col("name"), F.col("detail"))).collect()}
    assert set(api) == {"pub", "mod"} and api["pub"]["reference_count"] == 5 and api["pub"]["importance_score"] == pytest.approx((1 + 1.791759) * 1.5, abs=1e-4) and api["mod"]["importance_score"] == 6.0
    assert rows(analytics.entry_points(g)) == [("pub",)]
    got = lambda kind, wanted: [r[0] for r in rows(filters.type_filter(g, kind, wanted).select("id"))]
    assert got("returns", "Result") == ["pub"] and got("takes", "Vec<T>") == ["pub"] and got("sig", "(") == ["priv", "pub"]
    assert got("implements", "Show") == ["c", "s"] and got("field", "String") == ["d"] and got("returns", "io::Result") == ["pub"]
    assert [r["id"] for r in filters.find_definitions(g.symbols, "run", kind="func").collect()] == ["pub"]
    with pytest.raises(ValueError, match="unknown kind"):
        filters.kind_named("nonsense")
    assert rows(filters.advanced_search(g, "RUN", [("returns", "Result")])) == [("pub", "run")]
