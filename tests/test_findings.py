"""Work that must not grow faster than its input: rows of rounds, and many symbols on the same lines."""

from lodestar.operators import analytics, liveness, lookup, navigate, reachability
from lodestar.schema import SYMBOLS, Graph
from lodestar.sources import graphview






def test_symbols_on_the_same_lines_count_once(spark):
    rows = [(f"c{i}", "Class", f"c{i}", "f", i % 10, 0, i % 10 + 5, 10, None, None) for i in range(2000)]
    calls = [(f"e{i}", "Method", f"e{i}", "g", i, 0, i, 10, None, None) for i in range(100)]
    s = spark.createDataFrame(rows + calls, SYMBOLS)
    first = lambda line: min(r[0] for r in rows if r[4] == max(line - 5, 0))
    spots = spark.createDataFrame([("f", i, 3) for i in range(10)], "file_path string, line int, char int")
    assert {tuple(r) for r in navigate.at_positions(s, spots).select("line", "id").collect()} == {(i, first(i)) for i in range(10)}
    assert navigate.firsts(s, spots).count() == 10  # not 2000
    places = spark.createDataFrame([(f"e{i}", "f", i % 10) for i in range(100)], "id string, file_path string, line int")
    found = lookup.cross_file_references(s, places)
    assert {tuple(r) for r in found.select("src_id", "dst_id").collect()} == {(f"e{i}", first(i % 10)) for i in range(100)}


def test_imports_sum_by_nations_only(spark):
    plan = graphview.imports(graphview.Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_imports_shuffle_lines_once_and_sort_none(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        g = graphview.graph(spark, "/root/testdata/sf0.001", "Import")
        assert "edges" not in vars(g)  # planned, with counts of rows, only for queries that want edges
        plan = g.edges._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "hashpartitioning(l_suppkey" not in plan and "hashpartitioning(o_custkey" not in plan
    assert plan.count("hashpartitioning(l_orderkey") == plan.count("ShuffledHashJoin") == 1


def test_hierarchy_keeps_types_at_edges_only(spark, monkeypatch):
    rows = [(f"c{i}", "Class", f"c{i}", "f", i, 0, i, 1, None, None) for i in range(500)] + [("v", "Variable", "v", "f", 0, 0, 0, 1, None, None)]
    edges = [("c1", "c0"), ("c2", "c1"), ("c3", "c0"), ("c0", "v"), ("v", "c9"), ("c5", "c6"), ("c6", "c5"), ("c1", "c0")]
    g = Graph(spark.createDataFrame(rows, SYMBOLS), spark.createDataFrame([(a, b, "Definition") for a, b in edges], "src_id string, dst_id string, kind string"))
    written, walks, put, walk = [], [], analytics.materialized, analytics.traverse.reach
    monkeypatch.setattr(analytics, "materialized", lambda df: (x := put(df), written.append(x.count()))[0])
    monkeypatch.setattr(analytics.traverse, "reach", lambda *a, **k: (walks.append(1), walk(*a, **k))[1])
    found = {tuple(r) for r in analytics.type_hierarchy(g, g.symbols.select("id")).collect()}
    assert max(written) <= 2 * len(edges) and len(walks) == 2  # not the 500 classes; one walk down for roots and parents
    up = {("c1", "c0"), ("c2", "c1"), ("c2", "c0"), ("c3", "c0"), ("c5", "c6"), ("c5", "c5"), ("c6", "c5"), ("c6", "c6")}
    siblings = {(a, b) for a, p in up for b, q in up if p == q and a != b}
    assert found == {(a, "parent", b) for a, b in up} | {(b, "child", a) for a, b in up} | {(a, "sibling", b) for a, b in siblings}


def test_built_graph_keeps_first_symbols_and_known_edges(spark):
    s = spark.createDataFrame([("a", "Class", "n", "f", 2, 0, 3, 0, None, None), ("a", "Class", "n", "f", 1, 0, 3, 0, None, None), ("b", "Class", "n", "f", 1, 0, 3, 0, None, None)], SYMBOLS)
    e = spark.createDataFrame([("a", "b", "Reference"), ("a", "x", "Reference")], "src_id string, dst_id string, kind string")
    g = Graph.build(s, e)
    assert sorted((r.id, r.start_line) for r in g.symbols.collect()) == [("a", 1), ("b", 1)] and [tuple(r) for r in g.edges.collect()] == [("a", "b", "Reference")]
    assert "Aggregate" not in g.edges._jdf.queryExecution().optimizedPlan().toString()


def test_reachability_goes_back_from_few_goals(spark):
    edges = [(f"p{i}", f"s{(i * 7 + j * 3) % 40}") for i in range(300) for j in range(10)] + [(f"s{i}", f"n{i % 9}") for i in range(40)]
    pairs = [(f"p{i}", f"n{j}") for i in range(300) for j in range(9)]
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    want = {(a, b, any(b in up[s] for s in up[a])) for a, b in pairs}
    looked = []
    found = reachability.answer(spark.createDataFrame(pairs, "src string, dst string"), *reachability.label(spark.createDataFrame(edges, "src_id string, dst_id string")), looked)
    assert {tuple(r) for r in found.collect()} == want
    assert looked[0] > 300 and max(looked[1:]) <= 49  # a row for a supplier and its nation, not for a pair and each of its suppliers


def test_cyclomatic_walks_from_inner_nodes_only(spark, monkeypatch):
    edges = [("p", "s"), ("p", "t"), ("q", "s"), ("s", "n"), ("t", "n"), ("s", "n"), ("x", "y"), ("y", "x")]
    g = Graph(spark.createDataFrame([], SYMBOLS), spark.createDataFrame([(a, b, "Contains") for a, b in edges], "src_id string, dst_id string, kind string"))
    roots = spark.createDataFrame([(r,) for r in ["p", "q", "s", "n", "x", *[f"e{i}" for i in range(500)]]], "id string")
    started, walk = [], analytics.traverse.reach
    monkeypatch.setattr(analytics.traverse, "reach", lambda e, starts, *a, **k: (started.append(starts.count()), walk(e, starts, *a, **k))[1])
    found = {r.id: r.cyclomatic for r in analytics.cyclomatic(g, roots).collect()}
    assert started == [5]  # not the 500 roots that contain nothing
    assert found == {"p": 3, "q": 2, "s": 2, "n": 2, "x": 2, **{f"e{i}": 2 for i in range(500)}}


def test_upkeep_passes_chains_in_few_jobs(spark):
    frame = lambda e: spark.createDataFrame(e, "src_id string, dst_id string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    line = [(f"a{i:03}", f"a{i + 1:03}") for i in range(120)] + [(f"a{i:03}", f"leaf{i % 7}") for i in range(120)]
    before, after = [("r", "a000"), ("s", "leaf3"), *line], [("s", "leaf3"), *line, *line[:5]]
    live = liveness.start(frame(before), ids("r", "s"))
    tracker, group = spark.sparkContext.statusTracker(), "upkeep"
    spark.sparkContext.setJobGroup(group, group)
    out = liveness.update(live, frame(before), frame(after), ids("r", "s"), ids("r", "s"))
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.id for r in out.live.collect()} == {"r", "s", "leaf3"} and out.suspended == 121 + 6
    assert jobs < 200  # a wave for each of the 121 nodes took several each


def scans(spark, f):
    """How many tables f writes."""
    from lodestar.plans import tables

    made, write = [], tables.new_folder
    tables.new_folder = lambda s: (made.append(1), write(s))[1]
    try:
        f()
    finally:
        tables.new_folder = write
    return len(made)


def test_relations_of_no_rounds_write_no_steps(spark):
    from lodestar.operators import traverse

    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "src_id string, dst_id string")
    starts = spark.createDataFrame([("a",)], "id string")
    assert scans(spark, lambda: traverse.reach(e, starts, 0, with_start=True)) == 1  # the starts, not the edges too
    assert sorted(tuple(r) for r in traverse.reach(e, starts, 2, with_parent=True).collect()) == [("a", "b", 1, "a"), ("a", "c", 2, "b")]


def test_full_calls_write_their_edges_once(spark):
    g = Graph(spark.createDataFrame([], SYMBOLS), spark.createDataFrame([("a", "b", "Reference"), ("a", "b", "Reference"), ("c", "a", "Reference")], "src_id string, dst_id string, kind string"))
    out = []
    assert scans(spark, lambda: out.append(analytics.full_calls(g, spark.createDataFrame([("a",)], "id string"), 1))) == 5  # the edges, then starts and a round each way
    assert sorted(tuple(r) for r in out[0].collect()) == [("a", "b", "a", 1, "outgoing"), ("a", "c", "a", 1, "incoming")]


def test_ranges_read_little_beyond_their_end(tmp_path, monkeypatch):
    import io

    from lodestar.sources import lsif

    text = b"".join(b"%d:%s\n" % (i, b"x" * 90) for i in range(20_000)) + b"y" * 300_000 + b"\nend\n"
    read = []

    class Counted(io.BytesIO):
        def read(self, n=-1):
            data = super().read(n)
            read.append(len(data))
            return data

    monkeypatch.setattr(lsif, "_open", lambda uri: (type("Files", (), {"open_input_file": lambda self, at: Counted(text)})(), uri))
    got = [x for at in range(0, len(text), 50_000) for x in lsif.lines_of("f", at, min(at + 50_000, len(text)))]
    assert [line.encode() for _, line in got] == text.split(b"\n")[:-1]
    assert sum(read) < 2 * len(text)  # a range of 50,000 bytes read a million


def test_layers_of_long_paths(spark):
    from lodestar.operators import layers

    steps = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(12)], "a string, b string")
    found = layers.layers(steps, layers.ends(steps, spark.createDataFrame([("n00",)], "id string")))
    assert {(r.id, r.layer) for r in found.collect()} == {(f"n{i:02}", 12 - i) for i in range(13)}


def calls_of(edges, roots):
    """What full_calls gives without a bound, by breadth-first search."""
    rows = set()
    for way, steps in (("outgoing", edges), ("incoming", {(b, a) for a, b in edges})):
        for root in roots:
            level, met, depth = {root}, set(), 0
            while level:
                depth += 1
                parents = {}
                for a, b in steps:
                    if a in level and b not in met:
                        parents[b] = min(a, parents.get(b, a))
                rows |= {(root, b, a, depth, way) for b, a in parents.items()}
                met |= set(parents)
                level = set(parents)
    return rows


def lines_and_others():
    """Lines of 9, 3 and 2 nodes, cycles, a line into a cycle, forks, meetings and a short cut past a line's middle."""
    line = lambda name, n: [(f"{name}{i}", f"{name}{i + 1}") for i in range(n - 1)]
    return set(
        line("l", 9) + line("m", 3) + line("two", 2) + [*line("c", 5), ("c4", "c0"), *line("d", 4), ("d3", "d1"), ("self", "self"), ("self", "next")]
        + [*line("f", 4), ("f1", "f9"), *line("g", 4), ("g9", "g2"), *line("h", 4), ("h0", "h3"), ("star", "leaf1"), ("star", "leaf2"), ("other", "leaf1")]
    )


def test_full_calls_without_a_bound(spark, monkeypatch):
    import random

    from lodestar.operators import traverse

    monkeypatch.setattr(traverse, "TILE", 2)  # lines of several tiles
    rng = random.Random(4)
    cases = [lines_and_others(), {("x", "y"), ("y", "z")}, {("x", "y"), ("v", "y")}]
    cases += [{(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(20)}]
    for n, edges in enumerate(cases):
        ids = sorted({x for e in edges for x in e})
        g = Graph(spark.createDataFrame([], SYMBOLS), spark.createDataFrame([(a, b, "Reference") for a, b in edges] * 2 + [(ids[0], ids[-1], "Import"), (ids[0], None, "Reference")], "src_id string, dst_id string, kind string"))
        for roots in (ids, ids[::3]) if n == 0 else (ids,):
            found = analytics.full_calls(g, spark.createDataFrame([(x,) for x in [*roots, "nobody"]], "id string"), traverse.UNBOUNDED)
            assert sorted(tuple(r) for r in found.collect()) == sorted(calls_of(edges, roots))


def test_full_calls_along_a_line_take_few_rounds(spark):
    from lodestar.operators import traverse

    g = Graph(spark.createDataFrame([], SYMBOLS), spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}", "Reference") for i in range(300)], "src_id string, dst_id string, kind string"))
    out = []
    assert scans(spark, lambda: out.append(analytics.full_calls(g, spark.createDataFrame([(f"n{i:03}",) for i in range(301)], "id string"), traverse.UNBOUNDED))) < 20  # not 600
    assert out[0].count() == 301 * 300


def test_the_query_of_full_calls_goes_to_the_ends(spark):
    """Depth 1 of events only was all that it gave."""
    import duckdb

    import __spark_entry__

    folder = "/root/testdata/sf0.001"
    pairs, lone = duckdb.sql(f"SELECT (SELECT sum(n * (n - 1))::BIGINT FROM (SELECT count(*) AS n FROM '{folder}/events.parquet' GROUP BY user_id)), 2 * ((SELECT count(*) FROM '{folder}/orders.parquet') + (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM '{folder}/lineitem.parquet')))").fetchall()[0]
    found = __spark_entry__.queries()["full_calls"](spark, folder)
    assert found.count() == pairs + lone
    assert found.where("depth > 80").count() > 0
