"""Alignments, the kept name index, layered complexity, pruned paths, upkeep of what is live and reachability labels, each
against plain loops."""

import os
import random
import re
from functools import cache
from itertools import combinations, pairwise

import pytest
from pyspark.sql import functions as F

from lodestar.functions import alignment
from lodestar.operators import analytics, crawl, layers, liveness, nameindex, reachability, search, traverse
from lodestar.schema import EDGES
from tests.test_graph import build, one, rows


def score_brute(name, query):
    """The best of all ways to find the query's characters in the name."""
    best = None
    low = lambda c: c.lower() if len(c.lower()) == 1 else c

    def bonus(j):
        if j == 0:
            return 8
        if not name[j - 1].isalnum():
            return 7
        turn = name[j].isupper() and not name[j - 1].isupper() or name[j].isdigit() and not name[j - 1].isdigit()
        return 6 if turn else 0

    for at in combinations(range(len(name)), len(query)):
        if any(low(name[j]) != low(c) for j, c in zip(at, query)):
            continue
        total = sum(16 - 2 * (name[j] != c) for j, c in zip(at, query)) + 2 * bonus(at[0])
        for i, j in pairwise(at):
            total += max(bonus(j), 4) if j == i + 1 else bonus(j) - 3 - (j - i - 2)
        best = total if best is None else max(best, total)
    return best


def test_alignments():
    rnd = random.Random(1)
    names = ["", "a", "getUserName", "get_user_name", "GETUSERNAME", "user2Name", "Straße", "ÀÉgetß", "x" * 12] + ["".join(rnd.choice("abAB_1é") for _ in range(rnd.randint(1, 11))) for _ in range(150)]
    for query in ("gun", "gUN", "ab", "A", "b1", "aba", "_a", "é", "ss"):
        got = alignment.scores(names, query)
        for name, x in zip(names, got.tolist()):
            want = score_brute(name, query)
            assert (want is None and x < -(1 << 20)) or x == want, (name, query, x, want)
    assert alignment.scores(names, "").tolist() == [0] * len(names)
    assert alignment.scores(["a" + "b" * 5000 + "c"] * 3 + ["ac"], "ac").tolist()[3] == 16 + 16 + 16 + 4


def test_last_resort(spark):
    names = ["getUserName", "gun", "setUserName", "Gunner", "guNother", "begin_under", None, "gxuxn"]
    s = build(spark, {f"n{i}": ("Function", n, "a.rs", None) for i, n in enumerate(names)}, []).symbols
    found = search.engine_search(s, "gun", 10, last_resort=True).collect()
    want = {f"n{i}": float(x) for i, n in enumerate(names) if n and (x := score_brute(n, "gun")) and x > 30}
    assert {r["id"]: r["score"] for r in found if r["match_type"] == "Fuzzy"} == {k: v for k, v in want.items() if k not in ("n1", "n3", "n4")} and {r["id"] for r in found} == set(want)
    assert [r["match_type"] for r in search.engine_search(s, "gun", 1, last_resort=True).collect()] == ["Exact"]
    assert [r["id"] for r in search.search_by_kind(s, "gun", "class", last_resort=True).collect()] == []


QUERIES = ("", "a", "ab", "abc", "abcd", "abcdefgh", "ABC", "aB", "Xyz", "zzzzz", "aaaa", "é", "日本", "straße", "getUserNam", "gtUsr", "a b")


def symbol_rows(names):
    return [(f"{path}#{i}", name, path) for path, own in names.items() for i, name in enumerate(own)]


def test_the_index_finds_what_a_scan_finds(spark, tmp_path):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("aabbcdeXYZé") for _ in range(rnd.randint(0, 9)))
    files = {f"f{i}": [word() for _ in range(12)] for i in range(25)} | {"more": ["getUserName", "GetUserName", "getUserNames", "Straße", "日本語", "abcdefgh", "abdefgh", "aaaaaaaa", None, "a b c"]}
    schema = "id string, name string, file_path string"
    frame = lambda f: spark.createDataFrame(symbol_rows(f), schema)
    folder = str(tmp_path / "index")
    same = lambda folder: [q for q in QUERIES if nameindex.search(spark, folder, q, None).collect() != search.core_search(frame(files), q, None).collect()]
    nameindex.build(frame(files), folder)
    assert same(folder) == []
    change = {"f3": ["abcde", "new"], "f4": [], "f99": ["abcd", "getUserNam"]}
    files = {k: v for k, v in (files | change).items() if v}
    for _ in range(2):  # an update that runs again changes nothing
        nameindex.update(spark, folder, frame(change), spark.createDataFrame([(p,) for p in change], "path string"), 1)
        assert same(folder) == []
    nameindex.update(spark, folder, frame({"f3": ["abc"]}), spark.createDataFrame([("f3",)], "path string"), 2)
    files["f3"] = ["abc"]
    assert same(folder) == []
    nameindex.compact(spark, folder, str(tmp_path / "small"))
    assert same(str(tmp_path / "small")) == []
    total = lambda f: nameindex.table(spark, f, "postings").select("name").distinct().count()
    assert total(str(tmp_path / "small")) < total(folder)


def test_a_search_reads_its_buckets_only(spark, tmp_path):
    names = spark.range(3000).select(F.concat(F.lit("id"), F.col("id")).alias("id"), F.concat(F.lit("name"), F.hex(F.xxhash64("id"))).alias("name"), F.lit("f").alias("file_path"))
    nameindex.build(names, str(tmp_path))
    found = nameindex.candidates(spark, str(tmp_path), "Zq7x")
    plan = found._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"PartitionFilters: \[[^\]]*bucket#\d+ (?:IN|INSET) \(?([^)\]]*)", plan)
    assert len(read) == 1 and len(read[0].split(",")) <= len(nameindex.query_keys("Zq7x")) < nameindex.BUCKETS // 4


def dag(rnd, n, share):
    return [(f"v{i:02}", f"v{j:02}") for i in range(n) for j in range(i + 1, n) if rnd.random() < share]


def walk_brute(node, kids, kinds, branches):
    """Cognitive complexity by walking, without any memory."""
    met, total = 0, 0
    todo = [node]
    while todo:
        x = todo.pop()
        if branches.get(x, 0) > 1:
            total += (branches[x] - 1) * (1 + met)
        met += kinds[x] in ("Function", "Method")
        todo += sorted(kids.get(x, ()), reverse=True)
    return total


@pytest.mark.parametrize("seed", [1])
def test_complexity_by_layers(spark, seed):
    rnd = random.Random(seed)
    contains = dag(rnd, 11, 0.35)
    kinds = {f"v{i:02}": rnd.choice(("Function", "Method", "Class")) for i in range(11)}
    refs = [(rnd.choice(list(kinds)), rnd.choice(list(kinds))) for _ in range(40)]
    g = build(spark, kinds, [(a, "Contains", b) for a, b in contains] + [(a, "Reference", b) for a, b in refs])
    kids, branches = {}, {}
    for a, b in contains:
        kids.setdefault(a, []).append(b)
    for a, _ in refs:
        branches[a] = branches.get(a, 0) + 1
    longest = cache(lambda x: max((1 + longest(k) for k in kids.get(x, ())), default=0))
    roots = one(spark, *kinds)
    assert rows(analytics.nesting(g, roots)) == sorted((x, longest(x)) for x in kinds)
    assert rows(analytics.cognitive(g, roots)) == sorted((x, walk_brute(x, kids, kinds, branches)) for x in kinds)


def test_a_ladder_of_diamonds_ends(spark):
    names, contains, n = ["n000", "n001"], [], int(os.environ.get("DIAMONDS", 11))
    for i in range(40 - n, 40):
        top, left, right, foot = f"n{i:03}", f"n{i:03}a", f"n{i:03}b", f"n{i + 1:03}"
        names += [top, left, right, foot] if i == 40 - n else [left, right, foot]
        contains += [(top, "Contains", left), (top, "Contains", right), (left, "Contains", foot), (right, "Contains", foot)]
    g = build(spark, dict.fromkeys(names, "Function"), contains)
    assert rows(analytics.nesting(g, one(spark, f"n{40 - n:03}", "n038"))) == [(f"n{40 - n:03}", 2 * n), ("n038", 4)]
    small = [(a, k, b) for a, k, b in contains if a >= "n037"] + [("n040", "Reference", x) for x in ("n000", "n001")]
    # Each of the eight visits of the last node adds 1 and what came before.
    kids = {}
    for a, k, b in small:
        if k == "Contains":
            kids.setdefault(a, []).append(b)
    g = build(spark, dict.fromkeys(names, "Function"), small)
    assert rows(analytics.cognitive(g, one(spark, "n037"))) == [("n037", walk_brute("n037", kids, dict.fromkeys(names, "Function"), {"n040": 2}))]


def test_walks_too_long_to_count(spark):
    line = [(f"n{i}", f"n{i + 1}") for i in range(4)]
    nodes = spark.createDataFrame([(f"n{i}", 1, 2**62 if i == 4 else 0) for i in range(5)], "id string, f int, w long")
    steps = spark.createDataFrame(line, "a string, b string")
    found = layers.walks(steps, layers.layers(steps, nodes), nodes)
    assert {r["id"]: int(r["cost"]) for r in found.collect()} == {"n4": 2**62, **{f"n{i}": 2**63 - 1 for i in range(4)}}


def test_complexity_with_cycles(spark):
    g = build(spark, dict.fromkeys("abcdx", "Function"), [("a", "Contains", "b"), ("b", "Contains", "c"), ("c", "Contains", "b"), ("c", "Contains", "d"), ("x", "Contains", "d"), ("d", "Reference", "a"), ("d", "Reference", "b")])
    assert rows(analytics.nesting(g, one(spark, "a", "b", "x", "d", "nobody"))) == [("a", 3), ("b", 2), ("d", 0), ("nobody", 0), ("x", 1)]
    assert rows(analytics.cognitive(g, one(spark, "a", "x", "d"))) == [("a", 4), ("d", 1), ("x", 2)]


def test_paths_between_pairs_are_pruned(spark):
    rnd = random.Random(9)
    names = [f"v{i:02}" for i in range(30)]
    edges = sorted({(rnd.choice(names), rnd.choice(names)) for _ in range(110)})
    g = build(spark, dict.fromkeys(names, "Function"), [(a, "Reference", b) for a, b in edges] + [(a, "Reference", b) for a, b in edges[:5]])
    kids = {a: [b for x, b in edges if x == a] for a in names}
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(12)] + [("v01", "v01"), ("v02", "nobody"), ("nobody", "nobody")]

    def grow(path, dst, most):
        if path[-1] == dst:
            yield path
        elif len(path) <= most:
            for b in kids.get(path[-1], ()):
                if b not in path:
                    yield from grow([*path, b], dst, most)

    want = sorted((s, d, p) for s, d in set(pairs) for p in ([[s]] if s == d else grow([s], d, 4)))
    grown = []
    frame = spark.createDataFrame(pairs, "src string, dst string")
    assert rows(analytics.call_paths(g, frame, 4, grown)) == want
    ends = {(s, d): sum(p[0] == s and p[-1] == d for _, _, p in want) for s, d in pairs}
    free = sum(1 for s, d in set(pairs) if s != d for _ in every_path(kids, [s], 4))
    assert sum(grown) < free / 3 and sum(ends.values()) > 0
    line = build(spark, dict.fromkeys("abc", "Function"), [("a", "Reference", "b"), ("b", "Reference", "c")])
    grown.clear()
    assert rows(analytics.call_paths(line, spark.createDataFrame([("c", "a")], "src string, dst string"), 5, grown)) == [] and sum(grown) == 0


def every_path(kids, path, most):
    if len(path) <= most:
        for b in kids.get(path[-1], ()):
            if b not in path:
                yield path
                yield from every_path(kids, [*path, b], most)


def closure_brute(edges, entries, gone=()):
    live, todo = set(), [e for e in entries if e not in gone]
    while todo:
        x = todo.pop()
        if x not in live:
            live.add(x)
            todo += [b for a, b in edges if a == x and b not in gone]
    return live


def test_closure_of_chains(spark):
    rnd = random.Random(3)
    names = [f"v{i:02}" for i in range(40)]
    line = [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)] + [("c150", "v00"), ("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("c070", "leaf")]
    edges = [(rnd.choice(names), rnd.choice(names)) for _ in range(45)] + line
    frame = spark.createDataFrame(edges, "src_id string, dst_id string")
    for starts in (["c010"], ["v01", "r1"], ["leaf", "nobody"], []):
        ids = spark.createDataFrame([(x,) for x in starts], "id string")
        assert {r["id"] for r in traverse.closure_of_chains(frame, ids).collect()} == closure_brute(edges, starts)


def test_live_nodes_through_updates(spark):
    rnd = random.Random(12)
    names = [f"v{i:02}" for i in range(40)]
    frame = lambda e: spark.createDataFrame(sorted(e), "src_id string, dst_id string")
    ids = lambda x: spark.createDataFrame([(i,) for i in sorted(x)], "id string")
    edges = {(rnd.choice(names), rnd.choice(names)) for _ in range(60)}
    entries = {"v00", "v01", "v02"}
    live = liveness.start(frame(edges), ids(entries))
    gone = set()
    for step in range(int(os.environ.get("UPDATES", 3))):
        before, old = set(edges), set(entries)
        for _ in range(rnd.randint(1, 4)):
            edges.discard(rnd.choice(sorted(edges)))
            edges.add((rnd.choice(names), rnd.choice(names)))
        if step % 5 == 3:
            entries ^= {rnd.choice(names)}
            entries |= {"v00"}
        if step % 7 == 6:
            gone.add(rnd.choice(names[3:]))
            edges = {(a, b) for a, b in edges if a not in gone}
        out = liveness.update(live, frame(before), frame(edges), ids(old), ids(entries), ids(gone) if gone else None)
        live = out.live
        got = {r["id"]: r["depth"] for r in live.collect()}
        assert set(got) == closure_brute(edges, entries, gone), step
        assert all(x in entries or any(b == x and a in got and got[a] < d for a, b in edges) for x, d in got.items())


def test_an_update_touches_what_it_affects(spark):
    line = [(f"a{i:03}", f"a{i + 1:03}") for i in range(30)] + [("r", f"x{i:03}") for i in range(300)]
    frame = lambda e: spark.createDataFrame(e, "src_id string, dst_id string")
    entries = one(spark, "a000", "r")
    live = liveness.start(frame(line), entries)
    assert live.count() == 332
    cut = [e for e in line if e != ("a027", "a028")] + [("x005", "y")]
    out = liveness.update(live, frame(line), frame(cut), entries, entries)
    assert (out.suspended, out.found) == (3, 1) and out.live.count() == 330
    assert rows(liveness.dead(one(spark, "a029", "y", "nobody"), out.live)) == [("a029",), ("nobody",)]


@pytest.mark.parametrize("seed", [4])
def test_reachability_labels(spark, seed):
    rnd = random.Random(seed)
    names = [f"v{i:02}" for i in range(45)]
    edges = sorted({(rnd.choice(names), rnd.choice(names)) for _ in range(60 + 15 * seed)})
    kids = {a: {b for x, b in edges if x == a} for a in names}

    def reached(x):
        seen, todo = set(), list(kids[x])
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += kids[y]
        return seen

    want = sorted((a, b, a == b or b in reached(a)) for a in names for b in names) + [("nobody", "nobody", True)]
    pairs = spark.createDataFrame([(a, b) for a, b, _ in want] + [("v00", "nobody"), ("v00", "v01")], "src string, dst string")
    looked = []
    got = rows(reachability.answer(pairs, *reachability.label(spark.createDataFrame(edges, "src_id string, dst_id string")), looked))
    assert got == sorted([*want, ("v00", "nobody", False)])
    assert looked[0] < len(want) / 4


def test_reachability_of_many_pairs(spark):
    tree = spark.range(1, 20_000).select(F.concat(F.lit("n"), ((F.col("id") - 1) / 3).cast("long")).alias("src_id"), F.concat(F.lit("n"), F.col("id")).alias("dst_id"))
    labels = reachability.label(tree)
    pairs = spark.range(200_000).select(F.concat(F.lit("n"), F.col("id") % 400).alias("src"), F.concat(F.lit("n"), (F.col("id") * 7919) % 20_000).alias("dst"))
    looked = []
    found = reachability.answer(pairs, *labels, looked)
    above = lambda x: [x] if not x else [x, *above((x - 1) // 3)]
    assert looked[0] < 200 and found.where("found").count() == len({(i % 400, i * 7919 % 20_000) for i in range(200_000) if i % 400 in above(i * 7919 % 20_000)})
    none = spark.createDataFrame([], EDGES).select("src_id", "dst_id")
    assert rows(reachability.answer(spark.createDataFrame([("a", "b"), ("c", "c")], "src string, dst string"), *reachability.label(none))) == [("a", "b", False), ("c", "c", True)]


def crawl_brute(edges, starts, most_depth, most_files):
    queue, seen, out = [(p, 0, f) for f, p in starts], set(), []
    while queue and len(out) < most_files:
        p, d, f = min(queue)
        queue.remove((p, d, f))
        if f in seen:
            continue
        seen.add(f)
        out.append((f, -d, p, len(out) + 1))
        if -d < most_depth:
            queue += [(w, d - 1, b) for a, b, w in edges if a == f]
    return sorted(out)


@pytest.mark.parametrize(("seed", "files"), [(1, 100), (2, 9)])
def test_crawl_by_priority(spark, seed, files):
    rnd = random.Random(seed)
    names = [f"f{i:02}" for i in range(30)]
    edges = [(rnd.choice(names), rnd.choice(names), rnd.randint(1, 6)) for _ in range(90)]
    starts = [("f00", 5), ("f01", 3), ("zz", 4)]
    frame = spark.createDataFrame(edges, "src_file string, dst_file string, priority int")
    got = rows(crawl.crawl_by_priority(frame, spark.createDataFrame(starts, "file string, priority int"), 3, files))
    assert got == crawl_brute(edges, starts, 3, files)
    assert rows(crawl.crawl_by_priority(frame, spark.createDataFrame([], "file string, priority int"))) == []


