"""Names, source text, formats and upkeep."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import mapping, names, source, textrefs
from lodestar.operators import search
from lodestar.schema import EDGES, SYMBOLS, Graph
from lodestar.sources import formats
from lodestar.streaming import incremental, lifecycle
from tests.test_graph import build, one, rows

CODE = {
    "a.rs": "pub async fn run() {\n  struct Inner {\n}\nimpl Thing {\npub(crate) fn no() {}\ntrait Show {\nenum E {",
    "b.ts": "export const go = (x) => x;\nlet a = 1\r\nexport class K {\ninterface I {\nasync function f() {}",
    "c.py": "class A:\n    def m(self):\ndef top():\n",
    "d.go": "func (s *S) Run() {\ntype S struct {\ntype R interface {\nfunc Main() {",
    "e.md": "fn run()",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(CODE.items()), "path string, content string")


def named(spark, *texts):
    return build(spark, {f"s{i}": ("Function", t, "x.rs", None) for i, t in enumerate(texts)}, [("s0", "Reference", "s0")]).symbols


def test_extract(files):
    found = {(r["file_path"], r["kind"], r["name"], r["start_line"], r["start_char"]) for r in source.extract(files).collect()}
    assert found == {
        ("a.rs", "Function", "run", 0, 0), ("a.rs", "Struct", "Inner", 1, 0), ("a.rs", "Class", "impl Thing", 3, 0), ("a.rs", "Interface", "Show", 5, 0), ("a.rs", "Enum", "E", 6, 0),
        ("b.ts", "Function", "go", 0, 0), ("b.ts", "Variable", "a", 1, 0), ("b.ts", "Class", "K", 2, 0), ("b.ts", "Interface", "I", 3, 0), ("b.ts", "Function", "f", 4, 0),
        ("c.py", "Class", "A", 0, 0), ("c.py", "Method", "m", 1, 4), ("c.py", "Function", "top", 2, 0),
        ("d.go", "Function", "Run", 0, 0), ("d.go", "Struct", "S", 1, 0), ("d.go", "Interface", "R", 2, 0), ("d.go", "Function", "Main", 3, 0),
    }


def test_languages_and_scans(spark, files):
    assert source.project_language(files).first()["language"] == "rust"
    marked = spark.createDataFrame([("x/go.mod",), ("a.rs",)], "path string")
    assert source.project_language(marked).first()["language"] == "go"
    paths = spark.createDataFrame([(p,) for p in ("src/a.rs", "target/a.rs", "a/.git/x.ts", "a.py", "b/c.tsx")], "path string")
    assert [r["path"] for r in paths.where(source.scanned(F.col("path"))).collect()] == ["src/a.rs", "b/c.tsx"]


def test_references(spark):
    df = spark.createDataFrame([("a.rs", "fn run() { run(); }\n// run\nlet s = \"run\"; running(); run"), ("b.rs", "run /* run\n run */ run r\"a \\\" run\n\"run\nrun"), ("c.py", "# run\ndef run(): 'run' + \"\"\"run\nrun\"\"\" + run"), ("d.go", "func (s *T) run() { `run\nrun` }"), ("e.txt", "// run")], "path string, content string")
    want = [("a.rs", 0, 3, True), ("a.rs", 0, 11, False), ("a.rs", 2, 26, False), ("b.rs", 0, 0, False), ("b.rs", 1, 8, False), ("b.rs", 1, 19, False), ("b.rs", 3, 0, False), ("c.py", 1, 4, True), ("c.py", 2, 9, False), ("d.go", 0, 12, True), ("e.txt", 0, 3, False)]
    found = rows(textrefs.find_references(df, "run"))
    assert found == want
    assert [tuple(r) for r in textrefs.sorted_references(textrefs.find_references(df.unionByName(df), "run")).collect()] == want


def test_patterns_of_declarations(spark):
    lines = {"a.rs": ["impl <T> Set {", "impl<T> No {", "pub fn größe() {", "impl Plain {"], "b.ts": ["const f = async (x) => x;", "const g = [1];", "const h = x => x;", "export const k = ("], "c.go": ["  func (s *S) Inner() {", "\ttype T struct {", "  type I interface {"]}
    df = spark.createDataFrame([(p, "\n".join(x)) for p, x in lines.items()], "path string, content string")
    found = rows(source.extract(df).select("file_path", "start_line", "kind", "name"))
    assert found == [("a.rs", 0, "Class", "impl Set"), ("a.rs", 2, "Function", "größe"), ("a.rs", 3, "Class", "impl Plain"), ("b.ts", 0, "Function", "f"), ("b.ts", 1, "Function", "g"), ("b.ts", 2, "Variable", "h"), ("b.ts", 3, "Function", "k"), ("c.go", 0, "Function", "Inner"), ("c.go", 1, "Struct", "T"), ("c.go", 2, "Interface", "I")]
    source.add_catalogued("rust", "Macro", r"^macro_rules!\s+(\w+)")
    assert rows(source.catalogued(spark.createDataFrame([("m.rs", "macro_rules! vecs {\n")], "path string, content string"), "Macro")) == [("m.rs", 0, "vecs")]


def test_fuzzy(spark):
    s = named(spark, "openDoorLock", "openWindow", "XMLTreeReader", "sumOfSquares", "MAX_DEPTH", "größteZahl")
    kind = lambda q: {r["name"]: r["match_type"] for r in search.core_search(s, q).collect()}
    assert kind("OPENDOORLOCK")["openDoorLock"] == "Exact" and kind("open")["openWindow"] == "Prefix" and kind("DL")["openDoorLock"] == "CamelCase"
    assert kind("reader")["XMLTreeReader"] == "Substring" and kind("openWimdow")["openWindow"] in ("Typo", "Fuzzy") and kind("") == {} and kind("ßte")["größteZahl"] == "Substring"
    found = [(r["name"], r["match_type"], r["score"]) for r in search.cli_search(s, "xtr").collect()]
    assert found[0] == ("XMLTreeReader", "subsequence", 0.5) if found[0][1] == "subsequence" else found[0][1] == "abbreviation"
    assert search.needs_fuzzy("ab", 9) and search.needs_fuzzy("LONG", 9) and not search.needs_fuzzy("long", 3)
    assert {r["name"] for r in search.search_by_kind(s, "open", "func", 1).collect()} == {"openWindow"} and search.search_by_kind(s, "open", "class").count() == 0
    words = s.select("name", names.camel_words(F.col("name")).alias("w"), names.plain_camel_words(F.col("name")).alias("p"), names.grams(F.lit("ab"), 2).alias("g"), names.plain_grams(F.lit("abcd"), 3).alias("l")).collect()
    by = {r["name"]: r for r in words}
    assert by["XMLTreeReader"]["w"] == ["XML", "Tree", "Reader"] and by["openDoorLock"]["p"] == ["open", "Door", "Lock", "openDoorLock"] and sorted(by["MAX_DEPTH"]["g"]) == [" a", "ab", "b "] and by["MAX_DEPTH"]["l"] == ["abc", "bcd"]


def test_index_life_cycle(spark, tmp_path):
    store = lifecycle.Store(spark, str(tmp_path / "store"))
    files = lambda **x: spark.createDataFrame([(f"{k}.rs", v) for k, v in x.items()], "path string, content string")
    assert store.load()[0].symbols.count() == 0 and store.tables() == []
    first = store.index(files(a="fn one() {}\nfn two() {}", b="fn three() {}", c="fn four() {}", d=None))
    assert first.full and first.summary().first().asDict() == {"files_added": 4, "files_modified": 0, "files_deleted": 0, "symbols_added": 4, "symbols_removed": 0, "symbols_updated": 0, "full": True}
    g, known = store.load()
    linked = Graph(g.symbols, spark.createDataFrame([("a.rs#0:one", "b.rs#0:three", "Reference"), ("b.rs#0:three", "c.rs#0:four", "Reference")], EDGES))
    store.save(linked, known)
    second = store.index(files(a="fn one() {}\nfn other() {}", b="fn three() {}", c="fn four() {}", d=None))
    assert not second.full and rows(second.diff) == [("a.rs", "a.rs#0:one", "updated"), ("a.rs", "a.rs#1:other", "added"), ("a.rs", "a.rs#1:two", "removed")]
    assert rows(second.graph.edges) == [("b.rs#0:three", "c.rs#0:four", "Reference")]  # edges at updated symbols go
    third = store.index(files(a="fn one() {}\nfn other() {}", b="fn three() {}", c="fn four() {}", d=None))
    assert third.changes.count() == 0 and [r["version"] for r in store.metadata().orderBy("version").collect()] == [1, 2, 3]
    assert rows(store.ready(files(b="fn three() {}", d="")).symbols.select("id")) == [("b.rs#0:three",)]
    folder = str(tmp_path / "json")
    lifecycle.export_json(g.symbols, folder)
    assert spark.read.text(f"{folder}/symbols").count() == 4 and spark.read.text(f"{folder}/total").first()["value"] == '{"total":4}'


def test_user_functions(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.txt").write_text("a\nb")
    (tmp_path / "y.txt").write_text("bad")

    def lines_of(path, content):
        if content == "bad":
            raise ValueError(path)
        return content.split("\n")

    found = mapping.process_files(mapping.read_files(spark, str(tmp_path)), lines_of, "array<string>")
    assert sorted((r["path"], r["result"], r["error"]) for r in found.collect()) == [("deep/x.txt", ["a", "b"], None), ("y.txt", None, "ValueError: y.txt")]
    df = spark.createDataFrame([(i, None if i == 3 else str(i)) for i in range(5)], "k long, v string")
    assert rows(mapping.filter_map(df, lambda r: r["v"], "string").select("k", "result")) == [(0, "0"), (1, "1"), (2, "2"), (4, "4")]
    with pytest.raises(Exception, match="1 results for 2 rows"):
        mapping.process_chunked(df.coalesce(1), lambda rows: [0], "long", 2).collect()


def test_formats(spark, tmp_path):
    g = build(spark, {"a": ("Function", "f", "x.rs", "fn f()"), "b": ("Class", "C", "y.rs", None)}, [("a", "Reference", "b"), ("a", "Contains", "b")])
    again = formats.from_json(formats.to_json(g))
    assert rows(again.symbols) == rows(g.symbols) and rows(again.edges) == rows(g.edges)
    formats.save(g, f"{tmp_path}/g")
    assert rows(formats.load(spark, f"{tmp_path}/g").edges) == rows(g.edges) and formats.load(spark, f"{tmp_path}/none").symbols.count() == 0
    shown = g.symbols.where("id = 'a'").select(*[formats.formatted(x).alias(x) for x in ("human", "quickfix", "grep", "tsv", "null", "json", "lsp")]).first()
    assert shown["human"] == "f (Function) at x.rs:1:1" and shown["grep"] == "x.rs:1:f" and shown["tsv"] == "x.rs\t1\t1\tFunction\tf" and '"line":0' in shown["lsp"]
    with pytest.raises(ValueError, match="unknown format"):
        formats.formatted("xml")
    lines = formats.numbered(formats.lsif(g)).orderBy("n").collect()
    assert [r["n"] for r in lines] == list(range(1, len(lines) + 1)) and "metaData" in lines[0]["value"] and len(lines) == 2 + 4 + 8
    assert formats.tree_text([("b", "a"), ("c", "a"), ("d", "b")], "a") == "a\n├── b\n│   └── d\n└── c"
    text = spark.createDataFrame([(v,) for v in ('{"id":"1","type":"vertex","label":"document","uri":"file://x.rs"}', '{"id":"2","type":"vertex","label":"range","start":{"line":3,"character":1},"end":{"line":4,"character":0}}', '{"type":"edge","label":"contains","outV":"1","inV":"2"}', '{"type":"edge","label":"textDocument/definition","outV":"2","inV":"9"}', '{"id":"7","type":"vertex","label":"range","start":{"line":3,"character":1},"end":{"line":4,"character":0}}')], "value string")
    assert [(r["id"], r["file_path"], r["start_line"]) for r in formats.read_lsif(text).symbols.collect()] == [("symbol_2", "x.rs", 3)]


def test_upkeep(spark, tmp_path):
    pair = lambda *x: spark.createDataFrame(list(x), "file_path string, id string")
    assert rows(incremental.file_diff(pair(("f", "1"), ("f", "2")), pair(("f", "2"), ("f", "3")))) == [("f", "1", "removed"), ("f", "2", "updated"), ("f", "3", "added")]
    listing = lambda *x: spark.createDataFrame(list(x), "path string, hash string")
    old, new = listing(("a", "1"), ("b", "1"), ("c", "1")), listing(("a", "1"), ("b", "2"), ("d", "1"))
    assert rows(incremental.detect_changes(old, new).select("path", "status")) == [("b", "Modified"), ("c", "Deleted"), ("d", "Added")]
    assert rows(incremental.needs_update(old, new)) == [("a", False), ("b", True), ("d", True)] and incremental.change_ratio(old, new).first()["full"]
    updates = spark.createDataFrame([(1, "added", "f1", ["1", "2"]), (2, "added", "f2", ["3"]), (3, "modified", "f1", ["1"])], "seq long, op string, path string, ids array<string>")
    assert tuple(incremental.batch_totals(pair().limit(0), updates).first()) == (2, 3, 1, 1)
    assert rows(incremental.merged_changes(spark.createDataFrame([("a", "M")], "path string, status string"), spark.createDataFrame([("a", "A"), ("b", "A")], "path string, status string"))) == [("a", "M"), ("b", "A")]


def test_stream_of_updates(spark, tmp_path):
    g = build(spark, {"a": ("Function", "f", "x.rs", None), "b": ("Class", "C", "y.rs", None), "c": ("Class", "D", "z.rs", None)}, [("a", "Reference", "b"), ("b", "Reference", "c")])
    symbols = lambda path, *ids: [(i, "Function", i, path, 0, 0, 1, 0, None, None) for i in ids]
    kind = f"seq long, op string, path string, symbols array<struct<{', '.join(c.replace(' ', ':') for c in SYMBOLS.split(', ')).replace(':', ': ')}>>"
    batch = spark.createDataFrame([(1, "added", "n.rs", symbols("n.rs", "n1")), (2, "modified", "x.rs", symbols("x.rs", "a2")), (3, "removed", "n.rs", [])], kind)
    batch.write.parquet(f"{tmp_path}/in")
    q = incremental.stream_updates(spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck", g)
    q.awaitTermination(120)
    assert q.exception() is None
    out = Graph(spark.read.parquet(f"{tmp_path}/out/symbols/v=1"), spark.read.schema(EDGES).parquet(f"{tmp_path}/out/edges/v=1"))
    assert sorted(r["id"] for r in out.symbols.collect()) == ["a2", "b", "c"] and rows(out.edges) == [("b", "c", "Reference")]
    assert sorted(r["id"] for r in incremental.update_files(g, out.symbols.where("id = 'a2'")).symbols.collect()) == ["a2", "b", "c"]
    assert one(spark, "x").count() == 1


def test_languages_rules(spark):
    from lodestar.functions import languages as L

    g = build(spark, {"a": ("Function", "test_it", "src/net/mod.rs", "impl Foo for Bar"), "b": ("Function", "Serve", "/go/src/github.com/x/y/z.go", "func (s *Server) Serve()"), "c": ("Class", "K", "pkg/sub/mod.py", "class Base: pass"), "d": ("Function", "load", "web/lib/load.ts", "export default function")}, [("a", "Reference", "b")])
    one_of = lambda i, c: g.symbols.where(f"id = '{i}'").select(c.alias("x")).first()["x"]
    assert one_of("a", L.is_test("rust")) and one_of("a", L.parent_scope("rust")) == "Foo" and one_of("a", L.import_statement("rust")) == "use net::mod::test_it;"
    assert one_of("b", L.is_public("go")) and one_of("b", L.parent_scope("go")) == "Server" and one_of("b", L.import_statement("go")) == 'import "github.com/x/y"' and one_of("b", L.doc_url("go")) == "https://pkg.go.dev/github.com/x/y"
    assert one_of("c", L.parent_scope("python")) == "Base" and one_of("c", L.import_statement("python")) == "from pkg.sub.mod import K" and one_of("c", L.relevance("python", "K")) == 3.5
    assert one_of("d", L.import_statement("typescript", "web/app/main.ts")) == "import load from '../lib/load';" and one_of("d", L.import_statement("typescript", "web/lib/x.ts")) == "import load from './load';"
    q = L.parse_query("rust", "pub fn net::serve")
    assert (q.name, q.kind, q.modifiers, q.scope) == ("serve", "Function", ["pub"], "net")
    kinds = spark.createDataFrame([(6, ["INDEX_NEW", "WT_DELETED"]), (99, [])], "k int, f array<string>").select(L.kind_of_server(F.col("k")).alias("k"), L.status_of(F.col("f")).alias("s"))
    assert rows(kinds) == [("Method", "Deleted"), ("Variable", "Untracked")]
    low, high = (g.symbols.where(f"id in ({x})") for x in ("'a', 'b'", "'a'"))
    assert rows(L.first_successful([(1, low), (9, high.withColumn("name", F.lit("n")))]).select("id", "name")) == [("a", "n"), ("b", "Serve")]
    tree = '{"name":"A","kind":5,"range":{"start":{"line":0,"character":0},"end":{"line":9,"character":0}},"children":[{"name":"m","kind":6,"range":{"start":{"line":1,"character":2},"end":{"line":2,"character":0}},"children":[]}]}'
    symbols, edges = L.flattened(spark.createDataFrame([("p.rs", tree)], "path string, root string"))
    assert rows(symbols.select("id", "kind")) == [("p.rs#0:A", "Class"), ("p.rs#1:m", "Method")] and rows(edges) == [("p.rs#0:A", "p.rs#1:m", "Contains")]
    deep = '{"name":"n12","kind":12,"range":{"start":{"line":12,"character":0},"end":{"line":12,"character":1}}}'
    for n in range(11, -1, -1):
        deep = f'{{"name":"n{n}","kind":12,"range":{{"start":{{"line":{n},"character":0}},"end":{{"line":{n},"character":1}}}},"children":[{deep}]}}'
    symbols, edges = L.flattened(spark.createDataFrame([("q.rs", deep)], "path string, root string"))
    assert symbols.count() == 13 and edges.count() == 12
    uses = spark.createDataFrame([("f", "d1", 1, True), ("f", "d2", 5, True), ("f", "u", 7, False), ("g", "v", 8, False)], "name string, id string, place int, is_definition boolean")
    assert rows(L.definitions_and_references(uses)) == [("u", "d2", "Reference")]
    assert "Found 1 matches" in formats.matches_text(spark.createDataFrame([("a", "b")], "x string, y string"), g.symbols)
    many = spark.createDataFrame([("a", "b")] * 1200, "x string, y string")
    assert "Found 1200 matches" in formats.matches_text(many, g.symbols) and "Found 1200 matches" in (short := formats.matches_text(many, g.symbols, 3)) and "Match 4" not in short
    assert formats.tree_text([("b", "a"), ("c", "b"), ("b", "c"), ("d", "a")], "a") == "a\n├── b\n│   └── c\n│       └── b\n└── d"
    assert formats.listed(g.symbols.where("id in ('a', 'b')"), "json").first()["value"].count("{") == 2
    rel = spark.createDataFrame([("r", "users", i) for i in "abcd"], "root_id string, bucket string, symbol_id string")
    assert rows(formats.relations_report(rel, g.symbols, 2)) == [("r", "users", 4, "K, Serve")]


def test_command_line(spark, tmp_path):
    from lodestar.__main__ import run

    code, store = tmp_path / "code", str(tmp_path / "store")
    (code / "target").mkdir(parents=True)
    (code / "a.rs").write_text("fn alpha() {}\npub struct Beta {\n")
    (code / "c.py").write_text("class Gamma:\n    def delta(self):\n")
    (code / "target" / "x.rs").write_text("fn hidden() {}\n")
    assert "symbols_added: 4" in run(spark, ["index", store, str(code)])
    assert run(spark, ["search", store, "alpha"]) == ["a.rs#0:alpha\talpha"]
    assert run(spark, ["search", store, "gam", "--fuzzy"])[0].startswith("c.py#0:Gamma\tGamma\tprefix")
    assert run(spark, ["symbols", store, "c.py", "--format", "grep"]) == ["c.py:1:Gamma", "c.py:2:delta"]
    assert run(spark, ["definition", store, "a.rs:1:3"]) == ["a.rs\t1\t3\ta.rs#0:alpha\ta.rs#0:alpha"]
    assert run(spark, ["references", store, "a.rs:1:3"]) == [] == run(spark, ["calls", store, "a.rs#0:alpha", "--direction", "callers"])
    (code / "a.rs").write_text("fn alpha() {}\nfn main() {}\n")
    assert "a.rs#1:main\tmain" in run(spark, ["search", store, "main", "--project", str(code)])
    assert len(run(spark, ["unused", store])) == 3 and "Function\t2" in run(spark, ["stats", store])
    assert run(spark, ["export", store, str(tmp_path / "out")]) == [f"exported to {tmp_path / 'out'}"] and spark.read.text(str(tmp_path / "out" / "symbols")).count() == 4
