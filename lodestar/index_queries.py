"""Queries of lookups, references, upkeep, formats and user functions; registered with those of lodestar.queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import languages, mapping, names, source, textrefs
from lodestar.operators import analytics, filters, lookup, match, navigate, search, traverse
from lodestar.queries import EVENTS, GRAMS, REACH, SNAPSHOTS, SOURCES, VARIED, files, ids, query, rows_as, snapshots, varied
from lodestar.schema import EDGES, Graph
from lodestar.sources import formats
from lodestar.sources.graphview import SYMBOLS_SQL, Tables, edge, graph, under
from lodestar.streaming import incremental, lifecycle


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few literal rows."""
    cells = [F.struct(*[F.lit(v).alias(c.split()[0]) for v, c in zip(r, schema.split(", "), strict=True)]) for r in rows]
    kind = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in schema.split(", "))
    return spark.range(1).select(F.inline(F.array(*cells).cast(f"array<struct<{kind}>>")))


# Lookups and references.


@query("SELECT id, kind, name, file_path, start_line::INTEGER AS start_line FROM symbols WHERE id = 'part:7'", cte=SYMBOLS_SQL)
def point_lookup(spark, sf):
    return lookup.symbol(graph(spark, sf, "Import").symbols, "part:7").select("id", "kind", "name", "file_path", "start_line")


@query("SELECT id, kind, name FROM symbols WHERE kind IN ('Class', 'Function') AND start_line % 17 = 0", cte=SYMBOLS_SQL)
def symbols_by_ids(spark, sf):
    s = graph(spark, sf, "Import").symbols
    wanted = s.where("kind in ('Class', 'Function') and start_line % 17 = 0").select("id").unionByName(values(spark, [("nobody",)], "id string"))
    return lookup.symbols_of(s, wanted).select("id", "kind", "name")


@query("SELECT id, kind, name, start_line::INTEGER AS start_line FROM symbols WHERE file_path = 'crm/nation_3'", cte=SYMBOLS_SQL)
def file_scan(spark, sf):
    return lookup.in_file(graph(spark, sf, "Import").symbols, "crm/nation_3").select("id", "kind", "name", "start_line")


@query("SELECT id, other, file_path FROM (SELECT dst_id AS id, src_id AS other, s.file_path, row_number() OVER (PARTITION BY dst_id ORDER BY s.file_path, s.start_line, src_id) AS r FROM edges e JOIN symbols s ON s.id = src_id WHERE e.kind = 'Reference' AND starts_with(dst_id, 'part:') AND contains(s.file_path, 'cust_1')) WHERE r <= 3")
def references_with_options(spark, sf):
    g = graph(spark, sf, "Reference")
    return lookup.references_with(g, ids(g, "Function"), "cust_1", 3)


@query("SELECT dst_id AS id, a.file_path, count(*) AS n FROM edges e JOIN symbols a ON a.id = src_id JOIN symbols b ON b.id = dst_id WHERE e.kind = 'Reference' AND a.file_path <> b.file_path GROUP BY ALL")
def references_by_file(spark, sf):
    return lookup.references_by_file(graph(spark, sf, "Reference"))


@query("SELECT DISTINCT 'event:' || event_id AS src_id, first AS dst_id, 'Reference' AS kind FROM (SELECT event_id, arg_min(id, (start_line, id)) AS first FROM events JOIN symbols ON file_path = 'crm/nation_' || (user_id % 25) AND event_id % 1000 BETWEEN start_line AND start_line + 5 GROUP BY 1)", cte=SYMBOLS_SQL)
def cross_file_references(spark, sf):
    places = Tables(spark, sf)["events"].select(under("event:", "event_id").alias("id"), F.concat(F.lit("crm/nation_"), F.col("user_id") % 25).alias("file_path"), (F.col("event_id") % 1000).cast("int").alias("line"))
    return lookup.cross_file_references(graph(spark, sf, "Import").symbols, places)


PLACES = "places AS (SELECT DISTINCT 'root/' || file_path AS path, file_path, start_line + 3 AS line FROM symbols WHERE kind = 'Variable'), found AS (SELECT path, line, arg_min(id, (start_line, id)) AS id FROM places JOIN symbols USING (file_path) WHERE line - 1 BETWEEN start_line AND start_line + 5 GROUP BY ALL)"


def places_of_orders(g: Graph) -> DataFrame:
    return g.symbols.where("kind = 'Variable'").select(F.concat(F.lit("root/"), "file_path").alias("path"), (F.col("start_line") + 3).alias("line"), F.lit(4).alias("char")).distinct()


@query("SELECT path, line::INTEGER AS line, 4 AS char, found.id, coalesce(d.other, found.id) AS definition FROM found LEFT JOIN (SELECT dst_id, min(src_id) AS other FROM edges WHERE kind = 'Definition' GROUP BY 1) d ON d.dst_id = found.id", recursive=PLACES)
def location_definition(spark, sf):
    g = graph(spark, sf, "Definition")
    return lookup.definition_of(g, places_of_orders(g))


@query("SELECT path, line::INTEGER AS line, 4 AS char, id, count(*) AS n FROM found JOIN edges ON dst_id = found.id AND kind = 'Definition' GROUP BY ALL", recursive=PLACES)
def location_references(spark, sf):
    """Definition edges stand in for references, as orders have no incoming ones."""
    g = graph(spark, sf, "Definition")
    as_references = Graph(g.symbols, g.edges.withColumn("kind", F.lit("Reference")))
    return lookup.references_of(as_references, places_of_orders(g)).groupBy("path", "line", "char", "id").agg(rows_as("n"))


@query("SELECT id, file_path AS file, CASE WHEN start_line % 4 IN (1, 2) THEN start_line + 1 ELSE 1 END::INTEGER AS line, CASE start_line % 4 WHEN 2 THEN 5 WHEN 3 THEN 7 ELSE 1 END::INTEGER AS char FROM symbols WHERE kind IN ('Class', 'Function')", cte=SYMBOLS_SQL)
def location_strings(spark, sf):
    """Places of symbols written out, with and without a line and a column, and with a line that is no number."""
    s = graph(spark, sf, "Import").symbols.where("kind in ('Class', 'Function')")
    k, line = F.col("start_line") % 4, (F.col("start_line") + 1).cast("string")
    text = F.when(k == 0, F.col("file_path")).when(k == 1, F.concat_ws(":", "file_path", line)).when(k == 2, F.concat_ws(":", "file_path", line, F.lit("5"))).otherwise(F.concat_ws(":", "file_path", F.lit("y"), F.lit("7")))
    return s.select("id", navigate.location(text).alias("x")).select("id", "x.*")


@query("SELECT dst_id AS id, src_id AS other FROM edges WHERE kind = 'Override'")
def find_overrides(spark, sf):
    return navigate.overrides(graph(spark, sf, "Override"))


@query("SELECT e.src_id AS a, e.dst_id AS b FROM edges e JOIN symbols s ON s.id = e.src_id WHERE e.kind = 'Implementation' AND regexp_matches(s.name, '^[a-m].*(Ring|Bolt)$') AND regexp_matches(s.file_path, '2')")
def pattern_regex(spark, sf):
    return match.match(graph(spark, sf, "Implementation"), "(a:Function {name =~ '^[a-m].*(Ring|Bolt)$', file =~ '2'})-[:Implementation]->(b:Interface)")


@query("SELECT o.src_id AS n0, o.dst_id AS n1, '  Bindings:' || chr(10) || '    n0: ' || a.name || ' (' || a.kind || ')' || chr(10) || '    n1: ' || b.name || ' (' || b.kind || ')' AS text FROM edges o JOIN symbols a ON a.id = src_id JOIN symbols b ON b.id = dst_id WHERE o.kind = 'Import'")
def match_texts(spark, sf):
    g = graph(spark, sf, "Import")
    return formats.match_lines(match.match(g, "(:Namespace)-[:Import]->(:Namespace)"), g.symbols)


# Recursion.


#: Each event with its place among its user's.
PLACED = "placed AS (SELECT 'event:' || event_id AS id, user_id, row_number() OVER w AS r, 'event:' || lag(event_id) OVER w AS before, 'event:' || lead(event_id) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), lone AS (SELECT DISTINCT src_id, dst_id FROM edges WHERE kind = 'Reference' AND starts_with(src_id, 'order:'))"


@query("SELECT a.id AS root, b.id AS node, CASE WHEN b.r < a.r THEN b.after ELSE b.before END AS parent, abs(a.r - b.r)::INTEGER AS depth, CASE WHEN b.r < a.r THEN 'outgoing' ELSE 'incoming' END AS direction FROM placed a JOIN placed b ON a.user_id IS NOT DISTINCT FROM b.user_id AND a.r <> b.r UNION ALL SELECT src_id, dst_id, src_id, 1, 'outgoing' FROM lone UNION ALL SELECT dst_id, src_id, dst_id, 1, 'incoming' FROM lone", recursive=PLACED)
def full_calls(spark, sf):
    """Of every symbol, with callers and callees at any depth."""
    g = graph(spark, sf, "Reference")
    return analytics.full_calls(g, g.symbols.select("id"), traverse.UNBOUNDED)


@query("SELECT id AS src, p2 AS dst, id || '>' || p1 || '>' || p2 AS path FROM ev WHERE p2 IS NOT NULL UNION ALL SELECT id, id, id FROM ev WHERE p2 IS NOT NULL", cte=EVENTS)
def call_paths_between(spark, sf):
    """From each event to the second one before it, and to itself."""
    g = graph(spark, sf, "Reference")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    far = Tables(spark, sf)["events"].select(under("event:", "event_id").alias("src"), F.concat(F.lit("event:"), F.lag("event_id", 2).over(w)).alias("dst")).where("dst is not null")
    return analytics.call_paths(g, far.unionByName(far.select("src", F.col("src").alias("dst"))), 2).withColumn("path", F.array_join("path", ">"))


PATH_EXISTS = "SELECT a.id AS src, b.id AS dst, a.id = b.id OR EXISTS (SELECT 1 FROM reached WHERE s = a.id AND n = b.id) AS found FROM (SELECT id FROM symbols WHERE kind = 'Namespace' UNION ALL SELECT 'nobody') a, (SELECT id FROM symbols WHERE kind = 'Namespace' UNION ALL SELECT 'nobody') b"


@query(PATH_EXISTS, recursive=REACH)
def definition_path_exists(spark, sf):
    g = graph(spark, sf, "Import")
    n = ids(g, "Namespace").unionByName(values(spark, [("nobody",)], "id string"))
    pairs = n.select(F.col("id").alias("src")).crossJoin(n.select(F.col("id").alias("dst")))  # 26 by 26
    return traverse.has_path(g.of_kind("Import"), pairs)


@query("SELECT dst_id AS root_id, 'users' AS bucket, count(*) AS n, array_to_string(list_slice(list(s.name ORDER BY s.name, s.id), 1, 5), ', ') AS first FROM edges e JOIN symbols s ON s.id = src_id WHERE e.kind = 'Reference' AND starts_with(dst_id, 'customer:') GROUP BY 1")
def type_relations_report(spark, sf):
    g = graph(spark, sf, "Reference")
    return formats.relations_report(analytics.related_symbols(g, ids(g, "Class")), g.symbols)


@query("SELECT dst_id AS root_id, CASE WHEN c % 4 = 0 THEN 'methods' WHEN c % 4 = 1 THEN 'members' WHEN c % 4 = 2 THEN 'implementations' ELSE 'extensions' END AS bucket, count(*) AS n FROM (SELECT dst_id, split_part(src_id, ':', 2)::BIGINT AS c FROM edges WHERE kind = 'Implementation') GROUP BY ALL")
def type_relations_buckets(spark, sf):
    """Parts as methods, fields and classes of their suppliers; of the classes half by Definition."""
    g = graph(spark, sf, "Implementation")
    key = F.substring_index(F.col("id"), ":", -1).cast("long") % 4
    kinds = g.symbols.withColumn("kind", F.when(F.col("kind") == "Function", F.when(key == 0, "Method").when(key == 1, "Field").otherwise("Class")).otherwise(F.col("kind")))
    by = F.when(F.substring_index(F.col("src_id"), ":", -1).cast("long") % 4 == 3, "Definition").otherwise(F.col("kind"))
    return analytics.type_relations(Graph(kinds, g.edges.withColumn("kind", by)), ids(g, "Interface"))


LIVE_NAMES = "named AS (SELECT id, CASE split_part(id, ':', 2)::BIGINT % 40 WHEN 0 THEN 'main' WHEN 7 THEN 'x::main' WHEN 14 THEN 'pub f' WHEN 21 THEN 'my_test' ELSE 'f' END AS name FROM symbols WHERE kind IN ('Variable', 'Class', 'Function')), step AS (SELECT src_id AS a, dst_id AS b FROM edges WHERE kind IN ('Reference', 'Definition')), live(id) AS (SELECT id FROM named WHERE name <> 'f' UNION SELECT b FROM live JOIN step ON a = id)"


@query("SELECT id FROM named WHERE id NOT IN (SELECT id FROM live)", recursive=LIVE_NAMES)
def dead_by_entry_names(spark, sf):
    g = graph(spark, sf, "Reference", "Definition")
    key = F.substring_index("id", ":", -1).cast("long") % 40
    named = g.symbols.where("kind in ('Variable', 'Class', 'Function')").withColumn("name", F.when(key == 0, "main").when(key == 7, "x::main").when(key == 14, "pub f").when(key == 21, "my_test").otherwise("f"))
    return analytics.dead(Graph(named, g.edges))


@query("SELECT id, importance_score FROM (SELECT s.id, round((1.0 + CASE WHEN x.src_id IS NOT NULL THEN 2.0 ELSE 0.0 END + ln(coalesce(n, 0) + 1)) * CASE kind WHEN 'Module' THEN 2.0 WHEN 'Class' THEN 1.8 WHEN 'Interface' THEN 1.8 WHEN 'Function' THEN 1.5 WHEN 'Method' THEN 1.5 WHEN 'Variable' THEN 1.0 ELSE 0.8 END, 4)::DOUBLE AS importance_score FROM symbols s LEFT JOIN (SELECT DISTINCT src_id FROM edges WHERE kind = 'Export') x ON x.src_id = id LEFT JOIN (SELECT dst_id, count(*) AS n FROM edges WHERE kind = 'Reference' GROUP BY 1) r ON r.dst_id = id) ORDER BY importance_score DESC, id LIMIT 50")
def public_api_ranked(spark, sf):
    api = analytics.public_api(graph(spark, sf, "Reference", "Export"), source.visibility("python", F.col("name"), F.col("detail")))
    return analytics.ranked_api(api, 50).select("id", "importance_score")


# Searches.


@query("SELECT id, name, CASE WHEN lower(name) = 'small' THEN 'Exact' WHEN starts_with(lower(name), 'small') THEN 'Prefix' ELSE 'CamelCase' END AS match_type, CASE WHEN lower(name) = 'small' THEN 100.0 WHEN starts_with(lower(name), 'small') THEN 80.0 ELSE 70.0 END::DOUBLE AS score FROM symbols WHERE kind = 'Function' AND (starts_with(lower(name), 'small') OR list_contains(string_split(lower(regexp_replace(name, '([^A-Z])([A-Z])', '\\1 \\2', 'g')), ' '), 'small'))", cte=SYMBOLS_SQL)
def search_by_kind(spark, sf):
    return search.search_by_kind(graph(spark, sf, "Import").symbols, "small", "func", None)


@query("SELECT DISTINCT name, array_to_string(CASE WHEN strlen(name) >= 3 THEN list_transform(range(1, length(name) - 1), lambda i: substr(name, i, 3)) ELSE [] END, '|') AS grams FROM symbols WHERE kind IN ('Function', 'Parameter')", cte=SYMBOLS_SQL)
def plain_ngrams(spark, sf):
    s = graph(spark, sf, "Import").symbols.where("kind in ('Function', 'Parameter')").select("name").distinct()
    return s.select("name", F.array_join(names.plain_grams(F.col("name"), 3), "|").alias("grams"))


def _mean(parts: str) -> str:
    return f"(SELECT round(count(*) / count(DISTINCT p), 4) FROM (SELECT unnest({parts}) AS p FROM symbols WHERE kind = 'Function'))"


@query(f"SELECT {_mean('[lower(name)]')} AS names, {_mean(GRAMS.format(c='lower(name)', n=2))} AS bigrams, {_mean(GRAMS.format(c='lower(name)', n=3))} AS trigrams, {_mean('list_transform(range(1, least(length(name), 5) + 1), lambda i: substr(lower(name), 1, i))')} AS prefixes, {_mean('list_distinct(list_transform(regexp_extract_all(name, chr(91) || $$A-Z]?[a-z]+|[A-Z]+|[0-9]+$$), lambda w: lower(w)))')} AS words", cte=SYMBOLS_SQL)
def index_averages(spark, sf):
    return search.index_averages(graph(spark, sf, "Import").symbols.where("kind = 'Function'"))


@query("SELECT name, exact, exact < 3 OR strlen(name) <= 3 OR (name = upper(name) AND name <> lower(name)) AS needed FROM (SELECT name, count(*) AS exact FROM symbols GROUP BY 1)", cte=SYMBOLS_SQL)
def fuzzy_needed(spark, sf):
    """Whether a search for each name, of which so many symbols have it, needs more than equality."""
    counted = graph(spark, sf, "Import").symbols.groupBy("name").agg(rows_as("exact"))
    return counted.select("name", "exact", search.fuzzy_needed(F.col("name"), F.col("exact")).alias("needed"))


# Languages.


@query("""SELECT id, name <> '__x' AND name <> '_y' AND name <> '__init__' AND NOT coalesce(contains(detail, 'pub(crate)'), false) AS rust_public, name NOT IN ('__x', '_y') AS python_public, name = 'Zed' AS go_public,
  detail IS NULL OR contains(detail, 'export') OR contains(detail, 'public') OR NOT (contains(detail, 'private') OR contains(detail, 'protected')) AS typescript_public, coalesce(contains(detail, '#[test]'), false) OR name = 'test_z' AS rust_test, name = 'test_z' AS python_test, false AS go_test, contains(name, 'test') AS typescript_test,
  CASE WHEN detail = 'impl Thing {' THEN 'Thing' WHEN parse_filename(file_path) NOT IN ('mod', 'lib', 'main') THEN parse_filename(file_path) END AS rust_scope, CASE WHEN detail = 'func (s *Set) f' THEN 'Set' END AS go_scope, CASE WHEN contains(detail, 'class ') THEN CASE WHEN contains(detail, 'Base') THEN 'Base' ELSE 'C' END END AS python_scope FROM varied""", cte=SYMBOLS_SQL, recursive=VARIED)
def language_rules(spark, sf):
    public = [languages.is_public(x).alias(f"{x}_public") for x in ("rust", "python", "go", "typescript")]
    tests = [languages.is_test(x).alias(f"{x}_test") for x in ("rust", "python", "go", "typescript")]
    return varied(spark, sf).select("id", *public, *tests, *[languages.parent_scope(x).alias(f"{x}_scope") for x in ("rust", "go", "python")])


@query("SELECT id, round(1.5 + CASE WHEN name = 'Zed' THEN 2.0 ELSE 0 END - CASE WHEN name IN ('__init__', '__x', '_y') OR contains(detail, 'pub(crate)') THEN 0.5 ELSE 0 END - CASE WHEN name = 'test_z' OR contains(detail, '#[test]') THEN 0.5 ELSE 0 END + CASE WHEN contains(detail, 'impl') THEN 0.5 ELSE 0 END, 4)::DOUBLE AS rust, round(1.0 + CASE WHEN name = 'Zed' THEN 2.0 ELSE 0 END + CASE WHEN contains(detail, 'export') THEN 0.5 ELSE 0 END - CASE WHEN contains(name, 'test') THEN 0.5 ELSE 0 END + CASE WHEN contains(detail, 'export default') THEN 0.3 ELSE 0 END + CASE WHEN kind = 'Class' AND contains(detail, 'React') THEN 0.3 ELSE 0 END, 4)::DOUBLE AS typescript FROM varied JOIN (SELECT id, kind FROM symbols) USING (id)", cte=SYMBOLS_SQL, recursive=VARIED)
def language_scores(spark, sf):
    rust = languages.relevance("rust", "impl Zed").alias("rust")
    s = varied(spark, sf).withColumn("plain", F.col("name"))
    # The query's words choose the bonuses; its name is compared as it stands.
    return s.select("id", (rust + F.when(F.col("name") == "Zed", 2.0).otherwise(0.0)).alias("rust"), languages.relevance("typescript", "Zed").alias("typescript"))


PATHS = "paths AS (SELECT p_partkey AS k, p_partkey % 5 AS x, lower(replace(p_brand, '#', '')) AS b FROM part)"


@query("SELECT k, CASE WHEN x = 0 THEN 'https://pypi.org/project/' || b || '/' END AS python, CASE x WHEN 1 THEN 'https://www.npmjs.com/package/@types/@types/' || b WHEN 2 THEN 'https://www.npmjs.com/package/' || b END AS typescript, CASE WHEN x = 3 THEN 'https://pkg.go.dev/github.com/a/' || b END AS go FROM paths", cte=PATHS)
def documentation_urls(spark, sf):
    """Of brands as packages, in the places where each language keeps them."""
    b, x = F.lower(F.translate("p_brand", "#", "")), F.col("p_partkey") % 5
    path = F.when(x == 0, F.concat(F.lit("site-packages/"), b, F.lit("/core.py"))).when(x == 1, F.concat(F.lit("a/node_modules/@types/"), b, F.lit("/fs.d.ts"))).when(x == 2, F.concat(F.lit("node_modules/"), b, F.lit("/index.js"))).when(x == 3, F.concat(F.lit("x/src/github.com/a/"), b, F.lit("/c.go"))).otherwise(F.concat(F.lit("plain_"), b, F.lit(".py")))
    paths = Tables(spark, sf)["part"].select(F.col("p_partkey").alias("k"), path.alias("file_path"))
    return paths.select("k", *[languages.doc_url(n).alias(n) for n in ("python", "typescript", "go")])


@query("SELECT k, n AS name, CASE l WHEN 0 THEN 'Function' WHEN 1 THEN 'Class' WHEN 2 THEN 'TypeAlias' ELSE 'Interface' END AS kind, CASE l WHEN 0 THEN 'pub' WHEN 1 THEN 'async' WHEN 2 THEN 'const' ELSE 'export' END AS modifiers, CASE l WHEN 0 THEN 'a::b' || k WHEN 2 THEN 'p' WHEN 3 THEN 'N' END AS scope FROM code", cte=SOURCES)
def query_words(spark, sf):
    """Searches for the parts' names in the words of four languages."""
    n = F.concat(F.substring_index("p_name", " ", 1), F.lit("_"), F.substring_index("p_name", " ", -1))
    k = F.col("p_partkey")
    rows = Tables(spark, sf)["part"].select(k.alias("k"), (k % 4).alias("l"), n.alias("n"))
    asked = [("rust", F.concat(F.lit("pub fn a::b"), "k", F.lit("::"), "n")), ("python", F.concat(F.lit("async  class "), "n")), ("go", F.concat(F.lit("const type p."), "n")), ("typescript", F.concat(F.lit("export interface N."), "n"))]
    out = None
    for i, (language, text) in enumerate(asked):
        x = rows.where(F.col("l") == i).select("k", languages.query_columns(language, text).alias("q")).select("k", "q.name", "q.kind", F.array_join("q.modifiers", ",").alias("modifiers"), "q.scope")
        out = x if out is None else out.unionByName(x)
    return out


@query("SELECT n_nationkey AS number, CASE WHEN n_nationkey BETWEEN 1 AND 26 THEN list_extract(['File', 'Module', 'Namespace', 'Package', 'Class', 'Method', 'Property', 'Field', 'Constructor', 'Enum', 'Interface', 'Function', 'Variable', 'Constant', 'String', 'Number', 'Boolean', 'Array', 'Object', 'Key', 'Null', 'EnumMember', 'Struct', 'Event', 'Operator', 'TypeParameter'], n_nationkey) ELSE 'Variable' END AS kind FROM nation", cte=None)
def server_kinds(spark, sf):
    n = F.col("n_nationkey")
    return Tables(spark, sf)["nation"].select(n.alias("number"), languages.kind_of_server(n).alias("kind"))


@query("SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'Added' WHEN 1 THEN 'Modified' WHEN 2 THEN 'Deleted' WHEN 3 THEN 'Modified' WHEN 4 THEN 'Untracked' ELSE 'Added' END AS status FROM part", cte=None)
def git_statuses(spark, sf):
    flags = F.array(*[F.array(*[F.lit(x) for x in own]).cast("array<string>") for own in (("WT_NEW",), ("INDEX_NEW", "WT_MODIFIED"), ("WT_DELETED",), ("WT_RENAMED",), ("IGNORED",), ("INDEX_NEW", "INDEX_MODIFIED"))])
    return Tables(spark, sf)["part"].select(F.col("p_partkey").alias("k"), languages.status_of(F.element_at(flags, (1 + F.col("p_partkey") % 6).cast("int"))).alias("status"))


@query("SELECT p_partkey AS k, p_partkey % 5 = 0 AS rust, p_partkey % 5 = 1 AS typescript, p_partkey % 5 = 2 AS python, p_partkey % 5 = 3 AS go FROM part", cte=None)
def skipped_files(spark, sf):
    path = F.element_at(F.array(*[F.lit(x) for x in ("target/debug/a.rs", "node_modules/x/y.ts", "a/__pycache__/m.py", "pkg/x_test.go", "src/plain.txt")]), (1 + F.col("p_partkey") % 5).cast("int"))
    return Tables(spark, sf)["part"].withColumn("file_path", path).select(F.col("p_partkey").alias("k"), *[filters.skipped(x).alias(x) for x in ("rust", "typescript", "python", "go")])


SCANNED = ("a/b.rs", "node_modules/x.ts", ".idea/c.js", "tmp/d.tsx", "x/target/e.rs", ".hidden/f.rs", "g.py")


@query("SELECT p_partkey AS k, p_partkey % 7 = 0 OR p_partkey % 7 = 5 AS \"all\", p_partkey % 7 IN (0, 2, 3, 5) AS \"references\", p_partkey % 7 = 0 AS rust FROM part", cte=None)
def directory_scans(spark, sf):
    path = F.concat(F.lit("p/"), F.element_at(F.array(*[F.lit(x) for x in SCANNED]), (1 + F.col("p_partkey") % 7).cast("int")))
    listed = Tables(spark, sf)["part"].select(F.col("p_partkey").alias("k"), path.alias("path"))
    out = listed.select("k")
    for kind in source.SCANS:
        out = out.join(source.scan(listed, kind).select("k", F.lit(True).alias(kind)), "k", "left")
    return out.select("k", *[F.coalesce(kind, F.lit(False)).alias(kind) for kind in source.SCANS])


@query("SELECT unnest(['src/lib.rs', 'lib.rs', 'src/index.js']) AS id UNION ALL (SELECT DISTINCT 'src/bin/' || lower(translate(p_brand, '#', '_')) || '.rs' FROM part ORDER BY 1 LIMIT 5)", cte=None)
def crawl_entries(spark, sf):
    fixed = values(spark, [(x,) for x in ("main.go", "src/index.js", "lib.rs", "src/lib.rs", "src/bin/deep/x.rs", "src/bin/y.py")], "path string")
    bins = Tables(spark, sf)["part"].select(F.concat(F.lit("src/bin/"), F.lower(F.translate("p_brand", "#", "_")), F.lit(".rs")).alias("path"))
    return source.crawl_entries(fixed.unionByName(bins))


@query("SELECT path, line::INTEGER AS line, n AS name FROM rows WHERE l IN (0, 2)", cte=SOURCES)
def pattern_catalogue(spark, sf):
    return source.catalogued(files(spark, sf), "Function")


#: Projects by size of part and brand; a file for each part, and marker files in some.
PROJECTS = "projects AS (SELECT p_size AS size, p_brand AS brand, CASE p_partkey % 11 WHEN 0 THEN 'go.mod' WHEN 1 THEN 'pom.xml' WHEN 2 THEN 'read.me' ELSE 'f' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN '.java' WHEN 1 THEN '.go' WHEN 2 THEN '.py' WHEN 3 THEN '.txt' ELSE '.tsx' END END AS path FROM part)"


@query("SELECT size, brand, arg_min(l, r) AS language FROM (SELECT size, brand, CASE WHEN path = 'go.mod' THEN 4 WHEN path = 'pom.xml' THEN 5 WHEN path LIKE '%.tsx' THEN 102 WHEN path LIKE '%.py' THEN 103 WHEN path LIKE '%.go' THEN 104 WHEN path LIKE '%.java' THEN 105 END AS r, CASE r WHEN 4 THEN 'go' WHEN 5 THEN 'java' WHEN 102 THEN 'typescript' WHEN 103 THEN 'python' WHEN 104 THEN 'go' WHEN 105 THEN 'java' END AS l FROM projects) WHERE r IS NOT NULL GROUP BY ALL", cte=PROJECTS)
def project_language(spark, sf):
    k = F.col("p_partkey")
    ends = F.when(k % 5 == 0, ".java").when(k % 5 == 1, ".go").when(k % 5 == 2, ".py").when(k % 5 == 3, ".txt").otherwise(".tsx")
    path = F.when(k % 11 == 0, "go.mod").when(k % 11 == 1, "pom.xml").when(k % 11 == 2, "read.me").otherwise(F.concat(F.lit("f"), k, ends))
    return source.project_language(Tables(spark, sf)["part"].select(F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), path.alias("path")), "size", "brand")


TEMPLATE = ("let a = N;", "    fn N() {", "/* N", "N */ N::new(\"N\", r\"N\") // N", "let s = \"open N", "N + N + xN", "r#\"N \" N\"# N 'a' N", "")

@query("SELECT 'p' || k || '.rs' AS path, h.line, h.char::INTEGER AS char, h.def AS is_definition FROM code, LATERAL (SELECT * FROM (VALUES (0, 8, false), (1, 7, true), (3, length(n) + 4, false), (5, 0, false), (5, length(n) + 3, false), (6, 2 * length(n) + 9, false), (6, 3 * length(n) + 14, false)) AS v(line, char, def)) h WHERE n = 'small_ring'", cte=SOURCES)
def references_in_code(spark, sf):
    """Places outside comments over several lines, strings, raw strings and strings that a line's end leaves open."""
    n = F.concat(F.substring_index("p_name", " ", 1), F.lit("_"), F.substring_index("p_name", " ", -1))
    text = Tables(spark, sf)["part"].select(F.concat(F.lit("p"), "p_partkey", F.lit(".rs")).alias("path"), F.replace(F.lit("\n".join(TEMPLATE)), F.lit("N"), n).alias("content"))
    return textrefs.find_references(text, "small_ring", "Struct")


# Trees and strategies.


@query("SELECT 'Module' AS kind, count(*) AS n, 0::BIGINT AS held FROM region UNION ALL SELECT 'Namespace', count(*), count(*) FROM nation UNION ALL SELECT 'Class', count(*), count(*) FROM customer", cte=None)
def document_symbols(spark, sf):
    """Regions, nations and customers as nested symbols of a language server, flattened."""
    t = Tables(spark, sf)
    at = lambda c: F.struct(F.struct(F.col(c).alias("line"), F.lit(0).alias("character")).alias("start"), F.struct((F.col(c) + 5).alias("line"), F.lit(10).alias("character")).alias("end")).alias("range")
    leaf = t["customer"].select("c_nationkey", F.struct(F.col("c_name").alias("name"), F.lit(5).alias("kind"), at("c_custkey")).alias("x"))
    nations = t["nation"].join(leaf.groupBy("c_nationkey").agg(F.collect_list("x").alias("children")), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    nation = nations.select("n_regionkey", F.struct(F.col("n_name").alias("name"), F.lit(3).alias("kind"), at("n_nationkey"), "children").alias("x"))
    regions = t["region"].join(nation.groupBy("n_regionkey").agg(F.collect_list("x").alias("children")), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    trees = regions.select(F.concat(F.lit("geo/"), "r_regionkey").alias("path"), F.to_json(F.struct(F.col("r_name").alias("name"), F.lit(2).alias("kind"), at("r_regionkey"), "children")).alias("root"))
    symbols, edges = languages.flattened(trees)
    held = symbols.join(edges.select(F.col("dst_id").alias("id"), F.lit(1).alias("h")), "id", "left")
    return held.groupBy("kind").agg(rows_as("n"), F.count("h").alias("held"))


@query("SELECT 'part:' || k AS src_id, 'part:' || d AS dst_id, 'Reference' AS kind FROM code JOIN (SELECT n, max(k) AS d FROM code WHERE k % 3 = 0 GROUP BY 1) USING (n) WHERE k % 3 <> 0", cte=SOURCES)
def name_references(spark, sf):
    n = F.concat(F.substring_index("p_name", " ", 1), F.lit("_"), F.substring_index("p_name", " ", -1))
    rows = Tables(spark, sf)["part"].select(n.alias("name"), under("part:", "p_partkey").alias("id"), F.col("p_partkey").alias("place"), (F.col("p_partkey") % 3 == 0).alias("is_definition"))
    return languages.definitions_and_references(rows)


@query("SELECT id, file_path, CASE WHEN contains(file_path, '1') THEN 95 WHEN contains(file_path, '2') THEN 50 ELSE 10 END AS priority FROM symbols WHERE kind = 'Function' AND (NOT contains(file_path, '1') OR start_line % 2 = 0)", cte=SYMBOLS_SQL)
def strategy_chain(spark, sf):
    s = graph(spark, sf, "Import").symbols.where("kind = 'Function'").select("id", "file_path", "start_line")
    tries = [(10, s), (95, s.where("file_path like '%1%' and start_line % 2 = 0")), (50, s.where("file_path like '%2%' and file_path not like '%1%'"))]
    return languages.first_successful([(p, df.withColumn("priority", F.lit(p))) for p, df in tries]).select("id", "file_path", "priority")


# Upkeep.

UPDATED = """old AS (SELECT id, path AS file_path, k, k % 10 = 1 AS entry FROM snap WHERE k % 7 <> 0), new AS (SELECT id, path AS file_path, k, k % 10 = 1 AS entry FROM snap WHERE k % 5 <> 0 AND path LIKE 'cat/Brand#1%'),
after AS (SELECT * FROM old WHERE file_path NOT LIKE 'cat/Brand#1%' UNION ALL SELECT * FROM new),
step AS (SELECT a.id AS a, b.id AS b FROM old a JOIN old b ON b.k = a.k + 1 OR b.k = a.k + 25 WHERE a.file_path NOT LIKE 'cat/Brand#1%' AND b.file_path NOT LIKE 'cat/Brand#1%'),
live(id) AS (SELECT id FROM after WHERE entry UNION SELECT b FROM live JOIN step ON a = id)"""


@query("""SELECT file_path, id, 'added' AS op FROM new WHERE id NOT IN (SELECT id FROM old) UNION ALL SELECT file_path, id, 'updated' FROM new WHERE id IN (SELECT id FROM old)
  UNION ALL SELECT file_path, id, unnest(['removed', 'dead']) FROM old WHERE file_path LIKE 'cat/Brand#1%' AND id NOT IN (SELECT id FROM new) UNION ALL SELECT file_path, id, 'dead' FROM after WHERE id NOT IN (SELECT id FROM live)""", cte=SNAPSHOTS, recursive=UPDATED)
def update_file_results(spark, sf):
    """All files of some brands are updated at once."""
    key, name = F.col("p_partkey"), F.when(F.col("p_partkey") % 10 == 1, "main").otherwise("f")
    rows = Tables(spark, sf)["part"].select(F.concat(F.lit("cat/"), "p_brand").alias("file_path"), under("part:", "p_partkey").alias("id"), F.lit("Function").alias("kind"), name.alias("name"), key.alias("k"))
    old, touched = rows.where("k % 7 <> 0"), F.col("file_path").startswith("cat/Brand#1")
    far = lambda n: edge(old.select("id", (F.col("k") + n).alias("j")).join(old.select(F.col("k").alias("j"), F.col("id").alias("to")), "j"), F.col("id"), F.col("to"), "Reference")
    g = Graph(old.drop("k"), far(1).unionByName(far(25)))
    new = rows.where((F.col("k") % 5 != 0) & touched).drop("k")
    return lifecycle.update_results(g, rows.where(touched).select("file_path"), new)[1]


@query("SELECT count(*) AS updates, sum(p_size)::BIGINT AS total_added, sum(p_size % 7)::BIGINT AS total_removed, sum(p_size % 3)::BIGINT AS total_updated, arg_max(p_size % 11, p_partkey)::BIGINT AS total_dead FROM part", cte=None)
def update_totals(spark, sf):
    p = Tables(spark, sf)["part"]
    return lifecycle.fold_totals(p.select(F.col("p_partkey").alias("seq"), F.col("p_size").alias("added"), (F.col("p_size") % 7).alias("removed"), (F.col("p_size") % 3).alias("updated"), (F.col("p_size") % 11).alias("dead")))


CHANGED = """was AS (SELECT path || '#' || line || ':' || n AS id, path FROM rows), now AS (SELECT path || '#' || (row_number() OVER (PARTITION BY path ORDER BY k) - 1) || ':' || n AS id, path FROM texts WHERE l <> 2 OR k % 3 <> 0), changed AS (SELECT DISTINCT path FROM texts WHERE l = 2 AND k % 3 = 0)"""


@query("SELECT coalesce(w.path, x.path) AS file_path, coalesce(w.id, x.id) AS id, CASE WHEN w.id IS NULL THEN 'added' WHEN x.id IS NULL THEN 'removed' ELSE 'updated' END AS op FROM (SELECT * FROM was WHERE path IN (FROM changed)) w FULL OUTER JOIN (SELECT * FROM now WHERE path IN (FROM changed)) x ON w.id = x.id", cte=SOURCES, recursive=CHANGED)
def differential_index(spark, sf):
    """Python files lose a third of their lines; a full index before, a differential one after."""
    first = lifecycle.full_reindex(files(spark, sf))
    return lifecycle.index_differential(first.graph, first.files, changed_files(spark, sf)).diff


def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    p = Tables(spark, sf)["part"]
    return files(spark, sf, p.where("p_partkey % 4 <> 2 or p_partkey % 3 <> 0"))


@query("SELECT 0::BIGINT AS files_added, (SELECT count(*) FROM changed WHERE path IN (SELECT path FROM now)) AS files_modified, false AS \"full\", (SELECT count(*) FROM now) AS symbols", cte=SOURCES, recursive=CHANGED)
def index_summary(spark, sf):
    first = lifecycle.full_reindex(files(spark, sf))
    done = lifecycle.index_differential(first.graph, first.files, changed_files(spark, sf))
    n = done.graph.symbols.agg(F.count(F.lit(1)).alias("symbols"))
    return done.summary().select("files_added", "files_modified", "full").crossJoin(n)  # one row each


def new_folder(spark: SparkSession) -> str:
    from lodestar.plans.tables import materialized

    materialized(spark.range(0))  # names the shared folder if nothing has yet
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/store-{uuid.uuid4().hex}"


@query("SELECT 1::BIGINT AS version, count(DISTINCT path) AS files_count, count(*) AS symbols_count FROM rows UNION ALL SELECT 2, (SELECT count(DISTINCT path) FROM now), (SELECT count(*) FROM now)", cte=SOURCES, recursive=CHANGED)
def index_versions(spark, sf):
    """Metadata of a store that is indexed three times; the third run finds no change and writes nothing."""
    store = lifecycle.Store(spark, new_folder(spark))
    store.index(files(spark, sf))
    store.index(changed_files(spark, sf))
    store.index(changed_files(spark, sf))
    return store.metadata().select("version", "files_count", "symbols_count")


@query("SELECT id, path AS file_path FROM now", cte=SOURCES, recursive=CHANGED)
def index_ready(spark, sf):
    """A store's graph is brought up to date before it is used."""
    store = lifecycle.Store(spark, new_folder(spark))
    store.index(files(spark, sf), full=True)
    return store.ready(changed_files(spark, sf)).symbols.select("id", "file_path")


@query("SELECT path, hash FROM (SELECT unnest(['symbols', 'edges', 'files', 'metadata']) AS path, true AS hash)", cte=None)
def store_tables(spark, sf):
    store = lifecycle.Store(spark, new_folder(spark))
    if store.tables() or store.current() is not None:
        raise ValueError("a new store has no tables")
    store.save(graph(spark, sf, "Import"), values(spark, [("a", "1")], "path string, hash string"))
    return values(spark, [(t, True) for t in store.tables()], "path string, hash boolean")


@query("SELECT kind, count(*) AS n FROM edges WHERE kind IN ('Contains', 'Import') GROUP BY 1 UNION ALL SELECT kind, count(*) FROM symbols GROUP BY 1")
def save_and_load(spark, sf):
    folder = new_folder(spark)
    formats.save(graph(spark, sf, "Contains", "Import"), folder)
    g, empty = formats.load(spark, folder), formats.load(spark, f"{folder}-none")
    count = lambda df: df.groupBy("kind").agg(rows_as("n"))
    return count(g.edges).unionByName(count(g.symbols)).unionByName(count(empty.edges)).unionByName(count(empty.symbols))


@query("SELECT kind, count(*) AS n FROM symbols WHERE file_path <> 'crm/nation_3' AND kind <> 'Module' GROUP BY 1 UNION ALL SELECT 'Module', count(*) FROM region", cte=SYMBOLS_SQL)
def batch_updates(spark, sf):
    """Clears a file, removes the namespaces' ids but those that come again, and adds modules anew."""
    g = graph(spark, sf, "Contains")
    modules = g.symbols.where("kind = 'Module'")
    batch = lifecycle.Batch(values(spark, [("crm/nation_3",)], "file_path string"), modules.select("id"), modules)
    return batch.apply(g).symbols.groupBy("kind").agg(rows_as("n"))


@query("SELECT (SELECT count(*) FROM region) AS symbols_to_add, (SELECT count(*) FROM nation) AS symbols_to_remove, 1::BIGINT AS files_to_clear", cte=None)
def batch_stats(spark, sf):
    s = graph(spark, sf, "Import").symbols
    return lifecycle.Batch(values(spark, [("x",)], "file_path string"), s.where("kind = 'Namespace'").select("id"), s.where("kind = 'Module'")).stats()


@query("SELECT op, id, file_path FROM (SELECT *, row_number() OVER (PARTITION BY op ORDER BY id) AS r FROM (SELECT path AS file_path, id, CASE WHEN k % 7 = 0 AND k % 5 <> 0 THEN 'added' WHEN k % 5 = 0 AND k % 7 <> 0 THEN 'removed' END AS op FROM snap) WHERE op IS NOT NULL) WHERE r <= 20", cte=SNAPSHOTS)
def change_samples(spark, sf):
    old, new = snapshots(spark, sf)
    all_columns = lambda df: df.select("id", "file_path", F.lit("f").alias("name"), F.lit("Function").alias("kind"), F.lit(0).alias("start_line"))
    return lifecycle.samples(all_columns(old).unionByName(all_columns(new)), incremental.file_diff(old, new)).select("op", "id", "file_path")


@query("SELECT event_type AS operation, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(avg(CASE WHEN value > 50 THEN 1 ELSE 0 END), 6) AS success_rate FROM events GROUP BY 1", cte=None)
def operation_metrics(spark, sf):
    e = Tables(spark, sf)["events"].select(F.col("event_type").alias("operation"), F.col("value").alias("duration"), (F.col("value") > 50).alias("success"))
    return lifecycle.metrics(e).withColumn("mean", F.round("mean", 6)).withColumn("success_rate", F.round("success_rate", 6))


@query("SELECT 'docs/' || doc_id AS path, 'Modified' AS status FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'docs/' || doc_id, 'Added' FROM documents WHERE doc_id % 5 = 0 AND doc_id % 3 <> 0", cte=None)
def merged_changes(spark, sf):
    d = Tables(spark, sf)["documents"]
    of = lambda n, status: d.where(F.col("doc_id") % n == 0).select(F.concat(F.lit("docs/"), "doc_id").alias("path"), F.lit(status).alias("status"))
    return incremental.merged_changes(of(3, "Modified"), of(5, "Added"))


@query("SELECT CASE WHEN start_line % 2 = 0 THEN 'kept' ELSE 'new' END AS name, count(*) AS n FROM symbols WHERE kind = 'Function' GROUP BY 1", cte=SYMBOLS_SQL)
def folded_updates(spark, sf):
    """Two updates of a file in one batch: the last one counts; a file without updates stays."""
    s = graph(spark, sf, "Import").symbols.where("kind = 'Function'")
    each = s.select(F.concat("file_path", F.lit("/"), "id").alias("file_path"), *[c for c in s.columns if c != "file_path"]).select(s.columns)
    g = Graph(each.withColumn("name", F.lit("kept")), spark.createDataFrame([], EDGES))
    odd = each.where("start_line % 2 = 1")
    update = lambda seq, op, name: odd.select(F.lit(seq).alias("seq"), F.lit(op).alias("op"), F.col("file_path").alias("path"), F.array(F.struct(*[F.lit(name).alias("name") if c == "name" else F.col(c) for c in s.columns])).alias("symbols"))
    return incremental.apply_updates(g, update(1, "removed", "old").unionByName(update(2, "modified", "new"))).symbols.groupBy("name").agg(rows_as("n"))


# Formats.


@query("SELECT 'r:' || id AS vid, start_line::INTEGER AS line, (start_line + CASE WHEN kind = 'Parameter' THEN 0 ELSE 5 END)::INTEGER AS end_line, 'd:' || file_path AS document FROM symbols", cte=SYMBOLS_SQL)
def lsif_ranges(spark, sf):
    lines = formats.lsif(graph(spark, sf, "Import"))
    f = lambda p: F.get_json_object("value", f"$.{p}")
    ranges = lines.where(f("label") == "range").select(f("vid").alias("vid"), f("start.line").cast("int").alias("line"), f("end.line").cast("int").alias("end_line"))
    held = lines.where((f("label") == "contains") & (f("outV") != "project")).select(f("inV").alias("vid"), f("outV").alias("document"))
    return ranges.join(held, "vid")


@query("SELECT 'symbol_r:' || id AS id, 'Function' AS kind, file_path, start_line::INTEGER AS start_line FROM symbols WHERE kind IN ('Function', 'Class') AND start_line % 2 = 0", cte=SYMBOLS_SQL)
def lsif_read_back(spark, sf):
    """Half of the symbols get a definition edge; these are what a reader finds."""
    g = graph(spark, sf, "Import")
    s = g.symbols.where("kind in ('Function', 'Class')")
    edges = s.where("start_line % 2 = 0").select(F.to_json(F.struct(F.lit("edge").alias("type"), F.lit("textDocument/definition").alias("label"), F.concat(F.lit("r:"), "id").alias("outV"), F.concat(F.lit("s:"), "id").alias("inV"))).alias("value"))
    return formats.read_lsif(formats.lsif(Graph(s, g.edges)).select("value").unionByName(edges)).symbols.select("id", "kind", "file_path", "start_line")


@query("SELECT src_id, dst_id, kind FROM edges WHERE kind IN ('Contains', 'Import')")
def json_edges(spark, sf):
    return formats.from_json(formats.to_json(graph(spark, sf, "Contains", "Import"))).edges


@query("SELECT count(*) AS total, count(*) AS listed, min(id) AS first FROM symbols WHERE kind IN ('Module', 'Namespace')", cte=SYMBOLS_SQL)
def json_export(spark, sf):
    found = lifecycle.exported(graph(spark, sf, "Import").symbols.where("kind in ('Module', 'Namespace')"))
    parsed = F.from_json("value", "total long, symbols array<struct<id: string>>")
    return found.select(parsed.alias("x")).select("x.total", F.size("x.symbols").cast("long").alias("listed"), F.col("x.symbols")[0].id.alias("first"))


@query("SELECT file_path || ':' || (start_line + 1) || ':1' AS value FROM symbols WHERE kind = 'Namespace'", cte=SYMBOLS_SQL)
def list_format(spark, sf):
    return formats.listed(graph(spark, sf, "Import").symbols.where("kind = 'Namespace'"), "0")


# User functions.


@query("SELECT id, length(name)::BIGINT AS result FROM symbols WHERE kind = 'Function'", cte=SYMBOLS_SQL)
def map_symbols(spark, sf):
    s = graph(spark, sf, "Import").symbols.where("kind = 'Function'").select("id", "name")
    return mapping.map_rows(s, lambda r: len(r["name"]), "long").select("id", "result")


@query("SELECT id, CASE WHEN start_line % 2 = 0 THEN upper(name) END AS result FROM symbols WHERE kind = 'Function'", cte=SYMBOLS_SQL)
def map_some_symbols(spark, sf):
    s = graph(spark, sf, "Import").symbols.where("kind = 'Function'")
    return mapping.map_conditional(s, F.col("start_line") % 2 == 0, lambda r: r["name"].upper(), "string").select("id", "result")


@query("SELECT id, start_line::BIGINT AS result FROM symbols WHERE kind = 'Function' AND start_line % 3 = 0", cte=SYMBOLS_SQL)
def filter_map_symbols(spark, sf):
    s = graph(spark, sf, "Import").symbols.where("kind = 'Function'").select("id", "start_line")
    return mapping.filter_map(s, lambda r: None if r["start_line"] % 3 else r["start_line"], "long").select("id", "result")


@query("SELECT path, CASE WHEN max(l) <> 3 THEN count(*) END::BIGINT AS result, CASE WHEN max(l) = 3 THEN 'ValueError: no ' || path END AS error FROM rows GROUP BY path", cte=SOURCES)
def process_files(spark, sf):
    def count(path: str, content: str) -> int:
        if path.endswith(".go"):
            raise ValueError(f"no {path}")
        return content.count("\n") + 1

    return mapping.process_files(files(spark, sf), count, "long")


@query("SELECT id, round(1.5 + CASE WHEN name = 'Zed' THEN 2.0 ELSE 0 END, 4)::DOUBLE AS relevance, 'T' AS kind FROM varied", cte=SYMBOLS_SQL, recursive=VARIED)
def registered_language(spark, sf):
    """A language of the caller's own."""
    languages.register("toml", languages.Language(public="true", test="false", scope="cast(null as string)", keywords={"table": "T"}, modifiers=(), mark="."))
    kind = languages.parse_query("toml", "table x").kind
    return varied(spark, sf).select("id", languages.relevance("toml", "Zed").alias("relevance"), F.lit(kind).alias("kind"))

