"""Queries over the graph view of the tables, each with its SQL where that can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import languages, names, source, textrefs
from lodestar.operators import analytics, filters, match, navigate, search, traverse
from lodestar.operators import crawl as crawls
from lodestar.plans.tables import materialized
from lodestar.schema import EDGE_KINDS, Graph
from lodestar.sources import formats
from lodestar.sources.graphview import GRAPH_SQL, LATTICE_SQL, SYMBOLS_SQL, Tables, graph, lattice
from lodestar.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *, cte: str | None = GRAPH_SQL, recursive: str = "") -> Callable[[Query], Query]:
    """Registers a query by its name. cte: what the SQL builds on; recursive: more, that may refer to themselves."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            parts = ", ".join(p for p in (cte, recursive) if p)
            ORACLE[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n" if parts else "") + sql
        return f

    return add


def ids(g: Graph, kind: str) -> DataFrame:
    return g.symbols.where(F.col("kind") == kind).select("id")


def rows_as(name: str):
    return F.count(F.lit(1)).alias(name)


IMPORTS = "SELECT DISTINCT src_id AS a, dst_id AS b FROM edges WHERE kind = 'Import'"
#: Nodes reached from every namespace by Import, with the least depth; the start is reached by a cycle only.
REACH = f"imp AS ({IMPORTS}), walk(s, n, d) AS (SELECT a, b, 1 FROM imp UNION SELECT s, b, d + 1 FROM walk JOIN imp ON n = a WHERE d < 30), reached AS (SELECT s, n, min(d) AS d FROM walk GROUP BY ALL)"


# Patterns.


@query("SELECT b.id AS symbol_id, count(*) AS ref_count FROM edges e JOIN symbols a ON a.id = src_id AND a.kind = 'Variable' JOIN symbols b ON b.id = dst_id AND b.kind = 'Class' WHERE e.kind = 'Reference' GROUP BY 1")
def pattern_one_hop(spark, sf):
    found = match.match(graph(spark, sf, "Reference"), "(o:Variable)-[:Reference]->(c:Class)")
    return found.groupBy(F.col("c").alias("symbol_id")).agg(rows_as("ref_count"))


@query("SELECT n.src_id AS n, count(DISTINCT (n.dst_id, o.src_id)) AS pairs FROM edges n JOIN symbols c ON c.id = n.dst_id AND c.kind = 'Class' JOIN edges o ON o.dst_id = c.id AND o.kind = 'Reference' JOIN symbols v ON v.id = o.src_id AND v.kind = 'Variable' JOIN symbols s ON s.id = n.src_id AND s.kind = 'Namespace' WHERE n.kind = 'Contains' GROUP BY 1")
def pattern_two_hop_chain(spark, sf):
    found = match.match(graph(spark, sf, "Contains", "Reference"), "(n:Namespace)-[:Contains]->(c:Class)<-[:Reference]-(o:Variable)")
    return found.groupBy("n").agg(rows_as("pairs"))


@query("SELECT DISTINCT s AS a, n AS b FROM walk WHERE d <= 3 AND s <> n", recursive=REACH)
def pattern_varlen_1_3(spark, sf):
    return match.match(graph(spark, sf, "Import"), "(a:Namespace)-[:Import*1..3]->(b:Namespace)")


@query("SELECT dst_id AS s, count(*) AS n FROM edges WHERE kind = 'Implementation' GROUP BY 1")
def pattern_backward(spark, sf):
    return match.match(graph(spark, sf, "Implementation"), "(s:Interface)<-[:Implementation]-(p:Function)").groupBy("s").agg(rows_as("n"))


@query("SELECT src_id AS a, dst_id AS b FROM edges WHERE kind = 'Import' UNION SELECT dst_id, src_id FROM edges WHERE kind = 'Import'")
def pattern_both(spark, sf):
    return match.match(graph(spark, sf, "Import"), "(a:Namespace)<-[:Import]->(b:Namespace)")


@query("SELECT a.src_id AS start, count(DISTINCT a.dst_id) AS n0, count(DISTINCT c.id) AS n1 FROM edges a JOIN edges b ON b.src_id = a.dst_id AND b.kind = 'Contains' JOIN symbols c ON c.id = b.dst_id AND c.kind = 'Class' WHERE a.kind = 'Contains' AND starts_with(a.src_id, 'region:') GROUP BY 1")
def pattern_star(spark, sf):
    found = match.match_star(graph(spark, sf, "Contains"), "(r:Module)-[:Contains]->(n:Namespace)-[:Contains*1..2]->(c:Class)")
    return found.select("start", *[F.size(F.split(f"bound{i}", ",")).cast("long").alias(f"n{i}") for i in (0, 1)])


@query("SELECT n.id AS n, c.id AS c FROM edges e JOIN symbols n ON n.id = src_id JOIN symbols c ON c.id = dst_id WHERE e.kind = 'Contains' AND n.kind = 'Namespace' AND c.kind = 'Class' AND starts_with(n.name, 'NATION_1') AND ends_with(c.name, '7')")
def pattern_filtered(spark, sf):
    return match.match(graph(spark, sf, "Contains"), "(n:Namespace {name ^= 'NATION_1'})-[:Contains]->(c:Class {name $= '7'})")


@query("SELECT a.src_id AS m, count(DISTINCT x) AS n FROM edges a, LATERAL (SELECT a.dst_id AS x UNION SELECT b.dst_id FROM edges b WHERE b.kind = 'Contains' AND b.src_id = a.dst_id) WHERE a.kind = 'Contains' AND starts_with(a.src_id, 'region:') GROUP BY 1")
def pattern_unbounded(spark, sf):
    return match.match(graph(spark, sf, "Contains"), "(m:Module)-[:Contains*]->(x)").groupBy("m").agg(rows_as("n"))


@query("SELECT src_id AS a, dst_id AS b FROM edges WHERE kind = 'Import' OR kind = 'Contains' AND starts_with(src_id, 'region:')")
def pattern_alternatives(spark, sf):
    return match.match(graph(spark, sf, "Import", "Contains"), "(a)-[:Import|Contains]->(b:Namespace)")


# Navigation.


@query("SELECT dst_id AS id, count(*) AS n, count(DISTINCT src_id) AS sources FROM edges WHERE kind = 'Reference' GROUP BY 1")
def find_references(spark, sf):
    return navigate.references(graph(spark, sf, "Reference")).groupBy("id").agg(rows_as("n"), F.count_distinct("other").alias("sources"))


@query("SELECT dst_id AS id, min(src_id) AS other FROM edges WHERE kind = 'Definition' GROUP BY 1")
def find_definition_first(spark, sf):
    return navigate.first_definition(graph(spark, sf, "Definition"))


@query("SELECT dst_id AS id, src_id AS other FROM edges WHERE kind = 'Implementation'")
def find_implementations(spark, sf):
    return navigate.implementations(graph(spark, sf, "Implementation"))


@query("SELECT src_id AS id, kind, count(*) AS n FROM edges GROUP BY ALL")
def outgoing_edges(spark, sf):
    g = graph(spark, sf)
    return reduce(DataFrame.unionByName, [navigate.neighbours(g, k, False).groupBy("id").agg(rows_as("n")).withColumn("kind", F.lit(k)) for k in EDGE_KINDS])


@query("SELECT dst_id AS id, kind, count(*) AS n FROM edges GROUP BY ALL")
def incoming_edges(spark, sf):
    g = graph(spark, sf)
    return reduce(DataFrame.unionByName, [navigate.neighbours(g, k, True).groupBy("id").agg(rows_as("n")).withColumn("kind", F.lit(k)) for k in EDGE_KINDS])


@query("SELECT src_id, count(*) AS n FROM edges WHERE kind = 'Reference' AND starts_with(src_id, 'order:') AND starts_with(dst_id, 'customer:') GROUP BY 1")
def graph_builder_resolve_edges(spark, sf):
    g = graph(spark, sf, "Reference")
    known = g.symbols.where("kind in ('Variable', 'Class')")
    built = Graph.build(known.unionByName(known), g.edges)
    return built.edges.groupBy("src_id").agg(rows_as("n"))


def spots(g: Graph) -> DataFrame:
    return g.symbols.where("kind in ('Class', 'Interface', 'Function')").select("file_path", (F.col("start_line") + 2).alias("line"), F.lit(3).alias("char")).distinct()


SPOTS = "spots AS (SELECT DISTINCT file_path, start_line + 2 AS line FROM symbols WHERE kind IN ('Class', 'Interface', 'Function'))"


@query("SELECT file_path, line::INTEGER AS line, 3 AS char, arg_min(id, (start_line, id)) AS id FROM spots JOIN symbols USING (file_path) WHERE line BETWEEN start_line AND start_line + 5 GROUP BY 1, 2", recursive=SPOTS)
def symbol_at_position(spark, sf):
    g = graph(spark, sf, "Import")
    return navigate.at_positions(g.symbols, spots(g))


@query("SELECT file_path, line::INTEGER AS line, 3 AS char, coalesce(t.target, f.id) AS id FROM (SELECT file_path, line, arg_min(id, (start_line, id)) AS id FROM spots JOIN symbols USING (file_path) WHERE line BETWEEN start_line AND start_line + 5 GROUP BY 1, 2) f LEFT JOIN (SELECT src_id, min(dst_id) AS target FROM edges WHERE kind = 'Reference' GROUP BY 1) t ON t.src_id = f.id", recursive=SPOTS)
def definition_at_position(spark, sf):
    g = graph(spark, sf, "Reference")
    return navigate.definition_at(g, spots(g))


LOCATIONS = f"""{SPOTS}, asked AS (SELECT DISTINCT CASE line % 3 WHEN 0 THEN file_path WHEN 1 THEN 'root/' || file_path ELSE substr(file_path, 2) END AS path, line FROM spots),
fits AS (SELECT p.path, f.file_path FROM (SELECT DISTINCT path FROM asked) p JOIN (SELECT DISTINCT file_path FROM symbols) f ON ends_with(p.path, f.file_path) OR ends_with(f.file_path, p.path))"""


@query("SELECT path, (line + 1)::INTEGER AS line, 4 AS char, arg_min(id, (file_path, start_line, id)) AS id FROM asked JOIN fits USING (path) JOIN symbols USING (file_path) WHERE line BETWEEN start_line AND start_line + 5 GROUP BY 1, 2", recursive=LOCATIONS)
def symbol_at_location(spark, sf):
    """Paths as they are, with a folder before them, and without their first character."""
    g = graph(spark, sf, "Import")
    path = F.when(F.col("line") % 3 == 0, F.col("file_path")).when(F.col("line") % 3 == 1, F.concat(F.lit("root/"), "file_path")).otherwise(F.substring("file_path", 2, 1000))
    return navigate.at_location(g.symbols, spots(g).select(path.alias("path"), (F.col("line") + 1).alias("line"), (F.col("char") + 1).alias("char")))


@query("SELECT src_id, dst_id, 'Reference' AS kind FROM (SELECT e.id AS dst_id, arg_min(s.id, (s.start_line, s.id)) AS src_id FROM symbols e JOIN symbols s ON s.file_path = e.file_path AND e.start_line BETWEEN s.start_line AND s.start_line + 5 WHERE e.kind = 'Method' GROUP BY 1) WHERE src_id <> dst_id")
def reference_edges_by_range(spark, sf):
    s = graph(spark, sf, "Import").symbols
    return navigate.reference_edges(s, s.where("kind = 'Method'").select("file_path", F.col("start_line").alias("line"), F.col("id").alias("target")))


@query("SELECT a.file_path AS src_file, b.file_path AS dst_file, count(*) AS n FROM edges e JOIN symbols a ON a.id = src_id JOIN symbols b ON b.id = dst_id WHERE e.kind = 'Reference' AND a.file_path <> b.file_path GROUP BY 1, 2")
def file_dependencies(spark, sf):
    return navigate.file_edges(graph(spark, sf, "Reference"))


# Filters and searches.


@query("SELECT id, name, CASE WHEN name = 'Ring' THEN 2.0 WHEN starts_with(name, 'Ring') THEN 1.5 WHEN ends_with(name, 'Ring') THEN 1.2 ELSE 1.0 END::DOUBLE AS relevance FROM symbols WHERE lower(name) LIKE '%ring%' AND kind = 'Function' AND file_path LIKE '%cat%' ORDER BY id LIMIT 40", cte=SYMBOLS_SQL)
def find_definitions(spark, sf):
    return filters.find_definitions(graph(spark, sf, "Import").symbols, "Ring", False, "cat", "func", False, 40)


@query("SELECT id, name, 1.0::DOUBLE AS relevance FROM symbols WHERE regexp_matches(name, '^[a-z]+(Bolt|Gear)$')", cte=SYMBOLS_SQL)
def search_regex(spark, sf):
    return filters.search_pattern(graph(spark, sf, "Import").symbols, "^[a-z]+(Bolt|Gear)$")


@query("SELECT id, name FROM symbols WHERE lower(name) LIKE '%99%' AND kind = 'Class' ORDER BY id LIMIT 50", cte=SYMBOLS_SQL)
def cli_search(spark, sf):
    return filters.search(graph(spark, sf, "Import").symbols, "99", True, "class")


@query("SELECT id FROM symbols WHERE kind IN ('Function', 'Method') AND list_extract(string_split(detail, '->'), 2) LIKE '%Brand1%'", cte=SYMBOLS_SQL)
def type_filter_returns(spark, sf):
    return filters.type_filter(graph(spark, sf, "Import"), "returns", "Brand1").select("id")


@query("SELECT id FROM symbols WHERE kind IN ('Function', 'Method') AND regexp_extract(detail, '\\(([^)]*)\\)', 1) LIKE '%PROMO%'", cte=SYMBOLS_SQL)
def type_filter_takes(spark, sf):
    return filters.type_filter(graph(spark, sf, "Import"), "param", "PROMO").select("id")


@query("SELECT id FROM symbols WHERE kind = 'Class' AND detail LIKE '%implements MACHINERY%'", cte=SYMBOLS_SQL)
def type_filter_implements(spark, sf):
    return filters.type_filter(graph(spark, sf, "Implementation"), "extends", "MACHINERY").select("id")


@query("SELECT id FROM symbols WHERE regexp_matches(detail, 'size: (SMALL|LARGE)')", cte=SYMBOLS_SQL)
def type_filter_signature(spark, sf):
    return filters.type_filter(graph(spark, sf, "Import"), "sig", "size: (SMALL|LARGE)").select("id")


@query("SELECT DISTINCT src_id AS id FROM edges JOIN symbols s ON s.id = dst_id WHERE edges.kind = 'Contains' AND starts_with(src_id, 'nation:') AND s.detail LIKE '%BUILDING%'")
def type_filter_has_field(spark, sf):
    g = graph(spark, sf, "Contains")
    as_types = g.symbols.withColumn("kind", F.when(F.col("kind") == "Namespace", "Class").when(F.col("kind") == "Class", "Field").otherwise(F.col("kind")))
    return filters.type_filter(Graph(as_types, g.edges), "has_field", "BUILDING").select("id")


@query("SELECT id, name FROM symbols WHERE lower(name) LIKE '%gear%' AND kind = 'Function' AND detail LIKE '%-> Brand2%' AND regexp_extract(detail, '\\(([^)]*)\\)', 1) LIKE '%SMALL%' ORDER BY id LIMIT 50", cte=SYMBOLS_SQL)
def advanced_search(spark, sf):
    return filters.advanced_search(graph(spark, sf, "Import"), "gear", [("returns", "Brand2"), ("takes", "SMALL")])


WORDS = ("smallRing", "sma", "RB", "ldGea", "smalRing", "Gizmo")
FUZZY = f"qs AS (SELECT unnest({list(WORDS)}) AS q), named AS (SELECT id, name, lower(name) AS l, regexp_replace(name, '[^A-Z]', '', 'g') AS caps FROM symbols WHERE kind = 'Function')"
GRAMS = "list_distinct(list_transform(range(1, length({c}) + {n}), lambda i: substr(repeat(' ', {n} - 1) || {c} || repeat(' ', {n} - 1), i, {n})))"


def per_word(f: Callable[[str], DataFrame]) -> DataFrame:
    out = None
    for w in WORDS:
        found = f(w).withColumn("query", F.lit(w))
        out = found if out is None else out.unionByName(found)
    return out


CORE = f"""SELECT id, name, q AS query, match_type, round(score, 4) AS score FROM (
  SELECT *, CASE match_type WHEN 'Exact' THEN 100.0 WHEN 'Prefix' THEN 90 - 0.5 * (strlen(l) - strlen(q)) WHEN 'CamelCase' THEN 85.0 WHEN 'Substring' THEN 70 - 0.5 * (strpos(l, lq) - 1)
    WHEN 'Fuzzy' THEN ratio * 60 ELSE 50 * (1 - edits / greatest(strlen(l), strlen(q))) END::DOUBLE AS score FROM (
    SELECT *, CASE WHEN l = lq THEN 'Exact' WHEN starts_with(l, lq) AND strlen(q) <= 5 THEN 'Prefix' WHEN caps <> '' AND contains(caps, upper(q)) THEN 'CamelCase' WHEN contains(l, lq) THEN 'Substring'
      WHEN ratio >= least AND strlen(q) >= 2 THEN 'Fuzzy' WHEN strlen(q) >= 3 AND edits <= floor(0.3 * greatest(strlen(l), strlen(q))) THEN 'Typo' END AS match_type FROM (
      SELECT *, lower(q) AS lq, levenshtein(l, lower(q)) AS edits, CASE WHEN strlen(q) >= 3 THEN 0.25 ELSE 0.3 END AS least,
        CASE WHEN strlen(q) >= 3 THEN len(list_intersect({GRAMS.format(c="lower(q)", n=3)}, {GRAMS.format(c="l", n=3)})) / len({GRAMS.format(c="lower(q)", n=3)})
        ELSE len(list_intersect({GRAMS.format(c="lower(q)", n=2)}, {GRAMS.format(c="l", n=2)})) / len({GRAMS.format(c="lower(q)", n=2)}) END AS ratio FROM named, qs)) WHERE match_type IS NOT NULL)"""


@query(CORE, cte=SYMBOLS_SQL, recursive=FUZZY)
def fuzzy_core_search(spark, sf):
    s = graph(spark, sf, "Import").symbols.where("kind = 'Function'")
    return per_word(lambda w: search.core_search(s, w, None))


CLI = """SELECT id, name, q AS query, match_type, round(CASE match_type WHEN 'exact' THEN 1.0 WHEN 'prefix' THEN 0.9 WHEN 'substring' THEN 0.7 WHEN 'abbreviation' THEN 0.6 WHEN 'subsequence' THEN 0.5 ELSE e * 0.8 END::DOUBLE, 4) AS score FROM (
  SELECT *, CASE WHEN l = lower(q) THEN 'exact' WHEN starts_with(l, lower(q)) THEN 'prefix' WHEN contains(l, lower(q)) THEN 'substring' WHEN caps = upper(q) OR regexp_matches(caps, array_to_string(string_split(upper(q), ''), '.*')) THEN 'abbreviation'
    WHEN regexp_matches(l, array_to_string(string_split(lower(q), ''), '.*')) THEN 'subsequence' WHEN e >= 0.7 THEN 'edit' END AS match_type FROM (
    SELECT *, 1 - levenshtein(l, lower(q)) / greatest(strlen(l), strlen(q)) AS e FROM named, qs)) WHERE match_type IS NOT NULL"""


@query(CLI, cte=SYMBOLS_SQL, recursive=FUZZY)
def fuzzy_cli_cascade(spark, sf):
    s = graph(spark, sf, "Import").symbols.where("kind = 'Function'")
    return per_word(lambda w: search.cli_search(s, w))


@query("SELECT id, name, q AS query, match_type, CASE match_type WHEN 'Exact' THEN 100.0 WHEN 'Prefix' THEN 80.0 ELSE 70.0 END::DOUBLE AS score FROM (SELECT *, CASE WHEN l = lower(q) THEN 'Exact' WHEN starts_with(l, lower(q)) AND strlen(q) <= 5 THEN 'Prefix' WHEN len(list_filter(list_transform(regexp_extract_all(q, '[A-Z]+[^A-Z]*|^[^A-Z]+'), lambda x: lower(x)), lambda w: NOT list_contains(list_append(list_transform(regexp_extract_all(name, '[A-Z]+[^A-Z]*|^[^A-Z]+'), lambda x: lower(x)), l), w))) = 0 THEN 'CamelCase' END AS match_type FROM named, qs) WHERE match_type IS NOT NULL", cte=SYMBOLS_SQL, recursive=FUZZY)
def fuzzy_engine_search(spark, sf):
    s = graph(spark, sf, "Import").symbols.where("kind = 'Function'")
    return per_word(lambda w: search.engine_search(s, w, None))


@query("SELECT DISTINCT file_path, CASE WHEN contains(file_path, 'nation_1') THEN 'substring' ELSE 'subsequence' END AS match_type, CASE WHEN contains(file_path, 'nation_1') THEN 0.7 ELSE 0.5 END::DOUBLE AS score FROM symbols WHERE regexp_matches(file_path, 'n.*a.*t.*i.*o.*n.*_.*1')", cte=SYMBOLS_SQL)
def fuzzy_paths(spark, sf):
    return search.path_search(graph(spark, sf, "Import").symbols, "nation_1")


@query(f"SELECT DISTINCT name, array_to_string(list_sort({GRAMS.format(c='lower(name)', n=3)}), '|') AS grams FROM symbols WHERE kind = 'Function'", cte=SYMBOLS_SQL)
def name_trigrams(spark, sf):
    s = graph(spark, sf, "Import").symbols.where("kind = 'Function'").select("name").distinct()
    return s.select("name", F.array_join(F.array_sort(names.grams(F.lower("name"), 3)), "|").alias("grams"))


@query("SELECT DISTINCT name, array_to_string(regexp_extract_all(name, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), '|') AS words FROM symbols WHERE kind IN ('Function', 'Interface', 'Namespace', 'Variable')", cte=SYMBOLS_SQL)
def camel_words(spark, sf):
    s = graph(spark, sf, "Import").symbols.where("kind in ('Function', 'Interface', 'Namespace', 'Variable')").select("name").distinct()
    return s.select("name", F.array_join(names.camel_words(F.col("name")), "|").alias("words"))


NGRAMS = "low AS (SELECT DISTINCT lower(name) AS n, name FROM symbols WHERE kind = 'Function')"


@query(f"SELECT (SELECT count(*) FROM symbols WHERE kind = 'Function') AS symbols, (SELECT count(DISTINCT n) FROM low) AS names, (SELECT count(DISTINCT g) FROM (SELECT unnest({GRAMS.format(c='n', n=2)}) AS g FROM low)) AS bigrams, (SELECT count(DISTINCT g) FROM (SELECT unnest({GRAMS.format(c='n', n=3)}) AS g FROM low)) AS trigrams, (SELECT count(DISTINCT g) FROM (SELECT unnest(list_transform(range(1, least(length(n), 5) + 1), lambda i: substr(n, 1, i))) AS g FROM low)) AS prefixes, (SELECT count(DISTINCT lower(w)) FROM (SELECT unnest(regexp_extract_all(name, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')) AS w FROM low)) AS words", cte=SYMBOLS_SQL, recursive=NGRAMS)
def ngram_stats(spark, sf):
    return search.index_stats(graph(spark, sf, "Import").symbols.where("kind = 'Function'"))


@query("SELECT id, round(1.0 + CASE WHEN name = 'smallRing' THEN 2.0 ELSE 0 END + CASE WHEN regexp_matches(name, '^[A-Z]') THEN 0.5 ELSE 0 END, 4)::DOUBLE AS go, round(1.5 + CASE WHEN name = 'smallRing' THEN 2.0 ELSE 0 END - CASE WHEN contains(file_path, 'test_') THEN 0.5 ELSE 0 END, 4)::DOUBLE AS python FROM symbols WHERE kind IN ('Function', 'Class')", cte=SYMBOLS_SQL)
def language_relevance(spark, sf):
    s = graph(spark, sf, "Import").symbols.where("kind in ('Function', 'Class')")
    return s.select("id", *[languages.relevance(x, "smallRing").alias(x) for x in ("go", "python")])


@query("SELECT id, 'use cat::' || split_part(file_path, '/', 2) || '::' || name || ';' AS rust, 'from cat.' || split_part(file_path, '/', 2) || ' import ' || name AS python, 'import \"cat\"' AS go, 'import { ' || name || ' } from ' || chr(39) || '../' || file_path || chr(39) || ';' AS typescript, split_part(file_path, '/', 2) AS scope FROM symbols WHERE kind = 'Function'", cte=SYMBOLS_SQL)
def import_statements(spark, sf):
    s = graph(spark, sf, "Import").symbols.where("kind = 'Function'")
    return s.select("id", *[languages.import_statement(x, "lib/a.ts").alias(x) for x in ("rust", "python", "go", "typescript")], languages.parent_scope("rust").alias("scope"))


# Aggregates and rankings.


@query("SELECT kind, count(*) AS n FROM symbols GROUP BY 1 ORDER BY n DESC, kind LIMIT 10", cte=SYMBOLS_SQL)
def stats_by_kind(spark, sf):
    return analytics.counts(graph(spark, sf, "Import").symbols, "kind")


@query("SELECT file_path, count(*) AS n FROM symbols GROUP BY 1 ORDER BY n DESC, file_path LIMIT 10", cte=SYMBOLS_SQL)
def stats_by_file_top10(spark, sf):
    return analytics.counts(graph(spark, sf, "Import").symbols, "file_path")


@query("SELECT count(*) AS symbols, count(DISTINCT file_path) AS files FROM symbols", cte=SYMBOLS_SQL)
def stats_totals(spark, sf):
    return analytics.totals(graph(spark, sf, "Import").symbols)


@query("SELECT id, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM symbols LEFT JOIN (SELECT dst_id, count(*) AS n FROM edges WHERE kind = 'Reference' GROUP BY 1) i ON i.dst_id = id LEFT JOIN (SELECT src_id, count(*) AS n FROM edges WHERE kind = 'Reference' GROUP BY 1) o ON o.src_id = id")
def fan_in_out(spark, sf):
    return analytics.fan(graph(spark, sf, "Reference"))


@query("SELECT id, round(coalesce(d, 0) / (coalesce(d, 0) + 1), 6) AS coupling FROM symbols LEFT JOIN (SELECT a.id AS i, count(DISTINCT dst_id) AS d FROM edges e JOIN symbols a ON a.id = src_id JOIN symbols b ON b.id = dst_id WHERE e.kind IN ('Import', 'Reference') AND a.file_path <> b.file_path GROUP BY 1) ON i = id")
def coupling(spark, sf):
    return analytics.coupling(graph(spark, sf, "Import", "Reference")).withColumn("coupling", F.round("coupling", 6))


@query("SELECT s.id, name, 'Public' AS visibility, x.src_id IS NOT NULL AS is_exported, coalesce(n, 0) AS reference_count, round((1.0 + CASE WHEN x.src_id IS NOT NULL THEN 2.0 ELSE 0.0 END + ln(coalesce(n, 0) + 1)) * CASE kind WHEN 'Module' THEN 2.0 WHEN 'Class' THEN 1.8 WHEN 'Interface' THEN 1.8 WHEN 'Function' THEN 1.5 WHEN 'Method' THEN 1.5 WHEN 'Variable' THEN 1.0 ELSE 0.8 END, 4) AS importance_score FROM symbols s LEFT JOIN (SELECT DISTINCT src_id FROM edges WHERE kind = 'Export') x ON x.src_id = id LEFT JOIN (SELECT dst_id, count(*) AS n FROM edges WHERE kind = 'Reference' GROUP BY 1) r ON r.dst_id = id")
def public_api_python(spark, sf):
    return analytics.public_api(graph(spark, sf, "Reference", "Export"), source.visibility("python", F.col("name"), F.col("detail")))


@query("SELECT id FROM symbols WHERE kind = 'Variable' AND detail = 'F' AND id NOT IN (SELECT dst_id FROM edges WHERE kind = 'Reference')")
def entry_points(spark, sf):
    g = graph(spark, sf, "Reference", "Export")
    as_functions = g.symbols.withColumn("kind", F.when(F.col("kind") == "Variable", "Function").otherwise(F.col("kind")))
    return analytics.entry_points(Graph(as_functions, g.edges))


# Recursion.

EVENTS = "ev AS (SELECT 'event:' || event_id AS id, 'event:' || lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p1, 'event:' || lag(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p2 FROM events)"


@query("SELECT id AS root, p1 AS node, id AS parent, 1 AS depth FROM ev WHERE p1 IS NOT NULL UNION ALL SELECT id, p2, p1, 2 FROM ev WHERE p2 IS NOT NULL", cte=EVENTS)
def outgoing_calls(spark, sf):
    g = graph(spark, sf, "Reference")
    return analytics.calls(g, ids(g, "Method"), "callees", 2)


@query("SELECT p1 AS root, id AS node, p1 AS parent, 1 AS depth FROM ev WHERE p1 IS NOT NULL UNION ALL SELECT p2, id, p1, 2 FROM ev WHERE p2 IS NOT NULL", cte=EVENTS)
def incoming_calls(spark, sf):
    g = graph(spark, sf, "Reference")
    return analytics.calls(g, ids(g, "Method"), "incoming", 2)


@query("SELECT array_to_string(p, '>') AS path FROM w WHERE len(p) > 1", recursive=f"imp AS ({IMPORTS}), w(n, p) AS (SELECT DISTINCT a, [a] FROM imp UNION ALL SELECT b, list_append(p, b) FROM w JOIN imp ON a = n WHERE NOT list_contains(p, b) AND len(p) <= 3)")
def call_paths(spark, sf):
    g = graph(spark, sf, "Import")
    return traverse.paths(g.of_kind("Import"), ids(g, "Namespace"), 3).select(F.array_join("path", ">").alias("path"))


@query("SELECT s AS start_id, max(d) + 1 AS chain_len, arg_max(n, d) AS ultimate_id, false AS has_cycle FROM w GROUP BY 1", recursive="de AS (SELECT src_id AS a, dst_id AS b FROM edges WHERE kind = 'Definition' AND starts_with(src_id, 'order:')), w(s, n, d) AS (SELECT id, id, 0 FROM symbols WHERE kind = 'Variable' UNION ALL SELECT s, b, d + 1 FROM w JOIN de ON a = n)")
def definition_chain(spark, sf):
    g = graph(spark, sf, "Definition")
    found = traverse.chains(g.of_kind("Definition"), ids(g, "Variable"))
    return found.select(F.col("start").alias("start_id"), F.size("chain").alias("chain_len"), F.element_at("chain", -1).alias("ultimate_id"), "has_cycle")


@query("SELECT DISTINCT s AS start, array_to_string(p, '>') AS chain, loops AS has_cycle FROM (SELECT p[1] AS s, p, EXISTS (SELECT 1 FROM imp WHERE a = n AND list_contains(p, b)) AS loops, EXISTS (SELECT 1 FROM imp WHERE a = n) AS more FROM w) WHERE loops OR NOT more", recursive=f"imp AS ({IMPORTS}), w(n, p) AS (SELECT id, [id] FROM symbols WHERE kind = 'Namespace' UNION ALL SELECT b, list_append(p, b) FROM w JOIN imp ON a = n WHERE NOT list_contains(p, b))")
def all_definition_chains(spark, sf):
    g = graph(spark, sf, "Import")
    return traverse.all_chains(g.of_kind("Import"), ids(g, "Namespace")).select("start", F.array_join("chain", ">").alias("chain"), "has_cycle")


@query("SELECT s AS start, n AS node, path FROM (SELECT p[1] AS s, n, array_to_string(p, '>') AS path, row_number() OVER (PARTITION BY p[1], n ORDER BY len(p), p) AS r FROM w) WHERE r = 1", recursive=f"imp AS ({IMPORTS}), w(n, p) AS (SELECT id, [id] FROM symbols WHERE kind = 'Namespace' UNION ALL SELECT b, list_append(p, b) FROM w JOIN imp ON a = n WHERE NOT list_contains(p, b))")
def shortest_definition_path(spark, sf):
    g = graph(spark, sf, "Import")
    n = ids(g, "Namespace")
    return traverse.shortest_paths(g.of_kind("Import"), n, n).select("start", "node", F.array_join("path", ">").alias("path"))


@query("SELECT s AS start, n AS node, d::INTEGER AS depth FROM reached", recursive=REACH)
def reachability(spark, sf):
    g = graph(spark, sf, "Import")
    return traverse.reach(g.of_kind("Import"), ids(g, "Namespace"))


@query("SELECT a.s AS node, min(least(b.n, a.s)) AS component FROM reached a JOIN reached b ON b.s = a.s JOIN reached c ON c.s = b.n AND c.n = a.s WHERE b.n <> a.s GROUP BY 1", recursive=REACH)
def circular_dependencies(spark, sf):
    return traverse.cycles(graph(spark, sf, "Import").of_kind("Import")).select("node", "component")


LIVE = "step AS (SELECT src_id AS a, dst_id AS b FROM edges WHERE kind IN ('Reference', 'Definition')), live(id) AS (SELECT id FROM symbols WHERE kind = 'Variable' AND name = '1-URGENT' UNION SELECT b FROM live JOIN step ON a = id)"


@query("SELECT id FROM symbols WHERE id NOT IN (SELECT id FROM live)", recursive=LIVE)
def dead_symbols(spark, sf):
    g = graph(spark, sf, "Reference", "Definition")
    return analytics.dead(g, g.symbols.where("kind = 'Variable' and name = '1-URGENT'").select("id"))


@query("SELECT id, cyclomatic::BIGINT AS cyclomatic FROM cyc", cte=LATTICE_SQL)
def cyclomatic(spark, sf):
    g = lattice(spark, sf)
    return analytics.cyclomatic(g, g.symbols.where("kind in ('Function', 'Method')").select("id"))


@query("SELECT id, (coalesce(CASE WHEN o.b > 1 THEN o.b - 1 END, 0) + coalesce(inner_weight, 0))::BIGINT AS cognitive FROM cyc LEFT JOIN outs o ON o.src_id = id", cte=LATTICE_SQL)
def cognitive(spark, sf):
    g = lattice(spark, sf)
    return analytics.cognitive(g, g.symbols.where("kind in ('Function', 'Method')").select("id"))


@query("SELECT id, depth::BIGINT AS depth FROM cyc UNION ALL SELECT id, 1 FROM symbols WHERE kind = 'Namespace'", cte=LATTICE_SQL)
def nesting_depth(spark, sf):
    g = lattice(spark, sf)
    return analytics.nesting(g, g.symbols.where("kind in ('Function', 'Method', 'Namespace')").select("id"))


@query("SELECT id, cyclomatic::BIGINT AS cyclomatic, (coalesce(CASE WHEN o.b > 1 THEN o.b - 1 END, 0) + coalesce(inner_weight, 0))::BIGINT AS cognitive, depth::BIGINT AS depth, coalesce(i.b, 0) AS fan_in, coalesce(o.b, 0) AS fan_out, round(coalesce(d, 0) / (coalesce(d, 0) + 1), 6) AS coupling FROM cyc LEFT JOIN outs o ON o.src_id = id LEFT JOIN ins i ON i.dst_id = id LEFT JOIN far ON far.src_id = id", cte=LATTICE_SQL)
def complexity_metrics(spark, sf):
    return analytics.metrics(lattice(spark, sf)).withColumn("coupling", F.round("coupling", 6))


@query("SELECT id, cyclomatic::BIGINT AS cyclomatic FROM cyc ORDER BY cyclomatic DESC, id LIMIT 25", cte=LATTICE_SQL)
def complexity_rank(spark, sf):
    return analytics.rank_by_complexity(lattice(spark, sf), 25)


@query("SELECT s AS root_id, 'parent' AS bucket, n AS symbol_id FROM reached UNION ALL SELECT n, 'child', s FROM reached UNION ALL SELECT DISTINCT a.s, 'sibling', b.s FROM reached a JOIN reached b ON b.n = a.n WHERE a.s <> b.s", recursive=REACH)
def type_hierarchy(spark, sf):
    g = graph(spark, sf, "Import")
    return analytics.type_hierarchy(Graph(g.symbols, g.edges.withColumn("kind", F.lit("Definition"))), ids(g, "Namespace"))


@query("SELECT dst_id AS root_id, 'users' AS bucket, count(*) AS n FROM edges WHERE kind = 'Reference' AND starts_with(dst_id, 'customer:') GROUP BY 1")
def type_relations(spark, sf):
    g = graph(spark, sf, "Reference", "Definition")
    return analytics.type_relations(g, ids(g, "Class"))


@query("SELECT c AS start, o AS node, min(d) AS depth FROM (SELECT dst_id AS c, src_id AS o, 1 AS d FROM edges WHERE kind = 'Reference' AND starts_with(dst_id, 'customer:') UNION ALL SELECT r.dst_id, x.src_id, 2 FROM edges r JOIN edges x ON x.dst_id = r.src_id AND x.kind = 'Definition' WHERE r.kind = 'Reference' AND starts_with(r.dst_id, 'customer:')) GROUP BY 1, 2")
def type_references(spark, sf):
    g = graph(spark, sf, "Reference", "Definition")
    return analytics.type_references(g, ids(g, "Class"), 1)


@query("SELECT id, bucket, count(*) AS n FROM (SELECT dst_id AS id, 'in_' || lower(kind) AS bucket FROM edges WHERE kind IN ('Definition', 'Reference') UNION ALL SELECT src_id, 'out_' || lower(kind) FROM edges WHERE kind IN ('Definition', 'Reference') UNION ALL SELECT dst_id, 'referenced_by_' || lower(s.kind) FROM edges e JOIN symbols s ON s.id = src_id WHERE e.kind = 'Reference') GROUP BY ALL")
def relation_groups(spark, sf):
    return analytics.relation_groups(graph(spark, sf, "Definition", "Reference"))


@query("SELECT n AS file, min(d)::INTEGER AS depth FROM (SELECT 'nation:0' AS n, 0 AS d UNION ALL SELECT n, d FROM reached WHERE s = 'nation:0' AND d <= 3) GROUP BY 1 ORDER BY depth, file LIMIT 100", recursive=REACH)
def crawl(spark, sf):
    e = graph(spark, sf, "Import").of_kind("Import").select(F.col("src_id").alias("src_file"), F.col("dst_id").alias("dst_file"))
    return analytics.crawl(e, spark.range(1).select(F.lit("nation:0").alias("id")))


FILE_WEIGHTS = "far AS (SELECT a.file_path AS s, b.file_path AS t, count(*) AS p FROM edges e JOIN symbols a ON a.id = src_id JOIN symbols b ON b.id = dst_id WHERE e.kind IN ('Reference', 'Implementation') AND a.file_path <> b.file_path GROUP BY ALL), near AS (SELECT s, t, min(p) AS p FROM (SELECT * FROM far UNION ALL SELECT t, s, p FROM far) GROUP BY ALL), kids AS (SELECT s, list({'p': p, 't': t}) AS ks FROM near GROUP BY s)"
#: A queue kept as a list: each row takes the best of it and adds what that leads to.
QUEUE = f"""{FILE_WEIGHTS}, walk(n, queue, seen, best) AS (
  SELECT 0, [{{'p': 100::BIGINT, 'd': 0, 'f': 'oms/cust_1'}}, {{'p': 99::BIGINT, 'd': 0, 'f': 'oms/cust_2'}}], []::VARCHAR[], {{'p': 0::BIGINT, 'd': 0, 'f': ''}}
  UNION ALL SELECT n + 1, list_concat(queue, CASE WHEN best.d > -3 THEN list_transform(coalesce(ks, []), lambda k: {{'p': k.p, 'd': best.d - 1, 'f': k.t}}) ELSE [] END), list_append(seen, best.f), best
  FROM (SELECT n, seen, list_filter(queue, lambda x: NOT list_contains(seen, x.f)) AS queue, list_sort(list_filter(queue, lambda x: NOT list_contains(seen, x.f)))[1] AS best FROM walk WHERE n < 60) LEFT JOIN kids ON s = best.f WHERE best IS NOT NULL)"""


@query("SELECT best.f AS file, (-best.d)::INTEGER AS depth, best.p AS priority, n::BIGINT AS place FROM walk WHERE n > 0", recursive=QUEUE)
def crawl_by_priority(spark, sf):
    """Files by how often they refer to each other, the most loosely joined ones first."""
    g = graph(spark, sf, "Reference", "Implementation")
    far = reduce(DataFrame.unionByName, [navigate.file_edges(g, k) for k in ("Reference", "Implementation")]).groupBy("src_file", "dst_file").agg(F.sum("n").alias("priority"))
    far = materialized(far)  # read both ways
    both = far.unionByName(far.select(F.col("dst_file").alias("src_file"), F.col("src_file").alias("dst_file"), "priority"))
    starts = g.symbols.where("file_path in ('oms/cust_1', 'oms/cust_2')").select(F.col("file_path").alias("file"), F.when(F.col("file_path") == "oms/cust_1", 100).otherwise(99).alias("priority")).distinct()
    return crawls.crawl_by_priority(both, starts, 3, 60)


# Text.

SOURCES = """code AS (SELECT p_partkey AS k, split_part(p_name, ' ', 1) || '_' || split_part(p_name, ' ', 2) AS n, 'b' || regexp_replace(p_brand, '[^0-9]', '', 'g') || CASE p_partkey % 4 WHEN 0 THEN '.rs' WHEN 1 THEN '.ts' WHEN 2 THEN '.py' ELSE '.go' END AS path, p_partkey % 4 AS l, p_type FROM part),
texts AS (SELECT k, n, path, l, CASE l WHEN 0 THEN 'pub fn ' || n || '(x: ' || p_type || ') {' WHEN 1 THEN 'export const ' || n || ' = (x) => x; // ' || n WHEN 2 THEN '    def ' || n || '(self):' ELSE 'func (s *Set) ' || n || '() {' END AS text FROM code),
rows AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS line FROM texts)"""


def files(spark: SparkSession, sf: str, part: DataFrame | None = None) -> DataFrame:
    """path, content: a source file for each brand and language, a line for each part (of those given)."""
    n = F.concat(F.substring_index("p_name", " ", 1), F.lit("_"), F.substring_index("p_name", " ", -1))
    key = F.col("p_partkey") % 4
    ends = F.when(key == 0, ".rs").when(key == 1, ".ts").when(key == 2, ".py").otherwise(".go")
    text = F.when(key == 0, F.concat(F.lit("pub fn "), n, F.lit("(x: "), "p_type", F.lit(") {"))).when(key == 1, F.concat(F.lit("export const "), n, F.lit(" = (x) => x; // "), n)).when(key == 2, F.concat(F.lit("    def "), n, F.lit("(self):"))).otherwise(F.concat(F.lit("func (s *Set) "), n, F.lit("() {")))
    rows = (Tables(spark, sf)["part"] if part is None else part).select(F.concat(F.lit("b"), F.regexp_replace("p_brand", "[^0-9]", ""), ends).alias("path"), F.struct("p_partkey", text.alias("t")).alias("row"))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r.t), "\n").alias("content"))


@query("SELECT path || '#' || line || ':' || n AS id, CASE l WHEN 2 THEN 'Method' ELSE 'Function' END AS kind, n AS name, path AS file_path, line::INTEGER AS start_line, CASE l WHEN 2 THEN 4 ELSE 0 END AS start_char, line::INTEGER AS end_line, length(text)::INTEGER AS end_char FROM rows", cte=SOURCES)
def extract_lines_regex(spark, sf):
    return source.extract(files(spark, sf))


@query("SELECT DISTINCT path, CASE l WHEN 0 THEN 'rust' WHEN 1 THEN 'typescript' WHEN 2 THEN 'python' ELSE 'go' END AS language, l IN (0, 1) AS scanned FROM rows", cte=SOURCES)
def language_detect(spark, sf):
    return files(spark, sf).select("path", source.language_of(F.col("path")).alias("language"), source.scanned(F.col("path")).alias("scanned"))


@query("SELECT path, line::INTEGER AS line, (strpos(text, n) - 1)::INTEGER AS char, true AS is_definition FROM rows WHERE n = 'small_ring'", cte=SOURCES)
def textual_references(spark, sf):
    return textrefs.find_references(files(spark, sf), "small_ring")


VARIED = """varied AS (SELECT id, file_path, start_line, list_extract(['__init__', '__x', '_y', 'Zed', 'test_z', 'élan', 'main'], 1 + start_line % 7) AS name,
  list_extract(['pub fn f', 'pub(crate) fn f', 'export class C', 'private x', 'protected y', NULL, 'class Base: #[test]', 'impl Thing {', 'func (s *Set) f', 'export default React'], 1 + start_line % 10) AS detail FROM symbols WHERE kind IN ('Function', 'Class', 'Interface'))"""


def varied(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols with names and details of many shapes."""
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (1 + F.col("start_line") % n).cast("int"))
    s = graph(spark, sf, "Import").symbols.where("kind in ('Function', 'Class', 'Interface')")
    return s.withColumn("name", pick(("__init__", "__x", "_y", "Zed", "test_z", "élan", "main"), 7)).withColumn("detail", pick(("pub fn f", "pub(crate) fn f", "export class C", "private x", "protected y", None, "class Base: #[test]", "impl Thing {", "func (s *Set) f", "export default React"), 10))


@query("SELECT id, CASE WHEN contains(detail, 'pub(crate)') THEN 'Internal' WHEN contains(detail, 'pub') THEN 'Public' ELSE 'Private' END AS rust, CASE WHEN name = 'Zed' THEN 'Public' ELSE 'Private' END AS go, CASE name WHEN '__init__' THEN 'Public' WHEN '__x' THEN 'Private' WHEN '_y' THEN 'Protected' ELSE 'Public' END AS python, CASE WHEN contains(detail, 'private') THEN 'Private' WHEN contains(detail, 'protected') THEN 'Protected' WHEN contains(detail, 'export') THEN 'Public' ELSE 'Internal' END AS typescript FROM varied", cte=SYMBOLS_SQL, recursive=VARIED)
def visibility(spark, sf):
    n, d = F.col("name"), F.col("detail")
    return varied(spark, sf).select("id", *[source.visibility(x, n, d).alias(x) for x in ("rust", "go", "python", "typescript")])


@query("SELECT path, line::INTEGER AS line, text FROM rows", cte=SOURCES)
def source_lines(spark, sf):
    return source.lines(files(spark, sf))


# Upkeep.

SNAPSHOTS = "snap AS (SELECT 'cat/' || p_brand AS path, 'part:' || p_partkey AS id, p_partkey AS k FROM part)"


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """An older and a newer state of the parts as symbols of their brand's file: some went, some came."""
    rows = Tables(spark, sf)["part"].select(F.concat(F.lit("cat/"), "p_brand").alias("file_path"), F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_partkey").alias("k"))
    return rows.where("k % 7 <> 0").drop("k"), rows.where("k % 5 <> 0").drop("k")


@query("SELECT path AS file_path, id, CASE WHEN k % 7 = 0 THEN 'added' WHEN k % 5 = 0 THEN 'removed' ELSE 'updated' END AS op FROM snap WHERE k % 7 <> 0 OR k % 5 <> 0", cte=SNAPSHOTS)
def file_diff(spark, sf):
    return incremental.file_diff(*snapshots(spark, sf))


def listings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files, before and after: texts of every ninth id changed, some files are gone or new."""
    d = Tables(spark, sf)["documents"].select(F.concat(F.lit("docs/"), "doc_id").alias("path"), "doc_id", "text")
    old = d.where("doc_id % 11 <> 0").select("path", incremental.content_hash(F.col("text")).alias("hash"))
    new = d.where("doc_id % 13 <> 0").select("path", incremental.content_hash(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return old, new


@query("SELECT 'docs/' || doc_id AS path, doc_id % 11 = 0 OR doc_id % 9 = 0 AS needs_update FROM documents WHERE doc_id % 13 <> 0", cte=None)
def needs_update(spark, sf):
    return incremental.needs_update(*listings(spark, sf))


CHANGES = "ch AS (SELECT 'docs/' || doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN 'Added' WHEN doc_id % 13 = 0 THEN 'Deleted' ELSE 'Modified' END AS status, doc_id FROM documents WHERE NOT (doc_id % 11 = 0 AND doc_id % 13 = 0) AND (doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 9 = 0))"


@query("SELECT path, status FROM ch", cte=CHANGES)
def detect_changes(spark, sf):
    return incremental.detect_changes(*listings(spark, sf)).select("path", "status")


@query("SELECT c AS changed, t AS total, round(c / t, 4) AS ratio, c / t >= 0.5 AS \"full\" FROM (SELECT (SELECT count(*) FROM ch) AS c, (SELECT count(*) FROM documents WHERE doc_id % 13 <> 0) AS t)", cte=CHANGES)
def change_ratio(spark, sf):
    return incremental.change_ratio(*listings(spark, sf))


@query("SELECT count(DISTINCT path) AS files, (count(*) FILTER (k % 7 = 0 AND k % 5 <> 0) + count(*) FILTER (k % 3 = 0 AND k % 5 = 0))::BIGINT AS added, (count(*) FILTER (k % 7 <> 0 AND k % 5 = 0) + count(*) FILTER (k % 5 <> 0 AND k % 3 <> 0))::BIGINT AS removed, (count(*) FILTER (k % 7 <> 0 AND k % 5 <> 0) + count(*) FILTER (k % 5 <> 0 AND k % 3 = 0))::BIGINT AS updated FROM snap", cte=SNAPSHOTS)
def batch_update_totals(spark, sf):
    old, _ = snapshots(spark, sf)
    rows = Tables(spark, sf)["part"].select(F.concat(F.lit("cat/"), "p_brand").alias("path"), F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_partkey").alias("k"))
    update = lambda seq, kept: rows.groupBy("path").agg(F.collect_set(F.when(F.expr(kept), F.col("id"))).alias("ids")).select(F.lit(seq).alias("seq"), F.lit("modified").alias("op"), "path", "ids")
    return incremental.batch_totals(old, update(1, "k % 5 <> 0").unionByName(update(2, "k % 3 = 0")))


@query("SELECT kind, count(*) AS n FROM edges WHERE src_id NOT IN (SELECT id FROM symbols WHERE file_path = 'crm/nation_3') AND dst_id NOT IN (SELECT id FROM symbols WHERE file_path = 'crm/nation_3') GROUP BY 1")
def remove_file_edges(spark, sf):
    g = graph(spark, sf)
    return incremental.remove_files(g, spark.range(1).select(F.lit("crm/nation_3").alias("file_path"))).edges.groupBy("kind").agg(rows_as("n"))


@query("SELECT file_path AS path, array_to_string(list_sort(list(id)), ',') AS symbols FROM symbols GROUP BY 1", cte=SYMBOLS_SQL)
def files_of_graph(spark, sf):
    return incremental.files_of(graph(spark, sf, "Import")).select("path", F.array_join("symbols", ",").alias("symbols"))


# Formats.


@query("SELECT type, label, count(*) AS n FROM (SELECT 'vertex' AS type, unnest(['range', 'resultSet']) AS label FROM symbols UNION ALL SELECT 'edge', unnest(['contains', 'next']) FROM symbols UNION ALL SELECT 'vertex', 'document' FROM (SELECT DISTINCT file_path FROM symbols) UNION ALL SELECT 'edge', 'contains' FROM (SELECT DISTINCT file_path FROM symbols) UNION ALL SELECT 'vertex', unnest(['metaData', 'project'])) GROUP BY ALL", cte=SYMBOLS_SQL)
def lsif_elements_by_label(spark, sf):
    lines = formats.lsif(graph(spark, sf, "Import"))
    return lines.select(F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.label").alias("label")).groupBy("type", "label").agg(rows_as("n"))


@query("SELECT id, kind, name, file_path FROM symbols", cte=SYMBOLS_SQL)
def json_round_trip(spark, sf):
    return formats.from_json(formats.to_json(graph(spark, sf, "Import"))).symbols.select("id", "kind", "name", "file_path")


@query("SELECT id, file_path || chr(9) || (start_line + 1) || chr(9) || '1' || chr(9) || kind || chr(9) || name AS tsv, file_path || ':' || (start_line + 1) || ':' || name AS grep, file_path || ':' || (start_line + 1) || ':1: ' || kind || ' ' || name AS quickfix FROM symbols WHERE kind IN ('Class', 'Function')", cte=SYMBOLS_SQL)
def format_text(spark, sf):
    s = graph(spark, sf, "Import").symbols.where("kind in ('Class', 'Function')")
    return s.select("id", *[formats.formatted(x).alias(x) for x in ("tsv", "grep", "quickfix")])


@query("SELECT 'turn:' || conv_id || ':' || m AS start, t AS text FROM (SELECT conv_id, max(turn) AS m, string_agg(role || ' (chat/conv_' || conv_id || ':' || (turn + 1) || ')', ' → ' ORDER BY turn DESC) AS t FROM conversations GROUP BY 1)", cte=None)
def definition_chain_text(spark, sf):
    g = graph(spark, sf, "Definition")
    last = Tables(spark, sf)["conversations"].groupBy("conv_id").agg(F.max("turn").alias("m")).select(F.concat_ws(":", F.lit("turn"), "conv_id", "m").alias("id"))
    return formats.chain_text(traverse.chains(g.of_kind("Definition"), last), g.symbols)
