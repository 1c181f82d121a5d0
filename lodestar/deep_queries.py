"""Queries of alignments, kept indices and analyses that are kept up to date; registered with those of lodestar.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.index_queries import PATH_EXISTS, values
from lodestar.operators import liveness, nameindex, reachability, search
from lodestar.plans.tables import materialized, new_folder
from lodestar.queries import CHANGES, CORE, FUZZY, LIVE, REACH, listings, per_word, query
from lodestar.schema import SYMBOL_COLUMNS, Graph
from lodestar.sources import formats, lsif
from lodestar.sources.graphview import LATTICE_SQL, SYMBOLS_SQL, Tables, graph, lattice, under
from lodestar.streaming import kept, trees

#: Every way of finding the letters of the query in a name in their order, with its score.
ALIGNED = """q AS (SELECT 'smRg' AS q), names AS (SELECT DISTINCT name FROM symbols WHERE kind = 'Function'),
letters AS (SELECT name, j, substr(name, j, 1) AS c, CASE WHEN j = 1 THEN 8 WHEN NOT regexp_matches(substr(name, j - 1, 1), '[a-zA-Z0-9]') THEN 7 WHEN regexp_matches(substr(name, j - 1, 2), '[a-z0-9][A-Z]|[a-zA-Z][0-9]') THEN 6 ELSE 0 END AS bonus FROM names, unnest(range(1, length(name) + 1)) AS t(j)),
w(name, i, j, score) AS (SELECT name, 1, j, 16 - CASE WHEN c = q[1] THEN 0 ELSE 2 END + 2 * bonus FROM letters, q WHERE lower(c) = lower(q[1])
  UNION ALL SELECT w.name, i + 1, l.j, score + 16 - CASE WHEN c = q[i + 1] THEN 0 ELSE 2 END + CASE WHEN l.j = w.j + 1 THEN greatest(bonus, 4) ELSE bonus - 3 - (l.j - w.j - 2) END FROM w JOIN letters l ON l.name = w.name AND l.j > w.j, q WHERE lower(c) = lower(q[i + 1]))"""


@query("SELECT s.id, s.name, 'Fuzzy' AS match_type, best::DOUBLE AS score FROM symbols s JOIN (SELECT name, max(score) AS best FROM w WHERE i = 4 GROUP BY 1) USING (name) WHERE kind = 'Function' AND best > 30 ORDER BY score DESC, strlen(name), id LIMIT 40", cte=SYMBOLS_SQL, recursive=ALIGNED)
def fuzzy_engine_last_resort(spark, sf):
    """No name equals, starts with or has the camel words of the query, so its alignments come out."""
    return search.engine_search(graph(spark, sf, "Import").symbols.where("kind = 'Function'"), "smRg", 40, last_resort=True)


@query(CORE, cte=SYMBOLS_SQL, recursive=FUZZY)
def core_search_by_index(spark, sf):
    """The core search over a kept index: built when some files held other names, then brought up to date."""
    s = graph(spark, sf, "Import").symbols.where("kind = 'Function'").select("id", "name", "file_path")
    changed = F.col("file_path").endswith("1")
    folder = new_folder(spark)
    gone = s.where(changed).select(F.concat(F.lit("old:"), "id").alias("id"), "name", F.lit("cat/gone").alias("file_path"))
    nameindex.build(s.withColumn("name", F.when(changed, F.reverse("name")).otherwise(F.col("name"))).unionByName(gone), folder)
    now = s.where(changed)
    nameindex.update(spark, folder, now, now.select(F.col("file_path").alias("path")).unionByName(spark.range(1).select(F.lit("cat/gone").alias("path"))), 1)
    return per_word(lambda w: nameindex.search(spark, folder, w, None))


@query("SELECT id FROM symbols WHERE id NOT IN (SELECT id FROM live)", recursive=LIVE)
def dead_symbols_upkeep(spark, sf):
    """Dead symbols after an update: it adds the edges of every seventh order, and takes out edges that ran the wrong way."""
    g = graph(spark, sf, "Reference", "Definition")
    after = materialized(g.of_kind("Reference", "Definition"))
    key = F.when(F.col("src_id").startswith("order:"), F.substring_index("src_id", ":", -1).cast("long"))
    turned = after.where(key % 7 == 1).select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))
    before = materialized(after.where(F.coalesce(key % 7 != 0, F.lit(True))).unionByName(turned))
    entries = g.symbols.where("kind = 'Variable' and name = '1-URGENT'").select("id")
    fewer = entries.where(F.substring_index("id", ":", -1).cast("long") % 5 != 0).unionByName(g.symbols.where("kind = 'Class' and start_line = 1").select("id"))
    state = liveness.start(before, fewer)
    return liveness.dead(g.symbols, liveness.update(state, before, after, fewer, entries).live)


@query(PATH_EXISTS, recursive=REACH)
def reachability_by_labels(spark, sf):
    e = graph(spark, sf, "Import").of_kind("Import")
    n = graph(spark, sf, "Import").symbols.where("kind = 'Namespace'").select("id").unionByName(values(spark, [("nobody",)], "id string"))
    pairs = n.select(F.col("id").alias("src")).crossJoin(n.select(F.col("id").alias("dst")))  # 26 by 26
    return reachability.answer(pairs, *reachability.label(e))


@query("SELECT DISTINCT p.src, p.dst, EXISTS (SELECT 1 FROM up WHERE up.a = p.src AND up.b = p.dst) AS found FROM asked p", cte=LATTICE_SQL, recursive="up AS (SELECT src_id AS a, dst_id AS b FROM edges WHERE kind = 'Contains' UNION SELECT p, 'nation:' || s_nationkey FROM held JOIN supplier ON s = 'supplier:' || s_suppkey UNION SELECT p, 'region:' || r FROM held UNION SELECT 'supplier:' || s_suppkey, 'region:' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey), asked AS (SELECT 'part:' || l_partkey AS src, 'region:' || (l_orderkey % 5) AS dst FROM lineitem UNION SELECT 'part:' || l_partkey, 'nation:' || (l_suppkey % 25) FROM lineitem)")
def containment_by_labels(spark, sf):
    """Whether a part holds, over its suppliers and their nations, the nation or region that an order line asks for."""
    g = lattice(spark, sf)
    line = Tables(spark, sf)["lineitem"]
    part = under("part:", "l_partkey").alias("src")
    asked = line.select(part, F.concat(F.lit("region:"), F.col("l_orderkey") % 5).alias("dst")).unionByName(line.select(part, F.concat(F.lit("nation:"), F.col("l_suppkey") % 25).alias("dst")))
    return reachability.answer(asked, *reachability.label(g.of_kind("Contains")))


TOUCHED = "gone AS (SELECT DISTINCT file_path AS f FROM symbols WHERE starts_with(file_path, 'crm/nation_') AND split_part(file_path, '_', 2)::INTEGER % 5 = 0), new AS (SELECT DISTINCT file_path AS f FROM symbols WHERE starts_with(file_path, 'oms/cust_') AND split_part(file_path, '_', 2)::INTEGER % 10 = 0)"


@query("SELECT 'symbol' AS part, kind, count(*) AS n FROM symbols WHERE kind IN ('Class', 'Variable') AND file_path NOT IN (SELECT f FROM gone) GROUP BY 2 UNION ALL SELECT 'renewed', kind, count(*) FROM symbols WHERE file_path IN (SELECT f FROM new) GROUP BY 2 UNION ALL SELECT 'edge', e.kind, count(*) FROM edges e JOIN symbols a ON a.id = src_id JOIN symbols b ON b.id = dst_id WHERE e.kind IN ('Reference', 'Definition') AND a.kind = 'Variable' AND b.kind IN ('Class', 'Variable') AND NOT EXISTS (SELECT 1 FROM (SELECT f FROM gone UNION ALL SELECT f FROM new) t WHERE t.f = a.file_path OR t.f = b.file_path) GROUP BY 2", recursive=TOUCHED)
def kept_generations(spark, sf):
    """A kept graph after a batch in which some files went and others came anew, counted by kind."""
    g = graph(spark, sf, "Reference", "Definition")
    own = g.symbols.where("kind in ('Class', 'Variable')")
    folder = new_folder(spark)
    kept.create(Graph(own, g.edges), folder)
    number = F.regexp_extract("file_path", r"^(?:crm/nation|oms/cust)_(\d+)$", 1).cast("int")
    touched = own.withColumn("n", number).where((F.col("kind") == "Class") & (F.col("n") % 5 == 0) | (F.col("kind") == "Variable") & (F.col("n") % 10 == 0))
    again = F.struct(*[F.concat("id", F.lit(":new")).alias("id") if c == "id" else F.col(c) for c in SYMBOL_COLUMNS])
    batch = touched.groupBy(F.col("file_path").alias("path")).agg(F.first("kind").alias("k"), F.collect_list(again).alias("symbols"))
    rows = batch.select(F.lit(1).cast("long").alias("seq"), F.when(F.col("k") == "Class", "removed").otherwise("modified").alias("op"), "path", "symbols")
    kept.apply(spark, folder, rows, 1)
    now = kept.load(spark, folder)
    count = lambda df, part: df.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "kind", "n")
    return count(now.symbols, "symbol").unionByName(count(now.symbols.where(F.col("id").endswith(":new")), "renewed")).unionByName(count(now.edges, "edge"))


@query("SELECT replace(path, 'docs/', 'docs/' || (split_part(path, '/', 2)::BIGINT % 40) || '/') AS path, status FROM ch", cte=CHANGES)
def tree_changes(spark, sf):
    """The changed documents, found through directories that differ."""
    spread = lambda df: df.select(F.concat(F.lit("docs/"), F.substring_index("path", "/", -1).cast("long") % 40, F.lit("/"), F.substring_index("path", "/", -1)).alias("path"), "hash")
    folders = [new_folder(spark), new_folder(spark)]
    for df, folder in zip(listings(spark, sf), folders, strict=True):
        trees.store(spread(df), folder)
    return trees.changes(spark, *folders).select("path", "status")


@query("SELECT CASE kind WHEN 'Class' THEN 'customers' ELSE 'nations' END AS part, count(*) AS ranges, count(DISTINCT file_path) AS files FROM symbols WHERE kind IN ('Class', 'Namespace') GROUP BY 1", cte=SYMBOLS_SQL)
def lsif_source(spark, sf):
    """Symbols written by the data source and read back by ranges of bytes, counted by their ids."""
    g = graph(spark, sf, "Import")
    folder = new_folder(spark)
    lsif.write_lines(formats.numbered(formats.lsif(Graph(g.symbols.where("kind in ('Class', 'Namespace')"), g.edges))), folder)
    lines = materialized(lsif.read_lines(spark, folder, 50_000).select("value"))
    of = lambda p: F.get_json_object("value", f"$.{p}")
    held = lines.where(F.col("value").contains('"contains"')).select(of("outV").alias("doc"), of("inV").alias("vid")).where("vid like 'r:%'")
    ranges = lines.where(F.col("value").contains('"label":"range"')).select(of("vid").alias("vid"))
    part = F.when(F.col("vid").startswith("r:customer:"), "customers").otherwise("nations")
    return ranges.join(held, "vid").groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("ranges"), F.count_distinct("doc").alias("files"))
