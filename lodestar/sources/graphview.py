"""A graph over star-schema tables, so that every operator has data of any size to run on.

region, nation, customer, supplier, part, orders, events and conversation turns are symbols; their relations are edges.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.plans.tables import near
from lodestar.schema import SYMBOL_COLUMNS, Graph


#: The tables' columns. A read with a schema needs no job that looks into files first.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "conversations": "conv_id long, turn long, role string, text string",
}


class Tables:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        read = self.spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else self.spark.read
        return read.parquet(f"{self.folder}/{name}.parquet")


def camel(words: Column) -> Column:
    first, second = F.substring_index(words, " ", 1), F.substring_index(words, " ", -1)
    return F.concat(first, F.initcap(second))


def node(df: DataFrame, prefix: str, key: str, kind: str, name: Column, path: Column, detail: Column | None = None) -> DataFrame:
    line = (F.col(key) % 1000).cast("int")
    columns = [F.concat(F.lit(prefix), F.col(key)), F.lit(kind), name, path, line, F.lit(0), line + 5, F.lit(10), F.lit(None).cast("string"), detail if detail is not None else F.lit(None).cast("string")]
    return df.select(*[c.alias(n) for c, n in zip(columns, SYMBOL_COLUMNS, strict=True)])


def under(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key))


def signature() -> Column:
    return F.concat(F.lit("fn "), camel(F.col("p_name")), F.lit("(size: "), F.col("p_type"), F.lit(") -> "), F.translate("p_brand", "#", ""))


def symbols(t: Tables) -> DataFrame:
    turns = t["conversations"].select(F.concat_ws(":", F.lit("turn"), "conv_id", "turn").alias("id"), F.lit("Parameter").alias("kind"), F.col("role").alias("name"), under("chat/conv_", "conv_id").alias("file_path"), F.col("turn").cast("int").alias("start_line"), F.lit(0).alias("start_char"), F.col("turn").cast("int").alias("end_line"), F.lit(10).alias("end_char"), F.lit(None).cast("string").alias("documentation"), F.lit(None).cast("string").alias("detail"))
    parts = [
        node(t["region"], "region:", "r_regionkey", "Module", F.col("r_name"), F.lit("geo/world")),
        node(t["nation"], "nation:", "n_nationkey", "Namespace", F.col("n_name"), under("geo/region_", "n_regionkey")),
        node(t["customer"], "customer:", "c_custkey", "Class", F.col("c_name"), under("crm/nation_", "c_nationkey"), F.concat(F.lit("class implements "), F.col("c_mktsegment"))),
        node(t["supplier"], "supplier:", "s_suppkey", "Interface", F.col("s_name"), under("scm/nation_", "s_nationkey")),
        node(t["part"], "part:", "p_partkey", "Function", camel(F.col("p_name")), F.concat(F.lit("cat/"), F.translate("p_brand", "#", "")), signature()),
        node(t["orders"], "order:", "o_orderkey", "Variable", F.col("o_orderpriority"), under("oms/cust_", "o_custkey"), F.col("o_orderstatus")),
        node(t["events"], "event:", "event_id", "Method", F.col("event_type"), under("evt/user_", "user_id")),
        turns,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edge(df: DataFrame, src: Column, dst: Column, kind: str) -> DataFrame:
    return df.select(src.alias("src_id"), dst.alias("dst_id"), F.lit(kind).alias("kind"))


def before(df: DataFrame, key: str, group: str, *order: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.select(key, F.lag(key).over(w).alias("prev")).where("prev is not null")


def imports(t: Tables) -> DataFrame:
    """Each supplier nation imports from its two largest customer nations by quantity."""
    # Nations come before the sums: pairs of suppliers and customers hardly repeat, so their sums would be as many as order lines.
    # Lines are shuffled once, by their order; an order is one row of its side, so that side is hashed and lines are not sorted.
    supplier, customer = near(t["supplier"].select("s_suppkey", "s_nationkey")), near(t["customer"].select("c_custkey", "c_nationkey"))
    owner = t["orders"].select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    flows = (
        t["lineitem"].select("l_orderkey", "l_suppkey", "l_quantity")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("l_orderkey", "s_nationkey", "l_quantity")
        .join(owner.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
        .where("s_nationkey <> c_nationkey")
        .groupBy("s_nationkey", "c_nationkey").agg(F.sum("l_quantity").alias("q"))
    )
    rank = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("q"), "c_nationkey"))
    return edge(flows.withColumn("r", rank).where("r <= 2"), under("nation:", "s_nationkey"), under("nation:", "c_nationkey"), "Import")


def edge_sets(t: Tables) -> dict[str, list[Callable[[], DataFrame]]]:
    n, c, s, o, li, e, k = (t[x] for x in ("nation", "customer", "supplier", "orders", "lineitem", "events", "conversations"))
    turn = lambda x: F.concat_ws(":", F.lit("turn"), "conv_id", x)
    return {
        "Contains": [
            lambda: edge(n, under("region:", "n_regionkey"), under("nation:", "n_nationkey"), "Contains"),
            lambda: edge(c, under("nation:", "c_nationkey"), under("customer:", "c_custkey"), "Contains"),
            lambda: edge(s, under("nation:", "s_nationkey"), under("supplier:", "s_suppkey"), "Contains"),
        ],
        "Reference": [
            lambda: edge(o, under("order:", "o_orderkey"), under("customer:", "o_custkey"), "Reference"),
            lambda: edge(li, under("order:", "l_orderkey"), under("part:", "l_partkey"), "Reference"),
            lambda: edge(before(e, "event_id", "user_id", "ts", "event_id"), under("event:", "event_id"), under("event:", "prev"), "Reference"),
        ],
        "Implementation": [lambda: edge(li.select("l_partkey", "l_suppkey").distinct(), under("part:", "l_partkey"), under("supplier:", "l_suppkey"), "Implementation")],
        "Definition": [
            lambda: edge(before(o, "o_orderkey", "o_custkey", "o_orderdate", "o_orderkey"), under("order:", "o_orderkey"), under("order:", "prev"), "Definition"),
            lambda: edge(k.where("turn > 0"), turn("turn"), turn(F.col("turn") - 1), "Definition"),
        ],
        "Override": [lambda: edge(before(e.select("event_id", "ts", F.struct("user_id", "event_type").alias("group")), "event_id", "group", "ts", "event_id"), under("event:", "event_id"), under("event:", "prev"), "Override")],
        "Import": [lambda: imports(t)],
        "Export": [lambda: edge(o.where("o_orderstatus = 'F'"), under("order:", "o_orderkey"), under("order:", "o_orderkey"), "Export")],
    }


def lattice(spark: SparkSession, folder: str) -> Graph:
    """The same symbols with Contains edges that meet again (a part holds its suppliers, these their nation, this its
    region) and References between parts and suppliers, so that complexities differ."""
    t = Tables(spark, folder)
    li = t["lineitem"]
    held = li.select("l_partkey", "l_suppkey").distinct()
    some = li.select("l_partkey", "l_suppkey", "l_tax")
    parts = [
        edge(held, under("part:", "l_partkey"), under("supplier:", "l_suppkey"), "Contains"),
        edge(t["supplier"], under("supplier:", "s_suppkey"), under("nation:", "s_nationkey"), "Contains"),
        edge(t["nation"], under("nation:", "n_nationkey"), under("region:", "n_regionkey"), "Contains"),
        edge(some.where("l_tax = 0.08"), under("part:", "l_partkey"), under("supplier:", "l_suppkey"), "Reference"),
        edge(some.where("l_tax = 0.01"), under("supplier:", "l_suppkey"), under("part:", "l_partkey"), "Reference"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return Graph(symbols(t), out)


class View(Graph):
    """A graph whose edges are planned when they are first asked for: many queries want symbols only, and imports count rows."""

    def __init__(self, t: Tables, kinds: tuple[str, ...]) -> None:
        self.t, self.kinds, self.symbols = t, kinds, symbols(t)

    @cached_property
    def edges(self) -> DataFrame:
        sets = edge_sets(self.t)
        frames = [f() for k in self.kinds or sets for f in sets[k]]
        edges = frames[0]
        for f in frames[1:]:
            edges = edges.unionByName(f)
        return edges


def graph(spark: SparkSession, folder: str, *kinds: str) -> Graph:
    """The graph with the edges of these kinds, or of all."""
    return View(Tables(spark, folder), kinds)


#: The same view in DuckDB's SQL, for oracles.
SYMBOLS_SQL = """symbols AS (
  SELECT 'region:' || r_regionkey AS id, 'Module' AS kind, r_name AS name, 'geo/world' AS file_path, CAST(r_regionkey % 1000 AS INTEGER) AS start_line, CAST(NULL AS VARCHAR) AS detail FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'Namespace', n_name, 'geo/region_' || n_regionkey, n_nationkey % 1000, NULL FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'Class', c_name, 'crm/nation_' || c_nationkey, c_custkey % 1000, 'class implements ' || c_mktsegment FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'Interface', s_name, 'scm/nation_' || s_nationkey, s_suppkey % 1000, NULL FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'Function', split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2),
    'cat/' || replace(p_brand, '#', ''), p_partkey % 1000,
    'fn ' || split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) || '(size: ' || p_type || ') -> ' || replace(p_brand, '#', '') FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'Variable', o_orderpriority, 'oms/cust_' || o_custkey, o_orderkey % 1000, o_orderstatus FROM orders
  UNION ALL SELECT 'event:' || event_id, 'Method', event_type, 'evt/user_' || user_id, event_id % 1000, NULL FROM events
  UNION ALL SELECT 'turn:' || conv_id || ':' || turn, 'Parameter', role, 'chat/conv_' || conv_id, turn, NULL FROM conversations)"""
EDGES_SQL = """flows AS (
  SELECT s_nationkey AS s, c_nationkey AS c, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
  WHERE s_nationkey <> c_nationkey GROUP BY ALL),
imports AS (SELECT s, c FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY q DESC, c) AS r FROM flows) WHERE r <= 2),
edges AS (
  SELECT 'region:' || n_regionkey AS src_id, 'nation:' || n_nationkey AS dst_id, 'Contains' AS kind FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'Contains' FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'Contains' FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'Reference' FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'Reference' FROM lineitem
  UNION ALL SELECT 'event:' || event_id, 'event:' || p, 'Reference' FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'Implementation' FROM lineitem
  UNION ALL SELECT 'order:' || o_orderkey, 'order:' || p, 'Definition' FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) WHERE p IS NOT NULL
  UNION ALL SELECT 'turn:' || conv_id || ':' || turn, 'turn:' || conv_id || ':' || (turn - 1), 'Definition' FROM conversations WHERE turn > 0
  UNION ALL SELECT 'event:' || event_id, 'event:' || p, 'Override' FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL
  UNION ALL SELECT 'nation:' || s, 'nation:' || c, 'Import' FROM imports
  UNION ALL SELECT 'order:' || o_orderkey, 'order:' || o_orderkey, 'Export' FROM orders WHERE o_orderstatus = 'F')"""
GRAPH_SQL = f"{SYMBOLS_SQL},\n{EDGES_SQL}"
LATTICE_SQL = f"""{SYMBOLS_SQL},
edges AS (
  SELECT DISTINCT 'part:' || l_partkey AS src_id, 'supplier:' || l_suppkey AS dst_id, 'Contains' AS kind FROM lineitem
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'Contains' FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'Contains' FROM nation
  UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'Reference' FROM lineitem WHERE l_tax = 0.08
  UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'Reference' FROM lineitem WHERE l_tax = 0.01),
held AS (SELECT DISTINCT 'part:' || l_partkey AS p, 'supplier:' || l_suppkey AS s, n_regionkey AS r FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
outs AS (SELECT src_id, count(*) AS b FROM edges WHERE kind = 'Reference' GROUP BY 1),
ins AS (SELECT dst_id, count(*) AS b FROM edges WHERE kind = 'Reference' GROUP BY 1),
cyc AS (SELECT id, greatest(0, count(h.s) - count(DISTINCT h.r) - 1) + 2 AS cyclomatic, CASE WHEN count(h.s) > 0 THEN 3 ELSE 0 END AS depth, sum(CASE WHEN o.b > 1 THEN 2 * (o.b - 1) ELSE 0 END) AS inner_weight
  FROM symbols LEFT JOIN held h ON h.p = id LEFT JOIN outs o ON o.src_id = h.s WHERE kind IN ('Function', 'Method') GROUP BY 1),
far AS (SELECT e.src_id, count(DISTINCT e.dst_id) AS d FROM edges e JOIN symbols a ON a.id = e.src_id JOIN symbols b ON b.id = e.dst_id WHERE e.kind = 'Reference' AND a.file_path <> b.file_path GROUP BY 1)"""
