"""Graphs as LSIF lines, JSON and tables, and symbols as text in several formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.schema import CANONICAL, EDGES, SYMBOL_COLUMNS, SYMBOLS, Graph


def load(spark: SparkSession, folder: str) -> Graph:
    """The tables below folder; empty ones where there are none."""
    from pyspark.errors import AnalysisException

    def one(name: str, kind: str) -> DataFrame:
        try:
            return spark.read.schema(kind).parquet(f"{folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], kind)

    return Graph(one("symbols", SYMBOLS), one("edges", EDGES))


def save(g: Graph, folder: str) -> None:
    g.symbols.write.mode("overwrite").parquet(f"{folder}/symbols")
    g.edges.write.mode("overwrite").parquet(f"{folder}/edges")


def lsif(g: Graph) -> DataFrame:
    """n, value: the lines in order. First the meta data and the project, then each file's document, then each symbol's
    range, result set and hover result with the edges between them."""
    meta = g.symbols.sparkSession.range(1)
    position = lambda line, char: F.struct(F.col(line).alias("line"), F.col(char).alias("character"))
    files = g.symbols.select("file_path").distinct()
    key = lambda phase, path, line, ident, step: [F.lit(phase).alias("phase"), path.alias("path"), line.alias("sline"), ident.alias("ident"), F.lit(step).alias("step")]
    none, zero = F.lit(""), F.lit(0)
    vertex = lambda label, **data: F.to_json(F.struct(F.lit("vertex").alias("type"), F.lit(label).alias("label"), *[c.alias(k) for k, c in data.items()]))
    edge = lambda label, a, b: F.to_json(F.struct(F.lit("edge").alias("type"), F.lit(label).alias("label"), a.alias("outV"), b.alias("inV")))
    doc = F.concat(F.lit("d:"), F.col("file_path"))
    of = lambda p: F.concat(F.lit(p), F.col("id"))
    parts = [
        meta.select(*key(0, none, zero, none, 0), vertex("metaData", version=F.lit("0.5.0"), positionEncoding=F.lit("utf-16")).alias("value")),
        meta.select(*key(0, none, zero, none, 1), vertex("project", vid=F.lit("project"), kind=F.lit("lodestar")).alias("value")),
        files.select(*key(1, F.col("file_path"), zero, none, 0), vertex("document", vid=doc, uri=F.concat(F.lit("file://"), F.col("file_path"))).alias("value")),
        files.select(*key(1, F.col("file_path"), zero, none, 1), edge("contains", F.lit("project"), doc).alias("value")),
    ]
    s = g.symbols
    rows = [
        (vertex("range", vid=of("r:"), start=position("start_line", "start_char"), end=position("end_line", "end_char")), None),
        (edge("contains", doc, of("r:")), None),
        (vertex("resultSet", vid=of("s:")), None),
        (edge("next", of("r:"), of("s:")), None),
        (vertex("hoverResult", vid=of("h:"), result=F.col("documentation")), "documentation is not null"),
        (edge("textDocument/hover", of("s:"), of("h:")), "documentation is not null"),
    ]
    for step, (value, condition) in enumerate(rows):
        own = s if condition is None else s.where(condition)
        parts.append(own.select(*key(2, F.col("file_path"), F.col("start_line"), F.col("id"), step), value.alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def numbered(lines: DataFrame) -> DataFrame:
    """n (from 1), value in the order of the format. Ranks are counted within ranges and added up, not in one task."""
    order = ["phase", "path", "sline", "ident", "step"]
    ranged = lines.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    from lodestar.plans.tables import materialized

    kept = materialized(ranged.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(*order))))
    sizes = kept.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    return kept.join(F.broadcast(before), "part").select((F.col("before") + F.col("r")).alias("n"), "value")


def write_lsif(g: Graph, path: str) -> None:
    numbered(lsif(g)).orderBy("n").select("value").write.text(path)


def read_lsif(lines: DataFrame) -> Graph:
    """Symbols of the ranges that a definition or references edge leaves, by way of `contains` edges to documents.

    lines: one column, value. Other labels are left out; a line that is no JSON is an error when it is read.
    """
    f = lambda p: F.get_json_object("value", f"$.{p}")
    rows = lines.select(F.when(F.from_json("value", "type string").isNotNull(), F.col("value")).alias("value")).select(*[f(p).alias(n) for n, p in (("type", "type"), ("label", "label"), ("vid", "vid"), ("id", "id"), ("outV", "outV"), ("inV", "inV"), ("uri", "uri"), ("sl", "start.line"), ("sc", "start.character"), ("el", "end.line"), ("ec", "end.character"))]).withColumn("vid", F.coalesce("vid", "id"))
    documents = rows.where("label = 'document'").select(F.col("vid").alias("doc"), F.regexp_replace("uri", "^file://", "").alias("file_path"))
    held = rows.where("label = 'contains'").select(F.col("outV").alias("doc"), F.col("inV").alias("vid")).join(documents, "doc")
    ranges = rows.where("label = 'range'").select("vid", *[F.col(a).cast("int").alias(b) for a, b in (("sl", "start_line"), ("sc", "start_char"), ("el", "end_line"), ("ec", "end_char"))])
    named = rows.where("type = 'edge' and label in ('textDocument/definition', 'textDocument/references')").select(F.col("outV").alias("vid")).distinct()
    found = ranges.join(named, "vid", "left_semi").join(held.select("vid", "file_path"), "vid", "left")
    ident = F.concat(F.lit("symbol_"), F.col("vid"))
    symbols = found.select(ident.alias("id"), F.lit("Function").alias("kind"), ident.alias("name"), F.coalesce("file_path", F.lit("")).alias("file_path"), "start_line", "start_char", "end_line", "end_char", F.lit(None).cast("string").alias("documentation"), F.lit(None).cast("string").alias("detail"))
    return Graph(symbols, lines.sparkSession.createDataFrame([], EDGES))


def to_json(g: Graph) -> DataFrame:
    """part (symbol or edge), value: one JSON object a row."""
    symbols = g.symbols.select(F.lit("symbol").alias("part"), F.to_json(F.struct(*SYMBOL_COLUMNS)).alias("value"))
    return symbols.unionByName(g.edges.select(F.lit("edge").alias("part"), F.to_json(F.struct(F.col("src_id").alias("from_id"), F.col("dst_id").alias("to_id"), "kind")).alias("value")))


def from_json(rows: DataFrame) -> Graph:
    """The graph of rows as to_json gives them; edges to unknown ids go."""
    symbols = rows.where("part = 'symbol'").select(F.from_json("value", SYMBOLS).alias("s")).select("s.*")
    edges = rows.where("part = 'edge'").select(F.from_json("value", "from_id string, to_id string, kind string").alias("e")).select(F.col("e.from_id").alias("src_id"), F.col("e.to_id").alias("dst_id"), F.col("e.kind").alias("kind"))
    return Graph.build(symbols, edges)


def formatted(style: str) -> Column:
    """One symbol as text; lines and columns from 1, but from 0 in lsp and json."""
    line, char = (F.col("start_line") + 1).cast("string"), (F.col("start_char") + 1).cast("string")
    styles = {
        "human": lambda: F.concat(F.col("name"), F.lit(" ("), F.col("kind"), F.lit(") at "), F.col("file_path"), F.lit(":"), line, F.lit(":"), char),
        "quickfix": lambda: F.concat_ws(":", "file_path", line, char, F.concat(F.lit(" "), F.col("kind"), F.lit(" "), F.col("name"))),
        "grep": lambda: F.concat_ws(":", "file_path", line, "name"),
        "tsv": lambda: F.concat_ws("\t", "file_path", line, char, "kind", "name"),
        "null": lambda: F.concat_ws(":", "file_path", line, char),
        "lsp": lambda: F.to_json(F.struct(F.concat(F.lit("file://"), F.col("file_path")).alias("uri"), F.struct(F.struct(F.col("start_line").alias("line"), F.col("start_char").alias("character")).alias("start"), F.struct(F.col("end_line").alias("line"), F.col("end_char").alias("character")).alias("end")).alias("range"))),
        "json": lambda: F.to_json(F.struct("name", "kind", F.col("file_path").alias("file"), F.col("start_line").alias("line"), F.col("start_char").alias("column"))),
    }
    alias = {"vim": "quickfix", "qf": "quickfix", "tab": "tsv", "0": "null", "text": "human"}
    name = alias.get(style, style)
    if name not in styles:
        raise ValueError(f"unknown format: {style}")
    return styles[name]()


def chain_text(chains: DataFrame, symbols: DataFrame) -> DataFrame:
    """start, text: name (file:line) of each link, joined by arrows, and a mark for a cycle."""
    shown = symbols.select(F.col("id").alias("link"), F.concat(F.col("name"), F.lit(" ("), F.col("file_path"), F.lit(":"), F.col("start_line") + 1, F.lit(")")).alias("t"))
    links = chains.select("start", "has_cycle", F.posexplode("chain").alias("i", "link")).join(shown, "link")
    rows = links.groupBy("start", "has_cycle").agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("ts"))
    return rows.select("start", F.concat(F.array_join(F.transform("ts", lambda x: x.t), " → "), F.when(F.col("has_cycle"), " [CYCLE DETECTED]").otherwise("")).alias("text"))


def listed(symbols: DataFrame, style: str) -> DataFrame:
    """value, in the canonical order: a line for each symbol, or with json one text of all, a list."""
    if style != "json":
        return symbols.orderBy(*CANONICAL).select(formatted(style).alias("value"))
    rows = F.array_sort(F.collect_list(F.struct(*CANONICAL, formatted("json").alias("v"))))
    return symbols.agg(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda x: x.v), ","), F.lit("]")).alias("value"))


def tree_text(rows: list[tuple[str, str | None]], root: str) -> str:
    """A call tree of (node, parent) rows of one root, drawn with lines; a node above itself isn't drawn again."""
    below: dict[str | None, list[str]] = {}
    for node, parent in sorted(rows, key=lambda r: r[0]):
        below.setdefault(parent, []).append(node)
    out = [root]
    kids = below.get(root, [])
    todo = [(k, "", i + 1 == len(kids), (root,)) for i, k in reversed(list(enumerate(kids)))]
    while todo:
        node, indent, end, above = todo.pop()
        out.append(f"{indent}{'└── ' if end else '├── '}{node}")
        if node not in above:
            kids = below.get(node, [])
            todo += [(k, indent + ("    " if end else "│   "), i + 1 == len(kids), (*above, node)) for i, k in reversed(list(enumerate(kids)))]
    return "\n".join(out)


def match_lines(matches: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row per binding, text: its variables in the order of their columns, each as name (kind)."""
    names, rows = matches.columns, matches
    shown = symbols.select("id", "name", "kind")
    for c in names:
        rows = rows.join(shown.select(F.col("id").alias(c), F.concat("name", F.lit(" ("), "kind", F.lit(")")).alias(f"__{c}")), c)
    return rows.select(*names, F.concat_ws("\n", F.lit("  Bindings:"), *[F.concat(F.lit(f"    {c}: "), F.col(f"__{c}")) for c in names]).alias("text"))


def matches_text(matches: DataFrame, symbols: DataFrame, most: int | None = None) -> str:
    """How many bindings there are and all of them, or the first `most` by id, as one text on the driver; match_lines()
    has them as rows."""
    rows = match_lines(matches, symbols).orderBy(*matches.columns)
    found = (rows if most is None else rows.limit(most)).select("text").collect()
    total = len(found) if most is None else matches.count()
    out = [f"Found {total} matches", ""]
    for i, r in enumerate(found):
        out += [f"Match {i + 1}:", r["text"], ""]
    return "\n".join(out)


def relations_report(relations: DataFrame, symbols: DataFrame, most: int = 5) -> DataFrame:
    """root_id, bucket, n, first: each bucket's size and its first names. relations: root_id, bucket, symbol_id."""
    from lodestar.plans.tables import materialized

    relations = materialized(relations)
    named = relations.join(symbols.select(F.col("id").alias("symbol_id"), "name"), "symbol_id")
    rank = F.row_number().over(Window.partitionBy("root_id", "bucket").orderBy("name", "symbol_id"))
    sizes = relations.groupBy("root_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    first = named.withColumn("r", rank).where(F.col("r") <= most).groupBy("root_id", "bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ", ").alias("first"))
    return sizes.join(first, ["root_id", "bucket"], "left")
