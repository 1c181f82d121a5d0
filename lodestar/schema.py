"""The data model: symbols (nodes) and edges (a directed multigraph)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The closed sets of kinds.
SYMBOL_KINDS = (
    "File", "Module", "Namespace", "Package", "Class", "Method", "Property", "Field", "Constructor", "Enum", "Interface",
    "Function", "Variable", "Constant", "String", "Number", "Boolean", "Array", "Object", "Key", "Null", "EnumMember",
    "Struct", "Event", "Operator", "TypeParameter", "Parameter", "TypeAlias", "Trait", "Reference", "Unknown",
)
EDGE_KINDS = ("Definition", "Reference", "TypeDefinition", "Implementation", "Override", "Import", "Export", "Contains")
SYMBOLS = "id string, kind string, name string, file_path string, start_line int, start_char int, end_line int, end_char int, documentation string, detail string"
EDGES = "src_id string, dst_id string, kind string"
SYMBOL_COLUMNS = [c.split()[0] for c in SYMBOLS.split(", ")]
#: The order in which "the first" symbol is meant.
CANONICAL = ("file_path", "start_line", "start_char", "id")


@dataclass
class Graph:
    """Symbols of unique id; edges may repeat and may be loops."""

    symbols: DataFrame
    edges: DataFrame

    def of_kind(self, *kinds: str) -> DataFrame:
        return self.edges.where(F.col("kind").isin(*kinds)).select("src_id", "dst_id")

    @classmethod
    def build(cls, symbols: DataFrame, edges: DataFrame) -> Graph:
        """Of symbols with one id the first in the canonical order stays; edges to unknown ids go.

        Rows meet by id before they are compared: ids are nearly all different, so a task would sort its part for nothing.
        """
        rest = [c for c in symbols.columns if c != "id"]
        first = symbols.repartition("id").groupBy("id").agg(F.min_by(F.struct(*rest), F.struct(*CANONICAL[:-1], "kind", "name")).alias("s")).select("id", "s.*").select(symbols.columns)
        # Repeated ids do no harm. Short ids shrink so well on the way that parts sized by bytes sent would be large in memory.
        ids = symbols.select("id").repartition(int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
        known = edges.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
        return cls(first, known.select("src_id", "dst_id", "kind"))

    def add_symbols(self, more: DataFrame) -> Graph:
        return Graph(self.symbols.unionByName(more), self.edges)

    def add_edges(self, more: DataFrame) -> Graph:
        return Graph(self.symbols, self.edges.unionByName(more))

    def remove_symbols(self, ids: DataFrame) -> Graph:
        """Without the symbols of these ids and all edges at them. ids: one column, id."""
        edges = self.edges.join(ids.select(F.col("id").alias("src_id")), "src_id", "left_anti").join(ids.select(F.col("id").alias("dst_id")), "dst_id", "left_anti")
        return Graph(self.symbols.join(ids, "id", "left_anti"), edges.select("src_id", "dst_id", "kind"))
