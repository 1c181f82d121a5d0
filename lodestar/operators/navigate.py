"""Navigation: neighbours by edge kind, positions in files, and edges between files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.plans.tables import materialized, near
from lodestar.schema import CANONICAL, EDGES, Graph


def neighbours(g: Graph, kind: str | None, incoming: bool, targets: DataFrame | None = None) -> DataFrame:
    """id, other: the symbols at the far ends of each symbol's edges, as often as there are edges."""
    e = g.edges if kind is None else g.edges.where(F.col("kind") == kind)
    near, far = ("dst_id", "src_id") if incoming else ("src_id", "dst_id")
    out = e.select(F.col(near).alias("id"), F.col(far).alias("other"))
    return out if targets is None else out.join(targets.select("id"), "id", "left_semi")


def references(g: Graph, targets: DataFrame | None = None) -> DataFrame:
    return neighbours(g, "Reference", True, targets)


def implementations(g: Graph, targets: DataFrame | None = None) -> DataFrame:
    return neighbours(g, "Implementation", True, targets)


def overrides(g: Graph, targets: DataFrame | None = None) -> DataFrame:
    return neighbours(g, "Override", True, targets)


def first_definition(g: Graph) -> DataFrame:
    """id, other: the source, of smallest id, of an incoming Definition edge."""
    return neighbours(g, "Definition", True).groupBy("id").agg(F.min("other").alias("other"))


def inside(line: Column, char: Column) -> Column:
    """Columns count on the first and the last line only."""
    after = (line > F.col("start_line")) | ((line == F.col("start_line")) & (char >= F.col("start_char")))
    return after & ((line < F.col("end_line")) | ((line == F.col("end_line")) & (char <= F.col("end_char"))))


def box(line: Column, char: Column) -> Column:
    """Lines and columns each in their range."""
    return line.between(F.col("start_line"), F.col("end_line")) & char.between(F.col("start_char"), F.col("end_char"))


def held(symbols: DataFrame, points: DataFrame) -> DataFrame:
    """points (file_path, line and more columns) joined with the symbols of the file whose lines hold the line.

    A symbol goes to the one or two cells, of a size not smaller than itself, that its lines touch; a point to its cell of
    each size that there is. So a file with many symbols, or many points, is not one key.
    """
    size = F.greatest(F.ceil(F.log2(F.col("end_line") - F.col("start_line") + 1)), F.lit(0)).cast("int")
    own = symbols.where("end_line >= start_line").withColumn("__size", size)
    sizes = [r["__size"] for r in own.select("__size").distinct().collect()]  # at most 32
    shifted = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("__size"))).cast("int")
    cells = own.withColumn("__cell", F.explode(F.array_distinct(F.array(shifted("start_line"), shifted("end_line")))))
    asked = points.withColumn("__size", F.explode(F.array(*[F.lit(n) for n in sizes]) if sizes else F.array().cast("array<int>"))).withColumn("__cell", shifted("line"))
    return asked.join(cells, ["file_path", "__size", "__cell"]).where("line between start_line and end_line").drop("__size", "__cell")


def firsts(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """Of the symbols with one range the one of least id, in the files of the places (file_path); no other can come first at
    a place, so many symbols on the same lines don't meet all places there."""
    files = near(materialized(places.select("file_path").distinct()))
    ranges = ["file_path", *CANONICAL[1:-1], "end_line", "end_char"]
    return symbols.join(files, "file_path", "left_semi").groupBy(*ranges).agg(F.min("id").alias("id"))


def at_positions(symbols: DataFrame, positions: DataFrame, test=inside) -> DataFrame:
    """positions (file_path, line, char) with id: the first symbol in the canonical order that holds each."""
    asked = materialized(positions.select("file_path", "line", "char").distinct())
    found = held(materialized(firsts(symbols, asked)), asked).where(test(F.col("line"), F.col("char")))
    return found.groupBy("file_path", "line", "char").agg(F.min_by("id", F.struct(*CANONICAL[1:])).alias("id"))


def definition_at_id(g: Graph) -> DataFrame:
    """id, definition: the first definition of each symbol that has one."""
    return first_definition(g).select("id", F.col("other").alias("definition"))


def definition_at(g: Graph, positions: DataFrame) -> DataFrame:
    """Like at_positions by box, then the first target of the symbol's Reference edges if it has one."""
    target = neighbours(g, "Reference", False).groupBy("id").agg(F.min("other").alias("target"))
    return at_positions(g.symbols, positions, box).join(target, "id", "left").select("file_path", "line", "char", F.coalesce("target", "id").alias("id"))


def matching_files(paths: DataFrame, files: DataFrame) -> DataFrame:
    """path, file_path: the pairs of which one ends in the other, character by character ("a.rs" fits "xa.rs" too).

    By equi-joins of whole texts with suffixes: of the files those of the lengths that paths have, of the paths all.
    """
    paths, files = paths.select("path").distinct(), files.select("file_path").distinct()
    lengths = [r["n"] for r in paths.select(F.char_length("path").alias("n")).distinct().collect()]  # no more than a path can have
    end = lambda c, n: F.substr(F.col(c), F.char_length(c) - n + 1, n)
    some = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.char_length("file_path")) if lengths else F.array().cast("array<int>")
    longer = files.withColumn("n", F.explode(some)).select("file_path", end("file_path", F.col("n")).alias("path")).join(paths, "path").select("path", "file_path")
    own = paths.where("path <> ''").withColumn("n", F.explode(F.sequence(F.lit(1), F.char_length("path")))).select("path", end("path", F.col("n")).alias("file_path"))
    return longer.unionByName(own.join(files, "file_path").select("path", "file_path")).distinct()


def at_location(symbols: DataFrame, locations: DataFrame) -> DataFrame:
    """locations (path, line, char; both from 1) with id. Files match if one path ends in the other; a symbol that holds
    the position goes before one that starts on the line at most 10 columns after it."""
    line, char = F.col("line"), F.col("char") - 1
    asked = locations.select("path", (F.col("line") - 1).alias("line"), "char").distinct().join(matching_files(locations, symbols), "path")
    asked = materialized(asked)
    tier = F.when(inside(line, char), 0).when((F.col("start_line") == line) & (F.col("start_char") <= char + 10), 1)
    found = held(materialized(firsts(symbols, asked)), asked).withColumn("tier", tier).where("tier is not null")
    return found.groupBy("path", "line", "char").agg(F.min_by("id", F.struct("tier", *CANONICAL)).alias("id")).withColumn("line", F.col("line") + 1)


def parse_location(text: str) -> tuple[str, int, int]:
    """file[:line[:column]], both from 1."""
    parts = text.split(":")
    number = lambda i: int(parts[i]) if len(parts) > i and parts[i].isdigit() else 1
    return parts[0], number(1), number(2)


def location(text: Column) -> Column:
    """parse_location() of a column: a struct of file, line and char. A number that is none, or too large for one, is 1."""
    parts = F.split(text, ":")
    number = lambda i: F.coalesce(F.when(F.get(parts, F.lit(i)).rlike("^[0-9]+$"), F.get(parts, F.lit(i)).try_cast("int")), F.lit(1))
    return F.struct(F.get(parts, F.lit(0)).alias("file"), number(1).alias("line"), number(2).alias("char"))


def enclosing(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """places (file_path, line and more columns) with inner: the first symbol of the file whose lines hold the line."""
    lines = materialized(places.select("file_path", "line").distinct())
    own = materialized(firsts(symbols, lines)).select(F.col("id").alias("__id"), "file_path", "start_line", "start_char", "end_line")
    first = held(own, lines).groupBy("file_path", "line").agg(F.min_by("__id", F.struct("start_line", "start_char", "__id")).alias("inner"))
    return places.distinct().join(near(materialized(first)), ["file_path", "line"]).select(*places.columns, "inner")


def reference_edges(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """Reference edges from the symbol around each place (file_path, line, target) to its target."""
    return enclosing(symbols, places).where("inner <> target").select(F.col("inner").alias("src_id"), F.col("target").alias("dst_id"), F.lit("Reference").alias("kind")).to(_schema(EDGES))


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def file_edges(g: Graph, kind: str = "Reference") -> DataFrame:
    """src_file, dst_file, n: edges between different files."""
    files = g.symbols.select("id", "file_path")
    e = g.edges.where(F.col("kind") == kind).select("src_id", "dst_id").join(files.select(F.col("id").alias("src_id"), F.col("file_path").alias("src_file")), "src_id")
    return e.join(files.select(F.col("id").alias("dst_id"), F.col("file_path").alias("dst_file")), "dst_id").where("src_file <> dst_file").groupBy("src_file", "dst_file").agg(F.count(F.lit(1)).alias("n"))
