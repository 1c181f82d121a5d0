"""Lookups by id, file and location, and references with options."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.navigate import at_location, definition_at_id, enclosing, references
from lodestar.schema import CANONICAL, Graph


def symbol(symbols: DataFrame, ident: str) -> DataFrame:
    """The symbol of this id, or no row; the filter reaches the files."""
    return symbols.where(F.col("id") == ident)


def symbols_of(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """The symbols of many ids (column id)."""
    return symbols.join(ids.select("id"), "id", "left_semi")


def in_file(symbols: DataFrame, path: str) -> DataFrame:
    """One file's symbols, in the canonical order."""
    return symbols.where(F.col("file_path") == path).orderBy(*CANONICAL)


def references_with(g: Graph, targets: DataFrame, file: str | None = None, limit: int | None = None) -> DataFrame:
    """id, other, file_path: sources of Reference edges to each target (column id), in files whose path holds `file`; of
    each target the first `limit` by file and place. Other options of a search don't apply to references."""
    found = references(g, targets).join(g.symbols.select(F.col("id").alias("other"), *CANONICAL[:-1]), "other")
    found = found if file is None else found.where(F.col("file_path").contains(file))
    if limit is not None:
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(*CANONICAL[:-1], "other"))).where(F.col("r") <= limit)
    return found.select("id", "other", "file_path")


def references_by_file(g: Graph, targets: DataFrame | None = None) -> DataFrame:
    """id, file_path, n: how often each symbol is referred to from each other file."""
    files = g.symbols.select("id", "file_path")
    found = references(g, targets).join(files.withColumnRenamed("file_path", "own"), "id").join(files.withColumnRenamed("id", "other"), "other")
    return found.where("file_path <> own").groupBy("id", "file_path").agg(F.count(F.lit(1)).alias("n"))


def cross_file_references(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """Reference edges from functions and methods to the symbols of other files that hold their places. places: id,
    file_path, line. (navigate.reference_edges goes the other way.)"""
    callers = symbols.where(F.col("kind").isin("Function", "Method")).select("id", F.col("file_path").alias("own"))
    far = places.join(callers, "id").where("file_path <> own").select("file_path", "line", "id").distinct()
    return enclosing(symbols, far).select(F.col("id").alias("src_id"), F.col("inner").alias("dst_id"), F.lit("Reference").alias("kind"))


def definition_of(g: Graph, locations: DataFrame) -> DataFrame:
    """path, line, char, id, definition: the symbol at each location and the first definition of it, or itself."""
    return at_location(g.symbols, locations).join(definition_at_id(g), "id", "left").select("path", "line", "char", "id", F.coalesce("definition", "id").alias("definition"))


def references_of(g: Graph, locations: DataFrame, limit: int | None = None) -> DataFrame:
    """path, line, char, id, other, file_path: what refers to the symbol at each location."""
    found = at_location(g.symbols, locations)
    return found.join(references_with(g, found.select("id").distinct(), limit=limit), "id").select("path", "line", "char", "id", "other", "file_path")
