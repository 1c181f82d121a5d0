"""The command line: python -m lodestar COMMAND STORE ... over an index that lodestar.streaming.lifecycle.Store keeps.

Every command but `index` brings the index up to date first if --project names the folder of the sources.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import mapping, source
from lodestar.operators import analytics, filters, lookup, navigate, search
from lodestar.schema import Graph
from lodestar.sources import formats
from lodestar.streaming import lifecycle


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the sources of the languages that line patterns know, without excluded folders."""
    found = mapping.read_files(spark, folder)
    return found.where(source.scanned(F.col("path"), tuple(e for e, language in source.EXTENSIONS.items() if language in source.PATTERNS)))


def at(g: Graph, text: str) -> DataFrame:
    path, line, char = navigate.parse_location(text)
    return g.symbols.sparkSession.range(1).select(F.lit(path).alias("path"), F.lit(line).alias("line"), F.lit(char).alias("char"))


def answer(g: Graph, args: argparse.Namespace) -> DataFrame:
    """The rows of a command."""
    one = lambda ident: g.symbols.where(F.col("id") == ident).select("id")
    if args.command == "search":
        if args.fuzzy:
            return search.cli_search(g.symbols, args.what, args.max)
        return filters.search(g.symbols, args.what, False, args.type, args.path, args.max)
    if args.command == "definition":
        return lookup.definition_of(g, at(g, args.what))
    if args.command == "references":
        return lookup.references_of(g, at(g, args.what), args.max)
    if args.command == "symbols":
        return lookup.in_file(g.symbols, args.what).select(formatted(args.format))
    if args.command == "calls":
        return analytics.calls(g, one(args.what), args.direction, args.depth)
    if args.command == "unused":
        return lookup.symbols_of(g.symbols, analytics.dead(g)).select(formatted(args.format))
    if args.command == "stats":
        return analytics.counts(g.symbols, "kind").withColumnRenamed("kind", "what").unionByName(analytics.counts(g.symbols, "file_path").withColumnRenamed("file_path", "what"))
    raise ValueError(args.command)


def formatted(style: str):
    return formats.formatted(style).alias("symbol")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestar", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("index", "the folder of the sources"), ("search", "a name"), ("definition", "file[:line[:column]]"), ("references", "file[:line[:column]]"), ("symbols", "a file"), ("calls", "a symbol's id"), ("unused", None), ("stats", None), ("export", "the folder to write to")):
        c = sub.add_parser(name)
        c.add_argument("store")
        if what:
            c.add_argument("what", help=what)
        c.add_argument("--project", help="the folder of the sources, to index what changed first")
        c.add_argument("--max", type=int, default=50)
        c.add_argument("--format", default="human", help="human, quickfix, lsp, grep, json, tsv or null")
        if name == "index":
            c.add_argument("--full", action="store_true")
        if name == "search":
            c.add_argument("--fuzzy", action="store_true")
            c.add_argument("--type", choices=sorted(filters.GROUPS))
            c.add_argument("--path")
        if name == "calls":
            c.add_argument("--direction", choices=sorted(analytics.DIRECTIONS), default="outgoing")
            c.add_argument("--depth", type=int, default=5)
    return p


def run(spark: SparkSession, words: list[str]) -> list[str]:
    """The command's output, a line for each row."""
    args = parser().parse_args(words)
    store = lifecycle.Store(spark, args.store)
    if args.command == "index":
        row = store.index(sources(spark, args.what), args.full, args.what).summary().first()
        return [f"{k}: {v}" for k, v in row.asDict().items()]
    g = store.ready(sources(spark, args.project) if args.project else None)
    if args.command == "export":
        lifecycle.export_json(g.symbols, args.what)
        return [f"exported to {args.what}"]
    return ["\t".join("" if v is None else str(v) for v in r) for r in answer(g, args).collect()]


if __name__ == "__main__":
    import sys

    print("\n".join(run(SparkSession.builder.appName("lodestar").getOrCreate(), sys.argv[1:])))
