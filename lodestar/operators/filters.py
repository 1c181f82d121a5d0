"""Predicates over symbols, and the searches that are made of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.schema import Graph

#: Names of kinds in the second query facade, and groups of the command line's --type.
ALIASES = {
    "function": "Function", "func": "Function", "class": "Class", "interface": "Interface", "variable": "Variable", "var": "Variable",
    "constant": "Constant", "const": "Constant", "method": "Method", "property": "Property", "prop": "Property", "module": "Module",
    "mod": "Module", "enum": "Enum", "struct": "Struct", "namespace": "Namespace",
}
GROUPS = {"function": ("Function", "Method"), "variable": ("Variable", "Field"), "class": ("Class",), "interface": ("Interface",), "enum": ("Enum",)}
TYPE_KINDS = ("Class", "Interface", "Enum", "Module", "Namespace")
ENTRY_NAMES = ("main", "index", "app", "server", "cli", "start", "run")
FILTER_NAMES = {"returns": "returns", "return": "returns", "takes": "takes", "param": "takes", "implements": "implements", "extends": "implements", "has_field": "has_field", "has-field": "has_field", "field": "has_field", "signature": "signature", "sig": "signature"}


def kind_named(name: str) -> Column:
    """By an alias of any case; an unknown one is an error."""
    if name.lower() not in ALIASES:
        raise ValueError(f"unknown kind: {name}")
    return F.col("kind") == ALIASES[name.lower()]


def kind_group(name: str) -> Column:
    return F.col("kind").isin(*GROUPS[name]) if name in GROUPS else F.lit(False)


def relevance(query: str) -> Column:
    n = F.col("name")
    return F.when(n == query, 2.0).when(n.startswith(query), 1.5).when(n.endswith(query), 1.2).otherwise(1.0)


def is_private() -> Column:
    return F.col("name").startswith("_") | F.col("name").startswith("priv")


def name_contains(query: str, case_sensitive: bool = True) -> Column:
    return F.col("name").contains(query) if case_sensitive else F.lower("name").contains(query.lower())


def find_definitions(symbols: DataFrame, query: str, case_sensitive: bool = True, file: str | None = None, kind: str | None = None, private: bool = True, limit: int | None = None) -> DataFrame:
    """id, name, relevance: the first `limit` by id that fit, best first."""
    out = symbols.where(name_contains(query, case_sensitive))
    if file is not None:
        out = out.where(F.col("file_path").contains(file))
    if kind is not None:
        out = out.where(kind_named(kind))
    if not private:
        out = out.where(~is_private())
    out = out.select("id", "name", relevance(query).alias("relevance"))
    if limit is not None:
        out = out.orderBy("id").limit(limit)
    return out.orderBy(F.desc("relevance"), "id")


def search_pattern(symbols: DataFrame, pattern: str, file: str | None = None, kind: str | None = None) -> DataFrame:
    re.compile(pattern)
    out = symbols.where(F.col("name").rlike(pattern))
    out = out if file is None else out.where(F.col("file_path").contains(file))
    return (out if kind is None else out.where(kind_named(kind))).select("id", "name", F.lit(1.0).alias("relevance"))


def search(symbols: DataFrame, query: str, fuzzy: bool = False, kind: str | None = None, path: str | None = None, most: int = 50) -> DataFrame:
    """id, name: equal names, or with fuzzy those that contain the query in any case; the first `most` by id."""
    out = symbols.where(F.lower("name").contains(query.lower()) if fuzzy else F.col("name") == query)
    out = out if kind is None else out.where(kind_group(kind))
    out = out if path is None else out.where(F.col("file_path").contains(path))
    return out.orderBy("id").limit(most).select("id", "name")


def type_matches(text: Column, wanted: str) -> Column:
    """Holds the wanted text; or, without type arguments in it, some part between :: holds its last part."""
    plain = F.trim(text).contains(wanted.strip())
    if "<" in wanted:
        return plain
    last = wanted.strip().split("::")[-1]
    return plain | F.exists(F.split(F.trim(text), "::"), lambda x: x.contains(last))


def returns(wanted: str) -> Column:
    parts = F.split("detail", "->")
    return F.col("kind").isin("Function", "Method") & (F.size(parts) > 1) & type_matches(F.get(parts, F.lit(1)), wanted)


def takes(wanted: str) -> Column:
    inner = F.regexp_extract("detail", r"\(([^)]*)\)", 1)
    return F.col("kind").isin("Function", "Method") & F.col("detail").contains("(") & type_matches(inner, wanted)


def signature(pattern: str) -> Column:
    """By regular expression; text that is none is looked for as it stands."""
    try:
        re.compile(pattern)
    except re.error:
        return F.col("detail").contains(pattern)
    return F.col("detail").rlike(pattern)


def type_filter(g: Graph, kind: str, wanted: str) -> DataFrame:
    """The symbols that pass one of the filters in FILTER_NAMES."""
    what = FILTER_NAMES[kind]
    if what == "returns":
        return g.symbols.where(F.coalesce(returns(wanted), F.lit(False)))
    if what == "takes":
        return g.symbols.where(F.coalesce(takes(wanted), F.lit(False)))
    if what == "signature":
        return g.symbols.where(F.coalesce(signature(wanted), F.lit(False)))
    if what == "implements":
        phrases = (f"impl {wanted}", f"implements {wanted}", f"extends {wanted}", f": {wanted}", f": dyn {wanted}")
        said = F.lit(False)
        for p in phrases:
            said = said | F.col("detail").contains(p)
        named = g.symbols.where(F.col("name").contains(wanted)).select(F.col("id").alias("dst_id"))
        by_edge = g.edges.where("kind = 'Implementation'").join(named, "dst_id", "left_semi").select(F.col("src_id").alias("id"))
        own = g.symbols.where(F.col("kind").isin("Class", "Struct", "Enum"))
        return own.where(F.col("detail").isNotNull() & said).unionByName(own.where("detail is null").join(by_edge, "id", "left_semi"))
    fields = g.symbols.where(F.col("kind").isin("Field", "Property") & type_matches(F.col("detail"), wanted)).select(F.col("id").alias("dst_id"))
    owners = g.edges.where("kind = 'Contains'").join(fields, "dst_id", "left_semi").select(F.col("src_id").alias("id"))
    return g.symbols.where(F.col("kind").isin("Class", "Struct")).join(owners, "id", "left_semi")


def advanced_search(g: Graph, name: str | None, filters: list[tuple[str, str]], case_sensitive: bool = False, most: int = 50) -> DataFrame:
    out = g.symbols if name is None else g.symbols.where(name_contains(name, case_sensitive))
    for kind, wanted in filters:
        out = out.join(type_filter(g, kind, wanted).select("id"), "id", "left_semi")
    return out.orderBy("id").limit(most).select("id", "name")


def is_entry() -> Column:
    """Entry points of the dead-code search."""
    n = F.col("name")
    return (n == "main") | n.endswith("::main") | n.startswith("pub ") | n.contains("test") | n.contains("bench") | (F.col("file_path").contains("lib.rs") & n.startswith("pub"))


#: Files to skip by language, as regular expressions of the path.
SKIPPED = {
    "rust": r"(^|/)target/|\.generated\.rs$|/tests?/fixtures/",
    "typescript": r"\.min\.js$|\.d\.ts$|(^|/)node_modules/|(^|/)dist/|(^|/)build/",
    "python": r"(^|/)__pycache__/|\.pyc$|(^|/)venv/|(^|/)\.venv/",
    "go": r"(^|/)vendor/|_test\.go$|\.pb\.go$",
}


def skipped(language: str, path: str = "file_path", size: str | None = None, most: int = 100_000) -> Column:
    out = F.col(path).rlike(SKIPPED[language]) if language in SKIPPED else F.lit(False)
    return out if size is None else out | (F.col(size) > most)
