"""Textual references: where a name stands in source files, outside comments and strings, by language.

Everything is an expression over the file's text. Comments and literals are blanked with as many spaces, so that lines and
columns stay, and a name's places follow from the lengths of what lies between them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.source import language_of

_STRINGS = r"\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\z)"
_QUOTED = r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\z)"
_BLOCK = r"/\*(?:[^*]|\*(?!/))*(?:\*/|\z)"
#: What isn't code, by language: comments, strings (raw ones and ones that a line's end leaves open), characters.
NOT_CODE = {
    "rust": rf"//[^\n]*|{_BLOCK}|r#+\"(?:[^\"]|\"(?!#))*\"#+|r\"[^\"]*(?:\"|\z)|{_STRINGS}|'(?:\\.|[^'\\\n])'",
    "typescript": rf"//[^\n]*|{_BLOCK}|`(?:\\.|[^`\\])*(?:`|\z)|{_STRINGS}|{_QUOTED}",
    "python": rf"#[^\n]*|\"\"\"(?:[^\"]|\"(?!\"\"))*(?:\"\"\"|\z)|'''(?:[^']|'(?!''))*(?:'''|\z)|{_STRINGS}|{_QUOTED}",
    "go": rf"//[^\n]*|{_BLOCK}|`[^`]*(?:`|\z)|{_STRINGS}|{_QUOTED}",
    "java": rf"//[^\n]*|{_BLOCK}|{_STRINGS}|{_QUOTED}",
    "sql": rf"--[^\n]*|{_BLOCK}|{_STRINGS}|{_QUOTED}",
}
#: Words that make the name after them a definition, by language.
DEFINING = {
    "rust": ("fn", "struct", "enum", "trait", "impl", "type", "const", "static", "let", "mod"),
    "typescript": ("function", "class", "interface", "type", "enum", "const", "let", "var", "namespace"),
    "python": ("def", "class"),
    "go": ("func", "type", "var", "const"),
    "java": ("class", "interface", "enum"),
    "sql": ("table", "view", "function", "index"),
}


def by_language(pick: dict[str, Column], language: Column, rest: Column) -> Column:
    out = rest
    for name, value in pick.items():
        out = F.when(language == name, value).otherwise(out)
    return out


def code_only(text: Column, language: Column) -> Column:
    """The text with spaces for comments and literals; texts of unknown languages stay."""

    def blanked(pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda x: F.regexp_replace(x, r"[^\n]", " "))
        rest = F.split(text, pattern, -1)
        return F.array_join(F.zip_with(rest, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return by_language({name: blanked(p) for name, p in NOT_CODE.items()}, language, text)


def reference_pattern(name: str, kind: str | None = None) -> str:
    """A name as a whole word; a struct's or enum's also where :: follows."""
    word = rf"\b{re.escape(name)}"
    return rf"{word}(?:\b|(?=::))" if kind in ("Struct", "Enum") else rf"{word}\b"


def is_definition(before: Column, language: Column) -> Column:
    """Whether the text of the line before a name makes it a definition."""
    words = {name: before.rlike(rf"(?:^|\s)(?:{'|'.join(own)})\s+(?:mut\s+)?$") | (before.rlike(r"(?:^|\s)func\s*\([^)]*\)\s*$") if name == "go" else F.lit(False)) for name, own in DEFINING.items()}
    return by_language(words, language, F.lit(False))


def find_references(files: DataFrame, name: str, kind: str | None = None, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """path, line, char (both from 0), is_definition of each place of the name, once a place."""
    pattern = reference_pattern(name, kind)
    source = files.where(F.col(text_col).contains(name)).select(F.col(path_col).alias("path"), F.regexp_replace(F.col(text_col), r"\r\n", "\n").alias("text"), language_of(F.col(path_col)).alias("language"))
    lines = source.select("path", "language", F.posexplode(F.split(code_only(F.col("text"), F.coalesce("language", F.lit(""))), "\n", -1)).alias("line", "text")).where(F.col("text").rlike(pattern))
    parts = lines.withColumn("parts", F.split("text", pattern, -1))
    # The i-th place is after the first i parts and the i - 1 names between them.
    upto = lambda i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda s, x: s + F.char_length(x)) + (i - 1) * len(name)
    places = parts.select("path", "language", "line", "text", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), upto)).alias("char"))
    before = F.substr("text", F.lit(1), F.col("char"))
    return places.select("path", "line", "char", is_definition(before, F.coalesce("language", F.lit(""))).alias("is_definition")).dropDuplicates(["path", "line", "char"])


def sorted_references(found: DataFrame) -> DataFrame:
    return found.orderBy("path", "line", "char")
