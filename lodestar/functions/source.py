"""Symbols from source text by line patterns, languages of files, visibility, and textual references."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinePattern:
    """A pattern whose group 1 is the name; prefix goes before the name; method_if_indented as it says."""

    kind: str
    pattern: str
    prefix: str = ""
    method_if_indented: bool = False


#: Patterns by language, the first that fits a line counts.
PATTERNS: dict[str, list[LinePattern]] = {
    "rust": [
        LinePattern("Function", r"(?U)^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"),
        LinePattern("Struct", r"(?U)^\s*(?:pub\s+)?struct\s+(\w+)"),
        LinePattern("Enum", r"(?U)^\s*(?:pub\s+)?enum\s+(\w+)"),
        LinePattern("Class", r"(?U)^\s*impl(?:\s+<[^>]+>)?\s+(\w+)", "impl "),
        LinePattern("Interface", r"(?U)^\s*(?:pub\s+)?trait\s+(\w+)"),
    ],
    "typescript": [
        LinePattern("Function", r"(?U)^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"),
        LinePattern("Class", r"(?U)^\s*(?:export\s+)?class\s+(\w+)"),
        LinePattern("Interface", r"(?U)^\s*(?:export\s+)?interface\s+(\w+)"),
        LinePattern("Function", r"(?U)^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?[(\[]"),
        LinePattern("Variable", r"(?U)^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)"),
    ],
    "python": [LinePattern("Class", r"(?U)^\s*class\s+(\w+)"), LinePattern("Function", r"(?U)^\s*(?:async\s+)?def\s+(\w+)", "", True)],
    "go": [
        LinePattern("Function", r"(?U)^\s*func\s+(?:\(\s*\w+\s+[^)]+\)\s+)?(\w+)"),
        LinePattern("Struct", r"(?U)^\s*type\s+(\w+)\s+struct"),
        LinePattern("Interface", r"(?U)^\s*type\s+(\w+)\s+interface"),
    ],
}
#: Stricter patterns by language and kind, each asked for by itself; add_catalogued() adds one.
CATALOGUE: dict[tuple[str, str], str] = {
    ("rust", "Function"): r'^\s*(?:pub\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+"[^"]+"\s+)?fn\s+([a-zA-Z_][a-zA-Z0-9_]*)',
    ("rust", "Struct"): r"^\s*(?:pub\s+)?struct\s+([A-Z][a-zA-Z0-9_]*)",
    ("rust", "Enum"): r"^\s*(?:pub\s+)?enum\s+([A-Z][a-zA-Z0-9_]*)",
    ("rust", "Impl"): r"^\s*impl(?:\s+<[^>]+>)?\s+([A-Z][a-zA-Z0-9_]*)",
    ("rust", "Constant"): r"^\s*(?:pub\s+)?const\s+([A-Z_][A-Z0-9_]*)",
    ("typescript", "Function"): r"^\s*(?:export\s+)?(?:async\s+)?function\s+([a-zA-Z_$][a-zA-Z0-9_$]*)",
    ("typescript", "Class"): r"^\s*(?:export\s+)?class\s+([A-Z][a-zA-Z0-9_]*)",
    ("typescript", "Interface"): r"^\s*(?:export\s+)?interface\s+([A-Z][a-zA-Z0-9_]*)",
    ("typescript", "TypeAlias"): r"^\s*(?:export\s+)?type\s+([A-Z][a-zA-Z0-9_]*)",
    ("python", "Function"): r"^\s*(?:async\s+)?def\s+([a-z_][a-z0-9_]*)",
    ("python", "Class"): r"^\s*class\s+([A-Z][a-zA-Z0-9_]*)",
    ("go", "Function"): r"^\s*func\s+(?:\([^)]+\)\s+)?([A-Z][a-zA-Z0-9_]*)",
    ("go", "Struct"): r"^\s*type\s+([A-Z][a-zA-Z0-9_]*)\s+struct",
    ("go", "Interface"): r"^\s*type\s+([A-Z][a-zA-Z0-9_]*)\s+interface",
}
EXTENSIONS = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "py": "python", "go": "go", "java": "java"}
MARKERS = {"Cargo.toml": "rust", "package.json": "typescript", "pyproject.toml": "python", "setup.py": "python", "go.mod": "go", "pom.xml": "java"}
#: Candidates for where a crawl begins, in this order.
ENTRY_FILES = ("src/main.rs", "src/lib.rs", "main.rs", "lib.rs", "src/index.ts", "src/index.js", "index.ts", "index.js", "main.py", "__main__.py", "src/main.go", "main.go")
EXCLUDED = (".git", "target", "node_modules", ".idea", ".vscode", "tmp")


def add_pattern(language: str, pattern: LinePattern) -> None:
    """Registers one more pattern of a language; it comes last."""
    re.compile(pattern.pattern)
    PATTERNS.setdefault(language, []).append(pattern)


def add_catalogued(language: str, kind: str, pattern: str) -> None:
    """Sets the pattern of a language and kind in the catalogue."""
    re.compile(pattern)
    CATALOGUE[language, kind] = pattern


def catalogued(files: DataFrame, kind: str, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """path, line, name: lines that the catalogue's pattern for the file's language and this kind fits."""
    source = lines(files, path_col, text_col).withColumn("language", language_of(F.col("path")))
    name = F.lit("")
    for (language, own), pattern in CATALOGUE.items():
        if own == kind:
            name = F.when(F.col("language") == language, F.regexp_extract("text", pattern, 1)).otherwise(name)
    return source.select("path", "line", name.alias("name")).where("name <> ''")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language_of(path: Column) -> Column:
    """By the extension; null for others."""
    return F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[extension(path)]


def project_language(files: DataFrame, *by: str) -> DataFrame:
    """One row, language: of the first marker file that there is, else of the first extension that there is. With `by`
    (columns of files) a row for each of their values that has any."""
    order = list(dict.fromkeys([*MARKERS.values(), *EXTENSIONS.values()]))
    name = F.element_at(F.split("path", "/"), -1)
    marker, found = F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv])[name], language_of(F.col("path"))
    rank = lambda c, base: F.when(c.isNotNull(), base + F.array_position(F.array(*[F.lit(x) for x in order]), c))
    ranked = files.select(*by, F.struct(F.coalesce(rank(marker, 0), rank(found, 100)).alias("r"), F.coalesce(marker, found).alias("l")).alias("x"))
    return ranked.where("x.r is not null").groupBy(*by).agg(F.min("x").alias("x")).select(*by, F.col("x.l").alias("language"))


def scanned(path: Column, extensions: tuple[str, ...] = ("rs", "ts", "tsx", "js", "jsx"), excluded: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether a directory scan takes the file of this relative path."""
    return extension(path).isin(*extensions) & ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in excluded]))


#: Other scans' extensions and excluded folders (a leading dot: every folder of a name that begins so).
SCANS = {"all": (("rs", "ts", "tsx", "js", "jsx"), EXCLUDED), "references": (("rs", "ts", "tsx", "js", "jsx"), ("target", ".git", "node_modules", ".vscode")), "rust": (("rs",), (".", "target"))}


def scan(files: DataFrame, kind: str = "all") -> DataFrame:
    """The files (path and more columns) that one of the SCANS takes."""
    extensions, excluded = SCANS[kind]
    kept = files.where(scanned(F.col("path"), extensions, tuple(x for x in excluded if x != ".")))
    return kept.where(~F.exists(F.split("path", "/"), lambda x: x.startswith("."))) if "." in excluded else kept


def crawl_entries(files: DataFrame, most: int = 3, most_binaries: int = 5) -> DataFrame:
    """id: the first `most` of ENTRY_FILES that there are, and the first `most_binaries` Rust files in src/bin by path."""
    order = F.array_position(F.array(*[F.lit(x) for x in ENTRY_FILES]), F.col("path"))
    first = files.select("path", order.alias("o")).where("o > 0").distinct().orderBy("o").limit(most).select("path")
    binaries = files.where(F.col("path").rlike(r"^src/bin/[^/]+\.rs$")).select("path").distinct().orderBy("path").limit(most_binaries)
    return first.unionByName(binaries).select(F.col("path").alias("id"))


def lines(files: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """path, line (from 0), text: the last empty line doesn't count, nor does a carriage return at the end."""
    parts = F.split(F.regexp_replace(F.col(text_col), r"\r?\n$", ""), r"\r?\n")
    return files.where(F.col(text_col) != "").select(F.col(path_col).alias("path"), F.posexplode(parts).alias("line", "text"))


def extract(files: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """id, kind, name, file_path, start_line, start_char, end_line, end_char of the symbols that lines declare."""
    source = lines(files, path_col, text_col).withColumn("language", language_of(F.col("path")))
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    indent = F.char_length("text") - F.char_length(F.ltrim("text"))
    for language, patterns in PATTERNS.items():
        for p in reversed(patterns):
            hit = (F.col("language") == language) & F.col("text").rlike(p.pattern)
            own = F.when(indent > 0, "Method").otherwise("Function") if p.method_if_indented else F.lit(p.kind)
            kind = F.when(hit, own).otherwise(kind)
            name = F.when(hit, F.concat(F.lit(p.prefix), F.regexp_extract("text", p.pattern, 1))).otherwise(name)
    found = source.withColumn("kind", kind).withColumn("name", name).where("name is not null")
    start = F.when(F.col("language") == "python", indent).otherwise(F.lit(0)).cast("int")
    return found.select(F.concat("path", F.lit("#"), "line", F.lit(":"), "name").alias("id"), "kind", "name", F.col("path").alias("file_path"), F.col("line").alias("start_line"), start.alias("start_char"), F.col("line").alias("end_line"), F.char_length("text").alias("end_char"))


def visibility(language: str, name: Column, detail: Column) -> Column:
    text = F.coalesce(detail, F.lit(""))
    if language == "rust":
        return F.when(text.contains("pub(crate)"), "Internal").when(text.contains("pub"), "Public").otherwise("Private")
    if language == "typescript":
        return F.when(text.contains("private"), "Private").when(text.contains("protected"), "Protected").when(text.contains("export"), "Public").otherwise("Internal")
    if language == "python":
        return F.when(name.startswith("__") & name.endswith("__"), "Public").when(name.startswith("__"), "Private").when(name.startswith("_"), "Protected").otherwise("Public")
    if language == "go":
        return F.when(name.rlike(r"^\p{Lu}"), "Public").otherwise("Private")
    return F.lit("Public")
