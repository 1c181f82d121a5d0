"""What depends on a symbol's language, as columns: visibility, tests, scopes, imports, documentation, relevance.

Each language is a row of expressions in LANGUAGES; register() adds one.
"""

from __future__ import annotations

import re

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.plans.tables import materialized

#: Kinds by the number that language servers send; a method counts as one, an unknown number as a variable.
SERVER_KINDS = ("File", "Module", "Namespace", "Package", "Class", "Method", "Property", "Field", "Constructor", "Enum", "Interface", "Function", "Variable", "Constant", "String", "Number", "Boolean", "Array", "Object", "Key", "Null", "EnumMember", "Struct", "Event", "Operator", "TypeParameter")
#: Status of a changed file by git's flags, the first that is set counts.
GIT_STATUS = {"WT_NEW": "Added", "WT_MODIFIED": "Modified", "WT_DELETED": "Deleted", "WT_RENAMED": "Modified", "INDEX_NEW": "Added", "INDEX_MODIFIED": "Modified", "INDEX_DELETED": "Deleted"}
def kind_of_server(number: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(k) for k in SERVER_KINDS]), number - 1), F.lit("Variable"))


def status_of(flags: Column) -> Column:
    """flags: an array of git's flag names."""
    out = F.lit("Untracked")
    for flag, status in reversed(GIT_STATUS.items()):
        out = F.when(F.array_contains(flags, flag), status).otherwise(out)
    return out


def said(*texts: str) -> str:
    return "coalesce(" + " or ".join(f"contains(detail, '{t}')" for t in texts) + ", false)"


@dataclass(frozen=True)
class Language:
    """SQL expressions over a symbol's columns; words and scope marks of its queries."""

    public: str
    test: str
    scope: str
    keywords: dict[str, str]
    modifiers: tuple[str, ...]
    mark: str
    bonuses: tuple[tuple[str, float], ...] = ()
    query_bonuses: tuple[tuple[str, str, float], ...] = ()  # (word in the query, condition, amount)
    statement: str = "cast(null as string)"
    doc_url: str = "cast(null as string)"
    extra: dict[str, Callable] = field(default_factory=dict)


RUST_PATH = "array_join(concat(filter(transform(split(file_path, '/'), x -> regexp_replace(x, '[.]rs$', '')), x -> x not in ('', '.', '..', 'src', 'main', 'lib')), array(name)), '::')"
PYTHON_PATH = "array_join(filter(transform(split(file_path, '/'), x -> regexp_replace(x, '[.]py$', '')), x -> x not in ('', '.', '..', '__init__')), '.')"
GO_PATH = "case when file_path like '%/src/%' then regexp_extract(file_path, '^.*?/src/(.*)/[^/]*$', 1) when file_path like '%/go/%' then regexp_extract(file_path, '^.*?/go/(.*)/[^/]*$', 1) else regexp_extract(file_path, '([^/]+)/[^/]*$', 1) end"
NODE_PACKAGE = "regexp_extract(file_path, 'node_modules/(@[^/]+/[^/]+|[^/@][^/]*)', 1)"
STEM = "regexp_extract(file_path, '([^/]+?)([.][^./]*)?$', 1)"

LANGUAGES: dict[str, Language] = {
    "rust": Language(
        public=f"not startswith(name, '_') and not {said('pub(crate)', 'pub(super)')}",
        test=f"{said('#[test]', '#[cfg(test)]')} or startswith(name, 'test_') or endswith(name, '_test') or contains(file_path, '/tests/') or endswith(file_path, '_test.rs')",
        scope=f"case when contains(detail, 'impl') then nullif(regexp_extract(detail, 'impl\\\\s+(\\\\S+)', 1), '') when {STEM} not in ('mod', 'lib', 'main') then {STEM} end",
        keywords={"fn": "Function", "function": "Function", "struct": "Struct", "enum": "Enum", "trait": "Trait", "mod": "Module", "module": "Module"},
        modifiers=("pub", "pub(crate)", "pub(super)", "impl"),
        mark="::",
        query_bonuses=(("trait", "kind = 'Trait'", 0.5), ("struct", "kind = 'Struct'", 0.5), ("impl", said("impl"), 0.5)),
        statement=f"case when kind in ('Function', 'Struct', 'Enum', 'Trait') then concat('use ', {RUST_PATH}, ';') end",
    ),
    "go": Language(
        public="coalesce(name rlike '^\\\\p{Lu}', false)",
        test="startswith(name, 'Test') or startswith(name, 'Benchmark') or startswith(name, 'Example') or endswith(file_path, '_test.go')",
        scope="nullif(regexp_extract(detail, 'func [(]\\\\s*\\\\S+\\\\s+[*]*([^)\\\\s]+)', 1), '')",
        keywords={"func": "Function", "function": "Function", "struct": "Struct", "interface": "Interface", "type": "TypeAlias"},
        modifiers=("const", "var"),
        mark=".",
        bonuses=(("kind = 'Function' and name = 'main'", 0.5), ("kind = 'Function' and name = 'init'", 0.3)),
        statement=f"concat('import \"', {GO_PATH}, '\"')",
        doc_url=f"case when startswith({GO_PATH}, 'github.com/') or startswith({GO_PATH}, 'golang.org/') then concat('https://pkg.go.dev/', {GO_PATH}) end",
    ),
    "python": Language(
        public="not startswith(name, '_') or startswith(name, '__init__')",
        test=f"startswith(name, 'test_') or contains(file_path, 'test_') or contains(file_path, 'tests/') or {said('unittest', 'pytest')}",
        scope="nullif(trim(regexp_extract(detail, 'class ([^:]*)', 1)), '')",
        keywords={"def": "Function", "function": "Function", "class": "Class"},
        modifiers=("async", "await", "global", "nonlocal"),
        mark=".",
        bonuses=(("startswith(name, '__') and endswith(name, '__')", -0.3),),
        statement=f"case when kind in ('Function', 'Class', 'Variable') then concat('from ', {PYTHON_PATH}, ' import ', name) end",
        doc_url="case when contains(file_path, 'site-packages') then concat('https://pypi.org/project/', nullif(regexp_extract(file_path, 'site-packages/([^/]*)', 1), ''), '/') end",
    ),
    "typescript": Language(
        public=f"detail is null or {said('export', 'public')} or not {said('private', 'protected')}",
        test=f"contains(name, 'test') or contains(name, 'spec') or contains(file_path, '.test.') or contains(file_path, '.spec.') or contains(file_path, '__tests__') or {said('describe(', 'it(', 'test(', 'expect(')}",
        scope="coalesce(nullif(regexp_extract(detail, 'class (\\\\S+)', 1), ''), nullif(regexp_extract(detail, 'namespace (\\\\S+)', 1), ''))",
        keywords={"function": "Function", "func": "Function", "class": "Class", "interface": "Interface", "enum": "Enum", "type": "TypeAlias", "namespace": "Namespace", "module": "Namespace"},
        modifiers=("export", "public", "private", "protected", "static", "async", "const", "let", "var"),
        mark=".",
        bonuses=((said("export default"), 0.3), (f"kind = 'Class' and {said('React')}", 0.3)),
        query_bonuses=(("type", "kind in ('Interface', 'TypeAlias')", 0.5), ("interface", "kind in ('Interface', 'TypeAlias')", 0.5)),
        doc_url=f"case when contains(file_path, 'node_modules/@types') then concat('https://www.npmjs.com/package/@types/', {NODE_PACKAGE}) when contains(file_path, 'node_modules') then concat('https://www.npmjs.com/package/', {NODE_PACKAGE}) end",
    ),
}


def register(name: str, language: Language) -> None:
    LANGUAGES[name] = language


def is_public(language: str) -> Column:
    return F.expr(LANGUAGES[language].public)


def is_test(language: str) -> Column:
    return F.coalesce(F.expr(LANGUAGES[language].test), F.lit(False))


def parent_scope(language: str) -> Column:
    return F.expr(LANGUAGES[language].scope)


def import_statement(language: str, from_file: str | None = None) -> Column:
    """How another file takes the symbol in; TypeScript's is relative to from_file's folder."""
    if language != "typescript":
        return F.expr(LANGUAGES[language].statement)
    here = (from_file or "").split("/")[:-1]
    parts = F.split(F.regexp_replace("file_path", r"\.(ts|js|tsx|jsx)$", ""), "/")
    shared = F.lit(0)
    for n in range(len(here), 0, -1):  # the longest common folder
        same = F.slice(parts, F.lit(1), F.lit(n)) == F.array(*[F.lit(x) for x in here[:n]])
        shared = F.when(shared > 0, shared).otherwise(F.when(same & (F.size(parts) > n), n).otherwise(0))
    up = F.repeat(F.lit("../"), F.lit(len(here)) - shared)
    rest = F.array_join(F.slice(parts, shared + 1, F.size(parts)), "/")
    path = F.concat(F.when(up == "", F.lit("./")).otherwise(up), rest)
    named = F.when(F.coalesce(F.col("detail").contains("export default"), F.lit(False)), F.col("name")).otherwise(F.concat(F.lit("{ "), "name", F.lit(" }")))
    return F.when(F.col("kind").isin("Function", "Class", "Interface", "Variable", "Constant"), F.concat(F.lit("import "), named, F.lit(" from '"), path, F.lit("';")))


def doc_url(language: str) -> Column:
    return F.expr(LANGUAGES[language].doc_url)


def relevance(language: str, query: str) -> Column:
    """1, more for the exact name, public symbols and what the language adds, less for tests."""
    own = LANGUAGES[language]
    public = F.expr(said("export")) if language == "typescript" else is_public(language)
    out = 1 + F.when(F.col("name") == query, 2.0).otherwise(0.0) + F.when(public, 0.5).otherwise(0.0) - F.when(is_test(language), 0.5).otherwise(0.0)
    for condition, amount in [*own.bonuses, *dict.fromkeys((c, a) for word, c, a in own.query_bonuses if word in query)]:
        out = out + F.when(F.expr(condition), amount).otherwise(0.0)
    return F.round(out, 4)


@dataclass
class ParsedQuery:
    name: str | None = None
    kind: str | None = None
    modifiers: list[str] = field(default_factory=list)
    scope: str | None = None


def parse_query(language: str, text: str) -> ParsedQuery:
    """Words like "pub fn mod::name" as name, kind, modifiers and scope."""
    own, out = LANGUAGES[language], ParsedQuery()
    for word in text.split():
        if word in own.modifiers:
            out.modifiers.append(word)
        elif word in own.keywords:
            out.kind = own.keywords[word]
        elif own.mark in word:
            scope, _, out.name = word.rpartition(own.mark)
            out.scope = scope
        else:
            out.name = word
    return out


def query_columns(language: str, text: Column) -> Column:
    """parse_query() of a column: a struct of name, kind, modifiers and scope; name, kind and scope are null where there is none."""
    own = LANGUAGES[language]
    texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    modifiers, keywords = texts(own.modifiers), texts(own.keywords)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    kinds = F.create_map(*[F.lit(x) for kv in own.keywords.items() for x in kv])
    said = F.filter(words, lambda w: F.array_contains(keywords, w) & ~F.array_contains(modifiers, w))
    rest = F.filter(words, lambda w: ~F.array_contains(keywords, w) & ~F.array_contains(modifiers, w))
    marked = F.filter(rest, lambda w: w.contains(own.mark))
    mark = re.escape(own.mark)
    last = lambda xs: F.try_element_at(xs, F.lit(-1))
    return F.struct(
        F.substring_index(last(rest), own.mark, -1).alias("name"),
        kinds[last(said)].alias("kind"),
        F.filter(words, lambda w: F.array_contains(modifiers, w)).alias("modifiers"),
        F.regexp_replace(last(marked), f"{mark}(?!.*{mark}).*$", "").alias("scope"),
    )


def first_successful(results: list[tuple[int, DataFrame]], key: str = "file_path") -> DataFrame:
    """For each key the rows of the strategy of highest priority that has any. results: (priority, symbols)."""
    out = None
    for priority, df in results:
        x = df.withColumn("__p", F.lit(priority))
        out = x if out is None else out.unionByName(x)
    return out.withColumn("__m", F.max("__p").over(Window.partitionBy(key))).where("__p = __m").drop("__p", "__m")


def flattened(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and Contains edges of nested document symbols, however deep. trees: path, and root as JSON text with name,
    kind, range and children. Each level is a table; children of symbols without a name are left out."""
    node = "struct<name:string,kind:int,detail:string,range:struct<start:struct<line:int,character:int>,end:struct<line:int,character:int>>,children:array<string>>"
    level = trees.select("path", F.from_json("root", node).alias("n"), F.lit(None).cast("string").alias("parent"))
    levels: list[DataFrame] = []
    while True:
        ident = F.concat("path", F.lit("#"), F.col("n.range.start.line"), F.lit(":"), F.col("n.name"))
        own = materialized(level.where("n.name is not null").withColumn("id", ident))
        if levels and own.isEmpty():
            break
        levels.append(own.select("path", "n", "parent", "id"))
        if len(levels) > 12:  # merge, so that the plan stays small
            levels = [materialized(reduce(DataFrame.unionByName, levels))]
        level = own.select("path", F.explode("n.children").alias("c"), F.col("id").alias("parent")).select("path", F.from_json("c", node).alias("n"), "parent")
    every = reduce(DataFrame.unionByName, levels)
    symbols = every.select("id", kind_of_server(F.col("n.kind")).alias("kind"), F.col("n.name").alias("name"), F.col("path").alias("file_path"), F.col("n.range.start.line").alias("start_line"), F.col("n.range.start.character").alias("start_char"), F.col("n.range.end.line").alias("end_line"), F.col("n.range.end.character").alias("end_char"), F.lit(None).cast("string").alias("documentation"), F.col("n.detail").alias("detail"))
    return symbols, every.where("parent is not null").select(F.col("parent").alias("src_id"), F.col("id").alias("dst_id"), F.lit("Contains").alias("kind"))


def definitions_and_references(names: DataFrame) -> DataFrame:
    """Reference edges from each use to the last definition of its name. names: name, id, place, is_definition."""
    last = names.where("is_definition").groupBy("name").agg(F.max_by("id", "place").alias("dst_id"))
    return names.where("not is_definition").join(last, "name").select(F.col("id").alias("src_id"), "dst_id", F.lit("Reference").alias("kind"))
