"""Name searches: three cascades with scores of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.alignment import aligned
from lodestar.functions.names import bytes_of, camel_words, capitals, edit_score, grams, has_subsequence, plain_camel_words, query_grams
from lodestar.operators.filters import kind_named


def cascade(df: DataFrame, steps: list[tuple[str, Column, Column]]) -> DataFrame:
    """Adds match_type and score of the first step (name, condition, score) that holds; rows of none go."""
    kind, score = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, condition, value in reversed(steps):
        kind, score = F.when(condition, name).otherwise(kind), F.when(condition, value.cast("double")).otherwise(score)
    return df.withColumn("match_type", kind).withColumn("score", score).where("match_type is not null")


def best(df: DataFrame, most: int | None) -> DataFrame:
    out = df.select("id", "name", "match_type", F.round("score", 4).alias("score")).orderBy(F.desc("score"), F.octet_length("name"), "id")
    return out if most is None else out.limit(most)


def core_search(symbols: DataFrame, query: str, most: int | None = 50) -> DataFrame:
    """Exact, prefix, capitals, substring, shared n-grams, few edits; in any case."""
    q = query.lower()
    if not q:
        return best(cascade(symbols.limit(0), [("Exact", F.lit(False), F.lit(0.0))]), most)
    n = gram_size(q)
    own = query_grams(q, n)
    ratio = F.size(F.array_intersect(F.array(*[F.lit(x) for x in own]), grams(F.lower("name"), n))) / len(own) if own else F.lit(0.0)
    return best(cascade(symbols, core_cascade(query, ratio)), most)


def gram_size(q: str) -> int:
    return 3 if len(q.encode()) >= 3 else 2


def core_cascade(query: str, ratio: Column, may_be_typo: Column | None = None) -> list[tuple[str, Column, Column]]:
    """The steps of core_search(). ratio: the share of the query's n-grams that a name has; edits are counted only where
    may_be_typo holds (everywhere if it is None)."""
    q, size = query.lower(), len(query.lower().encode())
    low = F.lower("name")
    least = 0.25 if size >= 3 else 0.3
    longest = F.greatest(bytes_of(low), F.lit(size))
    edits = F.levenshtein(low, F.lit(q))
    close = edits <= F.floor(longest * 0.3)
    if may_be_typo is not None:
        close = F.when(may_be_typo, close).otherwise(False)
    position = F.octet_length(F.substring_index(low, q, 1))
    return [
        ("Exact", low == q, F.lit(100.0)),
        ("Prefix", low.startswith(q) & F.lit(size <= 5), 90 - 0.5 * (bytes_of(low) - size)),
        ("CamelCase", (capitals(F.col("name")) != "") & capitals(F.col("name")).contains(query.upper()), F.lit(85.0)),
        ("Substring", low.contains(q), 70 - 0.5 * position),
        ("Fuzzy", (ratio >= least) & F.lit(size >= 2), ratio * 60),
        ("Typo", F.lit(size >= 3) & close, 50 * (1 - edits / longest)),
    ]


#: A lower alignment doesn't count.
LEAST_ALIGNMENT = 30


def engine_search(symbols: DataFrame, query: str, most: int | None = 50, last_resort: bool = False) -> DataFrame:
    """Exact, prefix of at most 5 bytes, all camel words. With last_resort, where these are fewer than `most` (50 for None),
    other names of an alignment above LEAST_ALIGNMENT follow with that as their score (functions.alignment), type Fuzzy."""
    if last_resort:
        sure = engine_search(symbols, query, None)
        room = 50 if most is None else most
        if sure.limit(room).count() >= room:
            return sure if most is None else sure.limit(most)
        found = aligned(symbols, query).where(F.col("alignment") > LEAST_ALIGNMENT).join(sure.select("id"), "id", "left_anti")
        both = sure.unionByName(found.select("id", "name", F.lit("Fuzzy").alias("match_type"), F.col("alignment").cast("double").alias("score")))
        return best(both, most)
    q = query.lower()
    words = F.transform(plain_camel_words(F.col("name")), F.lower)
    wanted = [w.lower() for w in _plain_words(query)]
    return best(cascade(symbols, [("Exact", F.lower("name") == q, F.lit(100.0)), ("Prefix", F.lower("name").startswith(q) & F.lit(len(q.encode()) <= 5), F.lit(80.0)), ("CamelCase", F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), words)) == 0, F.lit(70.0))]), most)


def search_by_kind(symbols: DataFrame, query: str, kind: str, most: int | None = 50, last_resort: bool = False) -> DataFrame:
    """engine_search() without a limit, of the symbols of a kind (an alias of filters.ALIASES), the best `most`."""
    return engine_search(symbols.where(kind_named(kind)), query, most, last_resort)


def _plain_words(text: str) -> list[str]:
    import re

    parts = re.split(r"(?<=[^A-Z])(?=[A-Z])", text)
    return [*parts, text] if len(parts) > 1 else parts


def cli_cascade(query: str, c: Column) -> list[tuple[str, Column, Column]]:
    q = query.lower()
    low, caps = F.lower(c), capitals(c)
    return [
        ("exact", low == q, F.lit(1.0)),
        ("prefix", low.startswith(q), F.lit(0.9)),
        ("substring", low.contains(q), F.lit(0.7)),
        ("abbreviation", (caps == query.upper()) | has_subsequence(caps, query.upper()), F.lit(0.6)),
        ("subsequence", has_subsequence(low, q), F.lit(0.5)),
        ("edit", edit_score(c, query) > 0, edit_score(c, query)),
    ]


def cli_search(symbols: DataFrame, query: str, most: int | None = None) -> DataFrame:
    return best(cascade(symbols, cli_cascade(query, F.col("name"))), most)


def path_search(symbols: DataFrame, query: str, most: int | None = None) -> DataFrame:
    """file_path, match_type, score of distinct paths; a file name that holds the query scores 0.65 if nothing else did."""
    paths = symbols.select("file_path").distinct()
    steps = [*cli_cascade(query, F.col("file_path")), ("filename", F.element_at(F.split("file_path", "/"), -1).contains(query), F.lit(0.65))]
    out = cascade(paths, steps).select("file_path", "match_type", F.round("score", 4).alias("score")).orderBy(F.desc("score"), F.octet_length("file_path"), "file_path")
    return out if most is None else out.limit(most)


def needs_fuzzy(query: str, exact: int) -> bool:
    return exact < 3 or len(query.encode()) <= 3 or query.isupper()


def fuzzy_needed(query: Column, exact: Column) -> Column:
    """needs_fuzzy() of columns."""
    return (exact < 3) | (F.octet_length(query) <= 3) | ((query == F.upper(query)) & (query != F.lower(query)))


def index_stats(symbols: DataFrame) -> DataFrame:
    """Sizes of the indices that a name search could use: distinct names, n-grams, prefixes and words."""
    low = symbols.select(F.lower("name").alias("n"), "name").distinct()
    count = lambda c: low.select(F.explode(c).alias("x")).agg(F.count_distinct("x").alias("k"))
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.char_length("n"), F.lit(5))), lambda i: F.substring(F.col("n"), F.lit(1), i))
    out = symbols.agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct(F.lower("name")).alias("names"))
    for name, c in (("bigrams", grams(F.col("n"), 2)), ("trigrams", grams(F.col("n"), 3)), ("prefixes", prefixes), ("words", F.transform(camel_words(F.col("name")), F.lower))):
        out = out.crossJoin(count(c).withColumnRenamed("k", name))  # one row each
    return out


def index_averages(symbols: DataFrame) -> DataFrame:
    """One row: how many symbols a distinct name, n-gram, prefix or word has in the mean."""
    low = symbols.select("id", F.lower("name").alias("n"), "name")
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.char_length("n"), F.lit(5))), lambda i: F.substring(F.col("n"), F.lit(1), i))
    out = None
    for name, c in (("names", F.array("n")), ("bigrams", grams(F.col("n"), 2)), ("trigrams", grams(F.col("n"), 3)), ("prefixes", prefixes), ("words", F.array_distinct(F.transform(camel_words(F.col("name")), F.lower)))):
        one = low.select(F.explode(c).alias("x")).agg(F.round(F.count(F.lit(1)) / F.greatest(F.count_distinct("x"), F.lit(1)), 4).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out
