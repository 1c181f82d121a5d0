"""Column functions over names: capitals, word splits, n-grams, subsequences, edit scores."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def capitals(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{Lu}]", "")


def camel_words(c: Column) -> Column:
    """Acronyms, capitalised words, lower-case words and runs of digits."""
    return F.regexp_extract_all(c, F.lit(r"\p{Lu}+(?=\p{Lu}\p{Ll})|\p{Lu}?\p{Ll}+|\p{Lu}+|\p{N}+"), F.lit(0))


def plain_camel_words(c: Column) -> Column:
    """Split only before a capital that follows another character than a capital; the whole text is added if it has parts."""
    parts = F.split(c, r"(?<=[^\p{Lu}])(?=\p{Lu})")
    return F.when(F.size(parts) > 1, F.concat(parts, F.array(c))).otherwise(parts)


def grams(c: Column, n: int) -> Column:
    """Distinct n-grams of characters with n - 1 spaces before and after; none of a text of fewer than n bytes."""
    padded = F.concat(F.lit(" " * (n - 1)), c, F.lit(" " * (n - 1)))
    every = F.transform(F.sequence(F.lit(1), F.char_length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n)))
    return F.when(F.octet_length(c) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def plain_grams(c: Column, n: int) -> Column:
    """All n-grams of characters in their order, without padding; none of a text of fewer than n bytes."""
    every = F.transform(F.sequence(F.lit(1), F.char_length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.char_length(c) >= n, every).otherwise(F.array().cast("array<string>"))


def query_grams(q: str, n: int) -> list[str]:
    padded = " " * (n - 1) + q + " " * (n - 1)
    return sorted({padded[i : i + n] for i in range(len(padded) - n + 1)}) if len(q.encode()) >= n else []


def has_subsequence(c: Column, query: str) -> Column:
    return c.rlike("(?s)" + ".*".join(re.escape(x) for x in query)) if query else F.lit(True)


def bytes_of(c: Column) -> Column:
    return F.octet_length(c)


def edit_score(c: Column, query: str) -> Column:
    """0.8 times the share of equal characters if that is at least 0.7, else 0."""
    score = 1 - F.levenshtein(F.lower(c), F.lit(query.lower())) / F.greatest(bytes_of(c), F.lit(len(query.encode())))
    return F.when(score >= 0.7, score * 0.8).otherwise(0.0)
