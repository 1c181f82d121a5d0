"""Quality rules (operator 9), in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated 8-word windows. The method's verdict compares two
histograms of a text with its language's reference, by Jensen-Shannon distance (base 2, 0 to 1): of character classes
and of common words. A language's common words are the COMMON most frequent words of letters in all its texts, and its
references are sums over all of them. A histogram of too few characters or words isn't judged. A text without a single
common word has a distance that depends on its language's reference alone, so a text that lacks them is held against a
share of that distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.tables import written

COMMON = 40
#: So many languages' references are broadcast at most, a few KB each; of more Spark chooses the join.
BROADCAST_LANGUAGES = 200
CLASSES = ("upper", "digit", "symbol", "mark", "space", "rest")
SPLIT = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
WINDOW = 8


def small(df: DataFrame) -> DataFrame:
    """A table of a row for each language, to be broadcast if there are few of them."""
    return F.broadcast(df) if df.count() <= BROADCAST_LANGUAGES else df


def pairs_of(values: Column, by: int) -> Column:
    """Hashes of each value with the one `by` places on."""
    n = F.greatest(F.size(values) - by, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(1 + by), n), lambda a, b: F.xxhash64(a, b))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))


def common_words(source: DataFrame, most: int = COMMON) -> DataFrame:
    """lang, own: each language's most frequent words that are made of letters, ties to the smaller word."""
    words = source.select("lang", F.explode(F.split(F.lower("text"), SPLIT)).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("word").rlike(r"^\p{L}+$"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return counts.withColumn("r", rank).where(F.col("r") <= most).groupBy("lang").agg(F.sort_array(F.collect_list("word")).alias("own"))


def chosen(every: list[str]) -> Column:
    """The words of `words` in lower case that are in `own`, a language's common words; `every`: all languages' ones, if known."""
    likely = F.filter("words", lambda w: F.lower(w).isin(*every)) if every else F.col("words")
    return F.filter(F.transform(likely, F.lower), lambda w: F.array_contains("own", w))


def measures(df: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """id, lang, the base counts, the character classes' counts and those of the language's common words that there are."""
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    raw = df.select(F.col(id_col).alias("id"), F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    learned = written(common_words(raw))
    few = learned.count() <= BROADCAST_LANGUAGES
    # Of few languages, any one's common words are picked out by a set first; a text's own ones are told from these.
    every = sorted({w for r in learned.select("own").collect() for w in r["own"]}) if few else []  # at most COMMON words of each
    source = raw.join(F.broadcast(learned) if few else learned, "lang", "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    # Java's \s class is exactly these six characters.
    a = source.select("id", "lang", "own", F.char_length("text").alias("n_chars"), (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).alias("n_symbols"), lines.alias("lines"), words_of(F.col("text")).alias("words"))
    b = a.select("id", "lang", "n_chars", "n_symbols", F.size("words").cast("long").alias("n_words"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.array_join("words", "").alias("joined"), F.transform("words", lambda w: F.xxhash64(w)).alias("h1"), chosen(every).alias("common"))
    count = lambda pattern: (F.char_length("joined") - F.char_length(F.regexp_replace("joined", pattern, ""))).cast("long")
    c = b.select("id", "lang", "n_words", "n_dup_lines", F.col("n_symbols").cast("long").alias("n_symbols"), F.char_length("joined").cast("long").alias("word_chars"), (F.col("n_chars") - F.char_length("joined")).cast("long").alias("space"), count(r"\p{Lu}+").alias("upper"), count(r"\p{Nd}+").alias("digit"), count(r"[\p{P}\p{S}]+").alias("mark"), "common", F.array_distinct("common").alias("kinds"), pairs_of(F.col("h1"), 1).alias("h2"))
    d = c.select("*", pairs_of(F.col("h2"), 2).alias("h4")).drop("h2")
    # Equal windows of 8 words begin with equal ones of 4.
    e = d.select("*", F.when(F.size(F.array_distinct("h4")) < F.size("h4"), pairs_of(F.col("h4"), 4)).alias("h8")).drop("h4")
    # Only texts with an equal pair of windows are sorted.
    ranked = F.when(F.size(F.array_distinct("h8")) < F.size("h8"), F.sort_array(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    f = e.select("*", ranked.alias("s")).drop("h8")
    n = F.size("s") - 1
    after = F.concat(F.transform(F.slice("s", F.lit(2), n), lambda x: x.h), F.array(F.lit(None).cast("long")))
    before = F.concat(F.array(F.lit(None).cast("long")), F.transform(F.slice("s", F.lit(1), n), lambda x: x.h))
    both = F.when(F.col("s").isNotNull(), F.arrays_zip(F.col("s").alias("x"), before.alias("p"), after.alias("q")))
    g = f.select("*", both.alias("z")).drop("s")
    places = F.sort_array(F.transform(F.filter("z", lambda v: F.coalesce(v.x.h == v.p, F.lit(False)) | F.coalesce(v.x.h == v.q, F.lit(False))), lambda v: v.x.i))
    h = g.select("*", places.alias("at")).drop("z")
    gaps = F.zip_with(F.slice("at", F.lit(2), F.size("at") - 1), F.slice("at", F.lit(1), F.size("at") - 1), lambda y, x: F.least(y - x, F.lit(WINDOW)))
    repeated = F.when(F.col("at").isNotNull() & (F.size("at") > 0), F.aggregate(gaps, F.lit(WINDOW), lambda s, x: s + x)).otherwise(0).cast("long")
    counts = F.transform("kinds", lambda w: F.struct(w.alias("word"), (F.size("common") - F.size(F.array_remove("common", w))).cast("long").alias("n")))
    return h.select("id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"), "upper", "digit", F.col("n_symbols").alias("symbol"), (F.col("mark") - F.col("n_symbols")).alias("mark"), "space", (F.col("word_chars") - F.col("upper") - F.col("digit") - F.col("mark")).alias("rest"), counts.alias("counts"), F.size("common").cast("long").alias("n_common"))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def term(p: Column, q: Column) -> Column:
    """One class's part of the Jensen-Shannon divergence, in bits."""
    mean = (p + q) / 2
    return (F.when(p > 0, p * F.log2(p / mean)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / mean)).otherwise(0.0)) / 2


def references(found: DataFrame) -> DataFrame:
    """One row a language: the shares of the character classes and a map of the common words' shares."""
    whole = sum((F.sum(c) for c in CLASSES[1:]), F.sum(CLASSES[0]))
    chars = found.groupBy("lang").agg(*[share(F.sum(c), whole).alias(f"q_{c}") for c in CLASSES], F.sum("n_words").alias("all_words"), F.sum("n_common").alias("all_common"))
    words = found.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.word").agg(F.sum("c.n").alias("n"))
    per = words.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("ns"))  # at most COMMON entries
    joined = chars.join(per, "lang", "left").withColumn("ns", F.coalesce("ns", F.create_map().cast("map<string,bigint>")))
    return joined.select("lang", *[f"q_{c}" for c in CLASSES], F.transform_values("ns", lambda _, n: share(n, F.col("all_words"))).alias("q_words"), share(F.col("all_words") - F.col("all_common"), F.col("all_words")).alias("q_other"))


def judge(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    min_chars: int = 200,
    max_char_distance: float = 0.28,
    min_judged_words: int = 40,
    max_word_distance: float = 0.45,
    max_lack_share: float = 0.6,
    min_common_share: float = 0.3,
) -> DataFrame:
    """One row per row: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance,
    word_distance, kept.

    A null text counts as empty: all counts are 0 and the base rules fail. A row of null language is held against
    the reference of all such rows, any other against that of its language. Distances of texts below min_chars or min_judged_words are null and don't
    count. A text fails by its words if their distance is above max_word_distance, or if it is above max_lack_share of the
    distance of a text without common words while its share of common words is below min_common_share of the
    reference's; the second condition keeps short texts, whose distance is large by chance. Rows of one id are judged one by one. Other columns are left out. An empty table gives no rows.
    """
    found = written(measures(df, id_col, text_col, lang_col))
    own = found.join(small(written(references(found))), "lang", "left")
    total = sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0]))
    chars = sum((term(share(F.col(c), total), F.col(f"q_{c}")) for c in CLASSES[1:]), term(share(F.col(CLASSES[0]), total), F.col(f"q_{CLASSES[0]}")))
    n = F.col("n_words")
    # A word that the text lacks adds half its share in the reference.
    seen = F.aggregate("counts", F.lit(0.0), lambda s, c: s + term(share(c.n, n), F.coalesce(F.col("q_words")[c.word], F.lit(0.0))) - F.coalesce(F.col("q_words")[c.word], F.lit(0.0)) / 2)
    unseen = F.aggregate(F.map_values("q_words"), F.lit(0.0), lambda s, q: s + q) / 2
    words = seen + unseen + term(share(n - F.col("n_common"), n), F.col("q_other"))
    none = unseen + term(F.lit(1.0), F.col("q_other"))
    distance = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    out = own.withColumn("char_distance", F.when(total >= min_chars, distance(chars))).withColumn("word_distance", F.when(n >= min_judged_words, distance(words)))
    out = out.withColumn("base_failed", (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * n))
    word_distance = F.coalesce("word_distance", F.lit(0.0))
    lacks = (word_distance > max_lack_share * distance(none)) & (share(F.col("n_common"), n) < min_common_share * (1 - F.col("q_other")))
    kept = ~F.col("base_failed") & (F.coalesce("char_distance", F.lit(0.0)) <= max_char_distance) & (word_distance <= max_word_distance) & ~lacks
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", kept.alias("kept"))
