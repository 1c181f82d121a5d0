"""A kept index of names for core_search(): postings of n-grams in buckets, so that a search reads the query's buckets only.

Three tables below a folder, each in parts by generation (column seq); postings and holders also by bucket:

* postings: key, place, name. A row for each padded trigram and bigram of a distinct name in lower case with its place, for
  each character, and for one and two capitals in a row. Names with characters of several bytes have a key of their own.
* holders: name, id, file_path. Which symbols have a name.
* files: path. A file's holders count only in its newest generation.

An update appends a generation: the holders of the changed files, those files' paths and postings of names that are new. So
its cost goes with the change, and the same update written again gives the same parts. What no holder has any more stays in
the postings until compact() and never comes out of a search.

Why the scan's results come out: each match by equality, prefix, substring or shared n-grams shares an n-gram (or, for a query
of one character, that character); a match by capitals shares its first two (or one); and a name of ASCII within 0.3 of the
longer length in edits keeps at least one padded trigram, near its place. Names with longer characters are always looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.names import capitals, query_grams
from lodestar.operators.search import best, cascade, core_cascade, core_search, gram_size
from lodestar.plans.tables import materialized

#: Fixed for the life of an index.
BUCKETS = 64
WIDE = "w"
POSTINGS = "key string, place int, name string, seq long, bucket int"
HOLDERS = "name string, id string, file_path string, seq long, bucket int"
FILES = "path string, seq long"


def bucket_of(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def _runs(c: Column, n: int, mark: str) -> Column:
    """(key, place) of each n characters in a row; none of a shorter text."""
    every = F.transform(F.sequence(F.lit(1), F.char_length(c) - n + 1), lambda i: F.struct(F.concat(F.lit(mark), F.substring(c, i, F.lit(n))).alias("key"), i.cast("int").alias("place")))
    return F.when(F.char_length(c) >= n, every).otherwise(F.array().cast("array<struct<key:string,place:int>>"))


def postings_of(names: DataFrame) -> DataFrame:
    """key, place, name of distinct names (column name)."""
    low, caps = F.lower("name"), capitals(F.col("name"))
    none = F.array().cast("array<struct<key:string,place:int>>")
    padded = lambda n: F.when(F.octet_length(low) >= n, _runs(F.concat(F.lit(" " * (n - 1)), low, F.lit(" " * (n - 1))), n, str(n))).otherwise(none)
    wide = F.when(F.octet_length(low) > F.char_length(low), F.array(F.struct(F.lit(WIDE).alias("key"), F.lit(0).alias("place")))).otherwise(none)
    every = F.concat(padded(3), padded(2), _runs(low, 1, "1"), _runs(caps, 1, "c"), _runs(caps, 2, "C"), wide)
    return names.select("name", F.explode(every).alias("x")).select("x.key", "x.place", "name")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = {"postings": POSTINGS, "holders": HOLDERS, "files": FILES}[name]
    return spark.read.schema(schema).option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")


def _put(df: DataFrame, folder: str, name: str, seq: int, *by: str) -> None:
    df.repartition(*(F.col(c) for c in by)).write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/{name}/seq={seq}") if by else df.write.mode("overwrite").parquet(f"{folder}/{name}/seq={seq}")


def _append(symbols: DataFrame, paths: DataFrame, names: DataFrame, folder: str, seq: int) -> None:
    post = postings_of(names).withColumn("bucket", bucket_of(F.col("key")))
    _put(post, folder, "postings", seq, "bucket")
    _put(symbols.where("name is not null").select("name", "id", "file_path").withColumn("bucket", bucket_of(F.col("name"))), folder, "holders", seq, "bucket")
    _put(paths.select("path"), folder, "files", seq)


def build(symbols: DataFrame, folder: str) -> None:
    """Writes the index of symbols (id, name, file_path) as generation 0. Null names are not found by any search."""
    s = materialized(symbols.select("id", "name", "file_path"))
    _append(s, s.select(F.col("file_path").alias("path")).distinct(), s.where("name is not null").select("name").distinct(), folder, 0)


def update(spark: SparkSession, folder: str, symbols: DataFrame, paths: DataFrame, seq: int) -> None:
    """Appends generation `seq` (larger than those before): the files of `paths` (column path) now have these symbols; a file
    without any is gone. The same call again replaces its own generation."""
    s = materialized(symbols.select("id", "name", "file_path"))
    new = materialized(s.where("name is not null").select("name").distinct().withColumn("bucket", bucket_of(F.col("name"))))
    buckets = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
    old = table(spark, folder, "holders").where(F.col("bucket").isin(buckets) & (F.col("seq") < seq))
    fresh = materialized(new.join(old.select("bucket", "name"), ["bucket", "name"], "left_anti").select("name"))
    _append(s, paths.select("path").distinct(), fresh, folder, seq)


def live(spark: SparkSession, folder: str, holders: DataFrame) -> DataFrame:
    """name, id, file_path of holders in their file's newest generation."""
    newest = table(spark, folder, "files").groupBy(F.col("path").alias("file_path")).agg(F.max("seq").alias("seq"))
    return holders.join(newest, ["file_path", "seq"], "left_semi").select("name", "id", "file_path")


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """The index as one generation in another folder, without what nobody has any more."""
    build(live(spark, folder, table(spark, folder, "holders")), target)


def query_keys(query: str) -> dict[str, list[int]]:
    """The keys that a match shares, with the places of the query's n-grams (empty for the others)."""
    q, up = query.lower(), query.upper()
    n = gram_size(q)
    padded = " " * (n - 1) + q + " " * (n - 1)
    keys: dict[str, list[int]] = {WIDE: []}
    for g in query_grams(q, n):
        keys[f"{n}{g}"] = [i + 1 for i in range(len(padded) - n + 1) if padded[i : i + n] == g]
    if len(q) == 1:
        keys[f"1{q}"] = []
    keys[f"c{up}" if len(up) == 1 else f"C{up[:2]}"] = []
    return keys


def candidates(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """name, ratio (the share of the query's n-grams that the name has), may_be_typo: names that share a key with the query."""
    q = query.lower()
    n, size = gram_size(q), len(q.encode())
    keys = query_keys(query)
    own = query_grams(q, n)
    wanted = spark.range(1).select(F.array(*[F.lit(k) for k in keys]).alias("k")).select(F.explode("k").alias("k"))
    buckets = sorted({r["b"] for r in wanted.select(bucket_of(F.col("k")).alias("b")).collect()})  # of the query's few keys
    low = F.lower("name")
    edits = F.floor(F.greatest(F.octet_length(low), F.lit(size)) * 0.3)
    places = F.create_map(*[x for k, at in keys.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in at]).cast("array<int>"))])
    near = F.exists(places[F.col("key")], lambda p: F.abs(p - F.col("place")) <= edits)
    post = table(spark, folder, "postings").where(F.col("bucket").isin(buckets) & F.col("key").isin(list(keys)))
    is_gram = F.col("key").startswith(str(n)) & F.lit(bool(own))
    shared = post.groupBy("name").agg(F.count_distinct(F.when(is_gram, F.col("key"))).alias("shared"), F.count_distinct(F.when(is_gram & near, F.col("key"))).alias("near"), F.max((F.col("key") == WIDE).cast("int")).alias("wide"))
    fit = (F.col("near") >= F.greatest(F.lit(1), F.lit(len(own)) - n * edits)) & (F.abs(F.octet_length(low) - size) <= edits)
    return shared.select("name", (F.col("shared") / max(len(own), 1)).alias("ratio"), ((F.col("wide") == 1) | fit).alias("may_be_typo"))


def search(spark: SparkSession, folder: str, query: str, most: int | None = 50) -> DataFrame:
    """What core_search() gives for the symbols of the index: id, name, match_type, score. A query with characters of several
    bytes, whose edits can leave no n-gram, scans the names."""
    q = query.lower()
    holders = table(spark, folder, "holders")
    if not q or len(q.encode()) > len(q) or len(query.upper().encode()) > len(query.upper()):
        return core_search(live(spark, folder, holders), query, most)
    found = candidates(spark, folder, query)
    hits = materialized(cascade(found, core_cascade(query, F.col("ratio"), F.col("may_be_typo"))).select("name", "match_type", "score", bucket_of(F.col("name")).alias("bucket")))
    buckets = [r["bucket"] for r in hits.select("bucket").distinct().collect()]  # BUCKETS at most
    ids = live(spark, folder, holders.where(F.col("bucket").isin(buckets)).join(hits.select("bucket", "name"), ["bucket", "name"], "left_semi"))
    return best(ids.join(hits.select("name", "match_type", "score"), "name"), most)
