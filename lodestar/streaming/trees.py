"""What changed between two listings of files, by digests of their directories.

A directory's digest covers its files' names and hashes and its directories' names and digests, so equal digests mean equal
contents (two hashes of 64 bits each and the number of entries). Digests are made level by level from the deepest one up;
entries are stored in parts by a bucket of their directory. A comparison goes down from the roots through directories that
differ and reads the buckets of these only, so files below an equal directory are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.traverse import shortened, united
from lodestar.plans.tables import materialized

BUCKETS = 64
ENTRIES = "dir string, name string, is_dir boolean, digest string, bucket int"


def bucket_of(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def parent(path: Column) -> Column:
    """Up to the last slash; empty at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def digest_of() -> Column:
    """Of a directory's entries (name, is_dir, digest): sums without an order, so a large directory is added up in parts."""
    both = [F.lpad(F.hex(F.bit_xor(F.xxhash64(F.lit(seed), "name", "is_dir", "digest"))), 16, "0") for seed in ("a", "b")]
    return F.concat_ws("-", *both, F.count(F.lit(1)).cast("string"))


def store(listing: DataFrame, folder: str) -> None:
    """Writes the entries of a listing (path, hash; paths are distinct and relative) below folder. A null hash is a hash of its own."""
    files = listing.select(F.col("path"), F.coalesce(F.concat(F.lit("="), "hash"), F.lit("")).alias("digest"))
    rows = materialized(files.select(parent(F.col("path")).alias("dir"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(False).alias("is_dir"), "digest"))
    depth = lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, "/")))
    rows = rows.withColumn("depth", depth(F.col("dir")))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    dirs = []
    for n in range(deepest, 0, -1):
        level = rows.where(F.col("depth") == n).drop("depth")
        if dirs:
            level = level.unionByName(dirs[-1].where(F.col("dir") != ""))
        made = level.groupBy(F.col("dir").alias("d")).agg(digest_of().alias("digest"))
        at = made.select(parent(F.col("d")).alias("dir"), F.element_at(F.split("d", "/"), -1).alias("name"), F.lit(True).alias("is_dir"), "digest")
        dirs.append(materialized(at))
    every = united([rows.drop("depth"), *dirs]).withColumn("bucket", bucket_of(F.col("dir")))
    every.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def entries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ENTRIES).parquet(folder)


def changes(spark: SparkSession, old: str, new: str, looked: list[int] | None = None) -> DataFrame:
    """path, status (Added, Modified, Deleted), content_hash between two stored listings. `looked` takes the number of
    entries that each round compared."""
    frontier = materialized(spark.range(1).select(F.lit("").alias("dir")))
    out = []
    while not frontier.isEmpty():
        buckets = [r["b"] for r in frontier.select(bucket_of(F.col("dir")).alias("b")).distinct().collect()]  # BUCKETS at most
        side = lambda folder, x: entries(spark, folder).where(F.col("bucket").isin(buckets)).join(frontier, "dir", "left_semi").select("dir", "name", "is_dir", F.col("digest").alias(x))
        both = materialized(side(old, "o").join(side(new, "n"), ["dir", "name", "is_dir"], "full_outer"))
        if looked is not None:
            looked.append(both.count())
        differ = both.where(~F.col("o").eqNullSafe(F.col("n")))
        path = F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat_ws("/", "dir", "name"))
        status = F.when(F.col("o").isNull(), "Added").when(F.col("n").isNull(), "Deleted").otherwise("Modified")
        out = shortened([*out, materialized(differ.where("not is_dir").select(path.alias("path"), status.alias("status"), F.when(F.length("n") > 0, F.substring(F.col("n"), F.lit(2), F.length("n"))).alias("content_hash")))])
        frontier = materialized(differ.where("is_dir").select(path.alias("dir")).distinct())
    return united(out)
