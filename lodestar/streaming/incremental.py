"""Upkeep of the tables from file changes: diffs, change detection, batches and a stream of updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.schema import Graph


def content_hash(c: Column) -> Column:
    """16 hex digits; only equality counts."""
    return F.lpad(F.lower(F.hex(F.xxhash64(c))), 16, "0")


def file_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_path, id, op: symbols (file_path, id) that were removed, added or updated (in both)."""
    both = old.select("file_path", "id", F.lit(1).alias("o")).join(new.select("file_path", "id", F.lit(1).alias("n")), ["file_path", "id"], "full_outer")
    return both.select("file_path", "id", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("updated").alias("op"))


def needs_update(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """path, needs_update: whether the file (path, hash) is unknown or its hash differs."""
    known = files.select("path", F.col("hash").alias("old"))
    return candidates.join(known, "path", "left").select("path", (~F.col("hash").eqNullSafe(F.col("old"))).alias("needs_update"))


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status, content_hash: Added, Modified and Deleted files between two listings (path, hash)."""
    both = old.select("path", F.col("hash").alias("o")).join(new.select("path", F.col("hash").alias("n")), "path", "full_outer").where(~F.col("o").eqNullSafe(F.col("n")))
    return both.select("path", F.when(F.col("o").isNull(), "Added").when(F.col("n").isNull(), "Deleted").otherwise("Modified").alias("status"), F.col("n").alias("content_hash"))


def change_ratio(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: changed, total, ratio and whether to index everything anew."""
    changed = detect_changes(old, new).agg(F.count(F.lit(1)).alias("changed"))
    total = new.agg(F.count(F.lit(1)).alias("total"))
    ratio = F.when(F.col("total") > 0, F.col("changed") / F.col("total")).otherwise(0.0)
    return changed.crossJoin(total).withColumn("ratio", F.round(ratio, 4)).withColumn("full", ratio >= 0.5)  # one row each


def merged_changes(working: DataFrame, committed: DataFrame) -> DataFrame:
    """Changes of the working tree, and those of the commits for other paths."""
    return working.unionByName(committed.join(working.select("path"), "path", "left_anti"))


def update_files(g: Graph, new: DataFrame) -> Graph:
    """The symbols of the files in `new` replaced; all edges at symbols that were there go."""
    touched = g.symbols.join(new.select("file_path").distinct(), "file_path", "left_semi").select("id")
    return g.remove_symbols(touched).add_symbols(new)


def remove_files(g: Graph, paths: DataFrame) -> Graph:
    """Without the files in `paths` (column file_path)."""
    return g.remove_symbols(g.symbols.join(paths, "file_path", "left_semi").select("id"))


def files_of(g: Graph, hashes: DataFrame | None = None) -> DataFrame:
    """path, symbols (sorted ids)."""
    return g.symbols.groupBy(F.col("file_path").alias("path")).agg(F.array_sort(F.collect_set("id")).alias("symbols"))


def last_of_each(updates: DataFrame) -> DataFrame:
    """Of updates (seq, op, path, ...) the last for each path."""
    w = Window.partitionBy("path").orderBy(F.desc("seq"))
    return updates.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def batch_totals(old: DataFrame, updates: DataFrame) -> DataFrame:
    """One row: files, added, removed, updated when updates (seq, op, path, ids) are folded in order over old (file_path, id).

    Each update is held against the update of its path before it, or against old.
    """
    base = old.groupBy(F.col("file_path").alias("path")).agg(F.collect_set("id").alias("base"))
    none = F.array().cast("array<string>")
    now = F.when(F.col("op") == "removed", none).otherwise(F.coalesce("ids", none))
    w = Window.partitionBy("path").orderBy("seq")
    rows = updates.withColumn("now", now).withColumn("prev", F.lag("now").over(w)).withColumn("n", F.row_number().over(w)).join(base, "path", "left")
    prev = F.coalesce(F.when(F.col("n") > 1, F.col("prev")).otherwise(F.col("base")), none)
    size = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long")
    return rows.withColumn("p", prev).agg(F.count_distinct("path").alias("files"), size(F.array_except("now", "p")).alias("added"), size(F.array_except("p", "now")).alias("removed"), size(F.array_intersect("now", "p")).alias("updated"))


def apply_updates(g: Graph, updates: DataFrame) -> Graph:
    """The graph after a batch of updates (seq, op, path, symbols array of structs); the last of each path counts."""
    last = last_of_each(updates)
    new = last.where("op <> 'removed'").select(F.inline("symbols")).select(g.symbols.columns)
    gone = remove_files(g, last.select(F.col("path").alias("file_path")))
    return gone.add_symbols(new)


def stream_updates(updates: DataFrame, folder: str, checkpoint: str, start: Graph | None = None):
    """Starts a stream that folds micro-batches of updates into versioned tables below folder; returns the query.

    Each batch writes version n + 1 from version n, so a batch that runs again gives the same version.
    """

    def fold(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        at = lambda k, t: f"{folder}/{t}/v={k}"
        if n == 0:
            g = start or Graph(spark.createDataFrame([], batch.schema["symbols"].dataType.elementType), spark.createDataFrame([], "src_id string, dst_id string, kind string"))
        else:
            g = Graph(spark.read.parquet(at(n, "symbols")), spark.read.parquet(at(n, "edges")))
        out = apply_updates(g, batch)
        out.symbols.write.mode("overwrite").parquet(at(n + 1, "symbols"))
        out.edges.write.mode("overwrite").parquet(at(n + 1, "edges"))

    return updates.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
