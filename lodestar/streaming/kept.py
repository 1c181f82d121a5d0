"""A graph kept as generations: an update writes the rows of the changed files and nothing else.

Tables below a folder, each in parts by generation (column seq):

* files: path, op. The newest generation that names a path says in which one its symbols are, or that it is removed.
* symbols: also in parts by a bucket of the path, so a file's symbols are read from its bucket.
* edges: with both ends' paths and the generation that each of these was in. An edge counts while both are still current,
  so an update of a file takes out all edges at its symbols without a look at them.

Writing a generation again gives the same parts, so a batch of a stream may run twice. compact() merges generations into a
folder of one, when reads have too many parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.plans.tables import materialized
from lodestar.schema import SYMBOL_COLUMNS, SYMBOLS, Graph
from lodestar.streaming.incremental import last_of_each

#: Fixed for the life of a folder.
BUCKETS = 64
FILES = "path string, op string, seq long"
KEPT_SYMBOLS = f"{SYMBOLS}, seq long, bucket int"
KEPT_EDGES = "src_id string, dst_id string, kind string, src_file string, dst_file string, src_seq long, dst_seq long, seq long"


def bucket_of(path):
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")


def _put(df: DataFrame, folder: str, name: str, seq: int) -> None:
    to = f"{folder}/{name}/seq={seq}"
    if "bucket" in df.columns:
        df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(to)
    else:
        df.write.mode("overwrite").parquet(to)


def _symbols(symbols: DataFrame) -> DataFrame:
    return symbols.select(*SYMBOL_COLUMNS, bucket_of(F.col("file_path")).alias("bucket"))


def files(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """path, seq of the files that are there (in generations before `before`, if given)."""
    rows = _read(spark, folder, "files", FILES)
    rows = rows if before is None else rows.where(F.col("seq") < before)
    return rows.groupBy("path").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq")).where("op <> 'removed'").select("path", "seq")


def create(g: Graph, folder: str) -> None:
    """Generation 0: the whole graph. Edges to unknown ids are left out."""
    s = materialized(g.symbols.select(*SYMBOL_COLUMNS))
    _put(s.select(F.col("file_path").alias("path"), F.lit("added").alias("op")).distinct(), folder, "files", 0)
    _put(_symbols(s), folder, "symbols", 0)
    own = s.where("file_path is not null").select("id", "file_path", F.lit(0).cast("long").alias("seq"))  # nothing to look up yet
    add_edges(s.sparkSession, folder, g.edges, 0, own)


def add_edges(spark: SparkSession, folder: str, edges: DataFrame, seq: int, symbols: DataFrame | None = None) -> None:
    """Writes edges (src_id, dst_id, kind) of generation `seq`, in place of what it had, between symbols as they are then."""
    own = live_symbols(spark, folder, seq + 1) if symbols is None else symbols
    end = lambda x: own.select(F.col("id").alias(f"{x}_id"), F.col("file_path").alias(f"{x}_file"), F.col("seq").alias(f"{x}_seq"))
    rows = edges.select("src_id", "dst_id", "kind").join(end("src"), "src_id").join(end("dst"), "dst_id")
    _put(rows.select(*[c.split()[0] for c in KEPT_EDGES.split(", ")][:-1]), folder, "edges", seq)


def live_symbols(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The symbols with their generation (before `before`, if given)."""
    rows = _read(spark, folder, "symbols", KEPT_SYMBOLS)
    rows = rows if before is None else rows.where(F.col("seq") < before)
    return rows.join(files(spark, folder, before).withColumnRenamed("path", "file_path"), ["file_path", "seq"], "left_semi").select(*SYMBOL_COLUMNS, "seq")


def apply(spark: SparkSession, folder: str, updates: DataFrame, seq: int, edges: DataFrame | None = None) -> None:
    """Writes generation `seq` (larger than those before) from updates (seq, op, path, symbols array of structs), of which
    the last for each path counts, and from new edges (src_id, dst_id, kind)."""
    last = materialized(last_of_each(updates.select("seq", "op", "path", "symbols")))
    new = last.where("op <> 'removed'").select(F.inline("symbols"))
    _put(last.select("path", "op"), folder, "files", seq)
    _put(_symbols(new), folder, "symbols", seq)
    none = spark.createDataFrame([], "src_id string, dst_id string, kind string")
    add_edges(spark, folder, none if edges is None else edges, seq)


def load(spark: SparkSession, folder: str) -> Graph:
    """The graph as it is now."""
    now = materialized(files(spark, folder))
    symbols = _read(spark, folder, "symbols", KEPT_SYMBOLS).join(now.withColumnRenamed("path", "file_path"), ["file_path", "seq"], "left_semi").select(*SYMBOL_COLUMNS)
    rows = _read(spark, folder, "edges", KEPT_EDGES)
    for x in ("src", "dst"):
        rows = rows.join(now.select(F.col("path").alias(f"{x}_file"), F.col("seq").alias(f"{x}_seq")), [f"{x}_file", f"{x}_seq"], "left_semi")
    return Graph(symbols, rows.select("src_id", "dst_id", "kind"))


def in_file(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """A file's symbols, read from its bucket only."""
    bucket = spark.range(1).select(bucket_of(F.lit(path)).alias("b")).first()["b"]
    own = _read(spark, folder, "symbols", KEPT_SYMBOLS).where((F.col("bucket") == bucket) & (F.col("file_path") == path))
    now = files(spark, folder).where(F.col("path") == path).withColumnRenamed("path", "file_path")
    return own.join(now, ["file_path", "seq"], "left_semi").select(*SYMBOL_COLUMNS)


def generations(spark: SparkSession, folder: str) -> int:
    return _read(spark, folder, "files", FILES).select("seq").distinct().count()


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """The current graph as generation 0 of another folder. Files without symbols are kept as such."""
    now = materialized(files(spark, folder))
    create(load(spark, folder), target)
    _put(now.select("path", F.lit("added").alias("op")), target, "files", 0)


def stream(updates: DataFrame, folder: str, checkpoint: str):
    """Starts a stream that writes a generation for each micro-batch of updates over a folder that create() made; returns the query."""
    write = lambda batch, n: apply(batch.sparkSession, folder, batch, n + 1)
    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
