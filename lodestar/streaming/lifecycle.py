"""An index over time: results of updates, differential and full indexing, and the store that keeps versions of it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import source
from lodestar.operators.analytics import dead
from lodestar.plans.tables import materialized
from lodestar.schema import EDGES, SYMBOLS, Graph
from lodestar.streaming.incremental import content_hash, detect_changes, file_diff

FILES = "path string, hash string"
#: A share of changed files from which on everything is indexed anew.
FULL_RATIO = 0.5
Extract = Callable[[DataFrame], DataFrame]


def replaced(g: Graph, paths: DataFrame, new: DataFrame) -> Graph:
    """The graph without the symbols of the files in paths (column file_path), with the new ones; all edges at symbols
    that were there go, also of those that come again."""
    gone = g.symbols.join(paths.select("file_path").distinct(), "file_path", "left_semi").select("id")
    return g.remove_symbols(gone).add_symbols(new.select(g.symbols.columns))


def update_results(g: Graph, paths: DataFrame, new: DataFrame, with_dead: bool = True) -> tuple[Graph, DataFrame]:
    """The graph after the files in paths (column file_path) got the symbols in `new`, and file_path, id, op: symbols that
    were added, removed, updated (in both), and with with_dead those that no entry point reaches afterwards (with their
    file) and those removed, as `dead`."""
    old = g.symbols.join(paths.select("file_path").distinct(), "file_path", "left_semi")
    diff = materialized(file_diff(old, new))
    after = replaced(g, paths, new)
    if not with_dead:
        return after, diff
    unreached = after.symbols.join(dead(after), "id", "left_semi").select("file_path", "id")
    lost = diff.where("op = 'removed'").select("file_path", "id")
    return after, diff.unionByName(unreached.unionByName(lost).withColumn("op", F.lit("dead")))


def fold_totals(results: DataFrame) -> DataFrame:
    """One row: added, removed, updated summed over all updates, and dead as the last one (by seq) has it. results: seq,
    added, removed, updated, dead."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"total_{c}") for c in ("added", "removed", "updated")]
    return results.agg(F.count(F.lit(1)).alias("updates"), *sums, F.coalesce(F.max_by("dead", "seq"), F.lit(0)).cast("long").alias("total_dead"))


def samples(g: DataFrame, diff: DataFrame, most: int = 20) -> DataFrame:
    """op, id, name, kind, file_path, start_line of the first `most` symbols (by id) that were added and removed. g: the
    symbols of both states."""
    rank = F.row_number().over(Window.partitionBy("op").orderBy("id"))
    first = diff.where("op in ('added', 'removed')").select("op", "id").distinct().withColumn("r", rank).where(F.col("r") <= most).drop("r")
    return first.join(g.select("id", "name", "kind", "file_path", "start_line").dropDuplicates(["id"]), "id").select("op", "id", "name", "kind", "file_path", "start_line")


@dataclass
class Batch:
    """Changes that are applied together: files to clear, ids to remove, symbols to add, in this order."""

    clear: DataFrame  # file_path
    remove: DataFrame  # id
    add: DataFrame

    def stats(self) -> DataFrame:
        """One row: how many of each."""
        one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        return one(self.add, "symbols_to_add").crossJoin(one(self.remove, "symbols_to_remove")).crossJoin(one(self.clear, "files_to_clear"))  # one row each

    def apply(self, g: Graph) -> Graph:
        """Symbols to add replace those of their id that are left."""
        gone = g.symbols.join(self.clear.select("file_path").distinct(), "file_path", "left_semi").select("id").unionByName(self.remove.select("id")).distinct()
        left = g.remove_symbols(gone)
        ids = self.add.select("id").distinct()
        return Graph(left.symbols.join(ids, "id", "left_anti").unionByName(self.add.select(left.symbols.columns)), left.edges)


def listing(files: DataFrame) -> DataFrame:
    """path, hash of files (path, content)."""
    return files.select("path", content_hash(F.col("content")).alias("hash"))


@dataclass
class Indexed:
    """What an indexing run did: changes (path, status), diff (file_path, id, op), and whether all was read anew."""

    graph: Graph
    files: DataFrame
    changes: DataFrame
    diff: DataFrame
    full: bool

    def summary(self) -> DataFrame:
        """One row: files and symbols added, modified or removed."""
        n = lambda df, c, v, name: df.agg(F.count(F.when(F.col(c) == v, 1)).alias(name))
        parts = [n(self.changes, "status", v, f"files_{v.lower()}") for v in ("Added", "Modified", "Deleted")]
        parts += [n(self.diff, "op", v, f"symbols_{v}") for v in ("added", "removed", "updated")]
        out = parts[0]
        for p in parts[1:]:
            out = out.crossJoin(p)  # one row each
        return out.withColumn("full", F.lit(self.full))


def index_differential(g: Graph, known: DataFrame, files: DataFrame, extract: Extract | None = None, full_ratio: float = FULL_RATIO) -> Indexed:
    """Brings the graph up to date with files (path, content). known: path, hash as they were indexed last.

    New and changed files are extracted and replace their symbols, files that are gone go. If the changed files are
    full_ratio of all or more, all files are extracted. Nulls in content count as empty.
    """
    extract = extract or extracted
    now = materialized(listing(files.withColumn("content", F.coalesce("content", F.lit("")))))
    changes = materialized(detect_changes(known, now).select("path", "status"))
    changed, total = changes.count(), now.count()
    full = total > 0 and changed / total >= full_ratio
    todo = now.select("path") if full else changes.where("status <> 'Deleted'").select("path")
    new = materialized(extract(files.join(todo, "path", "left_semi")))
    paths = todo.unionByName(changes.select("path")).distinct().select(F.col("path").alias("file_path"))
    after, diff = update_results(g, paths, new, with_dead=False)
    return Indexed(Graph(materialized(after.symbols), materialized(after.edges)), now, changes, diff, full)


def full_reindex(files: DataFrame, extract: Extract | None = None) -> Indexed:
    """The index of files (path, content) from nothing."""
    spark = files.sparkSession
    return index_differential(Graph(spark.createDataFrame([], SYMBOLS), spark.createDataFrame([], EDGES)), spark.createDataFrame([], FILES), files, extract, 0.0)


def extracted(files: DataFrame) -> DataFrame:
    """Symbols of files (path, content) by line patterns, with all columns."""
    none = F.lit(None).cast("string")
    return source.extract(files).withColumn("documentation", none).withColumn("detail", none)


class Store:
    """Versions of an index below a folder: tables symbols, edges and files of each version, and a table of metadata.

    A version's tables are written first and its row of metadata last, so a run that is lost leaves the old version
    current, and readers of an old version aren't disturbed.
    """

    TABLES = ("symbols", "edges", "files")
    METADATA = "version long, folder string, created_at timestamp, format string, project_root string, files_count long, symbols_count long, commit string"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, path: str, schema: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def metadata(self) -> DataFrame:
        """A row for each version; none for a store that was never written."""
        return self._read(f"{self.folder}/metadata", self.METADATA)

    def current(self) -> tuple[int, str] | None:
        row = self.metadata().orderBy(F.desc("version")).select("version", "folder").first()
        return (row["version"], row["folder"]) if row else None

    def tables(self) -> list[str]:
        """Names of the current version's tables."""
        return [*self.TABLES, "metadata"] if self.current() else []

    def load(self) -> tuple[Graph, DataFrame]:
        """The current graph and files (path, hash); empty ones if there is none."""
        at = self.current()
        where = f"{self.folder}/{at[1]}" if at else f"{self.folder}/none"
        return Graph(self._read(f"{where}/symbols", SYMBOLS), self._read(f"{where}/edges", EDGES)), self._read(f"{where}/files", FILES)

    def save(self, g: Graph, files: DataFrame, project_root: str = "", commit: str | None = None) -> int:
        """Writes a new version and returns its number."""
        at = self.current()
        version, name = (at[0] + 1 if at else 1), f"v-{uuid.uuid4().hex}"
        symbols = g.symbols.select([F.col(c) for c in (x.split()[0] for x in SYMBOLS.split(", "))])
        for table, df in zip(self.TABLES, (symbols, g.edges, files.select("path", "hash")), strict=True):
            df.write.parquet(f"{self.folder}/{name}/{table}")
        sizes = [self.spark.read.parquet(f"{self.folder}/{name}/{t}").count() for t in ("files", "symbols")]
        row = self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(name).alias("folder"), F.current_timestamp().alias("created_at"), F.lit("lsif").alias("format"), F.lit(project_root).alias("project_root"), F.lit(sizes[0]).cast("long").alias("files_count"), F.lit(sizes[1]).cast("long").alias("symbols_count"), F.lit(commit).cast("string").alias("commit"))
        row.write.mode("append").parquet(f"{self.folder}/metadata")
        return version

    def index(self, files: DataFrame, full: bool = False, project_root: str = "", extract: Extract | None = None) -> Indexed:
        """Indexes files (path, content) differentially, or from nothing, and saves if anything changed."""
        g, known = self.load()
        done = full_reindex(files, extract) if full else index_differential(g, known, files, extract)
        if full or not done.changes.isEmpty():
            self.save(done.graph, done.files, project_root)
        return done

    def ready(self, files: DataFrame | None = None) -> Graph:
        """The current graph, brought up to date first if files are given."""
        if files is not None:
            self.index(files)
        return self.load()[0]


def export_json(symbols: DataFrame, folder: str) -> None:
    """Lines of JSON: first {"total": n}, then a symbol a line, in the order of ids; files in the order of their names."""
    total = symbols.agg(F.to_json(F.struct(F.count(F.lit(1)).alias("total"))).alias("value"))
    total.coalesce(1).write.mode("overwrite").text(f"{folder}/total")
    symbols.orderBy("id").select(F.to_json(F.struct(*symbols.columns)).alias("value")).write.mode("overwrite").text(f"{folder}/symbols")


def exported(symbols: DataFrame) -> DataFrame:
    """One row, value: {"symbols": [...], "total": n}; for as many symbols as one JSON text can hold."""
    own = F.array_sort(F.collect_list(F.struct("id", *[c for c in symbols.columns if c != "id"])))
    return symbols.agg(F.to_json(F.struct(own.alias("symbols"), F.count(F.lit(1)).alias("total"))).alias("value"))


def metrics(operations: DataFrame, by: str = "operation") -> DataFrame:
    """by, n, least, most, mean, share of successes of operations (by, duration, success)."""
    return operations.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("duration").alias("least"), F.max("duration").alias("most"), F.avg("duration").alias("mean"), F.avg(F.col("success").cast("int")).alias("success_rate"))
