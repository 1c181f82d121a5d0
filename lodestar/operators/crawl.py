"""A best-first crawl over weighted file edges with a budget of files.

A queue would take one file at a time: the one of least priority, of equal ones the deepest, then the first path. Here the
frontier is a table with one row a file, and each round takes a whole run of its least priority at once: all files up to the
first that leads on to one of the same or a smaller priority, as that one comes next. So the files, their order and depths
are the queue's, in as many rounds as priorities fall back, and a round looks at no more than the budget's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.traverse import shortened, united
from lodestar.plans.tables import materialized

COLUMNS = ("file", "priority", "depth")


def first_of_each(frontier: DataFrame) -> DataFrame:
    """Of a file's entries the one that a queue would give first."""
    best = F.min_by(F.struct("priority", "depth"), F.struct("priority", -F.col("depth"))).alias("x")
    return frontier.groupBy("file").agg(best).select("file", "x.priority", "x.depth")


def crawl_by_priority(file_edges: DataFrame, starts: DataFrame, most_depth: int = 3, most_files: int = 100) -> DataFrame:
    """file, depth, priority, place (from 1): the files that a queue gives, at most `most_files`.

    file_edges: src_file, dst_file, priority (the least one of parallel edges counts); starts: file, priority. A file
    deeper than most_depth isn't crawled; a file has the depth at which it came first. Null priorities come last.
    """
    last = F.lit(2**62)
    steps = materialized(file_edges.groupBy("src_file", "dst_file").agg(F.min(F.coalesce("priority", last)).cast("long").alias("p")))
    frontier = materialized(first_of_each(starts.select("file", F.coalesce("priority", last).cast("long").alias("priority"), F.lit(0).alias("depth"))))
    crawled = [materialized(frontier.limit(0).withColumn("place", F.lit(0).cast("long")))]
    taken = 0
    while taken < most_files:
        least = frontier.agg(F.min("priority")).first()[0]
        if least is None:
            break
        order = [F.desc("depth"), F.col("file")]
        wave = frontier.where(F.col("priority") == least).orderBy(*order).limit(most_files - taken)
        wave = materialized(wave.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")))  # at most the budget's rows
        known = united([x.select("file") for x in crawled])
        on = wave.where(F.col("depth") < most_depth).select(F.col("file").alias("src_file"), (F.col("depth") + 1).alias("depth"), "place").join(steps, "src_file").join(known.withColumnRenamed("file", "dst_file"), "dst_file", "left_anti")
        on = materialized(on.select(F.col("dst_file").alias("file"), F.col("p").alias("priority"), "depth", "place"))
        stop, end = on.where(F.col("priority") <= least).agg(F.min("place")).first()[0], wave.count()
        stop = end if stop is None else stop
        now = wave.where(F.col("place") <= stop)
        crawled = shortened([*crawled, materialized(now.withColumn("place", F.col("place") + taken))])
        grown = frontier.unionByName(on.where(F.col("place") <= stop).select(*COLUMNS)).join(now.select("file"), "file", "left_anti")
        frontier, taken = materialized(first_of_each(grown)), taken + stop
    return united(crawled).select("file", "depth", "priority", "place")
