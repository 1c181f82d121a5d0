"""Cutting lineage between the rounds of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession) -> str:
    """A new folder's name below the one that spark.checkpoint.dir names (a local one where it is unset and the master is local)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """The rows as a table in a new folder."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of narrow tables that are sent to all tasks rather than that the other side is shuffled.
NEAR_ROWS = 500_000


def near(table: DataFrame) -> DataFrame:
    """A table of files, to be broadcast in joins if it has few rows (the files' footers tell)."""
    return F.broadcast(table) if table.count() <= NEAR_ROWS else table
