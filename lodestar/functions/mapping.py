"""User functions over symbols and files: batches of rows in Arrow, from which each row's result comes back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Row = dict


def _type(ddl: str) -> T.DataType:
    return T.StructType.fromDDL(f"x {ddl}")["x"].dataType


def process_chunked(df: DataFrame, f: Callable[[list[Row]], list], result: str, chunk: int = 1000) -> DataFrame:
    """df with a column `result` of that type: f gets the rows in lists of at most `chunk` and gives a value for each."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(_type(result), prefers_large_types=False)
    schema = T.StructType([*df.schema.fields, T.StructField("result", _type(result))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                own = batch.slice(at, chunk)
                values = f(own.to_pylist())
                if len(values) != own.num_rows:
                    raise ValueError(f"{len(values)} results for {own.num_rows} rows")
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(values, kind)], names=[*own.schema.names, "result"])

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, f: Callable[[Row], object], result: str) -> DataFrame:
    """df with a column `result`: f of each row."""
    return process_chunked(df, lambda rows: [f(r) for r in rows], result)


def filter_map(df: DataFrame, f: Callable[[Row], object], result: str) -> DataFrame:
    """Like map_rows, without the rows for which f gives None."""
    return map_rows(df, f, result).where("result is not null")


def map_conditional(df: DataFrame, condition: Column, f: Callable[[Row], object], result: str) -> DataFrame:
    """Like map_rows for the rows that fulfil the condition; the others have a null result and are never sent to Python."""
    holds = F.coalesce(condition, F.lit(False))
    return map_rows(df.where(holds), f, result).unionByName(df.where(~holds).withColumn("result", F.lit(None).cast(result)))


def process_files(files: DataFrame, f: Callable[[str, str], object], result: str) -> DataFrame:
    """path, result, error of files (path, content): f of path and content, or the text of the exception that it raised."""

    def one(r: Row) -> dict:
        try:
            return {"result": f(r["path"], r["content"]), "error": None}
        except Exception as e:  # a file that can't be read isn't the others' end
            return {"result": None, "error": f"{type(e).__name__}: {e}"}

    return map_rows(files.select("path", "content"), one, f"struct<result: {result}, error: string>").select("path", "result.result", "result.error")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative to the folder), content of all files below it; bytes that are no UTF-8 are replaced."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/")
    return found.select(F.regexp_replace(F.substring_index("path", f"{root}/", -1), "^file:/*", "").alias("path"), F.col("content").cast("string").alias("content"))
