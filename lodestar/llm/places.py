"""Rows by their place in the files that they are read from, and marks of places that each task looks up for its own files.

A decision about a row so goes back to it without moving its text and without a broadcast: the marks of a file are bits by row
number in the shared folder, BLOCK rows a file of marks, and the task that reads a file's rows reads its marks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.tables import shared_dir, written

BLOCK = 1 << 20


def from_files(df: DataFrame) -> DataFrame:
    """The frame itself if its rows come straight from files, else the table of its rows."""
    try:
        df.select(df.metadataColumn("_metadata")["row_index"], df.metadataColumn("_metadata")["file_path"])
        return df
    except AnalysisException:
        return written(df)


def placed(df: DataFrame, file: str = "f", row: str = "i") -> DataFrame:
    """Adds a hash of the file's path and the row's number in it, of a frame that from_files() gives."""
    meta = df.metadataColumn("_metadata")
    return df.select("*", F.xxhash64(meta["file_path"]).alias(file), meta["row_index"].alias(row))


def name_of(file: int, block: int) -> str:
    return f"{file & (1 << 64) - 1:016x}-{block}.bits"


def marked(places: DataFrame) -> str:
    """The folder of the marks of some places (f, i). A task writes the marks of one block of a file at a time."""
    spark = places.sparkSession
    folder = shared_dir(spark)

    def write(table: pa.Table) -> pa.Table:
        from pyarrow import fs

        file, rows = table["f"][0].as_py(), table["i"].to_numpy()
        bits = np.zeros(BLOCK, bool)
        bits[rows % BLOCK] = True
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        own = f"{path}/{uuid.uuid4().hex}.part"
        with files.open_output_stream(own) as out:
            out.write(np.packbits(bits[: int(rows.max() % BLOCK) + 1]).tobytes())
        final = f"{path}/{name_of(file, int(rows[0]) // BLOCK)}"
        try:
            files.move(own, final)
        except OSError:  # another attempt has put the same marks there
            if files.get_file_info(final).type == fs.FileType.NotFound:
                raise
        return pa.table({"n": pa.array([len(rows)], pa.int64())})

    keyed = places.select("f", "i", F.expr(f"i div {BLOCK}").alias("b"))
    keyed.groupBy("f", "b").applyInArrow(write, "n long").agg(F.count(F.lit(1))).collect()  # one row
    return folder


def _looked_up(df: DataFrame, folder: str, wanted: bool, keep_places: bool) -> DataFrame:
    at = len(df.columns)
    names = [f"c{k}" for k in range(at)]
    full = placed(df.toDF(*names)) if not keep_places else df
    if keep_places:
        at -= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder)
        last, bits = None, None
        for batch in batches:
            file, row = batch.column(at).to_numpy(zero_copy_only=False), batch.column(at + 1).to_numpy(zero_copy_only=False)
            keep = np.zeros(batch.num_rows, bool)
            edge = np.flatnonzero((file[1:] != file[:-1]) | (row[1:] // BLOCK != row[:-1] // BLOCK)) + 1
            for own in np.split(np.arange(batch.num_rows), edge):
                if not len(own):
                    continue
                key = int(file[own[0]]), int(row[own[0]]) // BLOCK
                if key != last:
                    last, where = key, f"{path}/{name_of(*key)}"
                    there = files.get_file_info(where).type == fs.FileType.File
                    bits = np.unpackbits(np.frombuffer(files.open_input_file(where).read(), np.uint8)).astype(bool) if there else np.zeros(0, bool)
                place = row[own] % BLOCK
                hit = np.zeros(len(own), bool)
                inside = place < len(bits)
                hit[inside] = bits[place[inside]]
                keep[own] = hit == wanted
            out = batch.filter(pa.array(keep))
            yield out if keep_places else out.select(list(range(at)))

    kinds = full.schema if keep_places else full.schema[:at]
    found = full.mapInArrow(run, kinds)
    return found if keep_places else found.toDF(*df.columns)


def without(df: DataFrame, folder: str) -> DataFrame:
    """The rows of a frame that from_files() gives whose places aren't marked."""
    return _looked_up(df, folder, False, False)


def picked(rows: DataFrame, folder: str) -> DataFrame:
    """The marked ones of rows whose last two columns are f and i."""
    return _looked_up(rows, folder, True, True)


#: Rows of a file that one of Spark's bitmaps covers.
BITMAP = 1 << 15


def apart(df: DataFrame, gone: DataFrame) -> DataFrame:
    """What without() gives, for places (f, i) as they are and by DataFrame functions only: all tasks get a bitmap of 4 KB
    for each BITMAP rows of a file of which some are gone, so a thousandth of a share of what rows of text take."""
    names = [f"c{k}" for k in range(len(df.columns))]
    bitmaps = gone.groupBy(F.col("f").alias("__f"), F.expr(f"i div {BITMAP}").alias("__b")).agg(F.bitmap_construct_agg(F.col("i") % BITMAP).alias("__bits"))
    rows = placed(df.toDF(*names), "__file", "__row")
    at = F.col("__row") % BITMAP
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8) + 1, F.lit(1))), 16, 10).cast("int")
    hit = (F.col("__f") == F.col("__file")) & (F.col("__b") == F.expr(f"__row div {BITMAP}")) & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return rows.join(F.broadcast(bitmaps), hit, "left_anti").select(*names).toDF(*df.columns)


def discarded(df: DataFrame, folder: str) -> None:
    """Deletes marks that nothing reads any more."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
