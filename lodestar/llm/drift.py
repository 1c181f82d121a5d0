"""Rewriting files whose schemas have drifted to one evolved schema (operator 13).

Rows meet twice by a partitioner of our own, each time sorted within the partition: first by ranges of the key (crc32 of the
id, the id, a hash of the row), which gives every row its rank from the partitions' counts; then by file number with the rank
as the secondary key, which streams each file from one task. The rewrite reads the drifted files' row groups apart from each
other, matches columns by Parquet field id, and deals the rows out by file number and rank again.

Ranges end at quantiles of a bounded sample of keys, so an id that holds many rows is cut by the rows' hashes, and copies of
one row by a salt. The driver sees that sample, a count a partition and the files' names, whose number is a parameter. Files
are written under names of their own and renamed, so a task that runs again leaves the same files; drifted files go only
after the table of all rewritten ones is committed.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import TimestampNTZType, TimestampType

from lodestar.llm.tables import partitions, shared_dir, written

FILES, GROUP_ROWS = 250, 50_000
#: Keys of the sample for each range, so that ranges of a like size come out; the driver sees so many keys a partition.
SAMPLED = 30
FILE_ID = b"PARQUET:field_id"
STARTED = "file_no long, version long, path string, columns string, groups array<long>"
REWRITTEN = "file_no long, path string, columns string"
RESULT = "file_no long, version long, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, start_columns string, columns string, path string, rewritten boolean"
#: A column of a file: field id, name, type.
Field = tuple[int, str, pa.DataType]


def version_of(file_no: int) -> int:
    found = zlib.crc32(f"19:{file_no}".encode()) % 24
    return 0 if found > 15 else found


def drifted(fields: list[Field], version: int) -> list[Field]:
    """The columns of a file of a version. Bits: 1 swaps the names of name and email, 2 turns the columns after the first
    round, 4 leaves nation_id and segment out, 8 has balance as float and nation_id as int."""
    out = list(fields)
    if version & 1:
        other = {"name": "email", "email": "name"}
        out = [(i, other.get(n, n), t) for i, n, t in out]
    if version & 4:
        out = [x for x in out if x[1] not in ("nation_id", "segment")]
    if version & 8:
        narrow = {"balance": pa.float32(), "nation_id": pa.int32()}
        out = [(i, n, narrow.get(n, t)) for i, n, t in out]
    return out[:1] + out[:0:-1] if version & 2 else out


def schema_of(fields: list[Field]) -> pa.Schema:
    return pa.schema([pa.field(n, t, True, {FILE_ID: str(i).encode()}) for i, n, t in fields])


def micros(c: Column, kind: object) -> Column:
    """Microseconds since 1970 in UTC; a time without a zone is taken as UTC, whatever the session's zone."""
    if isinstance(kind, TimestampType):
        return F.unix_micros(c)
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86_400_000_000 + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def keyed(df: DataFrame, id_col: str) -> DataFrame:
    """k0 to k4, the sort key, and v0, v1, ..., the values (times as microseconds)."""
    own = [F.col(f"`{c}`") for c in df.columns]
    key = F.col(f"`{id_col}`").cast("long")
    values = [micros(c, f.dataType) if isinstance(f.dataType, (TimestampType, TimestampNTZType)) else c for c, f in zip(own, df.schema, strict=True)]
    crc = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    keys = [crc, key.isNotNull().cast("int"), F.coalesce(key, F.lit(0)), F.xxhash64(*own), F.monotonically_increasing_id()]
    return df.select(*[c.alias(f"k{i}") for i, c in enumerate(keys)], *[c.alias(f"v{i}") for i, c in enumerate(values)])


def bounds_of(rows: DataFrame, n: int, parts: int) -> list[tuple]:
    """At most parts - 1 keys between ranges of a like number of rows, from SAMPLED keys a range chosen by hash."""
    share = min(1.0, SAMPLED * parts / n)
    sampled = rows.where((F.xxhash64("k3", "k4").bitwiseAND((1 << 32) - 1)) < int(share * (1 << 32)))
    keys = sorted(tuple(r) for r in sampled.select("k0", "k1", "k2", "k3", "k4").collect())
    return [keys[i * len(keys) // parts] for i in range(1, parts)] if keys else []


def ranked(rows: DataFrame, n: int) -> RDD:
    """(rank, values): rows in the order of their keys."""
    parts = partitions(rows.sparkSession)
    bounds = bounds_of(rows, n, parts)
    dealt = rows.rdd.map(lambda r: (tuple(r[:5]), tuple(r[5:]))).repartitionAndSortWithinPartitions(parts, lambda key: bisect_right(bounds, key))
    counts = dict(dealt.mapPartitionsWithIndex(lambda p, it: [(p, sum(1 for _ in it))]).collect())
    first, total = {}, 0
    for p in sorted(counts):
        first[p], total = total, total + counts[p]
    return dealt.mapPartitionsWithIndex(lambda p, it: ((first[p] + i, values) for i, (_, values) in enumerate(it)))


def opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(temporary: str, final: str) -> None:
    """Renames a finished file. One that another attempt has put there already has the same rows and stays."""
    files, old = opened(temporary)
    new = opened(final)[1]
    try:
        files.move(old, new)
    except OSError:
        if files.get_file_info(new).type == 0:
            raise
        files.delete_file(old)


def streamed(rows: Iterator[tuple], fields: list[Field], folder: str, name: str) -> tuple[str, list[int]]:
    """Writes one file from rows of values in the order of `fields`; its path and the row groups' sizes."""
    import pyarrow.parquet as pq

    temporary, final = f"{folder}/attempts/{uuid.uuid4().hex}.parquet", f"{folder}/data/{name}"
    files, path = opened(temporary)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    files.create_dir(opened(final)[1].rpartition("/")[0], recursive=True)
    schema, groups, held = schema_of(fields), [], []
    with files.open_output_stream(path) as out, pq.ParquetWriter(out, schema) as writer:
        for row in rows:
            held.append(row)
            if len(held) == GROUP_ROWS:
                groups.append(put_group(writer, schema, held))
                held = []
        if held:
            groups.append(put_group(writer, schema, held))
    put(temporary, final)
    return final, groups


def put_group(writer, schema: pa.Schema, rows: list[tuple]) -> int:
    columns = [pa.array(list(c)) if pa.types.is_null(f.type) else pa.array(list(c), pa.float64()).cast(f.type, safe=False) if pa.types.is_floating(f.type) else pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    writer.write_table(pa.Table.from_arrays(columns, schema=schema), row_group_size=GROUP_ROWS)
    return len(rows)


def dealt_by_file(rows: RDD, files: int, parts: int) -> RDD:
    """((file_no, rank), values) with each file's rows in one partition, in the order of rank."""
    return rows.repartitionAndSortWithinPartitions(parts, lambda key: key[0] * parts // files)


def fields_of(df: DataFrame, wider: dict[str, pa.DataType]) -> list[Field]:
    return [(i + 1, f.name, wider.get(f.name, to_arrow_type(f.dataType))) for i, f in enumerate(df.schema)]


def start(df: DataFrame, fields: list[Field], folder: str, id_col: str, files: int = FILES, versions: Callable[[int], int] = version_of, drift: Callable[[list[Field], int], list[Field]] = drifted) -> DataFrame:
    """STARTED: the drifted files below folder/data."""
    spark = df.sparkSession
    rows = keyed(df, id_col)
    n = df.count()
    if not n:
        return spark.createDataFrame([], STARTED)
    size = 1 + n // files
    last = (n - 1) // size + 1
    place = {i: k for k, (i, _, _) in enumerate(fields)}

    def write(it: Iterator[tuple]) -> Iterator[tuple]:
        for file_no, group in groupby(it, key=lambda x: x[0][0]):
            version = versions(file_no)
            own = drift(fields, version)
            take = [place[i] for i, _, _ in own]
            path, groups = streamed((tuple(values[k] for k in take) for _, values in group), own, folder, f"part-{file_no:05d}-start.parquet")
            yield file_no, version, path, ",".join(name for _, name, _ in own), groups

    placed = ranked(rows, n).map(lambda x: ((x[0] // size, x[0]), x[1]))
    return written(spark.createDataFrame(dealt_by_file(placed, last, min(last, 2 * partitions(spark))).mapPartitions(write), STARTED))


def rewrite(started: DataFrame, fields: list[Field], defaults: dict[str, object], folder: str) -> DataFrame:
    """REWRITTEN: an evolved file for each started file of a version other than 0; columns that a file lacks have their defaults (else null)."""
    spark = started.sparkSession
    old = started.where("version <> 0").select("file_no", "path", F.posexplode("groups").alias("group", "n"), "groups")
    pieces = old.select("file_no", "path", "group", F.aggregate(F.slice("groups", F.lit(1), F.col("group")), F.lit(0).cast("long"), lambda a, x: a + x).alias("first"))
    last = started.agg(F.max("file_no")).first()[0]
    if last is None:
        return spark.createDataFrame([], REWRITTEN)
    parts = min(last + 1, 2 * partitions(spark))

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        for file_no, path, group, first in it:
            files, at = opened(path)
            with files.open_input_file(at) as source:
                table = pq.ParquetFile(source).read_row_group(group)
            held = {int(f.metadata[FILE_ID]): table[k] for k, f in enumerate(table.schema)}
            columns = []
            for i, name, kind in fields:
                c = held[i].cast(kind) if i in held else pa.chunked_array([pa.array([defaults.get(name)] * table.num_rows, kind)])
                columns.append((c.cast(pa.int64()) if pa.types.is_timestamp(kind) else c).to_pylist())
            for k, values in enumerate(zip(*columns, strict=True)):
                yield (file_no, first + k), values

    def write(it: Iterator[tuple]) -> Iterator[tuple]:
        for file_no, group in groupby(it, key=lambda x: x[0][0]):
            yield file_no, streamed((values for _, values in group), fields, folder, f"part-{file_no:05d}-evolved.parquet")[0], ",".join(name for _, name, _ in fields)

    dealt = dealt_by_file(pieces.repartition(parts, "file_no", "group").rdd.mapPartitions(rows), last + 1, parts)
    return written(spark.createDataFrame(dealt.mapPartitions(write), REWRITTEN))


def text_of(values: list, kind: pa.DataType) -> list[str]:
    """Null as ?, times as microseconds, floating numbers as the floor of 2^20 times them (nan, inf and -inf as such)."""
    if pa.types.is_floating(kind):
        return ["?" if v is None else str(math.floor(1048576 * v)) if math.isfinite(v) else str(v) for v in values]
    return ["?" if v is None else str(v) for v in values]


def digested(files: DataFrame, id_col: str) -> DataFrame:
    """RESULT of files (file_no, version, start_columns, columns, path, rewritten), each read as a stream of batches."""
    spark = files.sparkSession

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        for file_no, version, before, columns, path, changed in it:
            ids, rows, n, nulls, joint = hashlib.sha256(), hashlib.sha256(), 0, 0, ("", "")
            store, at = opened(path)
            with store.open_input_file(at) as source:
                for batch in pq.ParquetFile(source).iter_batches(8192):
                    cells = [text_of((c.cast(pa.int64()) if pa.types.is_timestamp(c.type) else c).to_pylist(), c.type) for c in batch.columns]
                    ids.update((joint[0] + ",".join(cells[batch.schema.get_field_index(id_col)])).encode())
                    rows.update((joint[1] + "\n".join(map("|".join, zip(*cells, strict=True)))).encode())
                    n, nulls, joint = n + batch.num_rows, nulls + sum(c.null_count for c in batch.columns), (",", "\n")
            yield file_no, version, n, nulls, ids.hexdigest(), rows.hexdigest(), before, columns, path, changed

    return spark.createDataFrame(files.repartition(2 * partitions(spark), "file_no").rdd.mapPartitions(run), RESULT)


def evolve(df: DataFrame, id_col: str = "client_id", wider: dict[str, pa.DataType] | None = None, defaults: dict[str, object] | None = None, files: int = FILES) -> DataFrame:
    """RESULT: writes df's rows to at most `files` files that drift (start()), rewrites those of a version other than 0
    to the evolved schema (df's columns, nullable, of the types in `wider`, with field ids from 1), and reads all files back.

    The folder is a new one in the shared folder; its data folder holds one file for each file_no in the end. Rows go by
    crc32 of the decimal id, then the id; a null id has the crc32 of no text and goes before an id of that crc32. Rows of
    one id are in the order of a hash of all their columns; equal rows are all kept. Further columns are columns of the files
    with ids of their own. An empty table gives no files and no rows.
    """
    folder = shared_dir(df.sparkSession)
    fields = fields_of(df, wider or {})
    started = start(df, fields, folder, id_col, files)
    rewritten = rewrite(started, fields, defaults or {}, folder)
    for r in started.where("version <> 0").select("path").collect():  # at most `files` names
        store, at = opened(r["path"])
        store.delete_file(at)
    if not started.isEmpty():
        store, at = opened(f"{folder}/attempts")
        store.delete_dir(at)
    new = rewritten.select("file_no", F.col("path").alias("new_path"), F.col("columns").alias("new_columns"))
    final = started.join(new, "file_no", "left").select("file_no", "version", F.col("columns").alias("start_columns"), F.coalesce("new_columns", "columns").alias("columns"), F.coalesce("new_path", "path").alias("path"), F.col("new_path").isNotNull().alias("rewritten"))
    return digested(final, id_col)
