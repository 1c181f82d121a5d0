"""LSIF files as a data source: `spark.read.format("lsif")` and `df.write.format("lsif")`.

Reading splits each file into ranges of bytes, one task each: a range gives the lines that begin in it, so one large file is
read by many tasks. Writing gives a file a task, named by its first line's number, once all tasks have succeeded; files of
tasks that failed are deleted. Numbered lines (formats.numbered) that are sorted by range so come out in order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SPLIT_BYTES = 16_000_000
READ_BYTES, LINE_BYTES = 1 << 20, 1 << 12


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    name: str
    first: int
    lines: int


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def listed(uri: str) -> list[tuple[str, int]]:
    """Files with their sizes: the one at the place, or those right below it whose names begin with neither . nor _."""
    from pyarrow import fs

    files, path = _open(uri)
    info = files.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(uri, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [f for f in files.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
    return [(f"{uri.rstrip('/')}/{f.base_name}", f.size) for f in sorted(found, key=lambda f: f.base_name)]


def lines_of(path: str, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(place of its first byte, line) of the lines that begin in start to end; a line ends at a line feed."""
    files, at = _open(path)
    with files.open_input_file(at) as f:
        # A line that begins at `start` follows the byte before; any other that reaches it belongs to the range before.
        place = max(start - 1, 0)
        f.seek(place)
        held, skip = b"", start > 0
        while True:
            # Beyond the end only the rest of a line is needed; a long one is read in parts that grow.
            data = f.read(min(READ_BYTES, max(end - place - len(held), LINE_BYTES, len(held))))
            held += data
            lines = held.split(b"\n")
            held = lines.pop() if data else b""
            if not data and lines == [b""]:
                return
            for line in lines:
                if skip:
                    skip = False
                elif place >= end:
                    return
                else:
                    yield place, line.decode()
                place += len(line) + 1
            if not data:
                return


class LsifReader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        out = [Range(p, at, min(at + self.size, total)) for p, total in listed(self.path) for at in range(0, total, self.size)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.path:
            name = partition.path.rsplit("/", 1)[-1]
            for place, line in lines_of(partition.path, partition.start, partition.end):
                yield name, place, line


class LsifWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        name = f"_{self.job}-{uuid.uuid4().hex}"
        files, path = _open(f"{self.path}/{name}")
        files.create_dir(path.rpartition("/")[0], recursive=True)
        first, n = -1, 0
        with files.open_output_stream(path) as out:
            for row in iterator:
                first = row["n"] if first < 0 else first
                out.write(row["value"].encode() + b"\n")
                n += 1
        return Written(name, first, n)

    def commit(self, messages: list[Written]) -> None:
        files, folder = _open(self.path)
        old = [p.rsplit("/", 1)[-1] for p, _ in listed(self.path)]
        if old and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path} holds files already")
        for name in old:
            files.delete_file(f"{folder}/{name}")
        for m in messages:
            if m is not None and m.lines:
                files.move(f"{folder}/{m.name}", f"{folder}/part-{m.first:020d}.lsif")
            elif m is not None:
                files.delete_file(f"{folder}/{m.name}")
        self._clean()

    def abort(self, messages: list[Written]) -> None:
        self._clean()

    def _clean(self) -> None:
        """Deletes what attempts that don't count have left."""
        from pyarrow import fs

        files, folder = _open(self.path)
        for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.job}-"):
                files.delete_file(f.path)


class LsifSource(DataSource):
    """Options: path, and for reading split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "lsif"

    def schema(self) -> str:
        return "file string, place long, value string"

    def reader(self, schema) -> LsifReader:
        return LsifReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> LsifWriter:
        return LsifWriter(self.options["path"], overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session, in which the format is known."""
    spark.dataSource.register(LsifSource)
    return spark


def read_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, place, value of the lines of a file or of the files right below a folder."""
    return registered(spark).read.format("lsif").option("split_bytes", split_bytes).load(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes numbered lines (n, value) as files in the order of n, in place of what the folder holds."""
    registered(lines.sparkSession)
    lines.repartitionByRange("n").sortWithinPartitions("n").select("n", "value").write.format("lsif").mode("overwrite").save(path)
