"""WARC archives written and read through an index (operator 3).

Payload digests come first, so each record's kind is known before it is written. Every task writes archives of its own
in the shared folder (one gzip member a record) and returns an index row for each record: file, offset, length, URL,
digest. The index is a table that Spark commits, so archives of failed or repeated tasks are never read. Reading sorts
the wanted index rows by file and offset and fetches neighbouring ranges together.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.tables import partitions, shared_dir, written

FILE_BYTES, READ_BYTES, GAP_BYTES = 256_000_000, 8_000_000, 64_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # fixed, so that equal input gives equal archives
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def kinds(df: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """id, url, payload and digest of each row, and the id that it revisits or null."""
    source = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    marked = source.withColumn("digest", F.sha1("payload"))
    groups = marked.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = marked.join(written(groups.select("digest", "keeper")).hint("merge"), "digest", "left")  # groups grow with the input: never broadcast
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))).drop("keeper")


def identity(page_id: int | None) -> str:
    return f"<urn:x-page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {identity(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~{}|^`\\\"<>-._"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {identity(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000, folder: str | None = None) -> DataFrame:
    """Writes a record per row to archives in `folder` (a new one in the shared folder by default) and returns the index.

    Of rows with equal payloads of at least least_bytes the one of largest id is a response and the others revisit it;
    rows that share that id are all responses. A null payload counts as empty, a null id is never referred to, a null
    URL is left out of its record. Other columns are left out. An empty table gives no archive and an empty index.
    """
    target = folder or shared_dir(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(target)
        files.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for whole in batches:
                for begin in range(0, whole.num_rows, 1000):
                    rows = []
                    for r in whole.slice(begin, 1000).to_pylist():
                        if out is None or at >= FILE_BYTES:
                            if out is not None:
                                out.close()
                            name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                            out = files.open_output_stream(f"{path}/{name}", compression=None)
                        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                        data = packer.compress(record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"])) + packer.flush()
                        out.write(data)
                        rows.append((f"{target}/{name}", at, len(data), r["page_id"], r["url"], r["digest"], "response" if r["refers_to"] is None else "revisit"))
                        at += len(data)
                    if rows:
                        kinds_ = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds_, strict=True)], names=["file", "offset", "length", "page_id", "url", "digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    return written(kinds(df, id_col, url_col, payload_col, least_bytes).mapInArrow(run, INDEX))


def parsed(data: bytes) -> dict:
    """The fields of one record; the payload is None for a revisit."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page = re.fullmatch(r"<urn:x-page:(-?\d+)>", fields["WARC-Record-ID"])
    to = re.fullmatch(r"<urn:x-page:(-?\d+)>", fields.get("WARC-Refers-To", ""))
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']}: the payload is not the one that was written")
    return {"page_id": int(page[1]) if page else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": int(to[1]) if to else None, "payload": payload if kind == "response" else None}


def ranges(rows: list[dict]) -> Iterator[list[dict]]:
    """Runs of index rows, sorted by file and offset, that one read fetches."""
    run: list[dict] = []
    for r in rows:
        if run and (r["file"] != run[0]["file"] or r["offset"] - (run[-1]["offset"] + run[-1]["length"]) > GAP_BYTES or r["offset"] + r["length"] - run[0]["offset"] > READ_BYTES):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def read(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row of RECORDS for each index row, from the archives; url is the index's. An empty index gives no rows.

    Every response's payload is held against its digest; a record that differs is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        last, source = None, None
        for batch in batches:
            for group in ranges(batch.to_pylist()):
                if group[0]["file"] != last:
                    if source is not None:
                        source.close()
                    last = group[0]["file"]
                    files, path = fs.FileSystem.from_uri(last)
                    source = files.open_input_file(path)
                begin = group[0]["offset"]
                data = source.read_at(group[-1]["offset"] + group[-1]["length"] - begin, begin)
                rows = [parsed(data[r["offset"] - begin : r["offset"] - begin + r["length"]]) | {"url": r["url"]} for r in group]
                yield pa.RecordBatch.from_pylist([r if with_payload else r | {"payload": None} for r in rows], schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]))
        if source is not None:
            source.close()

    n = 2 * partitions(index.sparkSession)
    return index.select("file", "offset", "length", "url").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, RECORDS)
