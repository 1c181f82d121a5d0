"""Merkle manifests of a table (operator 12).

Leaves are hashed in the JVM, so texts never move. Each leaf's place in its group comes from a range partitioning by
(group, order) and counts of each partition's rows. Leaves then meet in aligned blocks of BLOCK places, one row a block that
holds their digests as one contiguous matrix of 64-byte hex rows; a block is folded by reshaping FANOUT rows into one and
hashing rows, level by level. The blocks' roots are the leaves of the next, 512 times smaller table, until every group has
one node; the groups' roots go the same way under one root. On the way down each block gets what stands above it: for every
level the siblings to the left and to the right of its node. Siblings inside the block are found by index arithmetic. So no
task holds more than a block's leaves and one path, and a group of any size is many blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.tables import partitions, written

FANOUT, HEIGHT, WIDTH = 8, 3, 64
BLOCK = FANOUT**HEIGHT
BLOCKS = "g string, b long, total long, ids array<long>, leaves binary, given binary"
NODES = "g string, i long, total long, digest string"
PATHS = "g string, i long, lefts array<string>, rights array<string>, top string"
MANIFEST = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def field(c: Column) -> Column:
    """A value as its length in UTF-8 bytes, a colon and itself; null as a dash."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def ranked(nodes: DataFrame, order: list[str], parts: int) -> DataFrame:
    """Adds i, each row's place in its group g by `order` (from 0), and total, the group's size."""
    dealt = written(nodes.repartitionByRange(parts, "g", *order).sortWithinPartitions("g", *order).withColumn("at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    runs = dealt.groupBy("part", "g").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("part", "g", "first", before.alias("before"), F.sum("n").over(group).alias("total"))
    return dealt.join(runs, ["part", "g"]).select(*nodes.columns, (F.col("at") - F.col("first") + F.col("before")).alias("i"), "total")


def matrix(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, WIDTH)


def raised(level: np.ndarray) -> np.ndarray:
    """The next level: a digest for every FANOUT rows, and one for those that are left."""
    full = len(level) // FANOUT
    out = [hashlib.sha256(row).hexdigest() for row in level[: full * FANOUT].reshape(full, FANOUT * WIDTH)]
    if len(level) > full * FANOUT:
        out.append(hashlib.sha256(level[full * FANOUT :].tobytes()).hexdigest())
    return matrix("".join(out).encode())


def levels(leaves: np.ndarray, total: int) -> list[np.ndarray]:
    """The block's levels, its root last. A group of one block ends where one node is left; a larger one takes all HEIGHT."""
    out = [leaves]
    while total > 1 and len(out) <= HEIGHT:
        out.append(raised(out[-1]))
        total = -(-total // FANOUT)
    return out


def siblings(level: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node its run's others in order (the row's first `count` places), how many are to its left, and count."""
    start = nodes - nodes % FANOUT
    own, count = nodes - start, np.minimum(FANOUT, len(level) - start) - 1
    k = np.arange(FANOUT - 1)
    return level[np.minimum(start[:, None] + k + (k >= own[:, None]), len(level) - 1)], own, count


def blocked(nodes: DataFrame) -> DataFrame:
    """BLOCKS of nodes (g, i, total, digest; at the bottom also id and given)."""
    bottom = "given" in nodes.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        text = lambda name: "".join(table[name].to_pylist()).encode() if name in table.column_names else None
        row = (table["g"][0].as_py(), table["i"][0].as_py() // BLOCK, table["total"][0].as_py(), table["id"].to_pylist() if bottom else None, text("digest"), text("given"))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
        return pa.table([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["g", "b", "total", "ids", "leaves", "given"])

    keyed = nodes.select("g", "i", "total", "digest", *(["id", "given"] if bottom else []), F.expr(f"i div {BLOCK}").alias("b"))
    return written(keyed.groupBy("g", "b").applyInArrow(run, BLOCKS))


def block_roots(blocks: DataFrame) -> DataFrame:
    """NODES: the block's roots as the next table's leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["g"], r["b"], -(-r["total"] // BLOCK), levels(matrix(r["leaves"]), r["total"])[-1].tobytes().decode()) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["g", "i", "total", "digest"]) if rows else batch_of(NODES)

    return written(blocks.select("g", "b", "total", "leaves").mapInArrow(run, NODES))


def batch_of(schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([], kinds[k]) for _, k in fields], names=[n for n, _ in fields])


def paths(nodes: DataFrame) -> DataFrame:
    """PATHS of nodes (NODES): for each level above a node the digests to its left and right, and its group's root."""
    tallest = nodes.agg(F.max("total")).first()[0]
    none = F.array().cast("array<string>")
    if tallest is None or tallest == 1:
        return nodes.select("g", "i", none.alias("lefts"), none.alias("rights"), F.col("digest").alias("top"))
    blocks = blocked(nodes)
    above = paths(block_roots(blocks)).withColumnRenamed("i", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tree = levels(matrix(r["leaves"]), r["total"])
                n = len(tree[0])
                lefts, rights = [[] for _ in range(n)], [[] for _ in range(n)]
                for k, level in enumerate(tree[:-1]):
                    others, own, count = siblings(level, np.arange(n) // FANOUT**k)
                    for j in range(n):
                        lefts[j].append(others[j, : own[j]].tobytes().decode())
                        rights[j].append(others[j, own[j] : count[j]].tobytes().decode())
                columns = ([r["g"]] * n, range(r["b"] * BLOCK, r["b"] * BLOCK + n), [x + r["lefts"] for x in lefts], [x + r["rights"] for x in rights], [r["top"]] * n)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, batch_of(PATHS).schema, strict=True)], schema=batch_of(PATHS).schema)

    return blocks.join(above, ["g", "b"]).select("g", "b", "total", "leaves", "lefts", "rights", "top").mapInArrow(run, PATHS)


def folded(row: dict, batch: list[np.ndarray]) -> Iterator[tuple]:
    """MANIFEST rows of a block: batch is its levels, row also has what stands above."""
    n, given = len(batch[0]), matrix(row["given"])
    inside = [siblings(level, np.arange(n) // FANOUT**k) for k, level in enumerate(batch[:-1])]
    above = "".join(a + b for a, b in zip(row["lefts"], row["rights"], strict=True)).encode()
    for j in range(n):
        proof, digest = hashlib.sha256(), given[j].tobytes()
        for others, own, count in inside:
            left, right = others[j, : own[j]].tobytes(), others[j, own[j] : count[j]].tobytes()
            proof.update(left)
            proof.update(right)
            digest = hashlib.sha256(left + digest + right).hexdigest().encode()
        proof.update(above)
        for left, right in zip(row["lefts"], row["rights"], strict=True):
            digest = hashlib.sha256(left.encode() + digest + right.encode()).hexdigest().encode()
        found = digest.decode()
        yield row["ids"][j], batch[0][j].tobytes().decode(), row["subroot"], row["root"], proof.hexdigest(), found, found == row["root"]


def manifest(df: DataFrame, fields: list[Column], given: list[Column] | None = None, id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """One row per row (MANIFEST, with id named id_col): its leaf, its group's and the table's root, the digest of its proof,
    and the root that folding its leaf over `given` (by default the fields themselves) with the proof gives.

    Leaves of a group ascend by id (null first; rows of one id by leaf), groups by UTF-8 bytes, null first (it is a group
    of its own). Equal rows are leaves of their own. Null and empty values differ. Other columns are left out. An empty
    table gives no rows.
    """
    own = leaf(*fields)
    source = df.select(F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("g"), F.col(id_col).cast("long").alias("id"), own.alias("digest"), (leaf(*given) if given else own).alias("given"))
    parts = partitions(df.sparkSession)
    blocks = blocked(ranked(source, ["id", "digest"], parts))
    above = written(paths(block_roots(blocks)).withColumnRenamed("i", "b").withColumnRenamed("top", "subroot"))
    groups = written(ranked(above.where("b = 0").select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("subroot").alias("digest")), ["name"], parts))
    tops = paths(groups.select("g", "i", "total", "digest")).select("i", F.col("lefts").alias("more_lefts"), F.col("rights").alias("more_rights"), F.col("top").alias("root"))
    tops = groups.select(F.col("name").alias("g"), "i").join(tops, "i").drop("i")
    held = above.join(tops, "g").select("g", "b", F.concat("lefts", "more_lefts").alias("lefts"), F.concat("rights", "more_rights").alias("rights"), "subroot", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = batch_of(MANIFEST).schema
        for batch in batches:
            for r in batch.to_pylist():
                columns = zip(*folded(r, levels(matrix(r["leaves"]), r["total"])), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return blocks.join(held, ["g", "b"]).mapInArrow(run, MANIFEST).withColumnRenamed("id", id_col)
