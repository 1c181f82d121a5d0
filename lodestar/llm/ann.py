"""Approximate nearest neighbours by multiprobe p-stable hashing (operator 10).

Vectors are scaled to length 1, so the largest cosine is the smallest distance. Each of TABLES tables hashes a vector by
some projections on normal (2-stable) directions, each cut into cells of one width. A query visits, in each table, its own
cell and the perturbed ones (a cell up or down in some projections) in the order of their estimated success: the sum of
the squared distances to the cell walls that are crossed. In a cell the cosines of all its vectors are computed, the best
ones again exactly, and the tables' results merge into the answer. A query that finds too few is held against all rows.

Settings are fitted on a bounded sample: QUERIES of the queries are held against all rows, and ROWS rows tell what share of
the table a query visits. The number of projections is tried from the logarithm of the number of rows downward, each with
the least number of probes, MOST_PROBES at most, that finds RECALL of the sample's neighbours; the setting that visits least
counts. Where no setting finds so many, all queries are held against all rows, in blocks. All rows are indexed and all
queries asked. The settings with their recall are logged.

Index rows and probes meet by cell. A cell with many vectors is dealt out by vector id and its probes go to each part; a
query's vector goes to a task once, with the list of the cells that it visits there.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.hashing import mixed
from lodestar.llm.memory import released, tidy
from lodestar.llm.tables import partitions, written

log = logging.getLogger(__name__)
TABLES, SEED, PART = 8, 20, 4000
#: So many numbers of projections are tried at least, and fewer and fewer projections until RECALL is met.
TRIED = 4
#: MOST_PROBES: cells of a table that a query visits at most. It doesn't grow with the rows, so probes grow with the queries only.
QUERIES, ROWS, RECALL, MOST_PROBES = 100, 2000, 0.95, 40
U = np.uint64
CELLS = "cell long, id long, size int"


@dataclass(frozen=True)
class Settings:
    """hashes: projections of a table; recall and share: of the sample."""

    hashes: int = 6
    width: float = 2.0
    probes: int = 60
    recall: float = 0.0
    share: float = 1.0


def directions(table: int, size: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, table, size])
    return rng.normal(size=(hashes, size)).T, rng.uniform(0, 1, hashes) * width


def perturbed(hashes: int) -> np.ndarray:
    """Steps in at most 4 projections (3 if there are more than 10), none first."""
    out = [np.zeros((1, hashes), np.int8)]
    for k in range(1, min(hashes, 4 if hashes <= 10 else 3) + 1):
        at, signs = np.array(list(combinations(range(hashes), k))), np.array(list(product((-1, 1), repeat=k)), np.int8)
        block = np.zeros((len(at), len(signs), hashes), np.int8)
        np.put_along_axis(block, np.broadcast_to(at[:, None, :], (len(at), len(signs), k)), np.broadcast_to(signs, (len(at), len(signs), k)), 2)
        out.append(block.reshape(-1, hashes))
    return np.concatenate(out)


def key(cells: np.ndarray, table: int, size: int) -> np.ndarray:
    """One long for the table, the vectors' size and the cell's coordinates."""
    h = np.full(cells.shape[:-1], size << 16 | table, U)
    for i in range(cells.shape[-1]):
        h = mixed(h ^ cells[..., i].astype(np.int64).view(U))
    return h.view(np.int64)


def by_size(vectors: list) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """Usable vectors by their number of components: places and the matrix, each row divided by a power of two so that its
    largest component is between 1/2 and 1 (no square overflows, and cosines stay what they are)."""
    groups: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v is not None and len(v) and all(x is not None for x in v):
            groups.setdefault(len(v), []).append(i)
    for size, at in groups.items():
        x = np.array([vectors[i] for i in at], np.float64)
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if good.any():
            x = x[good]
            _, power = np.frexp(np.abs(x).max(axis=1))
            half = power // 2  # in two steps, as 2^-power itself may not be finite
            yield size, [i for i, g in zip(at, good, strict=True) if g], np.ldexp(np.ldexp(x, -half[:, None]), (half - power)[:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def places(x: np.ndarray, table: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Cells of unit vectors, and how far above its cell's lower wall each projection is."""
    a, b = directions(table, x.shape[1], s.hashes, s.width)
    f = (x @ a + b) / s.width
    cell = np.floor(f)
    return cell.astype(np.int64), (f - cell) * s.width


def probed(x: np.ndarray, table: int, s: Settings, steps: np.ndarray) -> np.ndarray:
    """Keys of the visited cells of unit vectors, the likeliest first: a row for each vector."""
    out = []
    for at in range(0, len(x), 200):
        cell, low = places(x[at : at + 200], table, s)
        cost = np.stack([low**2, np.zeros_like(low), (s.width - low) ** 2], axis=-1)
        score = sum(cost[:, i, steps[:, i] + 1] for i in range(s.hashes))
        order = np.argsort(score, axis=1, kind="stable")[:, : s.probes]
        out.append(key(cell[:, None, :] + steps[order], table, x.shape[1]))
    return np.concatenate(out)


def hashed(df: DataFrame, s: Settings, kind: str, asking: bool) -> DataFrame:
    """Of every usable vector a row for its cell in each table with the vector (as bytes of kind), or, asking, a row for
    each visited cell without it."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = perturbed(s.hashes)
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for size, at, x in by_size(batch.column(1).to_pylist()):
                    u, rows = unit(x), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())
                    for t in range(TABLES):
                        visited = probed(u, t, s, steps) if asking else key(places(u, t, s)[0], t, size)[:, None]
                        own = np.repeat(np.arange(len(at)), visited.shape[1])
                        columns = [pa.array(visited.ravel(), pa.int64()), pa.array(ids[at][own], pa.int64()), pa.array(np.full(len(own), size), pa.int32())]
                        if asking:
                            yield pa.RecordBatch.from_arrays(columns, names=["cell", "id", "size"])
                        else:
                            yield pa.RecordBatch.from_arrays([*columns, rows, pa.array(np.full(len(own), t), pa.int32())], names=["cell", "id", "size", "vec", "tab"])

    return df.mapInArrow(run, CELLS if asking else f"{CELLS}, vec binary, tab int")


def usable(df: DataFrame, kind: str) -> DataFrame:
    """id, size, vec (bytes of kind) of the usable vectors."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for size, at, x in by_size(batch.column(1).to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array([size] * len(at), pa.int32()), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())], names=["id", "size", "vec"])

    return df.mapInArrow(run, "id long, size int, vec binary")


def matrix(column: pa.ChunkedArray | pa.Array | list, kind: str, size: int) -> np.ndarray:
    values = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(-1, size).astype(np.float64)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The cosine of a row with each of x, all summed in the same order, so that equal vectors get equal scores."""
    dot, a, b = np.zeros(len(x)), np.float64(0), np.zeros(len(x))
    for d in range(len(q)):
        dot += q[d] * x[:, d]
        a += q[d] * q[d]
        b += x[:, d] * x[:, d]
    return np.clip(dot / (np.sqrt(a) * np.sqrt(b)), -1.0, 1.0)


def best_of(q: np.ndarray, own: int, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, near: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The k largest exact cosines among the rows of x that have other ids, ties to the smaller id. near: the rows' cosines
    but for rounding; a row may come up once for each table."""
    many = (TABLES + 1) * (k + 1)
    at = np.flatnonzero(near >= np.partition(near, len(near) - many)[len(near) - many] - 1e-9) if len(near) > many else np.arange(len(near))
    at = at[ids[rows[at]] != own]
    if len(at) < len(near) and len(np.unique(ids[rows[at]])) < k:  # rows of one id crowd out others
        at = np.flatnonzero(ids[rows] != own)
    at = rows[at]
    _, first = np.unique(ids[at], return_index=True)
    alone = at[first] if len(first) < len(at) and (x[at] == x[at[first]][np.searchsorted(ids[at[first]], ids[at])]).all() else at
    score = cosines(q, x[alone])
    out: dict[int, float] = {}
    for i in np.lexsort((ids[alone], -score)).tolist():
        out.setdefault(int(ids[alone[i]]), float(score[i]))
        if len(out) == k:
            break
    return list(out.items())


def meeting(index: DataFrame, asked: DataFrame, queries: DataFrame, k: int, bins: int, kind: str) -> DataFrame:
    """query_id, vec_id, score: the k best of each query in each bin of slots. index: slot, id, size, vec; asked: slot, id,
    size; queries: id, size, vec."""
    bin_of = F.pmod(F.xxhash64("slot"), F.lit(bins))
    lists = asked.groupBy(bin_of.alias("bin"), "id", "size").agg(F.collect_list("slot").alias("slots"))  # at most what one query visits
    sent = lists.join(queries, ["id", "size"]).select("bin", "id", "size", "slots", "vec")

    def meet(found: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        sizes, asked_sizes = (t.column("size").to_numpy() for t in (found, asking))
        for size in np.intersect1d(sizes, asked_sizes).tolist():
            own, some = (t.filter(pa.array(n == size)) for t, n in ((found, sizes), (asking, asked_sizes)))
            order = np.argsort(own.column("slot").to_numpy(), kind="stable")
            slot, ids = own.column("slot").to_numpy()[order], own.column("id").to_numpy()[order]
            x = matrix(own.column("vec").take(pa.array(order, pa.int64())), kind, size)
            u, q = unit(x), matrix(some.column("vec"), kind, size)
            first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            slots, last = slot[first], np.append(first[1:], len(slot))
            for asker, v, uv, wanted in zip(some.column("id").to_pylist(), q, unit(q), some.column("slots").to_pylist(), strict=True):
                wanted = np.unique(np.array(wanted, np.int64))
                at = np.minimum(np.searchsorted(slots, wanted), len(slots) - 1)
                at = at[slots[at] == wanted]
                n = last[at] - first[at]
                rows = np.arange(n.sum()) + np.repeat(first[at] - np.cumsum(n) + n, n)  # all rows of the cells
                if len(rows):
                    out += [(asker, i, score) for i, score in best_of(v, asker, x, ids, rows, u[rows] @ uv, k)]
        if found.num_rows > 20_000:
            released(False)
        return pa.table({"query_id": pa.array([r[0] for r in out], pa.int64()), "vec_id": pa.array([r[1] for r in out], pa.int64()), "score": pa.array([r[2] for r in out], pa.float64())})

    return index.withColumn("bin", bin_of).groupBy("bin").cogroup(sent.groupBy("bin")).applyInArrow(meet, "query_id long, vec_id long, score double")


def fitted(rows: DataFrame, queries: DataFrame, k: int, kind: str) -> tuple[Settings, int]:
    """Settings from a bounded sample, and the number of usable rows."""
    by_hash = lambda t, n: t.orderBy(F.xxhash64("id", "vec"), "id").limit(n).collect()
    asked, some, n = by_hash(queries, QUERIES), by_hash(rows, ROWS), rows.count()
    if not asked or n < 2:
        return Settings(), n
    size = max({r["size"] for r in asked}, key=lambda s: sum(r["size"] == s for r in asked))  # the commonest
    asked, some = [r for r in asked if r["size"] == size], [r for r in some if r["size"] == size]
    ids, q = [r["id"] for r in asked], matrix([r["vec"] for r in asked], kind, size)
    uq = unit(q)

    @tidy
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, vec = batch.column("id").to_numpy(), batch.column("vec")
                score = uq @ unit(matrix(vec, kind, size)).T
                score[np.array(ids)[:, None] == own[None, :]] = -2
                at = np.argsort(-score, axis=1, kind="stable")[:, :k]
                qi = np.repeat(np.arange(len(ids)), at.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(qi, pa.int32()), pa.array(np.take_along_axis(score, at, 1).ravel()), vec.take(pa.array(at.ravel(), pa.int64()))], names=["q", "s", "vec"])

    found = rows.where(F.col("size") == size).mapInArrow(nearest, "q int, s double, vec binary").where("s > -2")
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "vec"))).where(F.col("r") <= k).select("q", "vec").collect()  # at most k for each of QUERIES
    if not top:
        return Settings(), n
    of, near = np.array([r["q"] for r in top]), unit(matrix([r["vec"] for r in top], kind, size))
    sample = unit(matrix([r["vec"] for r in some], kind, size)) if some else near
    apart = np.sqrt(np.maximum(0, 2 - 2 * uq @ sample.T))
    width = 1.4 * float(np.median(apart)) or 1.0
    best = None
    most = int(min(16, max(3, round(np.log2(n)) - 6)))
    for hashes in range(most, 0, -1):
        if best is not None and best.recall >= RECALL and hashes <= most - TRIED:
            break
        s, steps = Settings(hashes, width, MOST_PROBES), perturbed(hashes)
        rank = np.full(len(of), len(steps) + MOST_PROBES)
        cells = []
        for t in range(TABLES):
            visited, goal = probed(uq, t, s, steps), key(places(near, t, s)[0], t, size)
            hit = visited[of] == goal[:, None]
            rank = np.minimum(rank, np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, rank))
            cells.append((visited, key(places(sample, t, s)[0], t, size)))
        probes = int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(RECALL * len(rank))) - 1)])
        probes = min(probes, MOST_PROBES)
        met = np.zeros((len(uq), len(sample)), bool)
        for visited, own in cells:
            for i in range(len(uq)):
                met[i] |= np.isin(own, visited[i, :probes])
        s = Settings(hashes, width, probes, float((rank <= probes).mean()), float(met.mean()))
        if best is None or (s.recall >= RECALL, -s.share if s.recall >= RECALL else s.recall) > (best.recall >= RECALL, -best.share if best.recall >= RECALL else best.recall):
            best = s
    log.info("fitted on %d of %d rows: %s", len(some), n, best)
    return best, n


def against_all(vectors: DataFrame, asking: DataFrame, n: int, k: int, kind: str) -> DataFrame:
    """query_id, vec_id, score: the k best of all rows in each block, for each query."""
    blocks = max(1, n // PART)
    dealt = vectors.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long")).select("slot", "id", "size", "vec")
    everywhere = asking.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("slot"), "id", "size")
    return meeting(dealt, everywhere, asking, k, blocks, kind)


def ranked_best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest rows found, by cosine, ties to the smaller id.

    Vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do rows with a null
    id; finite ones do, however large or small; only vectors with as many components meet. A query never finds rows of
    its own id. Rows of one id count as one, with its best score. If fewer than k others can be found, all are returned.
    Other columns are left out.
    """
    kind = "<f4" if df.schema[vector_col].dataType.simpleString() == "array<float>" == queries.schema[vector_col].dataType.simpleString() else "<f8"
    element = "float" if kind == "<f4" else "double"
    take = lambda t: t.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{element}>").alias("v"))
    vectors, asking = written(usable(take(df), kind)), written(usable(take(queries), kind))
    s, n = fitted(vectors, asking, k, kind)
    exact = settings is None and s.recall < RECALL
    s = settings or s
    if exact:
        return ranked_best(against_all(vectors, asking, n, k, kind), k)
    index = written(hashed(take(df), s, kind, False))
    parts = F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")
    large = written(index.groupBy("cell").agg(parts).where("parts > 1"))
    tasks = partitions(df.sparkSession)
    bins = max(2 * tasks, n * TABLES // 50_000)
    slot = lambda part: F.when(F.col("parts").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", part))
    rows = index.join(large, "cell", "left").withColumn("slot", slot(F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int"))).select("slot", "id", "size", "vec")
    probes = hashed(take(queries), s, kind, True).join(large, "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).select(slot(F.col("part")).alias("slot"), "id", "size")
    found = written(meeting(rows, probes, asking, k, bins, kind).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    few = written(asking.join(counts.withColumnRenamed("query_id", "id"), "id", "left").where(F.coalesce("n", F.lit(0)) < k).select("id", "size", "vec"))
    if n > 1 and not few.isEmpty():
        found = found.unionByName(against_all(vectors, few, n, k, kind))
    return ranked_best(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)
