"""Best-fit packing of token sequences (operator 5).

Texts become ids, then pieces of at most `capacity`. Only the histogram of the pieces' lengths (at most `capacity`
rows) goes to the driver. There a configuration linear program (cover each length's count with as few filled
sequences as possible) is solved by multiplicative weights: the price of a length falls exponentially with its
share covered so far, a knapsack dynamic program finds the filling of largest price, and some of it is taken. Each round's
prices, divided by that largest price, are a solution of the dual program, so their worth is a bound from below on the
number of sequences of any packing; rounds end when what is taken comes within GAP of the best bound. The fractional
amounts are rounded down and what is left goes to the fullest sequence that still has room.

The plan is a bounded table of fillings and how often each is used. A piece finds its place from its rank among the
pieces of its length: the rank within its task, counted while tokenizing, plus the counts of the tasks before. So no
length, however common, meets in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.memory import parts, tidy
from lodestar.llm.pretoken import Vocabulary, of_worker
from lodestar.llm.tables import written

STEP, DECAY, ROUNDS, GAP, LEFT = 0.7, 2.0, 1200, 0.0005, 0.01
Filling = tuple[tuple[int, int], ...]


class Kept(Vocabulary):
    """A cache for all pre-tokens of some 16 MB of text with many rare words: what is dropped there is encoded again and again."""

    MOST = 100_000_000


def vocabulary(path: str) -> Vocabulary:
    return of_worker(Kept, path)


def best_filling(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> Counter:
    """Unbounded knapsack: how often each length is taken for the largest total price."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    for c in range(int(lengths[0]), capacity + 1):
        n = int(np.searchsorted(lengths, c, "right"))
        sums = best[c - lengths[:n]] + prices[:n]
        k = int(sums.argmax())
        if sums[k] > best[c - 1]:
            best[c], took[c] = sums[k], lengths[k]
        else:
            best[c] = best[c - 1]
    out, c = Counter(), capacity
    while c > 0:
        if took[c]:
            out[int(took[c])] += 1
            c -= int(took[c])
        else:
            c -= 1
    return out


def solve(histogram: dict[int, int], capacity: int) -> tuple[dict[Filling, float], float]:
    """Fractional amounts of fillings that cover almost every length's count (what is left are LEFT of the tokens, or
    pieces of which less than half a one is left), and the best dual bound that was met: no packing of the histogram has
    fewer sequences."""
    out: dict[Filling, float] = {}
    every = {n: float(k) for n, k in histogram.items() if 0 < n < capacity and k > 0}
    whole = histogram.get(capacity, 0)
    left, taken_in_all = dict(every), 0.0
    total = sum(n * k for n, k in left.items())
    bound = total / capacity  # the dual solution in which a length costs its share of the capacity
    for _ in range(ROUNDS):
        lengths = np.array(sorted(left), np.int64)
        rest = sum(n * k for n, k in left.items())
        if not len(lengths) or rest < LEFT * total and taken_in_all + rest / capacity <= (1 + GAP) * bound:
            break
        share = np.array([1 - left[n] / every[n] for n in lengths.tolist()])
        prices = lengths / capacity * np.exp(-DECAY * share)
        found = best_filling(prices, lengths, capacity)
        price = dict(zip(lengths.tolist(), prices.tolist(), strict=True))
        bound = max(bound, sum(price[n] * every[n] for n in price) / sum(price[n] * k for n, k in found.items()))
        taken = {n: min(k, max(1, int(left[n]))) for n, k in found.items()}
        amount = STEP * min(left[n] / k for n, k in taken.items())
        if amount < 1:
            amount = min(1.0, min(left[n] / k for n, k in taken.items()))
        filling = tuple(sorted(taken.items()))
        out[filling] = out.get(filling, 0.0) + amount
        taken_in_all += amount
        for n, k in taken.items():
            left[n] -= amount * k
            if left[n] < 0.5:
                del left[n]
    return out, bound + whole


def sequences(groups: list[tuple[Counter, int]]) -> int:
    return sum(times for _, times in groups)


def best_fit(left: Counter, groups: list[tuple[Counter, int]], capacity: int) -> list[tuple[Counter, int]]:
    """The groups with all that is left placed, longest first, where the least room is; new ones where there is none."""
    left = Counter(left)
    room: dict[int, list[tuple[Counter, int]]] = {}
    for g, times in groups:
        room.setdefault(capacity - sum(n * k for n, k in g.items()), []).append((g, times))
    for n in sorted(left, reverse=True):
        while left[n] > 0:
            free = min((f for f, x in room.items() if f >= n and x), default=None)
            if free is None:
                each = min(capacity // n, left[n])
                old, g, times = Counter(), Counter({n: each}), max(1, left[n] // each)
            else:
                old, many = room[free].pop()
                each = min(free // n, left[n])
                times = max(1, min(many, left[n] // each))
                if many > times:
                    room[free].append((old, many - times))
                g = old + Counter({n: each})
            left[n] -= (g[n] - old[n]) * times
            room.setdefault(capacity - sum(a * b for a, b in g.items()), []).append((g, times))
    return [x for own in room.values() for x in own]


def rounded(left: Counter, capacity: int) -> tuple[list[tuple[Counter, int]], Counter]:
    """Fillings of the linear program, taken as often as their amounts rounded down, and what is left."""
    groups, left = [], Counter(left)
    for filling, amount in sorted(solve(dict(left), capacity)[0].items(), key=lambda x: (-x[1], x[0])):
        times = min([int(amount), *(left[n] // k for n, k in filling)])
        if times > 0:
            groups.append((Counter(dict(filling)), times))
            for n, k in filling:
                left[n] -= k * times
    return groups, left


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Fillings and how many sequences have each; every piece of the histogram is in one. The better of the rounded linear
    program, with what is left placed by best fit, and of best fit alone."""
    left = Counter({n: k for n, k in histogram.items() if k > 0})
    whole = [(Counter({capacity: 1}), left.pop(capacity))] if left[capacity] else []
    groups, rest = rounded(left, capacity)
    made = min(best_fit(rest, groups, capacity), best_fit(left, [], capacity), key=sequences)
    return [(tuple(sorted(g.items(), reverse=True)), times) for g, times in whole + made]


def slots(fillings: list[tuple[Filling, int]]) -> dict[int, np.ndarray]:
    """For each length: rows of (first rank, sequences' first id, pieces in one sequence, offset in it)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: Counter = Counter()
    first = 0
    for filling, times in fillings:
        at = 0
        for n, k in filling:
            out.setdefault(n, []).append((rank[n], first, k, at))
            rank[n] += k * times
            at += n * k
        first += times
    return {n: np.array(x, np.int64) for n, x in out.items()}


def pieces(df: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """Tokenized pieces with the task and the rank among the task's pieces of the same length."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, ranks, part = vocabulary(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for whole in batches:
            for batch in parts(whole, 1):
                rows: list[list] = [[] for _ in range(8)]
                for row, ids in enumerate(v.encode([t or "" for t in batch.column(1).to_pylist()])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    n = len(ids)
                    head = (n - 1) % capacity + 1
                    for k, start in enumerate([0, *range(head, n, capacity)]):
                        own = ids[start : head if k == 0 else start + capacity]
                        values = (row, k, start, len(own), zlib.crc32(own.tobytes()), part, int(ranks[len(own)]), own.astype(np.int32) if with_ids else None)
                        for column, x in zip(rows, values, strict=True):
                            column.append(x)
                        ranks[len(own)] += 1
                arrays = [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:5]), pa.array(rows[5], pa.int32()), pa.array(rows[6], pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32", "part", "rank"]
                if with_ids:
                    arrays.append(pa.array(rows[7], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * with_ids)


def pack(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null text counts as empty and still makes a piece of the end id alone. A text is cut only if it has more than
    `capacity` ids: into pieces of that length, the first of which may be shorter. Ids of rows may repeat or be null;
    each row is packed by itself. Columns other than the two named are left out. An empty table gives no rows.
    """
    made = written(pieces(df, path, capacity, end_id, id_col, text_col, with_ids))
    counts = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = slots(plan(histogram, capacity))  # bounded by the capacity and ROUNDS, whatever the input
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = made.join(before.select("part", "length", F.coalesce("before", F.lit(0)).alias("before")), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "part")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(own):
                    n = int(length[own[0]])
                    t = table[n]
                    at = t[np.searchsorted(t[:, 0], rank[own], "right") - 1]
                    since = rank[own] - at[:, 0]
                    sequence[own] = at[:, 1] + since // at[:, 2]
                    offset[own] = at[:, 3] + since % at[:, 2] * n
            keep = [i for i, name in enumerate(batch.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)], names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    kept = [f for f in ranked.schema.fields if f.name != "rank"]
    out = ranked.mapInArrow(place, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "sequence_id long", "offset long"]))
    return out.select(F.col("id").alias(id_col), *["piece", "start", "length", "ids_crc32", "sequence_id", "offset"], *["ids"] * with_ids)
