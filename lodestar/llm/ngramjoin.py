"""Jaccard join of word n-gram sets by count vectors (operator 8).

A text's n-grams are hashed into groups, GROUPS for up to 4 * GROUPS n-grams and four times as many for each four times as
many n-grams; the counts are its point (the finer of two points is folded to meet the other). For two sets the sum of the coordinates'
smaller values is at least the size of what they share, and the sum of a point's coordinates and a box's maxima, the
smaller of each, bounds it for all points in the box: that is the R-tree's test.

1. Equal sets become classes; only one row of each class goes on.
2. A set that shares enough with another shares one of its `n - ceil(t n) + 1` first n-grams, in any order that all
   texts keep to. The order is by estimated frequency (a count sketch over all texts, sized by the input's partitions),
   rarest first, so the lists of classes by such an n-gram are short. Of n-grams with the same list (as the n-grams of a
   passage have) one counts. Each list is one tree's points.
3. Each class is first held against one that leads its lists; pairs whose points allow the similarity are
   verified on the whole sets, and the links' components found.
4. Classes that no class of another component in a list is near in size leave the list. Lists that remain get a tree: every class outside the list's largest component searches
   it for classes of other components; what passes is verified, and the components are found anew. So a group of near
   copies costs about its size, not its square, and no link between different components is left out.

links() searches every list's tree for all pairs instead, and so gives all links between classes.

A list longer than TILE is dealt into tiles, and pairs of tiles meet in tasks of their own. n-grams are compared by hashes
of 64 bits (of words of up to 8 bytes without any collision, see hashing), classes by 128 bits of the set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.components import components
from lodestar.llm.hashing import mixed
from lodestar.llm.memory import parts, released, tidy
from lodestar.llm.places import from_files, marked, picked, placed
from lodestar.llm.tables import dropped, partitions, written
from lodestar.llm.words import Words

U = np.uint64
GROUPS, SLICES, LEAF, TILE = 64, 64, 16, 1000
#: A task's counters take about a 27th of the bytes it reads; so many bits at least and at most.
SKETCH_BITS = (16, 23)
BATCH = 1_500_000
#: Groups of the points that go with each of a node's lists, and lists of a node that go with them, at most.
COARSE, TOKENS = 256, 64


def sets_of(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct n-grams of k words of each text; of all its words if they are fewer."""
    w = Words(texts, lower=True)
    grams = w.grams(k)
    out: list[np.ndarray] = [np.zeros(0, U)] * len(texts)
    for d, (n, at) in enumerate(zip(w.n.tolist(), w.first.tolist(), strict=False)):
        if n >= k:
            out[d] = np.unique(grams[at : at + n - k + 1])
    for n in range(1, k):
        short = np.flatnonzero(w.n == n)
        if len(short):
            whole = mixed(w.grams(n)[w.first[short]] + U(n))  # not that of an n-gram of k words by chance of their words
            for d, h in zip(short.tolist(), whole, strict=True):
                out[d] = np.array([h], U)
    return out


def sketch_bits(source: DataFrame) -> int:
    total = source.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    each = total / max(1, source.rdd.getNumPartitions())
    return min(SKETCH_BITS[1], max(SKETCH_BITS[0], int(np.log2(max(1.0, each / 27)))))


def sketch(source: DataFrame, k: int) -> np.ndarray:
    """How often all texts' n-grams are met, by the low bits of their hashes: for each a byte, 16 steps for a factor of 4.
    A task sends a share of what it reads; the driver gets at most 8 MB."""
    size = 1 << sketch_bits(source)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for whole in batches:
            for batch in parts(whole, 0, BATCH):
                for x in sets_of(batch.column(0).to_pylist(), k):
                    np.add.at(total, (x & U(size - 1)).astype(np.int64), np.uint32(1))
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in np.split(total, SLICES)], pa.binary())], names=["slice", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size // SLICES, np.float64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(x.as_buffer(), np.uint32)
        steps = np.minimum(255, np.round(8 * np.log2(1 + total))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([steps.tobytes()], pa.binary())], names=["slice", "counts"])

    rows = source.select("text").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()
    whole = np.zeros(size, np.uint8)
    for r in rows:
        whole[r["slice"] * (size // SLICES) : (r["slice"] + 1) * (size // SLICES)] = np.frombuffer(r["counts"], np.uint8)
    return whole


POINTS = "doc_id long, t long, f long, i long, n long, k1 long, k2 long, point binary, coarse binary, first array<long>"


def point_bits(n: int) -> int:
    bits = GROUPS.bit_length() - 1
    while n > 4 << bits:
        bits += 2
    return bits


def points(source: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Each text's number of n-grams, 128 bits of its set, its point and its first n-grams in the common order."""
    often = sketch(source, k)

    @tidy
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, 1, BATCH):
                found = sets_of(batch.column(1).to_pylist(), k)
                n = [len(x) for x in found]
                first = []
                for x in found:
                    size = len(x) - -(-num * len(x) // den) + 1 if len(x) else 0
                    first.append(x[np.lexsort((x, often[(x & U(len(often) - 1)).astype(np.int64)]))[:size]].view(np.int64))
                # A sum of mixed values is the same for equal sets in any order.
                k1 = [int(mixed(x).sum(dtype=U).view(np.int64)) for x in found]
                k2 = [int(mixed(x ^ U(0xD1B54A32D192ED03)).sum(dtype=U).view(np.int64)) for x in found]
                vec = [np.bincount((x >> U(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint16).tobytes() for x, bits in ((x, point_bits(len(x))) for x in found)]
                coarse = [v if len(v) <= 2 * COARSE else coarser(np.frombuffer(v, np.uint16)).tobytes() for v in vec]
                columns = [pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(vec, pa.binary()), pa.array(coarse, pa.binary()), pa.array(first, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), *columns], names=["doc_id", "t", "f", "i", "n", "k1", "k2", "point", "coarse", "first"])

    return source.select("doc_id", "text", "t", "f", "i").mapInArrow(make, POINTS)


def needed(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least size of what two sets of a and b n-grams share if they are similar enough."""
    return -(-num * (a + b) // (num + den))


class CountTree:
    """An R-tree over points, packed by size and then by the widest coordinate: leaves of LEAF points, nodes of LEAF leaves."""

    def __init__(self, n: np.ndarray, vec: np.ndarray) -> None:
        wide = vec[:, int(vec.var(axis=0).argmax())] if len(vec) else n
        slab = np.argsort(np.argsort(n, kind="stable"), kind="stable") // (LEAF * LEAF)
        self.order = np.lexsort((wide, slab))
        self.n, self.vec = n[self.order], vec[self.order]
        self.levels = []
        low, high, top = self.n, self.n, self.vec
        while len(low) > 1:
            edge = np.arange(0, len(low), LEAF)
            low, high, top = np.minimum.reduceat(low, edge), np.maximum.reduceat(high, edge), np.maximum.reduceat(top, edge, axis=0)
            self.levels.append((low, high, top))

    def search(self, n: int, vec: np.ndarray, num: int, den: int) -> np.ndarray:
        """Places of all points that a set of this size and point can be similar enough to."""
        at = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.n))
        least, most = -(-num * n // den), den * n // num
        for depth in range(len(self.levels) - 1, -2, -1):
            low, high, top = self.levels[depth] if depth >= 0 else (self.n, self.n, self.vec)
            at = at[(high[at] >= least) & (low[at] <= most)]
            at = at[np.minimum(top[at], vec).sum(axis=1) >= needed(np.maximum(low[at], least), n, num, den)]
            if depth >= 0:
                size = len(self.levels[depth - 1][0]) if depth else len(self.n)
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < size]
        return self.order[at]


def by_width(points: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each number of groups the places of the points that have it, and their matrix."""
    width = np.array([len(p) // 2 for p in points], np.int64)
    out = {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        out[w] = at, np.frombuffer(b"".join([points[i] for i in at.tolist()]), np.uint16).reshape(-1, w).astype(np.int64)
    return out


def folded(vec: np.ndarray, width: int) -> np.ndarray:
    return vec if vec.shape[1] == width else vec.reshape(len(vec), width, -1).sum(axis=2)


def coarser(point: np.ndarray) -> np.ndarray:
    """The point folded to COARSE groups, or to the fewest more in which every count still has 16 bits."""
    width, vec = COARSE, point.reshape(1, -1).astype(np.int64)
    while width < len(point) and folded(vec, width).max() > 65535:
        width *= 2
    return folded(vec, width)[0].astype(np.uint16)


def texts_of(nodes: DataFrame, source: DataFrame) -> DataFrame:
    """node, text of nodes (node, f, i): only the texts at their places move."""
    folder = marked(nodes)
    return picked(source.select("text", "f", "i"), folder).join(nodes.select("node", "f", "i"), ["f", "i"]).select("node", "text")


def verified(pairs: DataFrame, nodes: DataFrame, source: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, 2, BATCH // 2, 500):
                a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
                texts = list(dict.fromkeys([*ta, *tb]))
                found = dict(zip(texts, sets_of(texts, k), strict=True))
                keep = []
                for x, y in zip(ta, tb, strict=True):
                    s, t = found[x], found[y]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(den * both >= num * (len(s) + len(t) - both))
                yield pa.RecordBatch.from_arrays([pa.array([v for v, y in zip(a, keep, strict=True) if y], pa.int64()), pa.array([v for v, y in zip(b, keep, strict=True) if y], pa.int64())], names=["a", "b"])

    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = texts_of(written(nodes.join(wanted, "node", "left_semi")), source)
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb").mapInArrow(tidy(check), "a long, b long")


def bounded(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs with both sizes and points, those that the points allow."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "m"))
                p, q = (batch.column(c).to_pylist() for c in ("p", "q"))
                both = np.zeros(len(n), np.int64)
                for w, (at, x) in by_width(p).items():
                    for v, (own, y) in by_width([q[i] for i in at.tolist()]).items():
                        both[at[own]] = np.minimum(folded(x[own], min(v, w)), folded(y, min(v, w))).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(both >= needed(n, m, num, den)))

    return pairs.where(f"n * {den} >= m * {num} and m * {den} >= n * {num}").select("a", "b", "n", "m", "p", "q").mapInArrow(tidy(check), "a long, b long")


def tree_pairs(lists: DataFrame, num: int, den: int, tasks: int, every: bool = False) -> DataFrame:
    """Pairs of nodes of different components, or with `every` of any two, found by the lists' trees; a pair that
    shares several lists comes from the one of smallest token. lists: token, node, n, point, comp, total, major, tokens (of all
    the node's lists)."""
    tiles = F.ceil(F.col("total") / TILE).cast("int")
    dealt = lists.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    asking = dealt if every else dealt.where("comp <> major")
    asks = asking.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).selectExpr("token", "tile as x", "other as y", "node", "n", "point", "comp", "tokens", "true as asks")
    told = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).selectExpr("token", "other as x", "tile as y", "node", "n", "point", "comp", "tokens", "false as asks")
    # Short lists share a task's group; each pair of tiles of a long one has its own.
    rows = asks.unionByName(told).withColumn("bin", F.pmod(F.xxhash64("token", "x", "y"), F.lit(16 * tasks)))

    def search(t: pa.Table) -> pa.Table:
        t = t.sort_by([("token", "ascending"), ("x", "ascending"), ("y", "ascending")])
        token, x, y, node, n, comp = (t.column(c).to_numpy() for c in ("token", "x", "y", "node", "n", "comp"))
        ask, points = t.column("asks").to_numpy(), t.column("point").to_pylist()
        own_tokens = [None if v is None else frozenset(v) for v in t.column("tokens").to_pylist()]
        edge = np.concatenate([[0], np.flatnonzero((token[1:] != token[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1, [len(token)]])
        found: set[tuple[int, int]] = set()
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            asking = lo + np.flatnonzero(ask[lo:hi])
            told = lo + np.flatnonzero(~ask[lo:hi])
            if not len(asking) or not len(told):
                continue
            asked = by_width([points[i] for i in asking.tolist()])
            for w, (own, vec) in by_width([points[i] for i in told.tolist()]).items():
                here = told[own]
                for v, (some, asking_vec) in asked.items():
                    tree = CountTree(n[here], folded(vec, min(v, w)))
                    for q, point in zip(asking[some].tolist(), folded(asking_vec, min(v, w)), strict=True):
                        hit = here[tree.search(int(n[q]), point, num, den)]
                        hit = hit[(node[hit] != node[q]) if every else (comp[hit] != comp[q])]
                        d, here_token, tokens = int(node[q]), int(token[lo]), own_tokens[q]
                        found.update((min(d, int(node[o])), max(d, int(node[o]))) for o in hit.tolist() if tokens is None or own_tokens[o] is None or min(tokens & own_tokens[o]) == here_token)
        out = pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})
        if len(node) > 10_000:
            released(False)
        return out

    return rows.groupBy("bin").applyInArrow(search, "a long, b long").distinct()


def partnered(rows: DataFrame) -> DataFrame:
    """Of rows (token, node, size, comp, ...) of lists those in whose list another component has a class of a like size: the
    same step of size or one beside it, so no pair whose sizes allow the similarity loses a row in any of its lists."""
    by = rows.groupBy("token", "size").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
    beside = Window.partitionBy("token").orderBy("size").rangeBetween(-1, 1)  # a row for each step of size
    near = by.select("token", "size", F.min("x").over(beside).alias("x"), F.max("y").over(beside).alias("y")).where("x <> y")
    return rows.join(near.select("token", "size"), ["token", "size"], "left_semi")


class Classes:
    """Rows and classes of a table, as tables in the shared folder.

    every: doc_id, t (a hash of the text), f and i (its place), n, k1, k2 and more, a row for each row; nodes: node, k1, k2,
    the place of one of its rows, members, least (its smallest id), n, point; shared: token, node, size (n in steps, so that similar sets are at most one apart), leader,
    total and grams of the lists."""

    def __init__(self, df: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> None:
        self.k, self.num, self.den, self.tasks = k, num, den, partitions(df.sparkSession)
        source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.source = placed(from_files(source.withColumn("t", F.xxhash64("text"))))
        self.every = written(points(self.source, k, num, den))
        one = self.every.where("n > 0").groupBy("k1", "k2").agg(F.first(F.struct("f", "i", "n", "point", "coarse", "first")).alias("x"), F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("least"))
        self.nodes = written(one.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "x.*", "members", "least"))
        step = np.log(den / num) * (1 + 1e-6) + 1e-6
        entries = self.nodes.select("node", "least", F.floor(F.log("n") / F.lit(float(step))).cast("int").alias("size"), F.explode("first").alias("token"))
        # The class with the smallest id leads a list: copies mostly come after what they are made from.
        leader = F.min(F.struct(F.col("least").isNull(), "least", "node")).node
        signature = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"s{i}") for i in range(2)]
        lists = entries.groupBy("token").agg(leader.alias("leader"), F.count(F.lit(1)).alias("total"), *signature).where("total > 1")
        distinct = written(lists.groupBy("s0", "s1", "total").agg(F.min("token").alias("token"), F.first("leader").alias("leader"), F.count(F.lit(1)).alias("grams")).select("token", "leader", "total", "grams"))
        self.shared = written(entries.drop("least").join(distinct, "token"))
        dropped(distinct)

    def slim(self, node: str, n: str, point: str) -> DataFrame:
        return self.nodes.select(F.col("node").alias(node), F.col("n").alias(n), F.col("point").alias(point))

    @staticmethod
    def tokens(rows: DataFrame) -> DataFrame:
        """node, tokens of its lists among some rows; null for a node of more than TOKENS, whose pairs may come from several lists."""
        few = F.count(F.lit(1)) <= TOKENS
        return rows.groupBy("node").agg(F.when(few, F.collect_list("token")).alias("tokens"))

    def coarse(self) -> DataFrame:
        return self.nodes.select("node", "n", F.col("coarse").alias("point"))

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """The table of those of some pairs (a, b) that their points allow."""
        full = pairs.join(self.slim("a", "n", "p"), "a").join(self.slim("b", "m", "q"), "b")
        return written(bounded(full, self.num, self.den))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The table of those of a table of pairs that are similar enough; the pairs' own table goes."""
        out = written(verified(pairs, self.nodes.select("node", "f", "i"), self.source, self.k, self.num, self.den))
        dropped(pairs)
        return out

    def components(self) -> DataFrame:
        """node, component (a node) of every node that has a link."""
        # Of the classes that lead a class's lists the one of most n-grams is tried first; what that leaves apart is found below.
        tried = self.shared.where("node <> leader").groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.sum("grams").alias("grams"))
        starts = tried.groupBy("b").agg(F.max_by("a", F.struct("grams", "a")).alias("a")).select("a", "b")
        links = self.verified(self.bounded(starts))
        found = written(components(links))
        # Lists of which two or more components are left, without the classes that nothing there can be similar to.
        every = written(self.shared.select("token", "node", "size").join(found, "node", "left").select("token", "node", "size", F.coalesce("component", "node").alias("comp")))
        parts_of = written(partnered(every).select("token", "node", "comp"))
        open_lists = written(parts_of.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.sum("c").alias("total")))
        rows = parts_of.join(open_lists, "token").join(self.coarse(), "node").join(self.tokens(parts_of), "node")
        pairs = written(tree_pairs(rows, self.num, self.den, self.tasks))
        more = self.verified(self.bounded(pairs))
        out = written(components(links.unionByName(more)))
        dropped(self.shared, links, found, every, parts_of, open_lists, pairs, more)
        return out

    def links(self) -> DataFrame:
        """a, b (a < b): every two nodes that are similar enough."""
        left = written(partnered(self.shared.select("token", "node", "size", "total", F.col("node").alias("comp"))))
        rows = left.select("token", "node", "total", "comp", F.lit(-1).cast("long").alias("major")).join(self.coarse(), "node").join(self.tokens(left), "node")
        return self.verified(self.bounded(written(tree_pairs(rows, self.num, self.den, self.tasks, True))))

    def of_one_id(self) -> DataFrame:
        """a, b: nodes that rows of one id have."""
        rows = self.every.where("n > 0 and doc_id is not null").select("doc_id", F.struct("k1", "k2").alias("k"))
        several = rows.groupBy("doc_id").agg(F.min("k").alias("x"), F.max("k").alias("y")).where("x <> y").select("doc_id", "x")
        pairs = written(rows.join(several, "doc_id").where("k <> x").select("x", "k").distinct())
        name = lambda c, x: self.nodes.select(F.struct("k1", "k2").alias(c), F.col("node").alias(x))
        return pairs.join(name("x", "a"), "x").join(name("k", "b"), "k").select("a", "b")


def join(df: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id_col, n_shingles, component_id. Two texts link if den * shared >= num * (size of the union)
    of their sets of k-word n-grams, lower-cased in A to Z; component_id is the smallest id reachable by links.

    A text without words, an empty or a null one has an empty set, links with nothing and is its own component, even if
    other rows have its id. One with fewer than k words has its whole sequence as the only n-gram. Rows of one id that
    have words are one node, whatever their texts; a row whose id is null takes its class's component (null if no row
    that it reaches has an id). Ids are longs. Other columns are left out. An empty table gives no rows.
    """
    c = Classes(df, k, num, den, id_col, text_col)
    found, same = c.components(), written(c.of_one_id())
    if not same.isEmpty():
        found = written(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(same)))
    labelled = c.nodes.select("node", "k1", "k2", "least").join(found, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    small = written(labelled.groupBy("comp").agg(F.min("least").alias("component_id")))
    labels = labelled.join(small, "comp").select("k1", "k2", "component_id")
    rows = c.every.select("doc_id", "n", "k1", "k2").join(written(labels), ["k1", "k2"], "left")  # sets without members have k1 = k2 = 0
    return rows.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def groups(df: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id_col, t (a hash of the text), f and i (the row's place, if df's rows come from files), group: a
    long that rows share if links join their texts, null for texts without words. Ids say nothing here: rows of one id
    are told apart. Other columns are left out."""
    c = Classes(df, k, num, den, id_col, text_col)
    grouped = c.nodes.select("node", "k1", "k2").join(c.components(), "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("group"))
    rows = c.every.select("doc_id", "t", "f", "i", "n", "k1", "k2").join(written(grouped), ["k1", "k2"], "left")
    return rows.select(F.col("doc_id").alias(id_col), "t", "f", "i", F.when(F.col("n") > 0, F.col("group")).alias("group"))


def links(df: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: the pairs (a, b) of linked classes, a < b, and one row per row with id_col, class (null for a text
    without words) and n_links, the number of other rows that its text is linked with, copies included.

    Pairs grow with the square of a group of different near copies: each of them is a link. Null and empty texts, and
    rows that repeat, as in join().
    """
    c = Classes(df, k, num, den, id_col, text_col)
    pairs = c.links()
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    far = ends.join(c.nodes.select(F.col("node").alias("other"), F.col("members").alias("m")), "other").groupBy("node").agg(F.sum("m").alias("far"))
    counted = c.nodes.select("node", "k1", "k2", "members").join(far, "node", "left").select("k1", "k2", "node", (F.col("members") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    rows = c.every.select("doc_id", "n", "k1", "k2").join(written(counted), ["k1", "k2"], "left")
    some = F.col("n") > 0
    return pairs, rows.select(F.col("doc_id").alias(id_col), F.when(some, F.col("node")).alias("class"), F.when(some, F.col("n_links")).otherwise(F.lit(0).cast("long")).alias("n_links"))
