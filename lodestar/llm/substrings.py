"""Removal of repeated passages (operator 7).

A passage is a window of `window` consecutive words of one text. A window is removed if the same words also start
earlier (in a text of smaller id, or before in the same text); every word of it goes.

Texts are dealt into segments: ranges of (id, hash of the text, place in the table), each of about as many bytes of text, so
neither clustered nor repeated nor null ids make one large. The driver holds one key for each segment. Fixed-block anchors
find the windows that can repeat at all. A repeat of `window` words holds a whole block of window // 2 words that stands
at a multiple of that length in the other text, so these non-overlapping blocks are the index and every rolling window of
their length probes it. A segment sends each of its distinct hashes once, with a bit that says whether it is of a block;
hits come back as a bitmap in the order sent. Hits are then extended: only windows that hold a hit are hashed whole, with
two hashes of 64 bits that are made from the words independently, and for each such pair every segment but the first that
has it is told so. Runs of windows told so are the maximal exact repeats.

Whatever the number of copies of a passage, a segment sends it once, so a bucket's size is bounded by the number of
segments for each distinct hash, and what comes back is one bit for each hash sent.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.memory import released
from lodestar.llm.tables import partitions, written
from lodestar.llm.words import Words

U = np.uint64
HASH_BITS, TREE = 31, 256
PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])
BLOBS = "seg int, bucket int, blob binary"


Key = tuple[int | None, int, int]


def bounds(rows: DataFrame, segment_bytes: int | None) -> tuple[list[Key], int]:
    """The first keys of all segments but the first, in order, and the bytes of text. rows: doc_id, h, m, b (bytes)."""
    total = rows.agg(F.sum("b").alias("b")).first()["b"] or 0
    # Segments and buckets both grow with the root of the input, so that what a segment sends to a bucket stays large.
    size = segment_bytes or min(64_000_000, max(2_000_000, int(6.4 * math.sqrt(total))))
    size = max(1, min(size, total // (2 * partitions(rows.sparkSession))))

    def cut(batches):
        held = None
        for batch in batches:
            own = batch.column("b").to_numpy(zero_copy_only=False)
            at = []
            for i, n in enumerate(own.tolist()):
                if held is None or held >= size:
                    at.append(i)
                    held = 0
                held += n
            yield batch.select(["doc_id", "h", "m"]).take(pa.array(at, pa.int64()))

    ranged = rows.repartitionByRange(max(1, math.ceil(total / size / 16)), "doc_id", "h", "m").sortWithinPartitions("doc_id", "h", "m")
    found = ranged.mapInArrow(cut, "doc_id long, h long, m long").collect()  # one key for each segment
    return sorted(((r["doc_id"], r["h"], r["m"]) for r in found), key=lambda k: (k[0] is not None, k[0] or 0, *k[1:]))[1:], total


def segmented(source: DataFrame, cuts: list[Key]) -> DataFrame:
    """Adds seg: how many of the cuts are at or before a row's key (doc_id, h, m). By halving between TREE of the cuts;
    the ones between two of these, if there are more, come as a row for each of TREE ranges."""
    key = F.struct("doc_id", "h", "m")
    literal = lambda k: F.struct(*[F.lit(x).cast("long").alias(n) for x, n in zip(k, ("doc_id", "h", "m"), strict=True)])
    each = math.ceil((len(cuts) + 1) / TREE)
    top = cuts[each - 1 :: each]

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo * each)
        mid = (lo + hi) // 2
        return F.when(key >= literal(top[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    first = source.withColumn("seg", tree(0, len(top)).cast("int"))
    if each == 1:
        return first
    spark = source.sparkSession
    rows = [(i * each, [*cuts[i * each : (i + 1) * each - 1]]) for i in range(len(top) + 1)]
    inner = spark.createDataFrame(rows, "seg int, cuts array<struct<doc_id: long, h: long, m: long>>")
    joined = first.join(F.broadcast(inner), "seg")  # a key for each segment: 24 bytes for some 64 MB of text
    return joined.withColumn("seg", F.col("seg") + F.size(F.filter("cuts", lambda c: c <= key))).drop("cuts")


class Segment:
    """The words of a segment's texts in the order of their ids, with the distinct hashes that it sends."""

    def __init__(self, t: pa.Table, window: int, bits: int) -> None:
        ids, hs, ms = (t.column(c).to_pylist() for c in ("doc_id", "h", "m"))
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, hs[i], ms[i]))
        self.words = w = Words(t.column("text").take(pa.array(self.order, pa.int64())).to_pylist())
        self.window, self.block, self.bits = window, window // 2, bits
        room = w.room()
        self.at = np.flatnonzero(room >= self.block)
        grams = w.grams(self.block)[self.at] >> U(64 - HASH_BITS - bits)
        aligned = (self.at - w.first[w.doc()[self.at]]) % self.block == 0
        self.sent, self.inverse, count = np.unique(grams, return_inverse=True, return_counts=True)
        self.indexed = np.zeros(len(self.sent), bool)
        self.indexed[self.inverse[aligned]] = True
        self.local = self.indexed & (count > 1)
        self.room = room

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and value of each distinct hash; the lowest bit of a value: it is of a block."""
        value = ((self.sent & U((1 << HASH_BITS) - 1)) << U(1)) | self.indexed.astype(U)
        return (self.sent >> U(HASH_BITS)).astype(np.int64), value.astype(np.uint32)

    def candidates(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the windows that hold a hit; their distinct hashes in the order of bucket, each one's bucket, the
        place in these of each window's, and where each first stands."""
        mark = np.zeros(len(self.room) + 1, np.int64)
        mark[self.at[(hit | self.local)[self.inverse]] + 1] = 1
        upto = np.cumsum(mark)
        places = np.flatnonzero(self.room >= self.window)
        places = places[upto[places + self.window - self.block + 1] > upto[places]]
        a, b = (self.words.grams(self.window, seed)[places] if len(places) else np.zeros(0, U) for seed in (0, 1))
        order = np.lexsort((places, a, b))  # the bucket is the upper bits of b
        new = np.ones(len(order), bool)
        new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        pairs = np.empty(int(new.sum()), PAIR)
        pairs["a"], pairs["b"] = a[order[new]], b[order[new]]
        return places, pairs, (pairs["b"] >> U(64 - self.bits)).astype(np.int64), inverse, places[order[new]]


def blobs(seg: int, bucket: np.ndarray, values: np.ndarray) -> pa.Table:
    """A row for each bucket with its values, which are in the order of the buckets."""
    edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    n = len(edge) - 1
    return pa.table({"seg": pa.array([seg] * n, pa.int32()), "bucket": pa.array(bucket[edge[:-1]], pa.int32()), "blob": pa.array([values[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())})


def bitmap(t: pa.Table, bucket: np.ndarray) -> np.ndarray:
    """What came back for each value sent; nothing came for a bucket without any bit."""
    out = np.zeros(len(bucket), bool)
    for b, blob in zip(t.column("bucket").to_pylist(), t.column("blob").to_pylist(), strict=True):
        lo, hi = np.searchsorted(bucket, [b, b + 1])
        out[lo:hi] = np.unpackbits(np.frombuffer(blob, np.uint8), count=hi - lo)
    return out


def answer(t: pa.Table, kind: type, judge) -> pa.Table:
    """A bucket's values of all segments in order, judged, and each segment's bits."""
    t = t.sort_by("seg")
    segs = t.column("seg").to_pylist()
    parts = [np.frombuffer(b, kind) for b in t.column("blob").to_pylist()]
    edge = np.cumsum([0, *map(len, parts)])
    bits = judge(np.concatenate(parts) if parts else np.zeros(0, kind))
    rows = [(s, np.packbits(bits[a:b]).tobytes()) for s, a, b in zip(segs, edge[:-1], edge[1:], strict=True) if bits[a:b].any()]
    bucket = t.column("bucket")[0].as_py()
    return pa.table({"seg": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})


def shared_blocks(values: np.ndarray) -> np.ndarray:
    """Hashes that more than one segment has and of which at least one is of a block."""
    order = np.argsort(values, kind="stable")
    key = values[order] >> np.uint32(1)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    out = np.zeros(len(values), bool)
    if len(start):
        size = np.diff(np.append(start, len(key)))
        out[order] = np.repeat((size > 1) & (np.bitwise_or.reduceat(values[order] & np.uint32(1), start) > 0), size)
    return out


def not_first(values: np.ndarray) -> np.ndarray:
    """Pairs that stand before, in an earlier segment."""
    order = np.lexsort((values["b"], values["a"]))
    out = np.zeros(len(values), bool)
    if len(values):
        v = values[order]
        out[order[1:]] = v[1:] == v[:-1]
    return out


def dedup(df: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int | None = None, bucket_words: int | None = None, carry: tuple[str, ...] = (), unchanged: bool = False) -> DataFrame:
    """One row per row: id_col, n_words, n_removed and text, the kept words joined by one space; with `unchanged`, a text
    of which nothing is removed stays as it is. Then the columns named in `carry`, each row's own.

    A null or empty text has no words and an empty kept text (unchanged: stays). Null ids stand first; rows of equal id
    count as ordered by a hash of their text, and each row keeps its own result; of rows that repeat one the first is any
    of them. Other columns are left out, whatever their names. An empty table gives no rows. segment_bytes is about what
    one task holds of the texts (and at least one whole text), bucket_words about the hashes of a bucket; by default both
    grow with the root of the input, from 2 MB and a million to 64 MB and 32 millions.
    """
    kept = [F.col(c).alias(f"carried{i}") for i, c in enumerate(carry)]
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *kept).withColumn("h", F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))).withColumn("m", F.monotonically_increasing_id())
    cuts, total = bounds(written(source.select("doc_id", "h", "m", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("b"))), segment_bytes)
    words = bucket_words or min(32_000_000, max(1_000_000, int(3.2 * math.sqrt(total))))
    bits = max(3, math.ceil(math.log2(max(1, total / 6 / words))))
    spread = max(partitions(df.sparkSession), min(len(cuts) + 1, 20_000))
    dealt = segmented(source, cuts).repartition(spread, "seg")

    def done(segment: Segment, out: pa.Table) -> pa.Table:
        if len(segment.words.data) > 1_000_000:
            released(False)
        return out

    def send(t: pa.Table) -> pa.Table:
        s = Segment(t, window, bits)
        return done(s, blobs(t.column("seg")[0].as_py(), *s.anchors()))

    def extend(docs: pa.Table, hits: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"seg": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        s = Segment(docs, window, bits)
        _, pairs, bucket, _, _ = s.candidates(bitmap(hits, s.anchors()[0]))
        return done(s, blobs(docs.column("seg")[0].as_py(), bucket, pairs))

    def remove(docs: pa.Table, back: pa.Table) -> pa.Table:
        s = Segment(docs, window, bits)
        first = back.column("bucket").to_numpy(zero_copy_only=False) >= 0
        hits, later = back.filter(pa.array(first)), back.filter(pa.array(~first))
        places, _, bucket, inverse, start = s.candidates(bitmap(hits, s.anchors()[0]))
        later = later.set_column(later.schema.get_field_index("bucket"), "bucket", pa.array(-1 - later.column("bucket").to_numpy(zero_copy_only=False), pa.int32()))
        gone = places[bitmap(later, bucket)[inverse] | (places != start[inverse])]
        turn = np.zeros(len(s.room) + 1, np.int64)
        np.add.at(turn, gone, 1)
        np.add.at(turn, gone + window, -1)
        keep = np.cumsum(turn[:-1]) == 0
        left = np.diff(np.concatenate([[0], np.cumsum(keep)])[s.words.first])
        own = docs.take(pa.array(s.order, pa.int64()))
        texts = s.words.kept_texts(keep)
        if unchanged:
            texts = [t if n else own.column("text")[i].as_py() for i, (t, n) in enumerate(zip(texts, (s.words.n - left).tolist(), strict=True))]
        made = {"doc_id": own.column("doc_id"), "n_words": pa.array(s.words.n, pa.int64()), "n_removed": pa.array(s.words.n - left, pa.int64()), "text": pa.array(texts, pa.string())}
        return done(s, pa.table(made | {f"carried{i}": own.column(f"carried{i}") for i in range(len(carry))}))

    def met(sent: DataFrame, kind: np.dtype | type, judge) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(lambda t: answer(t, kind, judge), BLOBS)

    hits = met(dealt.groupBy("seg").applyInArrow(send, BLOBS), np.uint32, shared_blocks)
    later = met(dealt.groupBy("seg").cogroup(hits.groupBy("seg")).applyInArrow(extend, BLOBS), PAIR, not_first)
    back = hits.unionByName(later.withColumn("bucket", -1 - F.col("bucket")))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(f"carried{i}", df.schema[c].dataType) for i, c in enumerate(carry))])
    out = dealt.groupBy("seg").cogroup(back.groupBy("seg")).applyInArrow(remove, schema)
    return out.select(F.col("doc_id").alias(id_col), "n_words", "n_removed", "text", *[F.col(f"carried{i}").alias(c) for i, c in enumerate(carry)])
