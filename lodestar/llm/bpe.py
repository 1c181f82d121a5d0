"""BPE encoding and decoding with reuse of content-defined chunks (operator 2).

Each text is cut where a rolling hash of its last WINDOW characters has its low bits zero, so equal passages of
different documents give equal chunks wherever they stand. A chunk is encoded on its own, once, and kept by its
text in a bounded cache. A cut may fall inside a pre-token, so each join is repaired: the last
k pre-tokens before it and the first k after it are encoded again as one window, and k grows until the window's
outer pre-tokens agree exactly with those of the two chunks. From such a pre-token on, the scan of the whole
text and that of the chunk are in the same state, so the result is that of encoding the whole text. Where a
chunk has too few pre-tokens left for agreement, the whole text is encoded at once.

The cache goes by the chunks themselves and is one task's: nothing is shuffled, the memory is bounded in bytes, and a lost
executor costs its own tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.memory import parts, tidy
from lodestar.llm.pretoken import BREAK, CLASS, LONG, SEPARATOR, Vocabulary, codes, of_worker, pieces_of, split

#: KEPT: bytes of chunks and of words that are kept, about; there are two generations of chunks.
WINDOW, CUT_BITS, KEPT = 16, 9, 16_000_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+"


def rolled(cps: np.ndarray) -> np.ndarray:
    """A rolling hash of the last WINDOW characters up to each place from WINDOW - 1 on; it only says where chunks end."""
    h, size, factor = (cps ^ (cps >> np.uint32(7))) * np.uint32(0x9E3779B1), 1, 0x85EBCA6B
    while size < WINDOW:
        h = h[:-size] * np.uint32(factor) + h[size:]
        size, factor = 2 * size, factor * factor % (1 << 32)
    return h * np.uint32(0xC2B2AE35)


class Chunk:
    __slots__ = ("bytes", "ends", "ids", "offsets", "shown", "starts")

    def __init__(self, starts, ends, ids, offsets, shown) -> None:
        self.starts, self.ends, self.ids, self.offsets, self.shown = starts.astype(np.int32), ends.astype(np.int32), ids, offsets.astype(np.int32), shown
        self.bytes = 700 + 20 * len(starts) + 4 * len(ids)


class ChunkCoder:
    """Encodes batches of texts by way of chunks; for a vocabulary that drops white space."""

    def __init__(self, path: str) -> None:
        import regex

        self.v = Vocabulary(path)
        if self.v.spaced:
            raise ValueError("chunk reuse needs a vocabulary whose pre-tokens never hold white space")
        self.find = regex.compile(PATTERN).finditer
        self.young: dict[str, Chunk] = {}
        self.old: dict[str, Chunk] = {}
        self.words: dict[str, tuple[list[int], bytes]] = {}
        self.kept = 0  # bytes of the young chunks
        self.reused = self.encoded = self.repaired = self.whole = 0

    def cached(self, key: str) -> Chunk | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.young[key] = found
            self.kept += found.bytes + 2 * len(key)
        return found

    def word(self, word: str) -> tuple[list[int], bytes]:
        found = self.words.get(word)
        if found is None:
            if 300 * len(self.words) > KEPT:
                self.words.clear()
            ids = self.v.word(word)
            found = self.words[word] = ids, " ".join(map(self.v.names.__getitem__, ids)).encode()
        return found

    def batch(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        """Ids and the decoded text in UTF-8 of each of some safe texts."""
        cps = self.v.normal(codes(SEPARATOR.join(texts)))
        cuts = np.flatnonzero(rolled(cps) >> np.uint32(32 - CUT_BITS) == 0) + WINDOW if len(cps) > WINDOW else np.zeros(0, np.int64)
        breaks = np.flatnonzero(CLASS[cps] == BREAK)
        starts = np.unique(np.concatenate([[0], cuts, breaks, breaks + 1]))
        starts = starts[starts < len(cps)]
        ends = np.append(starts[1:], len(cps))
        real = CLASS[cps[starts]] != BREAK if len(starts) else np.zeros(0, bool)
        starts, ends = starts[real], ends[real]
        text = str(cps.tobytes(), "utf-32-le", "surrogatepass")
        keys = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        fresh, seen = [], set()
        for i, k in enumerate(keys):
            if k not in seen and self.cached(k) is None:
                fresh.append(i)
            seen.add(k)
        self.encoded += len(fresh)
        self.reused += len(keys) - len(fresh)
        batch = self.encode_chunks(cps, starts, ends, keys, fresh)
        edges = np.concatenate([[0], breaks + 1, [len(cps) + 1]])
        first = np.searchsorted(starts, edges)
        for d in range(len(texts)):
            a, b = int(first[d]), int(first[d + 1])
            chunks = [batch.get(k) or self.cached(k) for k in keys[a:b]]
            yield self.joined(chunks, starts[a:b].tolist(), text) or self.all_at_once(texts[d])
        self.kept += sum(c.bytes + 2 * len(k) for k, c in batch.items())
        self.young.update(batch)
        if self.kept > KEPT:
            self.old, self.young, self.kept = self.young, {}, 0

    def encode_chunks(self, cps, starts, ends, keys, fresh) -> dict[int, Chunk]:
        if not fresh:
            return {}
        parts, gap = [], np.array([0xFFFF], np.uint32)
        for i in fresh:
            parts += [cps[starts[i] : ends[i]], gap]
        own = np.concatenate(parts)
        s, e = split(own, False)
        places = self.v.lookup(own, s, e)
        ids, offsets = self.v.expand(places)
        shown = [self.v.shown[p] for p in places.tolist()]
        begin = np.cumsum([0, *(ends[fresh] - starts[fresh] + 1).tolist()])
        cut = np.searchsorted(s, begin)
        out = {}
        for n, i in enumerate(fresh):
            a, b, o = int(cut[n]), int(cut[n + 1]), int(begin[n])
            out[keys[i]] = Chunk(s[a:b] - o, e[a:b] - o, ids[offsets[a] : offsets[b]].copy(), offsets[a : b + 1] - offsets[a], shown[a:b])
        return out

    def joined(self, chunks: list[Chunk], at: list[int], text: str) -> tuple[np.ndarray, bytes] | None:
        """One text's ids from its chunks, with the joins repaired; None where they don't come to agree."""
        lead = [0] * len(chunks)
        tail = [0] * len(chunks)
        mended: list[tuple[list[int], list[bytes]]] = []
        for j in range(len(chunks) - 1):
            a, b, here = chunks[j], chunks[j + 1], at[j + 1]
            na, nb = len(a.starts), len(b.starts)
            ids: list[int] = []
            shown: list[bytes] = []
            touching = na and nb and int(a.ends[-1]) + at[j] == here and int(b.starts[0]) == 0
            if (na == 0 or nb == 0) or touching:
                k = 1
                while True:
                    if na - lead[j] < k or nb < k:
                        if na and nb or not self.blank(chunks[j], chunks[j + 1], at, j, text):
                            return None
                        k = 0
                        break
                    s, e = int(a.starts[na - k]) + at[j], int(b.ends[k - 1]) + here
                    window = text[s:e]
                    found = [m.span() for m in self.find(window)]
                    if found[0] == (0, int(a.ends[na - k] - a.starts[na - k])) and found[-1] == (int(b.starts[k - 1]) + here - s, e - s) and len(found) > 1:
                        break
                    k += 1
                if k:
                    self.repaired += 1
                    for x, y in found:
                        i, w = self.word(window[x:y])
                        ids += i
                        shown.append(w)
                tail[j], lead[j + 1] = k, k
            mended.append((ids, shown))
        out, names = [], []
        for j, c in enumerate(chunks):
            n = len(c.starts) - tail[j]
            out.append(c.ids[c.offsets[lead[j]] : c.offsets[n]])
            names += c.shown[lead[j] : n]
            if j < len(mended):
                out.append(np.asarray(mended[j][0], np.uint32))
                names += mended[j][1]
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), b" ".join(names)

    @staticmethod
    def blank(a: Chunk, b: Chunk, at: list[int], j: int, text: str) -> bool:
        """Whether white space stands beside the cut, so that nothing goes across it."""
        here = at[j + 1]
        return any(CLASS[min(ord(c), 0xFFFE)] == 0 for c in text[here - 1 : here + 1])

    def all_at_once(self, text: str) -> tuple[np.ndarray, bytes]:
        self.whole += 1
        cps = self.v.normal(codes(text))
        places = self.v.lookup(cps, *split(cps, False))
        return self.v.expand(places)[0], b" ".join([self.v.shown[p] for p in places.tolist()])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bytes]]:
        out: list = [None] * len(texts)
        group: list[int] = []
        size = 0

        def flush() -> None:
            for i, x in zip(group, self.batch([texts[i] for i in group]), strict=True):
                out[i] = x
            group.clear()

        for i, t in enumerate(texts):
            if not self.v.safe(t):
                ids = self.v.by_library(t)
                out[i] = ids, self.v.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()
            elif len(t) > LONG:
                own = [next(self.batch([p])) for p in pieces_of(t)]
                out[i] = np.concatenate([ids for ids, _ in own]), b" ".join(shown for _, shown in own if shown)
            else:
                group.append(i)
                size += len(t) + 1
                if size > LONG:
                    flush()
                    size = 0
        if group:
            flush()
        return out


def coder(path: str) -> ChunkCoder:
    """One of each vocabulary in a task."""
    return of_worker(ChunkCoder, path)


COLUMNS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
ARROW = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """One row per row: id_col and the outputs named in COLUMNS, of the whole text.

    A null text counts as empty: no ids, an empty decoded text. Ids may be null or repeat. Other columns of df are
    left out, whatever their names. An empty table gives no rows.
    """

    make = {"n_tokens": lambda ids, _: len(ids), "ids": lambda ids, _: ids.astype(np.int32), "decoded": lambda _, shown: shown.decode(), "ids_sha256": lambda ids, _: hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), "decoded_sha256": lambda _, shown: hashlib.sha256(shown).hexdigest()}

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for whole in batches:
            for batch in parts(whole, 1):
                found = c.encode([t or "" for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([make[o](*x) for x in found], ARROW[o]) for o in outputs)], names=["id", *outputs])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, ", ".join([f"id {kind}", *(f"{o} {COLUMNS[o]}" for o in outputs)])).withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds out_col: the text of the ids as the library's decode with special tokens kept; null for null ids."""
    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        t = coder(vocabulary).v.tokenizer
        return pa.array([None if x is None else t.decode(x, skip_special_tokens=False) for x in ids.to_pylist()], pa.string())

    return df.withColumn(out_col, run(F.col(ids_col)))
