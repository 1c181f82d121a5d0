"""Vectorised pre-tokenisation and a word cache in front of a BPE vocabulary file.

A BPE model splits a text into pre-tokens by a pattern and merges inside each one only. Both patterns in use
are made of runs of letters, numbers, white space and other characters, so the split of a whole batch of texts
is a handful of numpy passes over its code points. Each distinct pre-token goes through the library's BPE model
once per worker; after that its ids come from the cache.

Texts with characters outside SAFE, or with the text of a special token, go through the library's own encoder.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np

from lodestar.llm.hashing import same_slices, slice_hashes
from lodestar.llm.memory import CACHES

SPACE, LETTER, NUMBER, OTHER, BREAK = 0, 1, 2, 3, 4
SEPARATOR = "￿"
#: Code points whose class, lower case and normal form are the same in every Unicode version.
SAFE_RANGES = ((0x00, 0x130), (0x131, 0x180), (0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C0))
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0)
SINGLE, DOUBLE = "stmd", (("r", "e"), ("v", "e"), ("l", "l"))
#: Letter, space, letter: no pre-token, normal form or special token goes across the space.
BREAKS = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
LONG = 500_000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    cls, low = np.full(0x10000, 255, np.uint8), np.arange(0x10000, dtype=np.uint32)
    for a, b in SAFE_RANGES:
        for c in range(a, b):
            kind = unicodedata.category(chr(c))[0]
            cls[c] = SPACE if c in WHITE_SPACE else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
            low[c] = ord(chr(c).lower())
    cls[0xFFFF] = BREAK
    return cls, low


CLASS, LOWER = _tables()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces_of(text: str) -> list[str]:
    """A long text in parts whose ids, one after another, are those of the whole; cut where that is certain only."""
    if len(text) <= LONG:
        return [text]
    out, at = [], 0
    while len(text) - at > LONG:
        found = BREAKS.search(text, at + LONG)
        if found is None:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


def split(cps: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of safe code points in which BREAK stands between texts.

    spaced: one space goes with the run after it, numbers are runs and white space is kept; else white space is
    dropped and every number character stands alone.
    """
    if not len(cps):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = CLASS[cps]
    new = np.empty(len(cps), bool)
    new[0] = True
    new[1:] = cls[1:] != cls[:-1]
    if not spaced:
        new |= cls == NUMBER
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(cps))
    kind = cls[starts]
    apostrophe = np.flatnonzero((kind[:-1] == OTHER) & (ends[:-1] - starts[:-1] == 1) & (cps[starts[:-1]] == 39) & (kind[1:] == LETTER))
    extra = None
    if spaced:
        apostrophe = apostrophe[(starts[apostrophe] == 0) | (cps[starts[apostrophe] - 1] != 32)]
        s = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != BREAK))
        at = cps[ends[s] - 1] == 32
        joins, alone = s[at], s[~at]
        alone = alone[ends[alone] - starts[alone] > 1]
        extra = ends[alone] - 1, ends[alone].copy()
        ends[joins] -= 1
        starts[joins + 1] -= 1
        ends[alone] -= 1
    if len(apostrophe):
        first = cps[starts[apostrophe + 1]]
        second = np.where(ends[apostrophe + 1] - starts[apostrophe + 1] > 1, cps[np.minimum(starts[apostrophe + 1] + 1, len(cps) - 1)], 0)
        take = np.isin(first, [ord(c) for c in SINGLE]).astype(np.int64)
        for a, b in DOUBLE:
            take[(first == ord(a)) & (second == ord(b))] = 2
        ends[apostrophe] += take
        starts[apostrophe + 1] += take
    keep = (ends > starts) & (kind != BREAK)
    if not spaced:
        keep &= kind != SPACE
    starts, ends = starts[keep], ends[keep]
    if extra is not None and len(extra[0]):
        starts, ends = np.concatenate([starts, extra[0]]), np.concatenate([ends, extra[1]])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    return starts, ends


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable stand-in of each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


class Vocabulary:
    """A tokenizers file with a cache of the ids of whole pre-tokens, bounded in bytes and emptied when a task ends."""

    MOST = 25_000_000  # bytes of cached pre-tokens in a worker, about; beyond it the cache starts anew

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.lower = spec["normalizer"] is not None
        self.spaced = not self.lower
        self.letters = np.array([ord(c) for _, c in sorted(byte_letters().items())], np.uint16)
        self.names = {i: t for t, i in self.tokenizer.get_vocab().items()} if self.lower else {}
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 14, np.uint32)
        self.begin = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)
        self.used = self.bytes = 0
        self.shown: list[bytes] = []

    def safe(self, text: str) -> bool:
        if any(s in text for s in self.specials):
            return False
        return text.isascii() or all((CLASS[np.minimum(codes(text[at : at + LONG]), 0xFFFE)] != 255).all() for at in range(0, len(text), LONG))

    def word(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(self.lettered(word))]

    def lettered(self, text: str) -> str:
        return self.letters[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")

    def add(self, words: list[str]) -> None:
        """Encodes distinct pre-tokens that the cache doesn't hold."""
        if not words:
            return
        tokenize = self.model.tokenize
        # No pre-token holds the separator, so all are turned into letters at once.
        found = [[t.id for t in tokenize(x)] for x in self.lettered(SEPARATOR.join(words)).split(self.lettered(SEPARATOR))]
        n, ids, size = len(self.shown), np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
        while n + len(words) > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.begin[n : n + len(words)], self.count[n : n + len(words)] = self.used + np.cumsum(size) - size, size
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.shown += [" ".join(map(self.names.__getitem__, x)).encode() for x in found] if self.lower else [b""] * len(words)
        self.bytes += 250 * len(words) + 4 * sum(map(len, words)) + 4 * len(ids)
        self.index.update(zip(words, range(n, n + len(words)), strict=True))

    def lookup(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Cache places of the pre-tokens; unseen ones are encoded. Hashes group equal pre-tokens; that they are equal is
        then compared, and the cache goes by the pre-tokens themselves."""
        if self.bytes > self.MOST:
            self.clear()
        data = np.concatenate([cps, np.zeros(2, np.uint32)]).view(np.uint8)
        _, first, inverse = np.unique(slice_hashes(data, 4 * starts, 4 * ends, 255), return_index=True, return_inverse=True)
        text = str(cps.tobytes(), "utf-32-le", "surrogatepass")
        if not same_slices(data, 4 * starts, 4 * ends, first[inverse]).all():
            first, inverse = np.arange(len(starts)), np.arange(len(starts))
        words = [text[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        self.add([w for w in dict.fromkeys(words) if w not in self.index])
        return np.array([self.index[w] for w in words], np.int64)[inverse]

    def expand(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the cached pre-tokens one after another, and where each one's ids begin (one more at the end)."""
        n = self.count[places]
        offsets = np.zeros(len(places) + 1, np.int64)
        np.cumsum(n, out=offsets[1:])
        at = np.arange(offsets[-1]) + np.repeat(self.begin[places] - offsets[:-1], n)
        return self.flat[at], offsets

    def normal(self, cps: np.ndarray) -> np.ndarray:
        return LOWER[cps] if self.lower else cps

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text, as the library gives them without added special tokens."""
        out: list[np.ndarray | None] = [None] * len(texts)
        group: list[int] = []
        size = 0

        def flush() -> None:
            for i, ids in zip(group, self._encode([texts[i] for i in group]), strict=True):
                out[i] = ids
            group.clear()

        for i, t in enumerate(texts):
            if not self.safe(t):
                out[i] = self.by_library(t)
            elif len(t) > LONG:
                out[i] = np.concatenate([self._encode([p])[0] for p in pieces_of(t)])
            else:
                group.append(i)
                size += len(t) + 1
                if size > LONG:
                    flush()
                    size = 0
        if group:
            flush()
        return out  # type: ignore[return-value]

    def by_library(self, text: str) -> np.ndarray:
        return np.concatenate([np.asarray(self.tokenizer.encode(p, add_special_tokens=False).ids, np.uint32) for p in pieces_of(text)])

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        cps = self.normal(codes(SEPARATOR.join(texts)))
        starts, ends = split(cps, self.spaced)
        ids, offsets = self.expand(self.lookup(cps, starts, ends))
        bounds = np.cumsum([len(t) + 1 for t in texts])
        cut = offsets[np.concatenate([[0], np.searchsorted(starts, bounds)])]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


_MADE: dict[tuple[Callable, str], object] = {}


def of_worker(kind: Callable, path: str):
    """One kind(path) in a worker, until its task ends."""
    if (kind, path) not in _MADE:
        _MADE[kind, path] = kind(path)
    return _MADE[kind, path]


CACHES.append(_MADE.clear)
