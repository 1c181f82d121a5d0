"""Words of texts and hashes of their n-grams, for whole batches of texts at once.

A word is a maximal run of characters other than the space and U+0009 to U+000D. All of these are single bytes in
UTF-8, so the batch is handled as bytes.
"""

from __future__ import annotations

import numpy as np

from lodestar.llm.hashing import run_hashes, slice_hashes

U = np.uint64
BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = b"\n" * 9


class Words:
    """Words of a batch of texts: data (bytes; a line feed after each text), starts, ends, and first[d] to
    first[d + 1] as the words of text d."""

    def __init__(self, texts: list[str | None], lower: bool = False) -> None:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        bounds = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=bounds[1:])
        self.data = np.frombuffer(b"\n".join([*raw, _GAP]), np.uint8)
        del raw
        edges = []
        if lower:
            self.data = _LOWER[self.data]
        for at in range(0, len(self.data), BLOCK):  # the last byte of the block before decides whether the first one is an edge
            inside = ~_SPACE[self.data[max(at - 1, 0) : at + BLOCK]]
            found = np.flatnonzero(inside[1:] != inside[:-1]) + max(at - 1, 0) + 1
            edges.append(np.concatenate([[0], found]) if not at and inside[0] else found)
        edge = np.concatenate(edges)
        self.starts, self.ends = edge[0::2].copy(), edge[1::2].copy()
        self.bounds = bounds
        self.first = np.searchsorted(self.starts, bounds)
        self.n = np.diff(self.first)

    def hash(self, seed: int = 0) -> np.ndarray:
        """64 bits of each word."""
        return slice_hashes(self.data, self.starts, self.ends, 32, seed)

    def doc(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.n)), self.n)

    def room(self) -> np.ndarray:
        """For each word, how many words of its text stand from it on."""
        return np.repeat(self.first[1:], self.n) - np.arange(len(self.starts))

    def grams(self, k: int, seed: int = 0) -> np.ndarray:
        """Hashes of the k words from each place on, whatever texts they are in; k - 1 fewer than words."""
        return run_hashes(self.hash(seed), k)

    def kept_texts(self, keep: np.ndarray) -> list[str]:
        """The kept words of each text joined by one space."""
        s, e = self.starts[keep], self.ends[keep]
        turn = np.zeros(len(self.data) + 1, np.int8)
        turn[s] += 1
        turn[e] -= 1
        use = np.cumsum(turn[:-1], dtype=np.int8).astype(bool)
        data = self.data.copy()
        use[e] = True
        data[e] = 32
        out = data[use].tobytes()
        size = np.concatenate([[0], np.cumsum(e - s + 1)])
        cut = size[np.searchsorted(s, self.bounds)]
        return [out[a : max(a, b - 1)].decode("utf-8", "surrogatepass") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
