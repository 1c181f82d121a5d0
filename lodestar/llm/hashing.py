"""64-bit hashes of many slices of a buffer at once, and of runs of consecutive hashes.

A slice is read in lanes of 8 bytes, the last one padded with a byte that no slice holds. A slice of one lane has a hash
of its own (the mixing is a bijection); longer ones are mixed lane by lane, so that no linear relation between texts
survives. Slices of more than LANES lanes go through BLAKE2b. Hashes of different seeds come from the bytes anew.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
LANES, BLOCK = 32, 1 << 18
#: Two seeds for hashes of 128 bits.
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], U)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of each ordered pair of hashes."""
    return mixed(mixed(a * U(0x9E3779B97F4A7C15) + U(0x632BE59BD9B4E019)) ^ (b * U(0xD6E8FEB86659FD93)))


def lanes_of(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of the data on, without the last 8 places."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pad: int, seed: int = 0) -> np.ndarray:
    """Hashes of the byte slices starts..ends. data needs 8 more bytes after the last slice."""
    out = np.empty(len(starts), U)
    view, fill = lanes_of(data), U(int.from_bytes(bytes([pad]) * 8, "little"))
    for lo in range(0, len(starts), BLOCK):
        s, size = starts[lo : lo + BLOCK], (ends - starts if len(starts) <= BLOCK else ends[lo : lo + BLOCK] - starts[lo : lo + BLOCK])
        keep = _KEEP[np.minimum(size, 8)]
        h = mixed(((view[s] & keep) | (fill & ~keep)) ^ U(SEEDS[seed]))
        long = np.flatnonzero(size > 8 * LANES)
        rest = np.flatnonzero((size > 8) & (size <= 8 * LANES))
        k = 8
        while len(rest):
            keep = _KEEP[np.minimum(size[rest] - k, 8)]
            h[rest] = paired(h[rest], (view[s[rest] + k] & keep) | (fill & ~keep))
            k += 8
            rest = rest[size[rest] > k]
        for i in long.tolist():
            digest = hashlib.blake2b(data[s[i] : s[i] + size[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little"))
            h[i] = int.from_bytes(digest.digest(), "little")
        out[lo : lo + BLOCK] = h
    return out


def same_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each slice whether it is equal to that at the place other[i] among the slices."""
    size = ends - starts
    same = size == size[other]
    view, k = lanes_of(data), 0
    rest = np.flatnonzero(same & (size > 0) & (other != np.arange(len(starts))))
    while len(rest) and k < 8 * LANES:
        keep = _KEEP[np.minimum(size[rest] - k, 8)]
        equal = (view[starts[rest] + k] ^ view[starts[other[rest]] + k]) & keep == 0
        same[rest[~equal]] = False
        k += 8
        rest = rest[equal & (size[rest] > k)]
    for i in rest.tolist():
        same[i] = data[starts[i] : ends[i]].tobytes() == data[starts[other[i]] : ends[other[i]]].tobytes()
    return same


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k hashes from each place on (k >= 1); len(h) - k + 1 of them. By doubling: runs of 2, 4, 8, ...
    from two of half the length, and at last two that overlap."""
    if len(h) < k:
        return np.zeros(0, U)
    size = 1
    while 2 * size <= k:
        h, size = paired(h[:-size], h[size:]), 2 * size
    return paired(h[: len(h) - (k - size)], h[k - size :]) if k > size else h
