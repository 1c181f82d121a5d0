"""How well a query fits into names when characters may be left out: the best alignment's score, for batches of names.

Every character of the query must occur in the name in its order, in any case. The score of an alignment is the sum over its
characters of

* 16, less 2 if the case differs,
* a bonus for the place: 8 at the name's start, 7 after a character that is no letter or digit, 6 for a capital or a digit
  after another kind of character; 4 at least if the character before is aligned too; twice the bonus for the first one,

less 3 for the first and 1 for each further name character that is left out between two aligned ones. What stands before
the first and after the last aligned character is free. A query character at a time, all names of a batch are one matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.names import has_subsequence

MATCH, OTHER_CASE, FIRST_GAP, NEXT_GAP, HEAD, AFTER_BREAK, CAPITAL, TOGETHER = 16, 2, 3, 1, 8, 7, 6, 4
NEVER, CELLS = -(1 << 28), 1 << 20


def lower_codes(codes: np.ndarray) -> np.ndarray:
    """Code points in lower case; those whose lower case is longer than a character stay."""
    own, back = np.unique(codes, return_inverse=True)
    low = [ord(chr(c).lower()) if c < 0x110000 and len(chr(c).lower()) == 1 else c for c in own.tolist()]
    return np.array(low, np.int64)[back].reshape(codes.shape)


def flags(codes: np.ndarray, test) -> np.ndarray:
    own, back = np.unique(codes, return_inverse=True)
    return np.array([test(chr(c)) for c in own.tolist()], bool)[back].reshape(codes.shape)


def scores(names: list[str], query: str) -> np.ndarray:
    """The best score of each name, NEVER or less if it doesn't hold the query. An empty query scores 0."""
    out = np.full(len(names), NEVER, np.int64)
    if not query:
        return np.zeros(len(names), np.int64)
    order = sorted(range(len(names)), key=lambda i: len(names[i]))
    at = 0
    while at < len(order):  # names of like lengths, of at most CELLS characters together
        end = at + 1
        while end < len(order) and (end + 1 - at) * max(len(names[order[end]]), 1) <= CELLS:
            end += 1
        out[order[at:end]] = matrix_scores([names[i] for i in order[at:end]], query)
        at = end
    return out


def matrix_scores(names: list[str], query: str) -> np.ndarray:
    width = max(map(len, names))
    if not width:
        return np.full(len(names), NEVER, np.int64)
    codes = np.zeros((len(names), width), np.int64)
    for i, name in enumerate(names):
        codes[i, : len(name)] = np.frombuffer(name.encode("utf-32-le", "surrogatepass"), "<u4")
    low, asked = lower_codes(codes), np.frombuffer(query.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    upper, digit, word = flags(codes, str.isupper), flags(codes, str.isdigit), flags(codes, str.isalnum)
    before = lambda x: np.concatenate([np.zeros((len(names), 1), bool), x[:, :-1]], 1)
    turn = upper & before(word & ~upper) | digit & before(word & ~digit)
    bonus = np.where(~before(word), AFTER_BREAK, np.where(turn, CAPITAL, 0))
    bonus[:, 0] = HEAD
    place = np.arange(width)
    last, skipped = None, None
    for c in asked.tolist():
        equal = low == lower_codes(np.array([c]))[0]
        own = np.where(equal, MATCH - OTHER_CASE * (codes != c), NEVER)
        if last is None:
            now = own + 2 * bonus
        else:
            together = np.concatenate([np.full((len(names), 1), NEVER), last[:, :-1]], 1) + np.maximum(bonus, TOGETHER)
            apart = np.concatenate([np.full((len(names), 1), NEVER), skipped[:, :-1]], 1) + bonus
            now = own + np.maximum(together, apart)
        last = np.maximum(now, NEVER)
        # skipped[j]: the best score with the last aligned character before j, which is left out itself.
        run = np.maximum.accumulate(last + NEXT_GAP * place, 1) - NEXT_GAP * place
        skipped = np.concatenate([np.full((len(names), 1), NEVER), run[:, :-1] - FIRST_GAP], 1)
    return last.max(1)


def aligned(symbols: DataFrame, query: str) -> DataFrame:
    """id, name, alignment (long) of the symbols whose name holds the query's characters in order; only these reach Python."""
    held = symbols.where(has_subsequence(F.lower("name"), query.lower())).select("id", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).dictionary_encode()
            found = scores(own.dictionary.to_pylist(), query) if len(own.dictionary) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found[own.indices.to_numpy(zero_copy_only=False)] if len(own) else found, pa.int64())], names=["id", "name", "alignment"])

    return held.where("name is not null").mapInArrow(run, "id string, name string, alignment long")
