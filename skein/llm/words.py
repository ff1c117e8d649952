"""Words of Arrow string columns as numpy arrays: bounds and 64-bit hashes, without a Python object for each word.

A word is a run of bytes other than 0x20 and 0x09-0x0D; bytes of non-ASCII characters always belong to words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of BASE and of its inverse, grown when a text is longer than all before."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = _powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)
        return self.up, self.down


POWERS = _Powers()


@dataclass
class Words:
    """Words of some texts, in order. doc: first word of each text and, last, their number."""

    bytes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    def hashes(self) -> np.ndarray:
        """Equal words get equal hashes; sums of byte times power of place, shifted to the word's start."""
        up, down = POWERS.of(len(self.bytes) + 1)
        total = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[: len(self.bytes)], out=total[1:])
        return mixed((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.doc)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc) - 1), self.counts())

    def word(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.end[i]].tobytes()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0] if len(at) else np.zeros(1, np.int64)


def split(body: np.ndarray, at: np.ndarray, breaks: np.ndarray = SPACE, lower: bool = True) -> Words:
    """breaks: which bytes stand between words."""
    gap = breaks[body]
    first = ~gap
    first[1:] &= gap[:-1]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(body))]
    first[edge] = ~gap[edge]
    last = ~gap
    last[:-1] &= gap[1:]
    last[edge - 1] = ~gap[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(LOWER[body] if lower else body, start, end, np.searchsorted(start, at))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows in slices of about `limit` bytes (a longer text alone): slice, bytes, offsets."""
    body, at = raw(column)
    n, low = len(at) - 1, 0
    while low < n:
        high = max(low + 1, min(low + 4096, int(np.searchsorted(at, at[low] + limit, "right")) - 1))
        yield slice(low, high), body[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words of each text, in order, with each text's first and, last, their number.

    A text with fewer words, but some, has one: all its words.
    """
    h, n = words.hashes(), words.counts()
    grams = np.maximum(n - size + 1, (n > 0).astype(n.dtype))
    first = np.concatenate([[0], np.cumsum(grams)])
    at = np.repeat(words.doc[:-1] - first[:-1], grams) + np.arange(first[-1])
    short = np.repeat(n < size, grams)
    out = np.zeros(first[-1], np.uint64)
    left = np.repeat(words.doc[1:], grams) - at
    for k in range(size):
        here = ~short | (left > k)
        out = np.where(here, mixed(out * np.uint64(BASE) + h[np.minimum(at + k, max(len(h) - 1, 0))]) if len(h) else out, out)
    return np.where(short, ~out, out), first


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each segment's distinct values, sorted, with the new bounds. Values keep their upper 52 bits (at most 4096 segments)."""
    n = len(first) - 1
    seg = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    keys = np.sort((seg << np.uint64(52)) | (values >> np.uint64(12)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    keys = keys[new]
    bounds = np.searchsorted(keys >> np.uint64(52), np.arange(n + 1, dtype=np.uint64))
    return keys & np.uint64((1 << 52) - 1), bounds
