"""Words, lines and n-grams of whole Arrow batches, hashed with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. All separators
are ASCII, so splitting the UTF-8 bytes equals splitting the code points. Words
are hashed by a polynomial over a 64-bit ring with a random value per byte: one
prefix sum per block gives the hash of every word, with no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are hashed at once; longer texts make a block of their own.
BLOCK_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection whose output bits look random."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the prime, or of its inverse."""
    if len(_powers[kind]) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), U(_PRIME if kind == "up" else _INVERSE))
        steps[0] = U(1)
        with np.errstate(over="ignore"):
            _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


@dataclass
class Block:
    """Some texts as one buffer: data, and offsets[i]:offsets[i + 1] of text i, the rows first, first + 1, ..."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def pieces(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each maximal run of bytes that are inside, never across texts."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        full = self.offsets[:-1] < self.offsets[1:]
        opens, shuts = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        shuts[:-1] &= ~inside[1:]
        first, last = self.offsets[:-1][full], self.offsets[1:][full] - 1
        opens[first], shuts[last] = inside[first], inside[last]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
        return starts, ends, np.searchsorted(self.offsets[1:], starts, "right")

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.pieces(~_SPACE[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lines that are not empty."""
        return self.pieces(self.data != 10)

    def sums(self, lower: bool) -> np.ndarray:
        """Prefix sums from which span() takes the hash of any piece."""
        out = np.zeros(len(self.data) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum((_LOWER if lower else _BYTES)[self.data] * _power("up", len(self.data)), out=out[1:])
        return out


def span(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each piece; equal bytes have equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * _power("down", len(sums))[starts] + (ends - starts).astype(U))


def grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows inside one text, and the number of the first word of each."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    g = np.zeros(len(at), U)
    with np.errstate(over="ignore"):
        for k in range(n):
            g = mix(g * U(3) + h[at + k] + U(k + 1))
    return g, at


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column, in order, some at a time; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield Block(a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


def bounds(doc: np.ndarray, n: int) -> np.ndarray:
    """Where each of n texts begins among items whose text numbers rise."""
    return np.searchsorted(doc, np.arange(n + 1))
