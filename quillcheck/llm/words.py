"""Words of whole texts and hashes of word windows, for many texts at once.

A word is a run of bytes other than blank and 0x09-0x0D, which is what ``bytes.split()`` cuts. All functions work on
one flat buffer that holds the texts one after the other, so a batch costs a few NumPy passes and no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GOLDEN = 0x9E3779B97F4A7C15
_SLAB = 1 << 18  # words hashed at a time


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: spreads every input bit over all 64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(_GOLDEN))


_BYTE = seeded(1, 256)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def portions(column: pa.Array, most: int = 4 << 20) -> Iterator[pa.Array]:
    """The column in runs of rows with about ``most`` bytes of text each (a longer text is a run of its own)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        begun = int(size[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(size, begun + most, side="right")))
        yield column.slice(at, to - at)
        at = to


class Texts:
    """The texts of an Arrow column as one buffer; a null counts as empty.

    ``data``: bytes of all texts; ``starts``/``ends``: byte places of every word; ``first``: for text i the number of
    its first word, so that its words are ``first[i]:first[i + 1]``.
    """

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = False):
        column = column.cast(pa.large_binary())
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
        if column.null_count:
            column = column.fill_null(b"")
        n = len(column)
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = whole[bounds[0] : bounds[-1]]
        if lower:
            self.data = _LOWER[self.data]
        bounds = bounds - bounds[0]
        inside = ~BLANK[self.data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        seams = bounds[1:-1]
        seams = seams[(seams > 0) & (seams < len(inside))]
        begins[seams] |= inside[seams]
        stops[seams - 1] |= inside[seams - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.bounds = bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        for a in range(0, len(out), _SLAB):
            s, e = self.starts[a : a + _SLAB], self.ends[a : a + _SLAB]
            out[a : a + _SLAB] = self._hash(s, e)
        return out

    def _hash(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        size = e - s
        firsts = np.cumsum(size) - size
        rel = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(firsts, size)
        with np.errstate(over="ignore"):
            value = _BYTE[self.data[rel + np.repeat(s, size)]] * powers(0x2545F4914F6CDD1D, int(size.max()))[rel]
            return mix(np.add.reduceat(value, firsts) + size.astype(np.uint64) * np.uint64(_GOLDEN))

    def joined(self, a: int, n: int) -> bytes:
        """The n words from word a on, joined by blanks."""
        return b" ".join(self.data[self.starts[a] : self.ends[a + n - 1]].tobytes().split())


def window_starts(first: np.ndarray, size: int, n_words: int) -> np.ndarray:
    """True at each word that begins a window of ``size`` words of one text."""
    ok = np.zeros(n_words, dtype=bool)
    last = np.minimum(first[1:] - size, n_words)
    long = last >= first[:-1]
    if long.any():
        edge = np.zeros(n_words + 1, dtype=np.int64)
        np.add.at(edge, first[:-1][long], 1)
        np.add.at(edge, last[long] + 1, -1)
        ok = np.cumsum(edge[:-1]) > 0
    return ok


def windows(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` words from each word on (the last size - 1 entries mean nothing)."""
    base = int(seeded(seed, 1)[0]) | 1
    out = np.zeros(len(words), dtype=np.uint64)
    n = len(words) - size + 1
    if n <= 0:
        return out
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(base, len(words)), dtype=np.uint64)])
        out[:n] = mix((run[size:] - run[:-size]) * powers(pow(base, -1, 1 << 64), n) + np.uint64(seed))
    return out
