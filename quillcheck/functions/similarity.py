"""String and vector similarity.

The string score is the indel ratio ``2 * LCS(a, b) / (len(a) + len(b))``. One pair costs
a bit-parallel pass over the shorter text; a block of values is scored against one probe
with the same pass run over a NumPy array of bit masks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# Workers get the helpers below by value and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_WORD_BITS = 64


def token_sorted(c: Column) -> Column:
    """Lower-case ASCII words of the text in alphabetical order, joined by one blank."""
    ascii_only = F.regexp_replace(c, r"[^\x{0}-\x{7f}]", "")
    words = F.split(F.trim(F.lower(F.regexp_replace(ascii_only, r"[^A-Za-z0-9_]+", " "))), " ")
    # A single word, as most values are, is in order.
    return F.when(F.rlike(c, F.lit(r"^[A-Za-z0-9_]+\z")), F.lower(c)).otherwise(F.array_join(F.array_sort(words), " "))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; Python integers serve as bit rows of any width."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(b):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(b)) - 1
    row = full
    for ch in a:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def _codes(values: list[str], width: int) -> np.ndarray:
    """Characters as numbers, one row per value, 0 beyond its end."""
    out = np.zeros((len(values), width), dtype=np.uint32)
    size = np.array([len(v) for v in values], dtype=np.int64)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(values)), size), place] = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return out


def _words(length: int) -> int:
    return max(-(-length // _WORD_BITS), 1)


def _bits(equal: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    return np.packbits(equal, axis=1, bitorder="little").view(np.uint64)


def _step(row: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """One character of the recurrence for rows of one or more words; the sum carries from word to word."""
    hit = row & mask
    if row.shape[1] == 1:
        return (row + hit) | (row - hit)
    total, carry = np.empty_like(row), np.zeros(len(row), dtype=np.uint64)
    for w in range(row.shape[1]):
        part = row[:, w] + hit[:, w]
        total[:, w] = part + carry
        carry = ((part < row[:, w]) | (total[:, w] < part)).astype(np.uint64)
    return total | (row - hit)


def _inside(lengths: np.ndarray, words: int) -> np.ndarray:
    """The bits of the places that a value has."""
    return _bits(np.arange(words * _WORD_BITS) < lengths[:, None])


class ValueBlock:
    """Some hundred or thousand strings prepared for scoring against many probes, grouped by the words their bits take."""

    def __init__(self, values: Iterable[str]):
        self.values = list(values)
        self.lengths = np.array([len(v) for v in self.values], dtype=np.int64)
        words = np.maximum(-(-self.lengths // _WORD_BITS), 1)
        self.groups = []
        for w in np.unique(words).tolist():
            at = np.flatnonzero(words == w)
            codes = _codes([self.values[i] for i in at], w * _WORD_BITS)
            masks = {chr(c): _bits(codes == c) for c in np.unique(codes) if c}
            self.groups.append((at, masks, _inside(self.lengths[at], w)))

    def lcs(self, probe: str, among: np.ndarray | None = None) -> np.ndarray:
        """LCS with every value, or with those of the (sorted) places ``among``."""
        out = np.zeros(len(self.values), dtype=np.int64)
        for at, masks, inside in self.groups:
            some = slice(None) if among is None else np.searchsorted(at, among[np.isin(among, at, assume_unique=True)])
            full = inside[some]
            row = np.full(full.shape, ~np.uint64(0))
            for ch in probe:
                mask = masks.get(ch)
                if mask is not None:
                    row = _step(row, mask[some])
            out[at[some]] = np.bitwise_count(~row & full).sum(axis=1)
        return out if among is None else out[among]

    def ratio(self, probe: str, among: np.ndarray | None = None) -> np.ndarray:
        total = (self.lengths if among is None else self.lengths[among]) + len(probe)
        return np.where(total > 0, 2.0 * self.lcs(probe, among) / np.maximum(total, 1), 0.0)

    def percent(self, probe: str, among: np.ndarray | None = None) -> np.ndarray:
        """The ratio rounded to whole percent; an empty side scores 0."""
        if not probe:
            return np.zeros(len(self.values) if among is None else len(among))
        return np.rint(100.0 * self.ratio(probe, among)) / 100.0


def lcs_pairs(a: list[str], b: list[str], at_once: int = 4096) -> np.ndarray:
    """LCS of a[i] and b[i] for every i: the same recurrence, run side by side for pairs of like lengths."""
    out = np.zeros(len(a), dtype=np.int64)
    la, lb = (np.array([len(x) for x in side], dtype=np.int64) for side in (a, b))
    order = np.lexsort((la, -(-lb // _WORD_BITS)))
    at = 0
    while at < len(order):
        words = _words(int(lb[order[at]]))
        size = max(at_once // words, 1)
        rows = order[at : at + size]
        rows = rows[np.maximum(-(-lb[rows] // _WORD_BITS), 1) == words]
        at += len(rows)
        left = _codes([a[i] for i in rows], int(la[rows].max()))
        right = _codes([b[i] for i in rows], words * _WORD_BITS)
        row = np.full((len(rows), words), ~np.uint64(0))
        for j in range(left.shape[1]):  # rows are sorted by the length of a
            live = int(np.searchsorted(la[rows], j, side="right"))
            row[live:] = _step(row[live:], _bits(right[live:] == left[live:, j, None]))
        out[rows] = np.bitwise_count(~row & _inside(lb[rows], words)).sum(axis=1)
    return out


@F.pandas_udf(IntegerType())
def _lcs_column(a: pd.Series, b: pd.Series) -> pd.Series:
    known = a.notna() & b.notna()
    out = pd.Series([None] * len(a), dtype="Int32")
    out[known.to_numpy()] = lcs_pairs(a[known].tolist(), b[known].tolist())
    return out


def indel_ratio(a: Column, b: Column) -> Column:
    """``2 * LCS / (len + len)``, 0 for two empty strings, null where one is missing."""
    total = F.length(a) + F.length(b)
    return F.when(total > 0, F.lit(2.0) * _lcs_column(a, b) / total).when(total == 0, F.lit(0.0))


def token_sort_score(a: Column, b: Column) -> Column:
    """Indel ratio of the token-sorted texts, in whole percent, 0..1."""
    left, right = token_sorted(a), token_sorted(b)
    empty = (F.length(left) == 0) | (F.length(right) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(F.bround(indel_ratio(left, right) * 100, 0) / 100)
