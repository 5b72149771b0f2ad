"""An inverted index of texts by two-letter grams, for partners at a high similarity.

Two texts whose indel ratio reaches the index's ``ratio`` share a number of grams that follows from their lengths alone. A
text is filed (gram, length, text) under as many of its rarest grams as that number asks for; a text that is asked looks its
own rarest grams up, for each length that a partner can have. The equi-join loses no pair; it drops those whose signatures (64
bits, one set for each gram) show that too few grams are shared, and every other pair is scored once, in batches. Where two lengths need not share any gram (very short texts, low ratios), all texts of that length
are candidates.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcheck.functions.similarity import lcs_pairs
from quillcheck.session import settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LETTERS = 97  # characters are told apart by their code modulo this, exactly so for lower-case ASCII; others may only add candidates
_GRAMS = LETTERS * LETTERS
ANY = -1  # what texts are filed under whose partners need not share a gram, as very short ones
_TIMES = 4  # a gram's first, second, third and later occurrences are ranked apart
_AT_ONCE = 1 << 14  # texts worked on together


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letter numbers of all texts, row of each letter, length of each text)."""
    column = texts.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    plain = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    if not (plain >= 128).any():
        size = np.diff(bounds)
        return plain.astype(np.int64) % LETTERS, np.repeat(np.arange(len(size)), size), size
    values = texts.to_pylist()
    size = np.array([len(v) for v in values], dtype=np.int64)
    letters = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) % LETTERS
    return letters, np.repeat(np.arange(len(values)), size), size


def letter_counts(texts: pa.Array) -> np.ndarray:
    letters, row, size = flat(texts)
    return np.bincount(row * LETTERS + letters, minlength=len(size) * LETTERS).reshape(len(size), LETTERS)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, length of each text): pairs of neighbours, told apart by their number of earlier occurrences in the text."""
    letters, row, size = flat(texts)
    inside = row[:-1] == row[1:] if len(row) else np.zeros(0, bool)
    pair, row = (letters[:-1] * LETTERS + letters[1:])[inside], row[:-1][inside]
    order = np.lexsort((pair, row))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (pair[order][1:] != pair[order][:-1]) | (row[order][1:] != row[order][:-1])
    first = np.flatnonzero(new)
    times = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    gram = np.empty(len(order), dtype=np.int64)
    gram[order] = times * _GRAMS + pair[order]
    return row, gram, size


def signatures(row: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
    """64 bits for each of ``n`` texts, one set for each of its grams; a bit that another text lacks is a gram that it lacks."""
    out = np.zeros(n, dtype=np.int64)
    if len(row):
        bit = (gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        out[row[first]] = np.bitwise_or.reduceat(np.uint64(1) << bit, first).view(np.int64)
    return out


def _class(gram: np.ndarray) -> np.ndarray:
    return np.minimum(gram // _GRAMS, _TIMES - 1) * _GRAMS + gram % _GRAMS


def shared_grams(a: np.ndarray, b: np.ndarray, ratio: float) -> np.ndarray:
    """The least number of grams that partners of these lengths share; -1 where none can reach the ratio.

    With a common subsequence of L letters, len(b) - L letters of b go and break two grams each at most, and len(a) - L
    come in and break one each: 3 L - len(a) - len(b) - 1 of the len(b) - 1 grams are left.
    """
    total = a + b
    common = np.ceil(ratio * total / 2 - 1e-9).astype(np.int64)
    return np.where(common <= np.minimum(a, b), np.maximum(3 * common - total - 1, 0), -1)


def partner_lengths(size: int, ratio: float) -> np.ndarray:
    reach = np.arange(max(int(size * ratio / (2 - ratio)), 1), int(size * (2 - ratio) / ratio) + 2)
    return reach[shared_grams(np.full(len(reach), size), reach, ratio) >= 0]


def _rarest(row: np.ndarray, gram: np.ndarray, rank: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep[r]`` rarest grams of every row r."""
    order = np.lexsort((gram, rank[_class(gram)], row))
    row, gram = row[order], gram[order]
    chosen = np.arange(len(row)) - np.searchsorted(row, np.arange(len(keep)))[row] < keep[row]
    return row[chosen], gram[chosen]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _AT_ONCE):
            yield batch.slice(at, _AT_ONCE)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_TIMES * _GRAMS, dtype=np.int64)
    for batch in _parts(batches):
        total += np.bincount(_class(grams(batch.column(0))[1]), minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])


def _posted(rank: np.ndarray, ratio: float) -> Callable:
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            row, gram, size = grams(batch.column(0))
            bits = signatures(row, gram, len(size))
            keep, any_ = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=bool)
            for s in np.unique(size).tolist():
                reach = partner_lengths(s, ratio)
                shared = shared_grams(np.full(len(reach), s), reach, ratio)
                keep[size == s] = s - min(shared[shared > 0].tolist(), default=s)
                any_[size == s] = (shared == 0).any()
            row, gram = _rarest(row, gram, rank, keep)
            row, gram = np.concatenate([row, np.flatnonzero(any_)]), np.concatenate([gram, np.full(int(any_.sum()), ANY)])
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(size[row]), batch.column(0).take(pa.array(row)), pa.array(bits[row])], names=["gram", "size", "text", "bits"])

    return post


def _asked(rank: np.ndarray, seen: np.ndarray, sizes: np.ndarray, ratio: float) -> Callable:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            row, gram, size = grams(batch.column(0))
            bits = signatures(row, gram, len(size))
            for s in np.unique(size).tolist():
                mine = size[row] == s
                for other in np.intersect1d(partner_lengths(s, ratio), sizes).tolist():
                    least = int(shared_grams(np.array([s]), np.array([other]), ratio)[0])
                    if least:
                        at, wanted = _rarest(row[mine], gram[mine], rank, np.full(len(size), s - least))
                        there = seen[_class(wanted)]  # nothing is filed under the others
                        at, wanted = at[there], wanted[there]
                    else:
                        at = np.flatnonzero(size == s)
                        wanted = np.full(len(at), ANY)
                    spare = pa.array(np.full(len(at), s - 1 - least))
                    yield pa.RecordBatch.from_arrays([pa.array(wanted), pa.array(np.full(len(at), other)), batch.column(0).take(pa.array(at)), pa.array(bits[at]), spare], names=["gram", "size", "asked", "own", "spare"])

    return ask


def _scored(ratio: float) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            a, b = (batch.column(c).to_pylist() for c in ("asked", "text"))
            total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
            found = np.where(total > 0, 2.0 * lcs_pairs(a, b) / np.maximum(total, 1), 0.0)
            ok = pa.array(np.flatnonzero(found >= ratio))
            yield pa.RecordBatch.from_arrays([batch.column("asked").take(ok), batch.column("text").take(ok), pa.array(found).take(ok)], names=["asked", "text", "ratio"])

    return score


def write_now(label: str, make: Callable[[], DataFrame]) -> DataFrame:
    return settled(make(), label)


class GramIndex:
    """Distinct texts (a DataFrame with a column ``text``) filed for partners at ``ratio`` or more.

    ``gate``: an expression of the texts that partners have in common, by name (``{"head": ...}`` of a column). ``write(label,
    make)`` stores a table; the default writes it for this job.
    """

    def __init__(self, texts: DataFrame, ratio: float, write: Callable[[str, Callable[[], DataFrame]], DataFrame] = write_now, gate: dict[str, Callable] | None = None):
        self.texts, self.ratio, self.write, self.gate = texts, ratio, write, gate or {}

    @cached_property
    def frequency(self) -> np.ndarray:
        """The number of texts under each gram, a table of fixed size."""
        found = self.write("gram-counts", lambda: self.texts.mapInArrow(_counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
        n = np.zeros(_TIMES * _GRAMS, dtype=np.int64)
        for row in found.collect():  # as many rows as there are grams
            n[row["gram"]] = row["n"]
        return n

    @cached_property
    def rank(self) -> np.ndarray:
        n = self.frequency
        out = np.empty(len(n), dtype=np.int64)
        out[np.lexsort((np.arange(len(n)), n))] = np.arange(len(n))
        return out

    @cached_property
    def postings(self) -> DataFrame:
        """(gram, size, gates, text, bits)."""

        def make() -> DataFrame:
            posted = self.texts.select("text").mapInArrow(_posted(self.rank, self.ratio), "gram long, size long, text string, bits long")
            return posted.withColumns({g: f(F.col("text")) for g, f in self.gate.items()}).sortWithinPartitions("gram", "size")

        return self.write("postings", make)

    @cached_property
    def lengths_of_lists(self) -> DataFrame:
        """(gram, size, gates, n): how many texts are filed under each."""
        return self.write("posting-counts", lambda: self.postings.groupBy("gram", "size", *self.gate).agg(F.count(F.lit(1)).alias("n")))

    @cached_property
    def sizes(self) -> np.ndarray:
        """The distinct lengths of texts that have a gram."""
        return np.array(sorted(r[0] for r in self.lengths_of_lists.select("size").distinct().collect()), dtype=np.int64)

    def questions(self, asked: DataFrame) -> DataFrame:
        """(gram, size, gates, asked, own, spare): what each distinct text ``asked`` looks up, its signature and how many of its grams a partner may lack."""
        rows = asked.select("asked").where("asked <> ''").mapInArrow(_asked(self.rank, self.frequency > 0, self.sizes, self.ratio), "gram long, size long, asked string, own long, spare long")
        return rows.withColumns({g: f(F.col("asked")) for g, f in self.gate.items()})

    def partners(self, asked: DataFrame, most: int | None = None) -> DataFrame:
        """(asked, text, ratio) of all pairs that reach the ratio; ``asked`` is distinct.

        With ``most`` a text with more candidates than that is left out altogether.
        """
        on = ["gram", "size", *self.gate]
        rows = settled(self.questions(asked), "asked-grams")
        if most is not None:
            told = rows.join(self.lengths_of_lists, on).groupBy("asked").agg(F.sum("n").alias("n"))
            many = told.where(F.col("n") > most).select("asked")
            rows = rows.join(many, "asked", "left_anti")
        # Both lack as many grams of the other as their lengths and the shared grams leave.
        alike = F.expr("bit_count(own & ~bits) <= spare AND bit_count(bits & ~own) <= spare + size - length(asked)")
        pairs = rows.join(self.postings, on).where(alike).select("asked", "text").distinct()
        return pairs.mapInArrow(_scored(self.ratio), "asked string, text string, ratio double")

