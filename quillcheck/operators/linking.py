"""Which column values does a text mention?

A mention is a run of whole words of the text whose indel ratio with a value reaches the threshold and that begins with the
same sign. Runs come out of a generator in batches, each with the number of its text, only those that a sieve of fixed size
lets through: some value has their head, a length that a partner can have and enough of their grams. No row holds all runs of a text. Distinct runs look values up in an index by grams (``grams``), which loses
no pair, and each distinct pair is scored once. Values that are numbers are no mentions and aren't in that index. Texts are told apart by digest and joined back at the end.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quillcheck.functions.text import number_or_null
from quillcheck.functions.wordlists import COMMON_WORDS, DATABASE_TERMS, LONG_BOOLEANS, STOP_WORDS
from quillcheck.operators.grams import LETTERS, GramIndex, flat, partner_lengths, shared_grams, write_now
from quillcheck.operators.skew import salted_join
from quillcheck.session import settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The characters that end a word, the score a mention must reach and how many
# mentions of a column are shown.
SEPARATORS = "'\"()`,.?! "
THRESHOLD = 0.85
TOP_K = 2

_SEP = r"['\"()`,.?! ]"
_NOT_SEP = r"[^'\"()`,.?! ]"


def head(c: Column) -> Column:
    """The first character that is no separator."""
    return F.left(F.regexp_replace(c, f"^{_SEP}+", ""), F.lit(1))


def word_pieces(c: Column) -> Column:
    """Words of the lower-cased text, each with the separators that follow it."""
    return F.regexp_extract_all(F.lower(F.trim(c)), F.lit(f"{_NOT_SEP}+{_SEP}*"), F.lit(0))


def owner(c: Column) -> Column:
    """The word in front of the first ``'s``, in lower case; null where there is none. The apostrophe ends a word, so the owner is a span of its own."""
    pieces = word_pieces(c)
    found = F.filter(pieces, lambda w, i: w.endswith("'") & F.startswith(F.get(pieces, i + 1), F.lit("s ")))
    return F.regexp_replace(F.get(found, F.lit(0)), "'$", "")


_WORD = re.compile(f"{_NOT_SEP}+{_SEP}*")
_ROWS_AT_ONCE = 8192


def runs(text: str, lengths: Sequence[int] | None = None) -> Iterator[str]:
    """Runs of whole words of the lower-cased text, without the separators that end them, of two letters or more.

    ``lengths``: sorted lengths that count; the others are passed over without being put together.
    """
    lower = text.strip(" ").lower()
    words = [(m.start(), m.start() + len(m.group().rstrip(SEPARATORS))) for m in _WORD.finditer(lower)]
    wanted = None if lengths is None else np.asarray(lengths, dtype=np.int64)
    ends = np.array([e for _, e in words], dtype=np.int64)
    for i, (start, _) in enumerate(words):
        if wanted is None:
            last = ends[i:]
        else:
            last = ends[i : int(np.searchsorted(ends, start + (wanted[-1] if len(wanted) else 0), side="right"))]
            last = last[np.isin(last - start, wanted)]
        for end in last.tolist():
            if end - start > 1:
                yield lower[start:end]


SIEVE_BITS = 1 << 23  # the size of the sieve; a fuller one only lets more runs through
_LETTERS_AT_ONCE = 1 << 16  # letters of texts worked on together
_CELLS_AT_ONCE = 1 << 20
_ENDS_WORD = np.isin(np.arange(128), [ord(c) for c in SEPARATORS])  # all of them are ASCII; the last place is none


def _place(first: np.ndarray, size: np.ndarray | int, pair: np.ndarray) -> np.ndarray:
    mixed = (np.asarray(size, dtype=np.uint64) * np.uint64(LETTERS) + first.astype(np.uint64)) * np.uint64(LETTERS * LETTERS) + pair.astype(np.uint64)
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - SIEVE_BITS.bit_length())).astype(np.int64)


def _sieved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, bits): words of the sieve that hold any of the values; below zero a length and head that there is."""
    seen, kinds = np.zeros(SIEVE_BITS, dtype=bool), np.zeros(0, dtype=np.int64)
    for batch in batches:
        column = batch.column(0)
        first = np.array([ord(v[0]) % LETTERS if v else -1 for v in (v.lstrip(SEPARATORS) for v in column.to_pylist())], dtype=np.int64)
        letters, row, size = flat(column)
        inside = row[:-1] == row[1:] if len(row) else np.zeros(0, bool)
        inside &= first[row[:-1]] >= 0
        of = row[:-1][inside]
        seen[_place(first[of], size[of], (letters[:-1] * LETTERS + letters[1:])[inside])] = True
        kinds = np.union1d(kinds, -1 - (size * LETTERS + first)[first >= 0])
    words = np.packbits(seen, bitorder="little").view(np.int64)
    at = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, kinds])), pa.array(np.concatenate([words[at], np.ones(len(kinds), np.int64)]))], names=["at", "bits"])


class Sieve:
    """Tells which runs of words can have a partner: some value of their head and a fitting length has enough of their grams.

    Partners at the index's ratio have their head in common and share a number of grams that follows from their lengths
    (``shared_grams``). A bitmap of fixed size holds (head, length, gram) of all values; a run passes for a length if that many of its
    grams are there. Nothing is lost; a few runs without a partner pass.
    """

    def __init__(self, ratio: float, words: np.ndarray, kinds: np.ndarray):
        """``words``: the bitmap; ``kinds``: length * LETTERS + head of all values."""
        self.ratio, self.words = ratio, words
        self.sizes = {int(m): np.isin(np.arange(LETTERS), kinds[kinds // LETTERS == m] % LETTERS) for m in np.unique(kinds // LETTERS)}
        self.longest = max((int(partner_lengths(m, ratio).max(initial=0)) for m in self.sizes), default=0)
        self._bits: np.ndarray | None = None

    @staticmethod
    def of(index: GramIndex) -> Sieve:
        found = index.write("sieve", lambda: index.texts.select("text").mapInArrow(_sieved, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")))
        rows = found.toPandas()  # the words of the bitmap, and a row per length and head
        at, bits = rows["at"].to_numpy(np.int64), rows["bits"].to_numpy(np.int64)
        words = np.zeros(SIEVE_BITS // 64, dtype=np.int64)
        words[at[at >= 0]] = bits[at >= 0]
        return Sieve(index.ratio, words, -1 - at[at < 0])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_bits": None}

    def runs(self, texts: Sequence[str]) -> Iterator[tuple[int, str]]:
        """(place of the text, run) for the runs (see ``runs``) that pass, each once per text."""
        if self._bits is None:
            self._bits = np.unpackbits(self.words.view(np.uint8), bitorder="little").view(bool)
        lower = [text.strip(" ").lower() for text in texts]
        offsets = np.cumsum([0, *map(len, lower)])
        whole = "".join(lower)
        plain = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        inside = ~_ENDS_WORD[np.minimum(plain, 127)]
        edge = np.zeros(len(plain) + 1, dtype=bool)
        edge[offsets] = True
        starts = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
        ends = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
        if not len(starts):
            return
        of = np.searchsorted(offsets, starts, side="right") - 1
        codes = plain.astype(np.int64) % LETTERS
        pair = np.append(codes[:-1] * LETTERS + codes[1:], 0)
        stop = np.searchsorted(of, of, side="right")  # behind the last word of the text
        passed = [self._of_size(m, heads, starts, ends, stop, codes, pair) for m, heads in self.sizes.items()]
        chosen = np.unique(np.concatenate(passed)) if passed else np.zeros(0, np.int64)
        last, seen = -1, set()
        for i, j in zip((chosen // len(ends)).tolist(), (chosen % len(ends)).tolist(), strict=True):
            if of[i] != last:
                last, seen = int(of[i]), set()
            run = whole[starts[i] : ends[j]]
            if run not in seen:
                seen.add(run)
                yield last, run

    def _of_size(self, m: int, heads: np.ndarray, starts: np.ndarray, ends: np.ndarray, stop: np.ndarray, codes: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """First word * number of words + last word, of the runs that may have a partner of ``m`` letters."""
        reach = partner_lengths(m, self.ratio)
        reach = reach[reach > 1]
        if not len(reach):
            return np.zeros(0, np.int64)
        need = np.zeros(int(reach[-1]) + 1, dtype=np.int64)
        need[reach] = shared_grams(np.full(len(reach), m), reach, self.ratio)
        i = np.flatnonzero(heads[codes[starts]])
        low = np.searchsorted(ends, starts[i] + reach[0])
        high = np.minimum(np.searchsorted(ends, starts[i] + reach[-1], side="right"), stop[i])
        i, low, high = i[low < high], low[low < high], high[low < high]
        out = [np.zeros(0, np.int64)]
        width = int(reach[-1]) - 1
        step = max(1, _CELLS_AT_ONCE // width)
        for k in range(0, len(i), step):
            some, n = i[k : k + step], (high - low)[k : k + step]
            at = np.minimum(starts[some][:, None] + np.arange(width), len(pair) - 1)
            held = np.cumsum(self._bits[_place(codes[starts[some]][:, None], m, pair[at])], axis=1, dtype=np.int32)
            row = np.repeat(np.arange(len(some)), n)
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[k : k + step][row]
            size = ends[j] - starts[some][row]
            ok = held[row, size - 2] >= need[size]
            out.append(some[row[ok]] * len(ends) + j[ok])
        return np.concatenate(out)


def _sieved_rows(sieve: Sieve, id_type: pa.DataType) -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _LETTERS_AT_ONCE, side="right")))
                part = batch.slice(at, end - at)
                found = sieve.runs(part.column(1).to_pylist())
                while rows := list(islice(found, _ROWS_AT_ONCE)):
                    ids = part.column(0).take(pa.array([k for k, _ in rows], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids.cast(id_type), pa.array([run for _, run in rows], pa.string())], names=["of", "span"])
                at = end

    return each


def _run_rows(lengths: Sequence[int] | None, id_type: pa.DataType) -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found = [], []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(found, pa.string())], names=["of", "span"])

        for batch in batches:
            for of, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen = set()
                for run in runs(text.as_py() or "", lengths):
                    if run not in seen:
                        seen.add(run)
                        ids.append(of)
                        found.append(run)
                        if len(found) >= _ROWS_AT_ONCE:
                            yield rows()
                            ids, found = [], []
        yield rows()

    return each


def digest(text: Column) -> Column:
    """What a text is named by where the text itself needn't be."""
    return F.unhex(F.sha2(text, 256)).alias("of")


def spans(texts: DataFrame, text: str, lengths: Sequence[int] | Sieve | None = None) -> DataFrame:
    """(of, span): the distinct runs of whole words of every distinct text, named by its digest; see ``runs``. With a sieve only those that pass."""
    named = texts.select(digest(F.col(text)), F.col(text).alias("text")).where("text IS NOT NULL").dropDuplicates(["of"])
    rows = _sieved_rows if isinstance(lengths, Sieve) else _run_rows
    return named.mapInArrow(rows(lengths, pa.binary()), "of binary, span string")


def of_text(texts: DataFrame, text: str, found: DataFrame) -> DataFrame:
    """``found`` with the text itself in place of its digest ``of``."""
    named = texts.select(digest(F.col(text)), text).dropDuplicates(["of"])
    return named.join(found, "of").select(text, *[c for c in found.columns if c != "of"])


def key_index(keys: DataFrame, threshold: float = THRESHOLD, write: Callable = write_now) -> GramIndex:
    """The values (``key``, distinct) filed for partners at the threshold that begin with the same sign."""
    return GramIndex(keys.select(F.col("key").alias("text")), threshold - 1e-9, write, {"head": head})


def span_lengths(index: GramIndex) -> list[int]:
    """The lengths that partners of some value can have; as many numbers as the longest value has letters, at most twice."""
    sizes = [r[0] for r in index.texts.select(F.length("text")).distinct().collect()]
    return sorted({int(n) for s in sizes for n in partner_lengths(int(s), index.ratio)})


def close_pairs(span_list: DataFrame, keys: DataFrame | GramIndex, threshold: float = THRESHOLD) -> DataFrame:
    """(span, key, score) of all pairs that share their head and reach the threshold.

    span_list has ``span``, keys has ``key`` (or is their index); both distinct. Each pair is scored once.
    """
    index = keys if isinstance(keys, GramIndex) else key_index(keys, threshold)
    found = index.partners(span_list.select(F.col("span").alias("asked")))
    same = head(F.col("asked")) == head(F.col("text"))
    return found.where(same).select(F.col("asked").alias("span"), F.col("text").alias("key"), F.col("ratio").alias("score"))


_PAIRS_AT_ONCE = 512


def _codes(texts: list[str], pad: int) -> np.ndarray:
    """Code points, one text a row, filled up with ``pad``."""
    out = np.full((len(texts), max(map(len, texts), default=0)), pad, dtype=np.int64)
    for row, text in zip(out, texts):
        row[: len(text)] = [ord(c) for c in text]
    return out


def longest_runs(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Place in a[i] and length of the longest text that a[i] and b[i] share, earliest first, for many pairs at once.

    One step for each character of the longest a: how far the run that ends there reaches back, at every place of b.
    """
    left, right = _codes(a, -1), _codes(b, -2)
    reach = np.zeros((len(a), right.shape[1] + 1), dtype=np.int32)
    at, size = np.zeros(len(a), dtype=np.int32), np.zeros(len(a), dtype=np.int32)
    for i in range(left.shape[1]):
        reach[:, 1:] = np.where(left[:, i : i + 1] == right, reach[:, :-1] + 1, 0)
        here = reach.max(axis=1)
        better = here > size
        size[better], at[better] = here[better], i + 1 - here[better]
    return at, size


@F.pandas_udf(StructType([StructField("at", IntegerType()), StructField("size", IntegerType())]))
def longest_run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    order = np.argsort(a.str.len().to_numpy() + b.str.len().to_numpy(), kind="stable")  # texts of like length together
    out = np.zeros((len(a), 2), dtype=np.int32)
    for k in range(0, len(order), _PAIRS_AT_ONCE):
        rows = order[k : k + _PAIRS_AT_ONCE]
        out[rows, 0], out[rows, 1] = longest_runs(a.iloc[rows].tolist(), b.iloc[rows].tolist())
    return pd.DataFrame(out, columns=["at", "size"])


def is_number(c: Column) -> Column:
    return number_or_null(F.replace(c, F.lit(","), F.lit(""))).isNotNull()


def usable(run: Column, span: Column, key: Column, score: Column) -> Column:
    """No numbers, no database terms, no stop words, and common words only when exact."""

    def among(words: Sequence[str]) -> Column:
        return run.isin(*words) | span.isin(*words) | key.isin(*words)

    return (
        (F.length(run) > 0)
        & ~is_number(run)
        & ~run.isin(*DATABASE_TERMS)
        & ~among(STOP_WORDS)
        & (~among(COMMON_WORDS) | (score >= 1))
    )


def all_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def keys_of(index: DataFrame) -> DataFrame:
    """The distinct values as they are compared: trimmed, in lower case, not empty."""
    return index.select(F.lower(F.trim("value")).alias("key")).filter(F.length("key") > 0).distinct()


def mentionable(keys: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The ``keys`` without plain numbers, which no text can mention: a mention's run is a piece of the key, and a run that is a number isn't ``usable``.

    Every piece of ``125`` is a number, and every piece of ``-12.5`` that has two letters. At the threshold a run has two: of the T
    letters of key and span d <= 0.15 T are unmatched, so the (T - d) / 2 matched pairs lie in d + 1 runs at most, which is
    less than (T - d) / 2 from T = 4 on, and a shorter key that is a number has one digit. At lower scores only digits alone are left out.
    """
    number = r"^-?[0-9]+(?:\.[0-9]+)?\z" if threshold >= THRESHOLD else r"^[0-9]+\z"
    return keys.where(~F.rlike("key", F.lit(number)))


def scored_pairs(found: DataFrame, keys: GramIndex) -> DataFrame:
    """(span, key, score, run_at, run_size, run): usable pairs of the runs ``found`` (of, span) and indexed values."""
    pairs = close_pairs(found.select("span").distinct(), keys).withColumn("r", longest_run(F.col("key"), F.col("span")))
    run = F.trim(F.substr("key", F.col("r.at") + 1, F.col("r.size")))
    return pairs.select(
        "span", "key", "score", F.col("r.at").alias("run_at"), F.col("r.size").alias("run_size"), run.alias("run")
    ).filter(usable(F.col("run"), F.col("span"), F.col("key"), F.col("score")))


def mentions(texts: DataFrame, text: str, index: DataFrame, threshold: float = THRESHOLD, keys: GramIndex | None = None) -> DataFrame:
    """(text, tbl, col, value, score, run_size): each value a text mentions, at its best span.

    Works per distinct text. Values written all in capitals count only when exact. Where several values of a column
    share the same matched run, the last in order stands for all. A null or empty text mentions nothing. ``keys``: the
    values' index by grams, if there is one already.
    """
    return of_text(texts, text, named_mentions(texts, text, index, threshold, keys))


def named_mentions(texts: DataFrame, text: str, index: DataFrame, threshold: float = THRESHOLD, keys: GramIndex | None = None) -> DataFrame:
    """``mentions`` with the ``digest`` of each text, ``of``, in place of the text."""
    keys = key_index(mentionable(keys_of(index), threshold), threshold) if keys is None else keys
    found = settled(spans(texts, text, Sieve.of(keys)), "spans")
    pairs = settled(scored_pairs(found, keys), "pairs")
    named = index.select("tbl", "col", F.trim("value").alias("value"), F.lower(F.trim("value")).alias("key"))
    hits = pairs.join(named, "key").filter((F.col("score") >= 1) | ~all_upper(F.col("value")))
    best = F.max(F.struct("score", "run_size", F.substr("value", F.col("run_at") + 1, "run_size").alias("run")))
    per_value = salted_join(found, hits, ["span"]).groupBy("of", "tbl", "col", "value").agg(best.alias("m"))
    last = F.max(F.struct("value", F.col("m.score").alias("score"), F.col("m.run_size").alias("run_size")))
    per_run = per_value.groupBy("of", "tbl", "col", F.col("m.run").alias("run")).agg(last.alias("l"))
    return per_run.select("of", "tbl", "col", "l.value", "l.score", "l.run_size")


def top_mentions(found: DataFrame, text: str, k: int = TOP_K) -> DataFrame:
    """The k best mentions per text and column; a column of names wants exact ones."""
    order = Window.partitionBy(text, "tbl", "col").orderBy(F.desc("score"), F.desc("run_size"), "value")
    return (
        found.filter(~F.contains(F.col("col"), F.lit("name")) | (F.col("score") >= 1))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= k)
    )


def always_shown(index: DataFrame) -> DataFrame:
    """(tbl, col, values): the values of columns with one value, or two short ones.

    Two values at most are kept, as the least and the greatest.
    """
    sizes = index.groupBy("tbl", "col").agg(
        F.count_distinct("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    short = (F.length("low") <= 3) | F.lower("low").isin(*LONG_BOOLEANS)
    shown = ((F.col("n") == 1) & (F.col("low") != "")) | ((F.col("n") == 2) & short)
    return sizes.filter(shown).select("tbl", "col", F.array_distinct(F.array("low", "high")).alias("values"))


def quoted(values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit('"'), v, F.lit('"')))


def linked_values(texts: DataFrame, text: str, index: DataFrame, keys: GramIndex | None = None) -> DataFrame:
    """(text, tbl, col, values): the best mentions of each column, in order, at most TOP_K."""
    return of_text(texts, text, named_linked_values(texts, text, index, keys))


def named_linked_values(texts: DataFrame, text: str, index: DataFrame, keys: GramIndex | None = None) -> DataFrame:
    """``linked_values`` with the ``digest`` of each text, ``of``, in place of the text: long texts move once, to be made distinct."""
    top = top_mentions(named_mentions(texts, text, index, keys=keys), "of")
    listed = F.array_sort(F.collect_list(F.struct("place", "value")))
    return top.groupBy("of", "tbl", "col").agg(F.transform(listed, lambda x: x["value"]).alias("values"))
