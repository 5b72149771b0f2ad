"""Near-duplicate documents by 64-bit SimHash.

Fingerprints that differ in at most two bits are found by bit-sliced comparison. Distinct fingerprints are dealt into
blocks by every choice of two of their four 16-bit quarters (two that differ in at most two bits agree in two quarters
at least). In a block, bit k of all its fingerprints is one row of machine words: a bit plane. One pass over the 64
planes updates the distances of a whole row of fingerprints at once, with two carry-save counter planes and a third
for "more than two"; where all of a tile's distances have passed the radius, it is abandoned.

From a block only a spanning forest of its links leaves the task. A block that very many distinct fingerprints share
is cut in parts of bounded size, and each pair of parts is a task's work of its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcheck.llm import free_prefix
from quillcheck.llm.components import components
from quillcheck.session import settled

RADIUS = 2
SHINGLE = 3
SEED = 42
_QUARTERS = [0xFFFF << s for s in (0, 16, 32, 48)]
_BANDS = [a | b for a, b in itertools.combinations(_QUARTERS, 2)]
_ROWS = 2048  # fingerprints compared at once, in columns of bits
_TILE = 128  # of which so many are looked up together
_EACH = 8  # planes between two looks at whether a tile can be abandoned
_PART = 1 << 15  # most fingerprints of a block that one task compares with so many others
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the XXH64 values of a text's shingles, repeats included; no words: 0; fewer than a shingle: all words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, dtype=np.int64), len(words) - k + 1
    for a in range(0, n, 1 << 16):
        spans = zip(starts[a : min(a + (1 << 16), n)].tolist(), ends[a + k - 1 : min(a + (1 << 16), n) + k - 1].tolist(), strict=True)
        values = np.array([digest(line[s:e], SEED) for s, e in spans], dtype="<u8")
        total += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * total > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fp) and the columns in ``keep``: fp holds the 64 bits as a signed long."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    kinds = [f"{c} {slim.schema[c].dataType.simpleString()}" for c in keep]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *keep])

    return slim.mapInArrow(each, ", ".join(["doc_id long", "fp long", *kinds]))


def planes(fps: np.ndarray) -> np.ndarray:
    """64 rows: row k holds bit k of all fingerprints, 64 to a machine word (the last one filled up with zeros)."""
    padded = np.zeros(-(-len(fps) // 64) * 64, dtype="<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # fingerprint x bit
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(queries: np.ndarray, table: np.ndarray, n: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(query, column) of all pairs at ``radius`` (at most 3) or less; ``table``: planes of n fingerprints."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    shape = (len(queries), table.shape[1])
    ones, twos, over = (np.zeros(shape, dtype=np.uint64) for _ in range(3))
    for k in range(64):
        bit = np.where((queries >> np.uint64(k)) & np.uint64(1), full, np.uint64(0))
        differs = table[k][None, :] ^ bit[:, None]
        carry = ones & differs
        ones ^= differs
        over |= twos & carry
        twos ^= carry
        if k % _EACH == _EACH - 1:
            beyond = over | (twos & ones) if radius == 2 else over | twos if radius == 1 else over
            if (beyond == full).all():
                return np.empty(0, np.int64), np.empty(0, np.int64)
    near = np.unpackbits(np.ascontiguousarray(~beyond, dtype="<u8").view(np.uint8), axis=1, bitorder="little")[:, :n]
    return np.nonzero(near)


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the sets of a[i] and b[i]; ``root`` leads from each member to the least of its set."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def _forest(fps: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that tie together whatever close pairs tie together, within ``fps`` and between it and ``others``."""
    both = np.concatenate([fps, others])
    root = np.arange(len(both))
    for q in range(0, len(fps), _TILE):  # a tile with itself: never abandoned, so it is kept apart
        tile = fps[q : q + _TILE]
        a, b = within(tile, planes(tile), len(tile))
        _joined(root, a + q, b + q)
    for at in range(0, len(fps), _ROWS):
        block = fps[at : at + _ROWS]
        table = planes(block)
        for q in range(0, len(fps), _TILE):
            skip = max(q + _TILE - at, 0)  # only with what comes after the tile
            if skip < len(block):
                a, b = within(fps[q : q + _TILE], table[:, skip // 64 :], len(block) - skip)
                _joined(root, a + q, b + at + skip)
    for at in range(0, len(others), _ROWS):  # planes of their own: ``fps`` may end inside a tile
        block = others[at : at + _ROWS]
        table = planes(block)
        for q in range(0, len(fps), _TILE):
            a, b = within(fps[q : q + _TILE], table, len(block))
            _joined(root, a + q, b + len(fps) + at)
    tied = np.flatnonzero(root != np.arange(len(both)))
    return both[tied], both[root[tied]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, lo, hi, fp), those of a block together: compares runs of rows with each other, and each run with
    what came before it in a block that goes on."""
    held_key, held = None, np.empty(0, np.uint64)  # earlier rows of the block that is still open
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
        fps = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), _ROWS):
            key, run = keys[:, at : at + _ROWS], fps[at : at + _ROWS]
            same = (key == held_key[:, None]).all(axis=0) if held_key is not None else np.zeros(len(run), bool)
            a, b = _forest(run, np.empty(0, np.uint64))
            if same.any():
                more = _forest(run[same], held)
                a, b = np.concatenate([a, more[0]]), np.concatenate([b, more[1]])
            last = (key == key[:, -1:]).all(axis=0)
            held = np.concatenate([held, run[last]]) if held_key is not None and (key[:, -1] == held_key).all() else run[last]
            held_key = key[:, -1]
            a, b = a[a != b], b[a != b]  # a fingerprint meets itself where its blocks are neighbours
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): enough links of fingerprints at two bits or less to connect all that such links connect.

    ``distinct`` holds each fingerprint once, in column fp.
    """
    bands = F.array(*(F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))).alias("bits")) for i, m in enumerate(_BANDS)))
    rows = distinct.select("fp", F.explode(bands).alias("x")).select("fp", F.xxhash64("x.band", "x.bits").alias("block"))
    large = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > _PART)
    parts = F.coalesce(F.ceil(F.col("n") / _PART), F.lit(1)).cast("int")
    cut = rows.join(large, "block", "left").select("block", "fp", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"))
    tiles = cut.select("block", "fp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = tiles.select("block", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "fp")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "block", "lo", "hi").sortWithinPartitions("block", "lo", "hi").mapInArrow(_compare, "a long, b long")


def _members(distinct: DataFrame) -> DataFrame:
    """``distinct`` with the component (a fingerprint) of every fingerprint."""
    groups = components(links(distinct.select("fp")))
    return distinct.join(groups, distinct["fp"] == groups["node"], "left").select(*distinct.columns, F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the least doc_id that can be reached, its own included) for every row.

    A null or wordless text has fingerprint 0, linked like any other. Repeated rows are copies of each other. A null
    doc_id takes part but is nobody's component_id unless a component has no other; an empty table gives no rows;
    other columns are not read. Fingerprints are written once to the shared folder.
    """
    marked = settled(fingerprints(docs, id_col, text_col), "fingerprints")
    members = _members(settled(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct"))
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    named = members.join(least, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with one of each group of near copies, columns unchanged.

    That with the least doc_id stays, rows without one come last; of rows that share it, that with the least digest of
    its text, and of rows that share both, one. Each group is judged on its own, whatever ids its rows have. A null
    text counts as an empty one, and all texts without words are copies of each other; an empty table gives no rows;
    helper columns have names that the table doesn't, in any case of letters.
    """
    tag = free_prefix(docs.columns, "__kept")
    mine, digest = f"{tag}_id", f"{tag}_digest"
    keyed = docs.select("*", F.col("doc_id").cast("long").alias(mine), F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias(digest))
    marked = fingerprints(keyed.select(mine, digest, "text"), mine, keep=[digest])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col(digest).alias("digest")))
    members = _members(settled(marked.groupBy("fp").agg(first.alias("first")), "distinct"))
    stay = members.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.id").alias(f"{tag}_own"), F.col("first.digest").alias(f"{tag}_of"))
    kept = keyed.join(stay, F.col(mine).eqNullSafe(F.col(f"{tag}_own")) & (F.col(digest) == F.col(f"{tag}_of")), "left_semi")
    return kept.dropDuplicates([mine, digest]).drop(mine, digest)
