"""Removal of long word sequences that occur more than once in a corpus, exactly.

Method: fixed-block anchors. Every text is cut into non-overlapping reference blocks of ``(size + 1) // 2`` words, so
that a window of ``size`` words holds one whole block. The blocks are indexed; all rolling windows of block length
probe the index. A block that meets no second place rules out every window around it. Around the others, hits are
extended to windows of full length and compared in full (96-bit hashes of word sequences plus the place by range);
overlapping repeated windows join into maximal repeats, whose words go.

Nothing is paired: both steps count equal keys. Keys travel packed, one row for each (chunk of documents, range of
hash values), and each is there once per chunk whatever its number of copies, so that a passage held by a third of the
corpus costs no task more than its share. What comes back to a chunk is one bit per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcheck.llm.words import Texts, window_starts, windows

SIZE = 35
CHUNK_BYTES = 4 << 20  # text handled at once by a Python worker
RANGE_BYTES = 16 << 20  # text whose keys make up one range of hashes: about three million keys, whatever the corpus
_CELL = "bucket int, chunk long, kind int, n long, keys binary, flags binary"
_CELL_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("flags", pa.binary())])
_ANCHOR, _WINDOW = 0, 1


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _planes(sorted_keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys as differences, byte plane by byte plane, which compresses well."""
    return np.diff(sorted_keys.astype("<u4"), prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes, n: int) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8).reshape(4, n).T.copy().view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32)


def _bucket(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """The range that a hash falls into; ranges follow the order of hashes."""
    return ((h >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)


class _Chunk:
    """The windows of one chunk of documents. All sets are sorted, so the order of documents doesn't matter."""

    def __init__(self, column: pa.ChunkedArray, size: int, n_buckets: int):
        self.size, self.block, self.n_buckets = size, (size + 1) // 2, n_buckets
        self.texts = Texts(column)
        words = self.texts.hashes()
        first = self.texts.first
        n = len(words)
        rolling = windows(words, self.block, 11)
        self.rolls = window_starts(first, self.block, n)
        begin = np.repeat(first[:-1], np.diff(first))  # of each word's text
        place = np.arange(n) - begin
        self.aligned = self.rolls & (place % self.block == 0)
        self.anchor_key = (_bucket(rolling, n_buckets) << np.uint64(32)) | (rolling & np.uint64(0xFFFFFFFF))
        self.anchors = np.unique(self.anchor_key[self.aligned])
        self.full = np.flatnonzero(window_starts(first, size, n))
        at = place[self.full]
        self.own_block = begin[self.full] + -(-at // self.block) * self.block
        self.words = words

    def anchor_cells(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """By range of hashes: (bucket, n, keys, flags); the flags say which are blocks and which occur again here."""
        keys, counts = np.unique(self.anchor_key[self.rolls], return_counts=True)
        is_block = np.zeros(len(keys), dtype=bool)
        is_block[np.searchsorted(keys, self.anchors)] = True
        edges = np.searchsorted(keys, np.arange(self.n_buckets + 1, dtype=np.uint64) << np.uint64(32))
        for b in range(self.n_buckets):
            a, e = edges[b], edges[b + 1]
            if e > a:
                yield b, e - a, _planes(keys[a:e] & np.uint64(0xFFFFFFFF)), _bits(np.concatenate([is_block[a:e], counts[a:e] > 1]))

    def anchor_hits(self, rows: dict[int, bytes]) -> np.ndarray:
        """Of all blocks (sorted, distinct): which have a second place."""
        hit = np.zeros(len(self.anchors), dtype=bool)
        edges = np.searchsorted(self.anchors, np.arange(self.n_buckets + 1, dtype=np.uint64) << np.uint64(32))
        for b, bits in rows.items():
            hit[edges[b] : edges[b + 1]] = _flags(bits, edges[b + 1] - edges[b])
        return hit

    def extended(self, hit: np.ndarray) -> None:
        """Extends hits to the windows around them; keeps those windows' distinct keys, sorted."""
        near = np.zeros(len(self.words), dtype=bool)
        if len(hit):
            near[self.aligned] = hit[np.searchsorted(self.anchors, self.anchor_key[self.aligned])]
        self.starts = self.full[near[self.own_block]] if len(self.full) else self.full
        one = windows(self.words, self.size, 21)[self.starts]
        two = (windows(self.words, self.size, 22)[self.starts] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.ones(len(one), dtype=bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        group = np.cumsum(new) - 1
        self.group = np.empty(len(one), dtype=np.int64)
        self.group[order] = group
        self.one, self.two = one[new], two[new]
        self.again = np.bincount(group, minlength=len(self.one)) > 1
        self.edges = np.searchsorted(_bucket(self.one, self.n_buckets), np.arange(self.n_buckets + 1, dtype=np.uint64))

    def window_cells(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        for b in range(self.n_buckets):
            a, e = self.edges[b], self.edges[b + 1]
            if e > a:
                keys = np.concatenate([self.one[a:e].astype("<u8").view(np.uint8), self.two[a:e].astype("<u4").view(np.uint8)])
                yield b, e - a, keys.tobytes(), _bits(self.again[a:e])

    def removed(self, rows: dict[int, bytes]) -> np.ndarray:
        """True for each word within a window that is repeated."""
        repeated = np.zeros(len(self.one), dtype=bool)
        for b, bits in rows.items():
            repeated[self.edges[b] : self.edges[b + 1]] = _flags(bits, self.edges[b + 1] - self.edges[b])
        starts = self.starts[repeated[self.group]]
        edge = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.size, -1)
        return np.cumsum(edge[:-1]) > 0


def _cells(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CELL_SCHEMA)], schema=_CELL_SCHEMA)


def _by_bucket(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: bits for b, k, bits in zip(table["bucket"].to_pylist(), table["kind"].to_pylist(), table["flags"].to_pylist(), strict=True) if k == kind}


def _count_anchors(table: pa.Table) -> pa.Table:
    """Within one range of hashes: for each chunk, which of its blocks occur in a second place."""
    cells = table.to_pylist()
    keys = [_from_planes(c["keys"], c["n"]) for c in cells]
    marks = [_flags(c["flags"], 2 * c["n"]) for c in cells]
    _, which = np.unique(np.concatenate(keys), return_inverse=True)
    again = np.concatenate([m[len(k) :] for k, m in zip(keys, marks, strict=True)])
    total = np.bincount(which) + np.bincount(which, weights=again).astype(np.int64)
    out, at = [], 0
    for c, k, m in zip(cells, keys, marks, strict=True):
        hit = (total[which[at : at + len(k)]] > 1)[m[: len(k)]]
        at += len(k)
        if hit.any():
            out.append((c["bucket"], c["chunk"], _ANCHOR, len(hit), None, _bits(hit)))
    return _cells(out)


def _count_windows(table: pa.Table) -> pa.Table:
    """The same for whole windows; what chunks know of their blocks passes through."""
    cells = table.to_pylist()
    out = [tuple(c.values()) for c in cells if c["kind"] == _ANCHOR]
    cells = [c for c in cells if c["kind"] == _WINDOW]
    if not cells:
        return _cells(out)
    one = np.concatenate([np.frombuffer(c["keys"], "<u8", c["n"]) for c in cells])
    two = np.concatenate([np.frombuffer(c["keys"], "<u4", c["n"], 8 * c["n"]) for c in cells])
    again = np.concatenate([_flags(c["flags"], c["n"]) for c in cells])
    order = np.lexsort((two, one))
    new = np.ones(len(one), dtype=bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    group = np.empty(len(one), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    total = np.bincount(group) + np.bincount(group, weights=again).astype(np.int64)
    repeated, at = total[group] > 1, 0
    for c in cells:
        mine = repeated[at : at + c["n"]]
        at += c["n"]
        if mine.any():
            out.append((c["bucket"], c["chunk"], _WINDOW, c["n"], None, _bits(mine)))
    return _cells(out)


def without_repeats(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by blanks) for every row.

    A word goes if a window of ``size`` words around it begins anywhere else too: in another document, in a repeated
    row, or again in the same text. Windows are judged on the input. A null text has no words; a null id is kept and
    counts as a document of its own; other columns are not read; an empty table gives no rows. Texts may be of any
    length (a chunk holds whole texts, so one text of x bytes needs about 12x of a worker's memory).
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = max(1, -(-total // chunk_bytes))
    n_buckets = max(1, -(-total // range_bytes))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    chunked = slim.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).alias("chunk"), "doc_id", "text")

    def index(key: tuple, table: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        return _cells([(b, chunk, _ANCHOR, n, keys, flags) for b, n, keys, flags in _Chunk(table["text"], size, n_buckets).anchor_cells()])

    def extend(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows or not found.num_rows:
            return _cells([])
        chunk, number = _Chunk(table["text"], size, n_buckets), key[0].as_py()
        hit = chunk.anchor_hits(_by_bucket(found, _ANCHOR))
        chunk.extended(hit)
        rows = [(b, number, _WINDOW, n, keys, flags) for b, n, keys, flags in chunk.window_cells()]
        return _cells([*rows, (number % n_buckets, number, _ANCHOR, len(hit), None, _bits(hit))])

    def apply(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        texts, gone = None, None
        if found.num_rows and table.num_rows:
            chunk = _Chunk(table["text"], size, n_buckets)
            hits = _by_bucket(found, _ANCHOR)
            chunk.extended(_flags(*hits.values(), len(chunk.anchors)))
            texts, gone = chunk.texts, chunk.removed(_by_bucket(found, _WINDOW))
        n_words, n_removed, kept = [], [], []
        for i, text in enumerate(table["text"].to_pylist()):
            words = (text or "").encode().split()
            mine = gone[texts.first[i] : texts.first[i + 1]] if texts is not None else np.zeros(len(words), bool)
            n_words.append(len(words))
            n_removed.append(int(mine.sum()))
            if n_removed[-1]:
                stay = np.flatnonzero(~mine).tolist()
                words = [words[k] for k in stay]
            kept.append(b" ".join(words).decode())
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    anchors = chunked.groupBy("chunk").applyInArrow(index, _CELL).groupBy("bucket").applyInArrow(_count_anchors, _CELL)
    found = chunked.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(extend, _CELL).groupBy("bucket").applyInArrow(_count_windows, _CELL)
    return chunked.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(apply, f"doc_id {id_type}, n_words long, n_removed long, kept string")
