"""Benchmark items inside documents: containment search by MinHash sketches, verified on the shingles themselves.

Items are partitioned by their number of shingles. In a partition whose items have up to u shingles, an item's sketch
is its k(u) shingles of least hash, with k(u) one more than the number of shingles that an item contained at the
threshold may lack: whatever contains the item holds one of them, so nothing is lost. Candidates are documents that
hold a shingle of a sketch; the exact share of the item's shingles in the document decides.

Documents of any length are scanned once. A bitmap of fixed size, made of all items' shingles, drops nearly all of a
document's shingles where they are read; the few others travel as text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcheck.llm.words import Texts, window_starts, windows
from quillcheck.session import settled

SHINGLE = 5
CONTAINED = 0.8
_BLOCK_BITS = 1 << 16
_BLOCKS = 512  # bitmap of 4 MB, whatever the number of items


def _hashed(texts: Texts, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every shingle."""
    at = np.flatnonzero(window_starts(texts.first, shingle, len(texts.starts)))
    return at, windows(texts.hashes(), shingle, 31)[at]


def _place(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(8)) % np.uint64(_BLOCKS * _BLOCK_BITS)


def _shingles(texts: Texts, at: np.ndarray, shingle: int) -> list[list[str]]:
    """The distinct shingles among those that begin at ``at``, by text."""
    owner = np.searchsorted(texts.first, at, side="right") - 1
    out: list[dict[str, None]] = [{} for _ in range(len(texts))]
    for i, a in zip(owner.tolist(), at.tolist(), strict=True):
        out[i][texts.joined(a, shingle).decode()] = None
    return [list(x) for x in out]


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """item_id and its distinct shingles: lower-case words joined by blanks. Items of fewer words have none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch.column(1), lower=True)
            at, _ = _hashed(texts, shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_shingles(texts, at, shingle), pa.list_(pa.string()))], names=["item_id", "shingles"])

    slim = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(each, "item_id long, shingles array<string>")


def sketches(items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """(item_id, shingle): the sketch of each item, as long as its size partition asks for.

    Partitions double: sizes 1, 2-3, 4-7, ... An item of n shingles that is contained may lack ``n - ceil(c n)``; the
    largest such number in the partition sets the length.
    """
    n = F.size("shingles")
    most = F.pow(F.lit(2), F.floor(F.log2(n.cast("double"))) + 1) - 1
    k = (F.floor(most * (1 - contained) + 1e-9) + 1).cast("int")
    by_hash = F.array_sort(F.transform("shingles", lambda s: F.struct(F.xxhash64(s).alias("h"), s.alias("s"))))
    return items.where(n > 0).select("item_id", F.explode(F.slice(by_hash, 1, k)).alias("x")).select("item_id", F.col("x.s").alias("shingle"))


def bitmap(items: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Bits of all items' shingles; each of ``_BLOCKS`` parts of 8 kB is put together by a task."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(_place(_hashed(Texts(batch.column(0)), shingle)[1])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place)], names=["place"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            place = batch.column(0).to_numpy()
            for block in np.unique(place // _BLOCK_BITS).tolist():
                held.setdefault(block, np.zeros(_BLOCK_BITS, dtype=bool))[place[place // _BLOCK_BITS == block] % _BLOCK_BITS] = True
        blobs = [np.packbits(b, bitorder="little").tobytes() for b in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(blobs, pa.binary())], names=["block", "bits"])

    places = items.select(F.explode("shingles").alias("s")).mapInArrow(bits, "place long").distinct()
    parts = places.repartition(8, F.floor(F.col("place") / _BLOCK_BITS)).mapInArrow(gather, "block long, bits binary")
    out = np.zeros(_BLOCKS * _BLOCK_BITS // 8, dtype=np.uint8)
    for block, data in parts.collect():  # 4 MB at most
        out[block * _BLOCK_BITS // 8 : (block + 1) * _BLOCK_BITS // 8] = np.frombuffer(data, np.uint8)
    return out


def evidence(docs: DataFrame, bits: np.ndarray, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, a hash of the text and the distinct shingles of the row that the bitmap knows; rows without any are left out."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch.column(2), lower=True)
            at, h = _hashed(texts, shingle)
            place = _place(h)
            known = (held.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
            found = _shingles(texts, at[known.astype(bool)], shingle)
            full = pa.array([i for i, x in enumerate(found) if x], pa.int64())
            lists = pa.array([x for x in found if x], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(full), batch.column(1).take(full), lists], names=["doc_id", "text_hash", "shingles"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(each, "doc_id long, text_hash long, shingles array<string>")


def _verified(docs: DataFrame, items: DataFrame, contained: float, shingle: int) -> DataFrame:
    """(doc_id, text_hash, item_id, n_shingles, n_found) for every row of ``docs`` and item at the threshold."""
    named = settled(item_shingles(items, shingle=shingle).withColumn("item", F.monotonically_increasing_id()), "items")  # written, so that rows keep their numbers
    found = evidence(docs, bitmap(named, shingle), shingle=shingle).withColumn("row", F.monotonically_increasing_id())
    found = settled(found, "evidence")  # written, so that rows keep their numbers
    met = found.select("row", F.explode("shingles").alias("shingle"))
    candidates = met.join(sketches(named.select(F.col("item").alias("item_id"), "shingles"), contained), "shingle").select("row", F.col("item_id").alias("item")).distinct()
    both = candidates.join(found.withColumnRenamed("shingles", "held"), "row").join(named, "item")
    counted = both.select("doc_id", "text_hash", "item_id", F.size("shingles").cast("long").alias("n_shingles"), F.size(F.array_intersect("held", "shingles")).cast("long").alias("n_found"))
    return counted.where(F.col("n_found") >= contained * F.col("n_shingles") - 1e-9)


def contaminated(docs: DataFrame, items: DataFrame, contained: float = CONTAINED, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment: every document that holds ``contained`` of an item's shingles.

    Words are compared in lower case (A-Z). An item of fewer words than a shingle, or with a null text, is in no
    document; a document of fewer words holds nothing. Each row of ``items`` is an item of its own, whatever item_id it
    shares or lacks; equal results are given once, so is that of a repeated row of ``docs``; a row without doc_id gives
    one without doc_id. Empty tables give no rows; other columns are not read.
    """
    found = _verified(docs, items, contained, shingle).drop("text_hash").distinct()
    return found.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item, columns unchanged; rows without doc_id are told apart by their text.

    A null or empty text contains none and stays, as do all rows where ``items`` is empty; an empty table gives no rows;
    each of repeated rows is judged, and alike. Every row of ``items`` counts, with or without an item_id of its own.
    """
    found = _verified(docs, items, CONTAINED, SHINGLE).select("doc_id", "text_hash").distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"]) == found["text_hash"])
    return docs.join(found, same, "left_anti")
