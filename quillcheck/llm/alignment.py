"""Alignment of two tokenisers' tokens over the same bytes, with corpus-wide counts of the pairs that meet.

A few MB of texts at a time become two Arrow list columns of token ids. Flattened, with parent indices and cumulative sums
that begin anew in each text, every token has the key (text, byte at which it ends). An Acero full outer join on these keys
gives all places where a token of either side ends: places known to both sides cut a text into groups, and as tokens have no
gaps, each place is one overlapping pair, the tokens of either side that end there or next. ``Table.group_by`` counts
pairs per text and per batch; Spark adds the batches' counts up, finds the best partners of each id, and hands every batch
the counts of its own pairs. No pair of tokens is compared and no table of all pairs is sent to a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillcheck.llm.packing import Encoder
from quillcheck.llm.words import portions
from quillcheck.session import scratch_path

BATCH_BYTES = 4 << 20  # text aligned at once by a Python worker
_SLAB = 1 << 20  # bytes of one text encoded at once
_CUT = re.compile(r"(?<=[^ ▁]) ")
_TEXT_BITS = 40  # of a key: the byte within the text; the text's number is above
_TEXT, _PAIRS, _ENTRIES = 0, 1, 2


class Pieces:
    """Ids of a sentence-piece model, and the bytes of each."""

    _held: dict[str, Pieces] = {}

    @classmethod
    def at(cls, path: str | None) -> Pieces:
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # A blank within a piece only follows blanks: pieces then never go across the end of a word
        self.may_cut = not any(re.search("[^▁]▁", p) for p in pieces)

    def __call__(self, texts: list[str]) -> list[list[int]]:
        short = [i for i, t in enumerate(texts) if len(t) <= _SLAB or not self.may_cut]
        out: list[list[int]] = [[]] * len(texts)
        for i, ids in zip(short, self.model.encode([texts[i] for i in short], num_threads=1), strict=True):
            out[i] = ids
        for i in set(range(len(texts))) - set(short):
            out[i] = self._in_parts(texts[i])
        return out

    def _in_parts(self, text: str) -> list[int]:
        """The model puts a blank before each part, which stands for the one that the cut took away."""
        ids: list[int] = []
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + _SLAB)
            end = cut.start() if cut else len(text)
            ids += self.model.encode(text[at:end], num_threads=1)
            at = end + 1
            if at == len(text):  # the text ends in the blank that was cut away
                ids.append(self.model.piece_to_id("▁"))
        return ids


def _lists(ids: list) -> pa.ListArray:
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in ids]) if ids else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]) if ids else np.zeros(1)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))


def _spelled(lists: pa.ListArray, vocabulary: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Bytes of all tokens one after the other, and where each list's begin."""
    spelled = vocabulary.take(pc.list_flatten(lists))
    offsets = np.frombuffer(spelled.buffers()[1], np.int64)[spelled.offset : spelled.offset + len(spelled) + 1]
    data = spelled.buffers()[2]
    return offsets[lists.offsets.to_numpy()], memoryview(data).cast("B") if data is not None else memoryview(b"")


class _Side:
    """One tokeniser's tokens of a batch: ids, and as keys the text and the byte after each token."""

    def __init__(self, lists: pa.ListArray, sizes: pa.Array):
        ids, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
        ends = pc.cumulative_sum(sizes.take(ids)).to_numpy(zero_copy_only=False)
        text = parent.to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.concatenate([[0], ends])[lists.offsets.to_numpy()[:-1]]  # bytes of earlier texts
        self.ids, self.keys = ids, (text << _TEXT_BITS) | (ends - before[text])
        self.size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)

    def table(self, name: str) -> pa.Table:
        return pa.table({"key": pa.array(self.keys), name: self.ids})


class Aligner:
    """Aligns batches of texts; holds the vocabularies as Arrow arrays."""

    _held: dict[tuple, Aligner] = {}

    @classmethod
    def at(cls, bpe: str | None, pieces: str | None) -> Aligner:
        if (bpe, pieces) not in cls._held:
            cls._held[bpe, pieces] = cls(bpe, pieces)
        return cls._held[bpe, pieces]

    def __init__(self, bpe: str | None, pieces: str | None):
        self.a, self.b = Encoder.at(bpe, plain=True), Pieces.at(pieces)
        spelled = [self.a.bytes_of, self.b.bytes_of]
        if spelled[0] is None:
            raise ValueError("the first tokeniser isn't byte-level")
        self.vocabulary = [pa.array(v, pa.large_binary()) for v in spelled]
        self.sizes = [pa.array([len(x) for x in v], pa.int64()) for v in spelled]
        said = [f"{i}{sep}" for v, seps in zip(spelled, (",|", ",;"), strict=True) for i in range(len(v)) for sep in seps]
        self.said, self.said_b = pa.array(said, pa.large_string()), 2 * len(spelled[0])

    def tokens(self, texts: list[str | None]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids on both sides; none for a text that is null, empty, or that either side doesn't spell in full."""
        given = [t or "" for t in texts]
        a = [np.frombuffer(self.a(" " + t), "<u4") if t else [] for t in given]
        b = [ids if t else [] for ids, t in zip(self.b(given), given, strict=True)]
        wanted = [b" " + t.encode() if t else b"" for t in given]
        wrong: set[int] = set()
        for ids, vocabulary in zip((a, b), self.vocabulary, strict=True):
            starts, data = _spelled(_lists(ids), vocabulary)
            wrong |= {i for i, w in enumerate(wanted) if data[starts[i] : starts[i + 1]] != w}
        return tuple(_lists([[] if i in wrong else ids for i, ids in enumerate(side)]) for side in (a, b))

    def aligned(self, texts: list[str | None]) -> tuple[dict[str, np.ndarray | list], pa.Table, pa.Table]:
        """(columns of each text; (text, pair, times) of each text's pairs; (pair, n) with the number of texts that hold it)."""
        a, b = (_Side(lists, sizes) for lists, sizes in zip(self.tokens(texts), self.sizes, strict=True))
        places = a.table("a").join(b.table("b"), "key", join_type="full outer", use_threads=False).sort_by("key")
        both = pc.and_(places["a"].is_valid(), places["b"].is_valid())
        shared = places["key"].filter(both).to_numpy()
        text = pc.shift_right(places["key"], _TEXT_BITS)
        # The token that covers a place is the one that ends there or next; both sides end at the end of the text
        pair = pc.bit_wise_or(pc.shift_left(pc.fill_null_backward(places["a"]), 32), pc.fill_null_backward(places["b"]))
        links = pa.table({"text": text, "pair": pair})
        per_text = links.group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["text", "pair", "times"])
        per_batch = per_text.group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "n"])
        n = len(texts)
        counted = lambda at: np.bincount(at >> _TEXT_BITS, minlength=n)
        columns = {
            "n_a": a.size,
            "n_b": b.size,
            "n_groups": counted(shared),
            "n_links": counted(places["key"].to_numpy()),
            "groups_sha256": self.groups(a, b, shared),
        }
        return columns, per_text, per_batch

    def groups(self, a: _Side, b: _Side, shared: np.ndarray) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each text; '' for one without tokens.

        All tokens' decimals, each with the sign that follows, are taken into one buffer in their final order.
        """
        bound = np.concatenate([[-1], shared])
        group_a, group_b = (np.searchsorted(shared, s.keys) for s in (a, b))
        last_a, last_b = (bound[g + 1] == s.keys for g, s in ((group_a, a), (group_b, b)))
        code = np.empty(len(a.keys) + len(b.keys), dtype=np.int64)
        code[np.arange(len(a.keys)) + np.searchsorted(b.keys, bound[group_a], side="right")] = 2 * a.ids.to_numpy() + last_a
        code[np.arange(len(b.keys)) + np.searchsorted(a.keys, bound[group_b + 1], side="right")] = self.said_b + 2 * b.ids.to_numpy() + last_b
        said = self.said.take(pa.array(code))
        _, offsets, data = said.buffers()
        starts = np.frombuffer(offsets, np.int64)[np.concatenate([[0], np.cumsum(a.size + b.size)])].tolist()
        data = memoryview(data) if data is not None else b""
        return [hashlib.sha256(data[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(starts, starts[1:], strict=False)]


def _schema(id_type: pa.DataType) -> pa.Schema:
    counts = [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    return pa.schema([("kind", pa.int32()), ("batch", pa.int64()), ("place", pa.int64()), ("doc_id", id_type), *counts, ("groups_sha256", pa.string()), ("pair", pa.int64()), ("n", pa.int64()), ("entries", pa.binary())])


def _rows(schema: pa.Schema, size: int, /, **known) -> pa.RecordBatch:
    """A record batch of ``schema``; columns that aren't given are null, single numbers hold for all rows."""
    arrays = []
    for f in schema:
        v = known.get(f.name)
        v = pa.nulls(size, f.type) if v is None else pa.repeat(pa.scalar(v, f.type), size) if isinstance(v, int) else v
        v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
        arrays.append(v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def aligned(docs: DataFrame, bpe: str | None = None, pieces: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row.

    A text that is null, empty, or not spelled in full by either side has no tokens: zeros and ''. A null id stays null; a
    repeated row is a document of its own, also in the counts; other columns are not read; an empty table gives no
    rows. A text of any length is aligned whole (x bytes of it need about 100x of a worker's memory).
    Batches are written once to the shared folder: their pairs, counts per text and numbers can't change under a lost
    executor.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner.at(bpe, pieces), TaskContext.get().partitionId() << 32
        for given in batches:
            schema = _schema(given.schema.field("doc_id").type)
            at = 0
            for texts in portions(given["text"], BATCH_BYTES):
                columns, per_text, per_batch = aligner.aligned(texts.to_pylist())
                ids, at = given["doc_id"].slice(at, len(texts)), at + len(texts)
                yield _rows(schema, len(ids), kind=_TEXT, batch=number, place=np.arange(len(ids)), doc_id=ids, **columns)
                per_batch = per_batch.sort_by("pair")
                if per_batch.num_rows:
                    known = per_batch["pair"].to_numpy()
                    yield _rows(schema, len(known), kind=_PAIRS, batch=number, place=np.arange(len(known)), pair=per_batch["pair"], n=per_batch["n"])
                    which = np.searchsorted(known, per_text["pair"].to_numpy())
                    order = np.lexsort((which, per_text["text"].to_numpy()))
                    entries = [per_text["text"].to_numpy()[order], which[order], per_text["times"].to_numpy()[order]]
                    packed = pa.compress(b"".join(e.astype("<u4").tobytes() for e in entries), codec="zstd", asbytes=True)
                    yield _rows(schema, 1, kind=_ENTRIES, batch=number, n=len(order), entries=[packed])
                number += 1

    columns = f"kind int, batch long, place long, doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, n long, entries binary"
    path = scratch_path(spark, "aligned")
    slim.mapInArrow(align, columns).write.partitionBy("kind").parquet(path)
    pairs = spark.read.schema(columns).parquet(path).where(F.col("kind") == _PAIRS).select("batch", "place", "pair", "n")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))  # at most as many rows as the other side has ids
    counts = counts.select("pair", "count", (F.col("count") == F.max("count").over(of_a)).alias("best"))
    known = pairs.join(counts, "pair").select("batch", "place", "count", "best")

    def add_up(key: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
        texts = rows.filter(pc.equal(rows["kind"], _TEXT)).sort_by("place")
        n_best, count_sum = np.zeros(texts.num_rows, np.int64), np.zeros(texts.num_rows, np.int64)
        for row in rows.filter(pc.equal(rows["kind"], _ENTRIES)).select(["n", "entries"]).to_pylist():
            flat = np.frombuffer(pa.decompress(row["entries"], 12 * row["n"], codec="zstd", asbytes=True), "<u4").reshape(3, -1)
            text, which, times = flat.astype(np.int64)
            count, best = np.zeros(known.num_rows, np.int64), np.zeros(known.num_rows, np.int64)
            count[known["place"].to_numpy()] = known["count"].to_numpy()
            best[known["place"].to_numpy()] = known["best"].to_numpy(zero_copy_only=False)
            np.add.at(n_best, text, best[which] * times)
            np.add.at(count_sum, text, count[which] * times)
        kept = texts.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        return kept.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum)).append_column("groups_sha256", texts["groups_sha256"])

    rows = spark.read.schema(columns).parquet(path).where(F.col("kind") != _PAIRS).drop("pair")
    schema = f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(add_up, schema)
