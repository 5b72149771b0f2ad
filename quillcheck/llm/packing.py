"""Best-fit packing of tokenised documents into sequences.

The packing is planned on *how many* pieces there are of each length, at most ``capacity`` numbers whatever the size
of the corpus. On these counts the dominance rules of Martello and Toth first fix sets of at most three pieces that no
other filling of their sequence can beat; best-fit decreasing packs the rest. The plan is a short list of sequence
patterns with multiplicities. Pieces find their place in it by their rank among the pieces of their length, which
Spark computes from counts per task; no piece passes through the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillcheck.session import settled

CAPACITY = 2048
END = 0  # the id that closes a document
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SLAB = 1 << 20  # characters encoded at a time
_LONG_BLANKS = re.compile(r"\s{100000}")  # runs that the quick encoder's pattern can't take
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def _byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of a text, as little-endian 32-bit bytes; equal to those of the tokeniser file.

    A byte-level BPE whose ids follow its merges is run by ``tiktoken``, which takes a quarter of the time; any other file,
    and the few texts that it can't take, by ``tokenizers``. Special tokens' names in a text are those tokens, or
    ordinary text where ``plain``.
    """

    _held: dict[tuple, Encoder] = {}

    @classmethod
    def at(cls, path: str | None, plain: bool = False) -> Encoder:
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        if (path, plain) not in cls._held:
            cls._held[path, plain] = cls(path, plain)
        return cls._held[path, plain]

    def __init__(self, path: str, plain: bool = False):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.bytes_of = self._bytes(told)
        self.quick = self._quick(told)

    @staticmethod
    def _bytes(told: dict) -> list[bytes] | None:
        """The bytes of every id; None where the vocabulary isn't byte-level."""
        sign, vocab = _byte_signs(), told["model"]["vocab"]
        if not all(c in sign for token in vocab for c in token):
            return None
        out = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            out[i] = bytes(sign[c] for c in token)
        return out

    def _quick(self, told: dict):
        import public_tokenizers
        import tiktoken

        model, pre, vocab = told["model"], told["pre_tokenizer"] or {}, told["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not told["normalizer"]
        set_aside = ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges")
        if self.bytes_of is None or not usual or any(model.get(k) for k in set_aside):
            return None
        if len(vocab) != 256 + len(merges) or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        ranks = {b: i for i, b in enumerate(self.bytes_of)}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def direct(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def __call__(self, text: str) -> bytes:
        if self.quick is None or any(s in text for s in self.special) or (len(text) > 100_000 and _LONG_BLANKS.search(text)):
            return np.array(self.direct(text), dtype="<u4").tobytes()
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + _SLAB) if len(text) - at > _SLAB else None
            end = cut.start() if cut else len(text)
            out.append(np.array(self.quick(text[at:end] if at or cut else text), dtype="<u4").tobytes())
            at = end
        return b"".join(out)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: ids of its whole text, then the closing id; only longer ones are cut, and of a
    cut document the first piece may be shorter.

    ``part`` is the task that made the piece, ``rank`` its number among that task's pieces of this length.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.at(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])
        for batch in batches:
            cols: list[list] = [[] for _ in schema]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + END.to_bytes(4, "little")
                total = len(ids) // 4
                n = -(-total // capacity)
                start = 0
                for k in range(n):
                    length = total - capacity * (n - 1) if k == 0 else capacity
                    row = (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, int(seen[length]))
                    seen[length] += 1
                    start += length
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


class _Sizes:
    """How many pieces are left of each length."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.astype(np.int64).copy()

    def without(self, j: int) -> np.ndarray:
        rest = self.n.copy()
        rest[j] -= 1
        return rest


def _smallest(rest: np.ndarray, k: int, above: int = 0) -> list[int]:
    """The k smallest pieces longer than ``above``, with repeats."""
    out: list[int] = []
    for size in np.flatnonzero(rest[above + 1 :]) + above + 1:
        out += [int(size)] * int(min(rest[size], k - len(out)))
        if len(out) == k:
            break
    return out


def _best_pair(rest: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two pieces with the largest sum that fits; of equal sums the one with the longest piece."""
    sizes = np.flatnonzero(rest[: room + 1])
    if not len(sizes):
        return None
    below = np.zeros(room + 1, dtype=np.int64)  # the longest length present up to each number
    below[sizes] = sizes
    below = np.maximum.accumulate(below)
    partner = below[np.minimum(room - sizes, sizes)]
    same = (partner == sizes) & (rest[sizes] < 2)
    partner[same] = below[np.maximum(sizes[same] - 1, 0)]
    ok = (partner > 0) & (sizes + partner <= room)
    if not ok.any():
        return None
    total = np.where(ok, sizes + partner, -1)
    at = len(total) - 1 - int(np.argmax(total[::-1]))
    return int(sizes[at]), int(partner[at])


def dominating(rest: np.ndarray, j: int, capacity: int) -> tuple[int, ...] | None:
    """The set that, next to a piece of length j, is at least as good as every other one; None where no rule decides.

    ``rest`` counts the pieces other than that one.
    """
    room = capacity - j
    small = _smallest(rest, 3)
    if not small or small[0] > room:
        return ()
    fitting = np.flatnonzero(rest[: room + 1])
    k = int(fitting[-1])
    if k == room or len(small) == 1 or small[0] + small[1] > room:
        return (k,)
    if len(small) == 3 and sum(small) <= room:
        return None
    pair = _best_pair(rest, room)
    if pair is None or k >= sum(pair):
        return (k,)
    a, b = pair
    if k == a:
        longer = _smallest(rest, 2, b)
        if len(longer) < 2 or sum(longer) > room:
            return (a, b)
    return None


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(sequences that are fixed for good, with multiplicities; counts of what is left)."""
    left, fixed = _Sizes(counts), []
    again = True
    while again:
        again = False
        for j in np.flatnonzero(left.n)[::-1]:
            j = int(j)
            while left.n[j] > 0:
                found = dominating(left.without(j), j, capacity)
                if found is None:
                    break
                members = (j, *found)
                times = min(int(left.n[s]) // members.count(s) for s in set(members))
                for s in members:
                    left.n[s] -= times
                fixed.append((members, times))
                again = True
    return fixed, left.n


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: sequences of the same content are one pattern with a multiplicity.

    Each length splits at most one group of sequences, so there are at most three patterns per length.
    """
    open_: list[list[tuple[tuple, int]]] = [[] for _ in range(capacity + 1)]  # by room: (chain of lengths, multiplicity)
    full = np.zeros(capacity + 1, dtype=np.int64)  # sequences by room
    for size in np.flatnonzero(counts)[::-1]:
        size, n = int(size), int(counts[size])
        while n:
            rooms = np.flatnonzero(full[size:])
            if not len(rooms):
                each = capacity // size
                for copies, times in ((each, n // each), (n % each, 1)):
                    if copies and times:
                        chain: tuple = ()
                        for _ in range(copies):
                            chain = (size, chain)
                        open_[capacity - copies * size].append((chain, times))
                        full[capacity - copies * size] += times
                break
            room = int(rooms[0]) + size
            chain, times = open_[room].pop()
            take = min(n, times)
            if take < times:
                open_[room].append((chain, times - take))
            full[room] -= take
            open_[room - size].append(((size, chain), take))
            full[room - size] += take
            n -= take
    out = []
    for group in open_:
        for chain, times in group:
            members = []
            while chain:
                members.append(chain[0])
                chain = chain[1]
            out.append((tuple(sorted(members, reverse=True)), times))
    return out


def plan_sequences(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def _slots(counts: np.ndarray, plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For every run of equal lengths in a pattern: the first place it takes among all pieces sorted by length."""
    before = np.cumsum(counts) - counts  # pieces of smaller lengths
    used = np.zeros(len(counts), dtype=np.int64)
    rows, base = [], 0
    for members, times in plan:
        offset = 0
        for size in sorted(set(members), reverse=True):
            copies = members.count(size)
            rows.append((before[size] + used[size], copies, base, offset, size))
            used[size] += copies * times
            offset += copies * size
        base += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {"first": table[:, 0], "copies": table[:, 1], "base": table[:, 2], "offset": table[:, 3], "size": table[:, 4], "before": before}


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece that holds the closing id only; a repeated row is packed once per row; a null
    id stays null; a text of any length is cut; an empty table gives no rows. Other columns are not read.
    The pieces (a few numbers each) are written once to the shared folder, so ranks cannot change under a lost executor.
    """
    spark = docs.sparkSession
    cut = settled(pieces(docs, capacity, tokenizer, id_col, text_col), "pieces")
    per_task = cut.groupBy("length", "part").agg((F.max("rank") + 1).alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in per_task.groupBy("length").agg(F.sum("n")).collect():  # at most one row per length
        counts[length] = n
    slots = _slots(counts, plan_sequences(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            nth = slots["before"][length] + rank
            at = np.searchsorted(slots["first"], nth, side="right") - 1
            within = nth - slots["first"][at]
            sequence = slots["base"][at] + within // slots["copies"][at]
            offset = slots["offset"][at] + (within % slots["copies"][at]) * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(offsets, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
