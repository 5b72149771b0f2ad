"""Scores of whole texts by an n-gram model of the corpus, run as a weighted backoff automaton.

The model: counts of all sequences of up to ``order`` tokens of the training texts (a start sign before the first word, an end
after the last one). One token has (c + 1/2) / (N + (V + 1) / 2); a longer sequence mixes its own rate with the probability
after its history without the first token, as a Dirichlet prior of that weight does. No count is cut off.

As an automaton: each history that the training texts hold is a state, the empty one is the root. A sequence that occurred
is an arc from its history, weighted by its log-probability, to the longest state that ends it; a state fails over to the
history without its first token at the cost of the mass that its arcs leave. A text is read once from left to right.

No task holds the model. A chunk of texts sends its distinct sequences, packed by range of their hashes, with their counts
in its training texts; a range adds up what all chunks send and returns the sums to each of them. A chunk then has the
part of the automaton that its own texts can reach. A frequent sequence is sent once per chunk, whatever its count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcheck.llm.words import Texts, mix, seeded

ORDER = 3
#: Weight of the shorter history, for sequences of two tokens, of three, and so on (the last one holds for all longer ones).
PRIOR = (64.0, 16.0)
CHUNK_BYTES = 6 << 20  # text handled at once by a Python worker
RANGE_BYTES = 16 << 20  # text whose sequences make up one range of hashes, about two million for the usual order
_STEPS = 512  # tokens of one run; longer texts are cut into runs that begin in the right state
_START, _END = seeded(31, 2)
_CELL = "bucket long, chunk long, length int, n long, keys binary, counts binary, tokens long, types long"
_CELL_SCHEMA = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("length", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane, compressed."""
    if not len(values):
        return b""
    return pa.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _from_planes(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    flat = pa.decompress(data, 8 * n, codec="zstd", asbytes=True)
    return np.frombuffer(flat, np.uint8).reshape(8, n).T.copy().view("<u8").ravel()


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one: half the bytes of what a shuffle makes of them."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch["text"]), 0).cast(pa.int64())
        text = pa.array([pa.compress(t.as_buffer(), codec="zstd", asbytes=True) if t.is_valid else b"" for t in batch["text"]], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["chunk"], batch["doc_id"], batch["held_out"], text, size], names=["chunk", "doc_id", "held_out", "text", "size"])


def _texts(table: pa.Table) -> pa.Array:
    sizes = table["size"].to_pylist()
    return pa.array([pa.decompress(t.as_buffer(), n, codec="zstd").to_pybytes() if n else b"" for t, n in zip(table["text"], sizes, strict=True)], pa.large_binary())


def _differences(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=np.uint64(0))


def _cells(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CELL_SCHEMA)], schema=_CELL_SCHEMA)


class _Chunk:
    """Sequences of one chunk of texts. ``keys[k]`` are its distinct ones of k + 1 tokens, sorted, so the order of texts is of
    no matter; ``at[k]`` says which of them ends at each token (-1: none that lies within the text)."""

    def __init__(self, column: pa.Array, order: int):
        texts = Texts(column, lower=True)
        hashes, n = texts.hashes(), len(texts)
        size = np.diff(texts.first) + 2  # with start and end
        self.first = np.concatenate([[0], np.cumsum(size)])
        self.tokens = np.empty(int(self.first[-1]), dtype=np.uint64)
        inner = np.ones(len(self.tokens), dtype=bool)
        inner[self.first[:-1]] = inner[self.first[1:] - 1] = False
        self.tokens[inner] = hashes
        self.tokens[self.first[:-1]], self.tokens[self.first[1:] - 1] = _START, _END
        self.text = np.repeat(np.arange(n, dtype=np.int32), size)
        self.place = (np.arange(len(self.tokens)) - np.repeat(self.first[:-1], size)).astype(np.int32)
        self.keys, self.at, self.example = [], [], []
        run = self.tokens
        with np.errstate(over="ignore"):
            for k in range(order):
                if k:  # 56 bits are enough for longer sequences, and travel lighter
                    run = mix(run + np.concatenate([np.zeros(min(k, len(run)), np.uint64), self.tokens[:-k]]) * (seeded(40 + k, 1)[0] | np.uint64(1)))
                here = np.flatnonzero(self.place >= k)
                keys, example, which = np.unique(run[here] >> np.uint64(8 if k else 0), return_index=True, return_inverse=True)
                at = np.full(len(self.tokens), -1, dtype=np.int32)
                at[here] = which
                self.keys.append(keys)
                self.at.append(at)
                self.example.append(here[example].astype(np.int32))
                del here, which, example

    def edges(self, k: int, n_buckets: int) -> np.ndarray:
        """Where each range of hashes begins in the keys; ranges follow the order of hashes."""
        width = 1 << (56 if k else 64)
        bounds = np.array([-(-b * width // n_buckets) for b in range(n_buckets)], dtype=np.uint64)
        return np.append(np.searchsorted(self.keys[k], bounds), len(self.keys[k]))

    def cells(self, train: np.ndarray, n_buckets: int) -> Iterator[tuple]:
        """By range and length: (bucket, length, n, keys, counts in training texts). Each range gets one for length 1."""
        learnt = train[self.text]
        for k, keys in enumerate(self.keys):
            counted = learnt & (self.at[k] >= 0)
            counts = np.bincount(self.at[k][counted], minlength=len(keys))
            edges = self.edges(k, n_buckets)
            for b in range(n_buckets):
                a, e = int(edges[b]), int(edges[b + 1])
                if e > a or k == 0:
                    yield b, k + 1, e - a, _planes(_differences(keys[a:e])), _planes(counts[a:e])


def _add_up(key: tuple, table: pa.Table) -> pa.Table:
    """Within one range: the counts of all chunks together, for each chunk's own keys; and how many tokens of how many
    types the training texts have in this range."""
    cells = table.to_pylist()
    found, tokens, types = [], 0, 0
    for length in sorted({c["length"] for c in cells}):
        mine = [c for c in cells if c["length"] == length]
        keys = [np.cumsum(_from_planes(c["keys"], c["n"]), dtype=np.uint64) for c in mine]
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([_from_planes(c["counts"], c["n"]) for c in mine])
        total = np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.int64)
        if length == 1:
            seen = total[(total > 0) & (distinct != _START)]
            tokens, types = int(seen.sum()), len(seen)
        place = 0
        for c in mine:
            found.append((c["bucket"], c["chunk"], length, c["n"], None, _planes(total[which[place : place + c["n"]]])))
            place += c["n"]
    return _cells([(*f, tokens, types) for f in found])


class Automaton:
    """States, arcs and failure arcs for sequences with counts.

    ``keys``/``example``/``at`` as in ``_Chunk``, ``counts[k]`` the corpus-wide counts of the sequences of k + 1 tokens.
    State 0 is the root; a word is known by its number among the chunk's distinct tokens.
    """

    def __init__(self, chunk: _Chunk, counts: Sequence[np.ndarray], tokens: int, types: int, prior: Sequence[float]):
        order, n_words = len(counts), len(counts[0])
        self.n_words = max(n_words, 1)
        scale = tokens + 0.5 * (types + 1)
        self.base = np.log10((counts[0] + 0.5) / scale)  # of each word, known or not
        self.unknown = float(np.log10(0.5 / scale))
        known = [c > 0 for c in counts]
        # A state for every history: numbers run on from length to length
        state, fail, fail_weight, so_far = [], [np.zeros(1, np.int64)], [np.zeros(1)], 1
        for k in range(order - 1):
            number = np.where(known[k], so_far + np.cumsum(known[k]) - 1, -1)
            state.append(number)
            end = chunk.example[k][known[k]]
            fail.append(state[k - 1][chunk.at[k - 1][end]] if k else np.zeros(len(end), np.int64))
            weight = prior[min(k, len(prior) - 1)]
            fail_weight.append(np.log10(weight / (counts[k][known[k]] + weight)))
            so_far += len(end)
        self.fail, self.fail_weight = np.concatenate(fail), np.concatenate(fail_weight)
        self.start = int(state[0][chunk.at[0][0]]) if order > 1 and len(chunk.tokens) else 0
        self.start = max(self.start, 0)  # no training text: the root
        arcs, to, weights, shorter = [], [], [], None
        for k in range(order):
            end = chunk.example[k]
            if k:
                weight = prior[min(k - 1, len(prior) - 1)]
                history = chunk.at[k - 1][end - 1]
                p = (counts[k] + weight * shorter[chunk.at[k - 1][end]]) / (counts[k - 1][history] + weight)
            else:
                p = (counts[0] + 0.5) / scale
            shorter = p
            ok = known[k] & (chunk.tokens[end] != _START)
            end = end[ok]
            begin = state[k - 1][chunk.at[k - 1][end - 1]] if k else np.zeros(len(end), np.int64)
            arcs.append(begin.astype(np.int64) * self.n_words + chunk.at[0][end])
            if k < order - 1:
                to.append(state[k][ok].astype(np.int32))
            else:
                to.append((state[k - 1][chunk.at[k - 1][end]] if k else np.zeros(len(end))).astype(np.int32))
            weights.append(np.log10(p[ok]))
        del state, shorter, p
        self.arcs = np.concatenate(arcs)
        del arcs
        sort = np.argsort(self.arcs).astype(np.int32)
        self.arcs = self.arcs[sort]
        self.to = np.concatenate(to)[sort]
        self.weights = np.concatenate(weights)[sort]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads one word in each of the given states: the states after it and the log-probabilities on the way."""
        state, cost = state.copy(), np.zeros(len(state))
        left = np.arange(len(state))
        while len(left):
            key = state[left] * self.n_words + word[left]
            arc = np.minimum(np.searchsorted(self.arcs, key), max(len(self.arcs) - 1, 0))
            hit = self.arcs[arc] == key if len(self.arcs) else np.zeros(len(left), dtype=bool)
            cost[left[hit]] += self.weights[arc[hit]]
            state[left[hit]] = self.to[arc[hit]]
            left = left[~hit]
            lost = left[state[left] == 0]  # no training text has this word
            cost[lost] += self.unknown
            left = left[state[left] != 0]
            cost[left] += self.fail_weight[state[left]]
            state[left] = self.fail[state[left]]
        return state, cost

    def read(self, words: np.ndarray, first: np.ndarray, history: int) -> np.ndarray:
        """The log10 probability of each text ``words[first[i]:first[i + 1]]``, whose first token is the start sign.

        All texts are read side by side, a word of each at a time. A long text is cut into runs; a run begins
        ``history`` words early, without cost, which brings it into the state that the run before ends in.
        """
        runs, size = np.maximum(-(-(np.diff(first) - 1) // _STEPS), 1), np.diff(first)
        text = np.repeat(np.arange(len(size)), runs)
        number = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
        begin = 1 + number * _STEPS
        end = np.minimum(begin + _STEPS, size[text])
        from_start = begin - 1 <= history
        early = np.where(from_start, 1, begin - history)
        state = np.where(from_start, self.start, 0)
        by_length = np.argsort(early - end, kind="stable")
        text, begin, end, early, state = (x[by_length] for x in (text, begin, end, early, state))
        spans, total = end - early, np.zeros(len(text))
        for t in range(int(spans[0]) if len(spans) else 0):
            n = int(np.searchsorted(-spans, -t, side="left"))  # runs that are longer than t
            state[:n], cost = self.step(state[:n], words[first[text[:n]] + early[:n] + t])
            total[:n] += np.where(early[:n] + t >= begin[:n], cost, 0.0)
        return np.bincount(text, weights=total, minlength=len(size))


def scored(
    docs: DataFrame, folds: int = 5, held_out: int = 1, order: int = ORDER, prior: Sequence[float] = PRIOR, id_col: str = "doc_id", text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row.

    Learns from all rows whose crc32(doc_id as text) modulo ``folds`` is not ``held_out``. A null or empty text has the one
    token that ends it; a null id is taken for an empty one (crc32 0); a repeated row is learnt and scored once per
    row; other columns are not read; an empty table gives no rows; without training rows every text has probability 1 (the
    one unknown word takes all). Texts may be of any length (a chunk holds whole texts, so one text of x bytes needs
    about 40x of a worker's memory).
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks, n_buckets = max(1, -(-total // chunk_bytes)), max(1, -(-total // range_bytes))
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    chunked = slim.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).alias("chunk"), "doc_id", (fold == held_out).alias("held_out"), "text")
    chunked = chunked.mapInArrow(_squeezed, f"chunk long, doc_id {id_type}, held_out boolean, text binary, size long")

    def count(key: tuple, table: pa.Table) -> pa.Table:
        train = ~table["held_out"].to_numpy(zero_copy_only=False).astype(bool)
        number = key[0].as_py()
        return _cells([(b, number, length, n, keys, counts, 0, 0) for b, length, n, keys, counts in _Chunk(_texts(table), order).cells(train, n_buckets)])

    def score(key: tuple, table: pa.Table, sums: pa.Table) -> pa.Table:
        chunk = _Chunk(_texts(table), order)
        counts = [np.zeros(len(k), dtype=np.int64) for k in chunk.keys]
        edges = [chunk.edges(k, n_buckets) for k in range(order)]
        tokens = types = 0
        for c in sums.to_pylist():
            k = c["length"] - 1
            counts[k][edges[k][c["bucket"]] : edges[k][c["bucket"] + 1]] = _from_planes(c["counts"], c["n"])
            if k == 0:
                tokens, types = tokens + c["tokens"], types + c["types"]
        model = Automaton(chunk, counts, tokens, types, prior)
        words, told = chunk.at[0], chunk.place > 0
        n = table.num_rows
        known = counts[0][words] > 0
        out = {
            "doc_id": table["doc_id"],
            "held_out": table["held_out"],
            "n_tokens": pa.array(np.diff(chunk.first) - 1, pa.int64()),
            "n_known": pa.array(np.bincount(chunk.text[told & known], minlength=n), pa.int64()),
            "train_tokens": pa.array(np.full(n, tokens), pa.int64()),
            "base_score": pa.array(np.bincount(chunk.text[told], weights=model.base[words[told]], minlength=n), pa.float64()),
            "score": pa.array(model.read(words, chunk.first, order - 1), pa.float64()),
        }
        return pa.table(out)

    sums = chunked.groupBy("chunk").applyInArrow(count, _CELL).groupBy("bucket").applyInArrow(_add_up, _CELL)
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunked.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(score, schema)
