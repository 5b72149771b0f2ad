"""Quality scores from random-indexing word vectors and a small network.

Random indexing: every word has a fixed sparse random index vector, made from the hash of its exact spelling; a word's
vector is the sum of the index vectors met next to it, over the whole corpus. Words are hashed to ``WORDS`` places (a
parameter), so all vectors together are a table of fixed size; words that meet in a place share its vector. A text is
described by mean and spread of its words' vectors, the length of the mean of their index vectors, and its size; a
two-layer network turns that into a score, whose temperature is set on rows kept aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcheck.llm.words import Texts, mix, portions

WORDS = 1 << 18
DIM = 32
NONZERO = 4
WIDTH = 2 * DIM + 3  # numbers that describe a text
SAMPLE = 20_000  # most labelled rows that the network is fitted on
HIDDEN = 32
EPOCHS = 40
THRESHOLD = 0.3
FOLDS = 5  # fold 0 is held out
_SLAB = 1 << 16
_ROWS = 8192


def word_index(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, +1 or -1) of the ``NONZERO`` entries of each word's own index vector, a row for each entry."""
    draws = mix(hashes ^ np.uint64(0x9E3779B97F4A7C15))
    parts = (draws >> (np.uint64(16) * np.arange(NONZERO, dtype=np.uint64)[:, None])) & np.uint64(0xFFFF)
    return ((parts >> np.uint64(1)) % np.uint64(DIM)).astype(np.int64), np.where(parts & np.uint64(1), 1.0, -1.0)


def word_places(hashes: np.ndarray, places: int = WORDS) -> np.ndarray:
    """The place of each word's vector, below ``places``."""
    return (mix(hashes) % np.uint64(places)).astype(np.int64)


def word_vectors(docs: DataFrame, text_col: str = "text", places: int = WORDS) -> np.ndarray:
    """The vectors of all words, from all texts; ``places`` rows at most come to the driver.

    Each task adds up its own texts first; the sums of tasks meet in an ordinary aggregate. All addends are whole
    numbers, so the order of addition doesn't matter.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((places, DIM))
        for column in (part for batch in batches for part in portions(batch.column(0))):
            texts = Texts(column)
            hashes = texts.hashes()
            inner = np.ones(max(len(hashes) - 1, 0), dtype=bool)
            seams = texts.first[1:-1] - 1
            inner[seams[(seams >= 0) & (seams < len(inner))]] = False
            for a in range(0, len(inner), _SLAB):
                left = np.flatnonzero(inner[a : a + _SLAB])
                h = hashes[a : a + _SLAB + 1]
                seen, own = np.unique(word_places(h, places), return_inverse=True)
                sums = np.zeros(len(seen) * DIM)
                for at, sign in zip(*word_index(h), strict=True):
                    sums += np.bincount(own[left] * DIM + at[left + 1], sign[left + 1], len(sums))
                    sums += np.bincount(own[left + 1] * DIM + at[left], sign[left], len(sums))
                total[seen] += sums.reshape(-1, DIM)
        seen = np.flatnonzero(total.any(axis=1))
        for a in range(0, len(seen), _ROWS):
            some = seen[a : a + _ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, d]) for d in range(DIM))], names=["place", *(f"v{d}" for d in range(DIM))])

    kind = "place long, " + ", ".join(f"v{d} double" for d in range(DIM))
    sums = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(add, kind)
    found = sums.groupBy("place").agg(*(F.sum(f"v{d}").cast("float").alias(f"v{d}") for d in range(DIM))).toArrow()  # at most ``places`` rows
    out, place = np.zeros((places, DIM), dtype=np.float32), found.column(0).to_numpy()
    for d in range(DIM):
        out[place, d] = found.column(1 + d).to_numpy()
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows by text; a text without words has zeros."""
    out = np.zeros((len(first) - 1, values.shape[1]))
    full = first[1:] > first[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, first[:-1][full], axis=0, dtype=np.float64)
    return out


def describe(column: pa.Array, words: np.ndarray) -> np.ndarray:
    """One row per text: mean and spread of its words' vectors, how much one word prevails, and the size."""
    parts = [_described(part, words) for part in portions(column)]
    return np.vstack(parts) if parts else np.zeros((0, WIDTH))


def _described(column: pa.Array, words: np.ndarray) -> np.ndarray:
    texts = Texts(column)
    hashes = texts.hashes()
    place = word_places(hashes, len(words))
    first = texts.first
    n = len(texts)
    sums, squares, own = np.zeros((n, DIM)), np.zeros((n, DIM)), np.zeros((n, DIM))
    at = 0
    while at < n:  # some texts at a time, by their number of words
        to = max(at + 1, int(np.searchsorted(first, first[at] + _SLAB, side="right")) - 1)
        for a in range(first[at], max(first[to], first[at] + 1), 4 * _SLAB):  # one long text in parts
            b = min(a + 4 * _SLAB, first[to])
            if b <= a:
                break
            cut = np.clip(first[at : to + 1], a, b) - a
            v = words[place[a:b]]
            sums[at:to] += _per_text(v, cut)
            squares[at:to] += _per_text(v * v, cut)
            of = np.repeat(np.arange(to - at), np.diff(cut)) * DIM
            for d, sign in zip(*word_index(hashes[a:b]), strict=True):
                own[at:to] += np.bincount(of + d, sign, (to - at) * DIM).reshape(-1, DIM)
        at = to
    count = np.maximum(np.diff(first), 1)[:, None]
    mean = sums / count
    spread = np.sqrt(np.maximum(squares / count - mean**2, 0))
    one = np.linalg.norm(own / count, axis=1, keepdims=True)
    size = np.diff(first)[:, None]
    return np.hstack([mean, spread, one, np.log1p(size), np.minimum(size / 50.0, 1.0)])


@dataclass
class Model:
    words: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(np.clip((x - self.centre) / self.scale, -8, 8) @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def score(self, text: Column) -> Column:
        """A column with the probability of label 1; each text on its own."""
        model = self

        @F.arrow_udf("double")
        def score(column: pa.Array) -> pa.Array:
            return pa.array(model.probability(describe(column, model.words)))

        return score(F.coalesce(text.cast("string"), F.lit("")))


def fit(x: np.ndarray, y: np.ndarray, words: np.ndarray, seed: int = 3) -> Model:
    """A network of two layers by Adam on four fifths of the rows; the temperature by the likelihood of the rest.

    With no labels, or labels of one kind only, the score is the share of label 1 (1 without labels).
    """
    width = WIDTH
    share = float(y.mean()) if len(y) else 1.0
    if len(y) < 20 or share in (0.0, 1.0):
        logit = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        return Model(words, np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), logit, 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    aside, used = order[: len(y) // 5], order[len(y) // 5 :]
    centre, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
    z = np.clip((x - centre) / scale, -8, 8)
    p = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(EPOCHS):
        rate = 0.01 * (1 - epoch / EPOCHS) + 1e-4
        for rows in np.array_split(rng.permutation(used), max(1, len(used) // 256)):
            a, b = z[rows], y[rows]
            h = np.tanh(a @ p[0] + p[1])
            error = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - b) / len(b)
            back = error[:, None] * p[2] * (1 - h * h)
            grads = [a.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ error + 1e-4 * p[2], np.array([error.sum()])]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    model = Model(words, centre, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    logits, truth = model.logits(x[aside]), y[aside]
    loss = lambda heat: np.logaddexp(0, np.where(truth == 1, -logits, logits) / heat).mean()
    model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo ``FOLDS``; a null id has none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, places: int = WORDS) -> Model:
    """Vectors from all texts; the network from at most ``sample`` labelled rows outside fold 0, by the hash of the id.

    Labels with null id or quality don't count; an id with unlike labels counts with the least, rows that share an id as
    the one whose text has the least hash.
    """
    words = word_vectors(docs, text_col, places)
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(fold(F.col("doc_id")) != 0)
    few = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = describe(batch.column(3), words)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "said", "x"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(few), "doc_id")
    slim = chosen.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), F.xxhash64("text").alias("said"), "text")
    first = slim.mapInArrow(rows, "doc_id long, quality int, said long, x array<double>").groupBy("doc_id").agg(F.min(F.struct("said", "quality", "x")).alias("row"))
    got = first.select("doc_id", "row.quality", "row.x").toArrow().sort_by("doc_id")  # at most ``sample`` rows
    x = np.array(got["x"].combine_chunks().flatten()).reshape(-1, WIDTH)
    return fit(x, got["quality"].to_numpy().astype(float), words)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    A null or empty text has the score of a text without words; a null id is not held out; repeated rows have equal
    scores; an empty table gives no rows. Only the text enters a score.
    """
    model = trained(docs, labels, id_col, text_col)
    d = docs.select(F.col(id_col).alias("doc_id"), model.score(F.col(text_col)).alias("score"))
    return d.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, columns unchanged.

    A null or empty text is judged as a text without words; each of repeated rows is judged, and alike; a null id is a
    row like any other that no label names; an empty table gives no rows; without labels all rows stay.
    """
    return docs.where(trained(docs, labels).score(F.col("text")) >= THRESHOLD)
