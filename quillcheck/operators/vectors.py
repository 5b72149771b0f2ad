"""Search over precomputed vectors."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillcheck.operators.skew import salted_join
from quillcheck.session import settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VECTORS_PER_BLOCK = 512
PIVOTS = 64  # vectors that the others are filed by; never more than this reach the driver
FIRST_BLOCKS = 4
BLOCKS_PER_TILE = 32  # a probe's vector is sent once to all of these that it opens
PROBES_PER_TILE = 16_384
_ZERO = -2  # in place of a pivot: a vector without direction
# What no angle can be told of: no vector, or one with a number that is none.
_UNKNOWN = "vector IS NULL OR exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"


def _unit(vectors, width: int) -> np.ndarray:
    """Rows of length 1; a null vector is a row of NaN, one without direction a row of zeros."""
    matrix = np.array([np.full(width, np.nan) if v is None else np.asarray(v, dtype=np.float64) for v in vectors]).reshape(len(vectors), width)
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(size == 0, 1.0, size)


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(np.nan_to_num(unit) @ pivots.T, -1.0, 1.0))


class VectorIndex:
    """Vectors filed by their nearest pivot and the angle to it, in blocks of one pivot and one ``on``.

    ``values`` has ``on``, ``id`` (a number) and ``vector`` (null, or all of one length). Rows are dealt out by ranges of key,
    pivot, angle and id and blocks are cut within the tasks, so a hot key makes many blocks. Values without a vector are in no
    block: they are all alike to a probe, so the least of them are enough (``firsts``).
    """

    def __init__(self, values: DataFrame, on: Sequence[str]):
        self.on = list(on)
        self.values = values.select(*on, F.col("id").cast("long"), F.col("vector").cast("array<double>").alias("vector"))
        some = values.where("vector IS NOT NULL").select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
        self.width = len(some[0]["vector"]) if some else 1
        unit = _unit([r["vector"] for r in some], self.width)
        self.pivots = unit[np.abs(unit).sum(axis=1) > 0]
        self.blocks = settled(self._cut(), "vectors")

    def _cut(self) -> DataFrame:
        pivots, width, keys, per_block = self.pivots, self.width, self.on, VECTORS_PER_BLOCK
        kinds = ", ".join(f"`{k}` {self.values.schema[k].dataType.simpleString()}" for k in keys)
        slim = self.values.where(f"NOT ({_UNKNOWN})")

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                unit = _unit(batch["vector"].tolist(), width)
                some = np.abs(unit).sum(axis=1) > 0
                angles = _angles(unit, pivots) if len(pivots) else np.zeros((len(unit), 1))
                near = angles.argmin(axis=1)
                batch = batch.assign(pivot=np.where(some, near, _ZERO), angle=angles[np.arange(len(unit)), near])
                yield batch[[*keys, "id", "vector", "pivot", "angle"]]

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for key, group in batch.groupby([*keys, "pivot"], sort=False, dropna=False):
                    for at in range(0, len(group), per_block):
                        part = group.iloc[at : at + per_block]
                        rows.append((*key, float(part["angle"].min()), float(part["angle"].max()), part["id"].tolist(), part["vector"].tolist()))
                yield pd.DataFrame(rows, columns=[*keys, "pivot", "lo", "hi", "ids", "vectors"])

        head = kinds + ", " if kinds else ""
        placed = slim.mapInPandas(place, head + "id long, vector array<double>, pivot int, angle double")
        near = placed.repartitionByRange(*keys, "pivot", "angle", "id")  # neighbours share a task, so blocks are full
        blocks = near.sortWithinPartitions(*keys, "pivot", "angle").mapInPandas(cut, head + "pivot int, lo double, hi double, ids array<long>, vectors array<array<double>>")
        return blocks.withColumn("block", F.monotonically_increasing_id())

    def firsts(self, n: int) -> DataFrame:
        """(on, other_id, known): the ``n`` least ids of each ``on``, of the values with a vector and of those without."""
        named = self.values.select(*self.on, F.col("id").alias("other_id"), F.expr(f"NOT ({_UNKNOWN})").alias("known"))
        place = F.row_number().over(Window.partitionBy(*self.on, "known").orderBy("other_id"))
        return settled(named.withColumn("n", place).where(F.col("n") <= n).drop("n"), "firsts")

    def with_angles(self, probes: DataFrame) -> DataFrame:
        """``probes`` with the angles to all pivots; null for one without vector, empty for one without direction."""
        pivots, width = self.pivots, self.width
        names = probes.columns

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                unit = _unit(batch["vector"].tolist(), width)
                angles = _angles(unit, pivots) if len(pivots) else np.zeros((len(unit), 0))
                told = [None if np.isnan(u).any() else a.tolist() if np.abs(u).sum() > 0 else [] for u, a in zip(unit, angles, strict=True)]
                yield batch.assign(angles=pd.Series(told, index=batch.index, dtype=object))[[*names, "angles"]]

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in probes.schema)
        return probes.mapInPandas(measure, kinds + ", angles array<double>")


def nearest(
    probes: DataFrame, values: DataFrame | VectorIndex, on: Sequence[str], k: int = 1, skip_same: bool = False, digits: int = 6, per: Sequence[str] = ()
) -> DataFrame:
    """The k values of highest cosine per probe, among those with equal ``on``; of equal scores the least id.

    Both sides have ``on``, ``id`` (a number) and ``vector``; probes may have further columns ``per`` that tell them apart (then the
    k best are over all their ``on``). The score is -1 where a vector is null and 0 where one has no direction.

    An exact search by pivots: the angle to a vector can't be less than the difference of the two angles to a pivot, so
    the blocks whose bound is best are opened first, and of the others only those that may still hold one of the k best.
    Probes and blocks meet in tiles of ``PROBES_PER_TILE`` by ``BLOCKS_PER_TILE``; no vector is sent for a single pair.
    A probe without vector or direction scores the same with all vectors, and so does a value without vector with all probes:
    these open no blocks, the least ids decide.
    """
    index = values if isinstance(values, VectorIndex) else VectorIndex(values, on)
    width, keep, places = index.width, k, digits
    group = [*per, "id"] if per else [*on, "id"]
    p = probes.select(*dict.fromkeys([*on, *per]), F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    named = list(dict.fromkeys([*on, *per, "id"]))
    p = p.dropDuplicates(named).repartitionByRange(*named).sortWithinPartitions(*named)  # a bundle has few ``on``
    p = settled(index.with_angles(p.withColumn("bundle", F.floor(F.monotonically_increasing_id() / PROBES_PER_TILE))), "probes")
    summary = index.blocks.select(*index.on, "block", "pivot", "lo", "hi")
    alike = salted_join(p.drop("vector"), index.firsts(k + skip_same), on).where("NOT known OR angles IS NULL OR size(angles) = 0")
    alike = alike.where("id <> other_id") if skip_same else alike
    alike = alike.select(*named, "other_id", F.when(F.col("known") & F.col("angles").isNotNull(), 0.0).otherwise(-1.0).alias("score"))
    pairs = salted_join(p.where("size(angles) > 0").drop("vector"), summary, on)
    angle = F.get("angles", F.col("pivot"))
    gap = F.greatest(F.lit(0.0), angle - F.col("hi"), F.col("lo") - angle)
    reach = F.when(F.col("pivot") == _ZERO, 0.0).otherwise(F.cos(gap))
    pairs = settled(pairs.select(*named, "bundle", "block", (reach + 2 * 10.0**-digits).alias("reach")), "pairs")
    placed = pairs.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("reach"), "block")))
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in named) + ", other_id long, score double"

    def best_of(part: pd.DataFrame, ids: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best ``keep`` for some probes; ``ids`` ascend, so the first of equals is the least."""
        mine = _unit(part["vector"].tolist(), width)
        cosine = np.round(np.clip(mine @ theirs.T, -1, 1), places)
        if skip_same:
            cosine[part["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
        at = cosine.argmax(axis=1)[:, None] if keep == 1 else np.argsort(-cosine, axis=1, kind="stable")[:, :keep]
        return at, np.take_along_axis(cosine, at, axis=1)

    def score(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        wanted = asked["wanted"].explode()
        rows_of = pd.Series(np.repeat(np.arange(len(asked)), asked["wanted"].str.len()), index=wanted.to_numpy(dtype=np.int64)).groupby(level=0)
        rows_of = {b: r.to_numpy() for b, r in rows_of}
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for block, ids, vectors in zip(held["block"], held["ids"], held["vectors"], strict=True):
            order, ids = np.argsort(ids, kind="stable"), np.sort(ids)
            theirs, rows = _unit(list(vectors), width)[order], rows_of.get(block, [])
            for at in range(0, len(rows), VECTORS_PER_BLOCK):  # one matrix product for some probes
                some = rows[at : at + VECTORS_PER_BLOCK]
                near, how = best_of(asked.iloc[some], ids, theirs)
                ok = np.isfinite(how).ravel()
                found.append((np.repeat(some, near.shape[1])[ok], ids[near.ravel()][ok], how.ravel()[ok]))
        row, other, cosine = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((other, -cosine, row))
        row, other, cosine = row[order], other[order], cosine[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < keep
        return asked[named].iloc[row[best]].assign(other_id=other[best], score=cosine[best])

    def opened(some: DataFrame) -> DataFrame:
        tile = F.floor(F.col("block") / BLOCKS_PER_TILE).alias("tile")  # numbers of blocks run on within a task
        wanted = some.groupBy(*named, "bundle", tile).agg(F.collect_list("block").alias("wanted"))  # as many as a tile has
        asked = wanted.join(p.select(*named, "vector"), named)
        blocks = index.blocks.select("block", "ids", "vectors").join(some.select(F.col("bundle").alias("met"), "block").distinct(), "block")
        return asked.groupBy("bundle", "tile").cogroup(blocks.withColumn("__tile", tile).groupBy("met", "__tile")).applyInPandas(score, schema)

    order = Window.partitionBy(*group).orderBy(F.desc("score"), "other_id")
    first = settled(opened(placed.where(F.col("place") <= FIRST_BLOCKS)), "first")
    floor = first.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select(*group, F.col("score").alias("floor"))
    later = placed.where(F.col("place") > FIRST_BLOCKS).join(floor, group, "left").where(F.col("reach") >= F.coalesce("floor", F.lit(-2.0)))
    later = settled(later.select(*named, "bundle", "block"), "later")
    found = first.unionByName(opened(later)).unionByName(alike).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return found if k > 1 else found.drop("place")


def words_of(value: Column) -> Column:
    return F.filter(F.split(F.lower(value), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def mean_of_tokens(values: DataFrame, token_vectors: DataFrame) -> DataFrame:
    """(value, vector): the mean over the known words of each distinct value.

    A value without a known word falls back to its known characters, and to null when it
    has none of these either.
    """
    return values.select("value").distinct().join(known_means(values, token_vectors), "value", "left")


def known_means(values: DataFrame, token_vectors: DataFrame) -> DataFrame:
    """``mean_of_tokens`` of the values that have one. Only these are made distinct, so with few known tokens few values move."""
    known = token_vectors.filter(F.col("embedding").isNotNull())
    word, char = (lambda v: F.explode(words_of(v)).alias("token")), (lambda v: F.explode(F.split(v, "")).alias("token"))

    def with_any(pieces: Callable[[Column], Column], tokens: DataFrame) -> DataFrame:
        return values.select("value", pieces(F.col("value"))).join(tokens, "token", "left_semi").select("value").distinct()

    def mean(some: DataFrame, pieces: Callable[[Column], Column]) -> DataFrame:
        cells = some.select("value", pieces(F.col("value"))).join(known, "token").select("value", F.posexplode("embedding").alias("dim", "x"))
        per_dim = cells.groupBy("value", "dim").agg(F.avg("x").alias("x"))
        # A list as long as the vectors are wide.
        line = F.array_sort(F.collect_list(F.struct("dim", "x")))
        return per_dim.groupBy("value").agg(F.transform(line, lambda c: c["x"]).alias("vector"))

    by_word = settled(with_any(word, known), "with-words")
    by_char = with_any(char, known.where("char_length(token) <= 1")).join(by_word, "value", "left_anti")
    return mean(by_word, word).unionAll(mean(by_char, char))
