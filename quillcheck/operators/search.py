"""The best values of a column, a table or a database for literals, by token-sort score.

Most literals have a near value, at a score of ``NEAR`` or more, which an index of grams finds by an equi-join (``grams``). The
number of values under each gram is known beforehand: a literal whose grams lead to more than ``MOST_CANDIDATES`` is
not looked up at all.

Literals without a near value, and those that weren't looked up, go on to the scan: values lie in blocks with the least and greatest length and the
greatest count of each letter; a block whose bound can't reach the wanted score is never opened, and within a block
the letters' counts of each value decide which ones are compared at all, best bound first, until no bound beats what was
found; the blocks with the best bounds are opened before the others. Blocks are cut within the tasks that hold the rows, so a hot column makes many blocks and no large group.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillcheck.functions.similarity import ValueBlock, token_sorted
from quillcheck.operators.grams import GramIndex, flat, letter_counts, write_now
from quillcheck.session import settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEAR = 0.85
_NEAR_RATIO = 0.845  # what rounds to NEAR
VALUES_PER_BLOCK = 4096
PROBES_PER_GROUP = 50_000
MOST_CANDIDATES = 20_000  # values that a literal is compared with one by one; with more, the scan is cheaper
BLOCKS_PER_PART = 1000
FIRST_BLOCKS = 4


# ---- what is searched ------------------------------------------------------------------


class Searchable:
    """Values made ready for search, each part written when it is first needed.

    ``values`` has a column ``value`` and the columns that say where it stands (``tbl``, ``col``). ``write(label, make)``
    stores a table; the default writes it for this job. ``unique``: the rows are known to be distinct.
    """

    def __init__(self, values: DataFrame, write: Callable[[str, Callable[[], DataFrame]], DataFrame] = write_now, unique: bool = False):
        self.spark = values.sparkSession
        self.keys = [c for c in values.columns if c != "value"]
        self.values = values
        self.write = write
        self.unique = unique

    @cached_property
    def entries(self) -> DataFrame:
        def make() -> DataFrame:
            v = self.values.filter("value IS NOT NULL")
            v = v if self.unique else v.distinct()
            return v.withColumn("norm", token_sorted(F.col("value")))

        return self.write("entries", make)

    @cached_property
    def grams(self) -> GramIndex:
        return GramIndex(self.entries.select(F.col("norm").alias("text")).where("text <> ''").distinct(), _NEAR_RATIO, self.write)

    @cached_property
    def blocks(self) -> DataFrame:
        """(block, keys, lo, hi, most, value, norm): runs of at most ``VALUES_PER_BLOCK`` values of one column."""
        keys, size = self.keys, VALUES_PER_BLOCK

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:  # sorted by keys and length
                table = pa.Table.from_batches([batch])
                at = 0
                while at < table.num_rows:
                    run = table.slice(at, size)
                    here = [run[k][0] for k in keys]
                    same = np.ones(run.num_rows, dtype=bool)
                    for k, v in zip(keys, here, strict=True):
                        equal = pc.fill_null(pc.equal(run[k], v), False) if v.is_valid else pc.is_null(run[k])
                        same &= equal.to_numpy()
                    run = run.slice(0, int(np.argmin(same)) if not same.all() else run.num_rows)
                    norm = run["norm"].combine_chunks()
                    lengths, counts = flat(norm)[2], letter_counts(norm)
                    out = [pa.array([v.as_py()], run.schema.field(k).type) for k, v in zip(keys, here, strict=True)]
                    out += [pa.array([int(lengths.min())]), pa.array([int(lengths.max())]), pa.array([counts.max(axis=0).tolist()], pa.list_(pa.int32()))]
                    out += [pa.ListArray.from_arrays(pa.array([0, run.num_rows], pa.int32()), run[c].combine_chunks()) for c in ("value", "norm")]
                    yield pa.RecordBatch.from_arrays(out, names=[*keys, "lo", "hi", "most", "value", "norm"])
                    at += run.num_rows

        def make() -> DataFrame:
            kinds = ", ".join(f"`{k}` {self.entries.schema[k].dataType.simpleString()}" for k in keys)
            ordered = self.entries.withColumn("size", F.length("norm")).sortWithinPartitions(*keys, "size", "norm").select(*keys, "value", "norm")
            packed = ordered.mapInArrow(cut, (kinds + ", " if kinds else "") + "lo long, hi long, most array<int>, value array<string>, norm array<string>")
            return packed.withColumn("block", F.monotonically_increasing_id())

        return self.write("blocks", make)

    def near(self, literals: DataFrame) -> DataFrame:
        """(literal, keys, value, score, exact) for every value that scores ``NEAR`` or more with a literal, for the literals
        with at most ``MOST_CANDIDATES`` candidates: all such values of a literal or none."""
        asked = literals.select("literal").filter("literal IS NOT NULL").distinct().withColumn("asked", token_sorted(F.col("literal")))
        asked = settled(asked, "asked")
        found = self.grams.partners(asked.select("asked").distinct(), MOST_CANDIDATES)
        scored = found.select("asked", F.col("text").alias("norm"), (F.bround(F.col("ratio") * 100, 0) / 100).alias("score")).where(F.col("score") >= NEAR)
        exact = F.lower(F.trim("literal")) == F.lower(F.trim("value"))
        return scored.join(asked, "asked").join(self.entries, "norm").select("literal", *self.keys, "value", "score", exact.alias("exact"))


# ---- search ----------------------------------------------------------------------------


class _Block:
    """The values of a block, ready to be compared with many probes."""

    def __init__(self, values: list[str], norms: list[str]):
        self.values, self.norms = values, ValueBlock(norms)
        self.counts = np.ascontiguousarray(np.minimum(letter_counts(pa.array(norms, pa.string())), 255).astype(np.uint8).T)
        self.exact: dict[str, list[int]] = {}
        for i, v in enumerate(values):
            self.exact.setdefault(v.strip().lower(), []).append(i)
        self.order = np.empty(len(values), dtype=np.int64)
        self.order[sorted(range(len(values)), key=values.__getitem__)] = np.arange(len(values))

    def bound(self, norm: str) -> np.ndarray:
        """The score that each value can reach, by the letters that it has in common with the probe."""
        if not norm:
            return np.zeros(len(self.values))
        own = np.minimum(letter_counts(pa.array([norm], pa.string()))[0], 255).astype(np.uint8)
        common = np.zeros(len(self.values), dtype=np.int32)
        for letter in np.flatnonzero(own):
            common += np.minimum(self.counts[letter], own[letter])
        if len(norm) > 255:  # counts end there
            common = np.minimum(self.norms.lengths, len(norm))
        return np.rint(100.0 * (2.0 * common / np.maximum(self.norms.lengths + len(norm), 1))) / 100.0


def _best_of_block(block: _Block, literal: str, norm: str, k: int, above: float | None) -> list[tuple[int, float, bool]]:
    """The k best of a block: score, then exact hit, then the order of the values."""
    n, order = len(block.values), block.order
    exact = np.zeros(n, dtype=bool)
    exact[block.exact.get(literal.strip().lower(), [])] = True
    bound = block.bound(norm)
    score = np.zeros(n)
    tried = np.zeros(n, dtype=bool)
    floor = -1.0 if above is None else above
    step = 64
    while True:
        open_ = np.flatnonzero(~tried & (bound > floor if above is not None and floor == above else bound >= floor))
        if not len(open_):
            break
        if len(open_) > step:
            open_ = np.sort(open_[np.argpartition(-bound[open_], step)[:step]])
        score[open_] = block.norms.percent(norm, open_)
        tried[open_] = True
        step *= 8
        done = np.flatnonzero(tried)
        if len(done) >= k:
            floor = max(floor, float(np.partition(score[done], len(done) - k)[len(done) - k]))
    done = np.flatnonzero(tried)
    if above is not None:
        done = done[score[done] > above]
    best = done[np.lexsort((order[done], ~exact[done], -score[done]))][:k]
    return [(int(i), float(score[i]), bool(exact[i])) for i in best]


def _spread(df: DataFrame, on: Sequence[str], hot: DataFrame, every: bool) -> DataFrame:
    """Adds ``part``: one of the parts of a hot key, or (``every``) a row for each of them."""
    parts = F.coalesce("__parts", F.lit(1))
    if not on:
        return df.withColumn("part", F.lit(0))
    joined = df.join(F.broadcast(hot), list(on), "left")
    part = F.explode(F.sequence(F.lit(0), parts - 1)) if every else F.pmod("block", parts).cast("int")
    return joined.withColumn("part", part).drop("__parts")


def _with_letters(probes: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array(letter_counts(batch.column(batch.schema.get_field_index("asked"))).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, "__own"])

    return probes.mapInArrow(count, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in probes.schema) + ", `__own` array<int>")


def scan(probes: DataFrame, s: Searchable, on: Sequence[str], mine: Sequence[str], differ: Sequence[str], k: int, above: float | None, per: Sequence[str]) -> DataFrame:
    """(on, mine, literal, value, further keys, score, exact): k best of blocks, the k best of every ``per`` among them.

    Probes have the columns ``on`` + ``mine`` + ``literal``. The ``FIRST_BLOCKS`` blocks with the best bounds are opened first;
    of the others only those whose bound reaches the score that is found by then.
    """
    p = settled(_with_letters(probes.withColumn("asked", token_sorted(F.col("literal")))), "probes")
    groups = max(1, -(-p.count() // PROBES_PER_GROUP))
    p = p.withColumn("bundle", F.pmod(F.xxhash64("literal"), F.lit(groups)).cast("int"))
    summary = s.blocks.select("block", *s.keys, "lo", "hi", "most")
    hot = s.blocks.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCKS_PER_PART)
    hot = hot.select(*on, F.ceil(F.col("n") / BLOCKS_PER_PART).cast("int").alias("__parts"))  # one row for every thousand blocks at most
    pairs = _spread(p, on, hot, True).join(_spread(summary, on, hot, False), [*on, "part"])
    for c in differ:
        pairs = pairs.filter(F.col(f"__p_{c}") != F.col(c))
    common = F.aggregate(F.zip_with("__own", "most", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    pairs = pairs.withColumn("__common", common).withColumn("__at", F.greatest("lo", F.least("hi", F.col("__common").cast("long"))))
    reach = 2 * F.least(F.col("__common").cast("long"), F.col("__at")) / F.greatest(F.length("asked") + F.col("__at"), F.lit(1))
    pairs = pairs.withColumn("__reach", reach + 0.01)  # a score is rounded to whole percent
    if above is not None:
        pairs = pairs.where(F.col("__reach") > above)
    pairs = settled(pairs.select("block", "bundle", *on, *mine, "literal", "asked", "__reach"), "block-pairs")
    place = F.row_number().over(Window.partitionBy(*per).orderBy(F.desc("__reach"), "block"))
    placed = pairs.withColumn("__place", place)
    first = settled(_opened(placed.where(F.col("__place") <= FIRST_BLOCKS), s, on, mine, k, above, groups), "first")
    best = F.row_number().over(Window.partitionBy(*per).orderBy(F.desc("score")))
    floor = first.withColumn("__n", best).where(F.col("__n") == k).select(*per, F.col("score").alias("__floor"))
    later = placed.where(F.col("__place") > FIRST_BLOCKS).join(floor, list(per), "left").where(F.col("__reach") >= F.coalesce("__floor", F.lit(0.0)))
    return first.unionByName(_opened(later, s, on, mine, k, above, groups))


def _opened(pairs: DataFrame, s: Searchable, on: Sequence[str], mine: Sequence[str], k: int, above: float | None, groups: int) -> DataFrame:
    """The k best values of each block for each of its probes."""
    pairs = pairs.select("block", "bundle", *on, *mine, "literal", "asked")
    bundles = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    blocks = s.blocks.select("block", bundles.alias("bundle"), *[F.col(c).alias(f"__{c}") for c in s.keys], "value", "norm")
    blocks = blocks.join(pairs.select("block", "bundle").distinct(), ["block", "bundle"], "left_semi")  # the others stay where they are
    rest = [c for c in s.keys if c not in on]
    kinds = {**{c: s.blocks.schema[c].dataType.simpleString() for c in s.keys}}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in on), *(f"`{c}` {kinds[c.removeprefix('__p_')]}" for c in mine), "literal string, value string", *(f"`{c}` {kinds[c]}" for c in rest), "score double, exact boolean"])
    names = [*on, *mine]

    def compare(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        rows: list[list] = [[] for _ in range(len(names) + 3 + len(rest) + 1)]
        if asked.num_rows and held.num_rows:
            row = held.slice(0, 1).to_pylist()[0]
            values, block = row["value"], _Block(row["value"], row["norm"])
            for probe in asked.to_pylist():
                for i, score, exact in _best_of_block(block, probe["literal"], probe["asked"], k, above):
                    found = [*(probe[c] for c in names), probe["literal"], values[i], *(row[f"__{c}"] for c in rest), score, exact]
                    for column, v in zip(rows, found, strict=True):
                        column.append(v)
        return pa.table(rows, names=[*names, "literal", "value", *rest, "score", "exact"]) if rows[0] else _nothing(names, rest, asked, held)

    def _nothing(names: list[str], rest: list[str], asked: pa.Table, held: pa.Table) -> pa.Table:
        kind = lambda c: (asked.schema.field(c) if c in asked.schema.names else held.schema.field(f"__{c}")).type
        fields = [*(pa.field(c, kind(c)) for c in names), pa.field("literal", pa.string()), pa.field("value", pa.string()), *(pa.field(c, kind(c)) for c in rest), pa.field("score", pa.float64()), pa.field("exact", pa.bool_())]
        return pa.schema(fields).empty_table()

    # Few bytes, but much work: parts of a given number aren't put together by their size
    pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "bundle")
    return pairs.groupBy("block", "bundle").cogroup(blocks.groupBy("block", "bundle")).applyInArrow(compare, schema)


def ranked(found: DataFrame, group: Sequence[str], carried: Sequence[str], k: int) -> DataFrame:
    """The k best rows of each group: score, exact hit, value, then the further columns in order."""
    if k == 1:
        better = F.struct((-F.col("score")).alias("worse"), (~F.col("exact")).alias("inexact"), "value", *carried)
        best = found.groupBy(*group).agg(F.min(better).alias("b"))
        return best.select(*group, (-F.col("b.worse")).alias("score"), (~F.col("b.inexact")).alias("exact"), "b.value", *[f"b.{c}" for c in carried])
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), F.desc("exact"), "value", *carried))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def search(
    probes: DataFrame, values: DataFrame | Searchable, on: Sequence[str], k: int = 1, above: float | None = None, differ: Sequence[str] = (), near: DataFrame | None = None
) -> DataFrame:
    """The k best values per distinct (``on``, ``differ``, literal), by token-sort score.

    probes: ``on`` + ``differ`` columns and ``literal``. values: ``on`` columns, ``value`` and further columns that say where
    it stands. ``differ`` columns exist on both sides and must not be equal (those of the probe come back as ``__p_…``).
    With ``above`` only scores beyond it count. ``near``: what ``Searchable.near`` found for these literals or more. A
    null literal or value has no part; a probe for which nothing is indexed has no row.
    """
    s = values if isinstance(values, Searchable) else Searchable(values)
    mine = [f"__p_{c}" for c in differ]
    p = probes.select(*on, *[F.col(c).alias(f"__p_{c}") for c in differ], "literal").filter("literal IS NOT NULL").distinct()
    group, carried = [*on, *mine, "literal"], [c for c in s.keys if c not in on]
    near = settled(s.near(p), "near") if near is None else near
    found = p.join(near, [*on, "literal"])
    for c in differ:
        found = found.filter(F.col(f"__p_{c}") != F.col(c))
    if above is not None:
        found = found.filter(F.col("score") > above)
    found = ranked(found, group, carried, k).select(*group, "value", *carried, "score", "exact")
    enough = found.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(*group)
    scanned = scan(p.join(enough, group, "left_anti"), s, on, mine, differ, k, above, group)
    both = found.join(enough, group, "left_semi").unionByName(scanned.select(*group, "value", *carried, "score", "exact"))
    return ranked(both, group, carried, k)


def search_elsewhere(probes: DataFrame, s: Searchable, own: str, k: int = 1, above: float | None = None, near: DataFrame | None = None) -> DataFrame:
    """The k best values per distinct (own, literal) whose ``own`` (say the table) is another one than the probe's.

    The probe's comes back as ``__p_<own>``. What isn't found near is searched in each of the other tables by name.
    """
    mine = f"__p_{own}"
    p = probes.select(F.col(own).alias(mine), "literal").filter("literal IS NOT NULL").distinct()
    carried = s.keys
    near = settled(s.near(p), "near") if near is None else near
    found = p.join(near, "literal").filter(F.col(mine) != F.col(own))
    found = ranked(found, [mine, "literal"], carried, k).select(mine, "literal", "value", *carried, "score", "exact")
    enough = found.groupBy(mine, "literal").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(mine, "literal")
    places = [r[0] for r in s.blocks.select(own).distinct().collect()]  # as many as the database has tables
    everywhere = F.array(*[F.lit(x) for x in places]) if places else F.array().cast("array<string>")
    asked = p.join(enough, [mine, "literal"], "left_anti").select(F.explode(everywhere).alias(own), mine, "literal").filter(F.col(own) != F.col(mine))
    scanned = scan(asked, s, [own], [mine], [], k, above, [mine, "literal"])
    both = found.join(enough, [mine, "literal"], "left_semi").unionByName(scanned.select(mine, "literal", "value", *carried, "score", "exact"))
    return ranked(both, [mine, "literal"], carried, k)
