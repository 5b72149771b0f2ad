"""Are two result tables the same, as bags of rows, in order, or up to column order?

Rows of the two results are never paired. Both are counted into one aggregate, gold rows
with +1 and predicted rows with -1, so equal rows cancel and map-side counts absorb hot ones.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import groupby, islice, product
from itertools import permutations as arrange

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillcheck.operators.skew import salted_join
from quillcheck.session import settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    return kind.simpleString()


def _number(c: Column, kind: T.DataType) -> Column:
    """A number as the text of a double; whole numbers that a double can't tell apart keep all their digits."""
    large = F.abs(c) >= 2**53
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        exact = c.cast("string") if isinstance(kind, T.IntegralType) else F.when(c == F.floor(c), F.floor(c).cast("string"))
    else:
        exact = F.when(F.abs(c) < 9.2e18, F.floor(c).cast("string"))
    text = c.cast("double").cast("string")
    return F.coalesce(F.when(large, exact), text)


def typed_cell(name: str, kind: T.DataType) -> Column:
    """The cell as text with its type family, for results whose column types disagree."""
    value = _number(F.col(name), kind) if isinstance(kind, T.NumericType) else F.col(name).cast("string")
    return F.when(F.col(name).isNotNull(), F.concat(value, F.lit(":" + _family(kind))))


def _numbered(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def aligned(gold: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both results with columns c0, c1, …; columns whose types cannot be equal become typed text."""
    g, p = _numbered(gold), _numbered(pred)
    for a, b in zip(g.schema.fields, p.schema.fields):
        mixed = a.dataType != b.dataType and not (isinstance(a.dataType, T.IntegralType) and isinstance(b.dataType, T.IntegralType))
        if _family(a.dataType) != _family(b.dataType) or (mixed and _family(a.dataType) == "number"):
            g = g.withColumn(a.name, typed_cell(a.name, a.dataType))
            p = p.withColumn(b.name, typed_cell(b.name, b.dataType))
    return g, p


def _signed(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return gold.withColumn("__sign", F.lit(1)).unionAll(pred.withColumn("__sign", F.lit(-1)))


def _verdict(signed: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """n_gold, n_pred, n_unmatched and equal, per ``by``, of +1/-1 rows."""
    per_row = signed.groupBy(*by, *[k for k in keys if k not in by]).agg(
        F.sum("__sign").alias("net"),
        F.count_if(F.col("__sign") == 1).alias("g"),
        F.count_if(F.col("__sign") == -1).alias("p"),
    )
    totals = per_row.groupBy(*by) if by else per_row
    return totals.agg(
        F.coalesce(F.sum("g"), F.lit(0)).alias("n_gold"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("n_pred"),
        F.coalesce(F.sum(F.abs("net")), F.lit(0)).alias("n_unmatched"),
    ).withColumn("equal", F.col("n_unmatched") == 0)


def shape(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Row and column counts, and what they already decide: equal, different or open."""
    sizes = _signed(gold.select(F.lit(0).alias("x")), pred.select(F.lit(0).alias("x"))).agg(
        F.count_if(F.col("__sign") == 1).alias("n_gold"), F.count_if(F.col("__sign") == -1).alias("n_pred")
    )
    same_width = len(gold.columns) == len(pred.columns)
    return sizes.select(
        "*",
        F.lit(len(gold.columns)).alias("gold_columns"),
        F.lit(len(pred.columns)).alias("pred_columns"),
        F.when((F.col("n_gold") == 0) & (F.col("n_pred") == 0), "equal")
        .when((F.col("n_gold") != F.col("n_pred")) | ~F.lit(same_width), "different")
        .otherwise("open")
        .alias("decision"),
    )


def bag_equal(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: the exact bag comparison, column by column in the given order."""
    if len(gold.columns) != len(pred.columns):
        counts = shape(gold, pred).select("n_gold", "n_pred")
        return counts.select(
            "*",
            (F.col("n_gold") + F.col("n_pred")).alias("n_unmatched"),
            (F.col("n_gold") + F.col("n_pred") == 0).alias("equal"),
        )
    g, p = aligned(gold, pred)
    return _verdict(_signed(g, p), g.columns)


def unordered_row(df: DataFrame) -> Column:
    """The row's cells as typed text in sorted order."""
    return F.array_sort(F.array(*[F.coalesce(typed_cell(f.name, f.dataType), F.lit("None:null")) for f in df.schema.fields]))


def _hash_sum(c: Column) -> Column:
    return F.coalesce(F.sum(F.xxhash64(c).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and a hash total of the unordered rows; it can reject but never accept."""
    return df.select(unordered_row(df).alias("r")).agg(F.count(F.lit(1)).alias("n"), _hash_sum(F.col("r")).alias("total"))


def quick_reject(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: True when the fingerprints already rule equality out."""
    both = fingerprint(gold).withColumn("side", F.lit("g")).unionAll(fingerprint(pred).withColumn("side", F.lit("p")))

    def of(side: str, col: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(col)))

    return both.agg(
        of("g", "n").alias("n_gold"),
        of("p", "n").alias("n_pred"),
        ((of("g", "n") != of("p", "n")) | (of("g", "total") != of("p", "total"))).alias("rejected"),
    )


def column_fingerprints(df: DataFrame) -> DataFrame:
    """(pos, n, total): per column the non-null count and hash total of its typed cells."""
    cells = [typed_cell(f.name, f.dataType) for f in df.schema.fields]
    sums = df.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(cells)], *[_hash_sum(c).alias(f"t{i}") for i, c in enumerate(cells)]
    )
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.col(f"n{i}").alias("n"), F.col(f"t{i}").alias("total")) for i in range(len(cells))])
    return sums.select(F.inline(rows))


def column_matches(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(gold_pos, pred_pos): columns that hold the same bag of cells by fingerprint."""
    g = column_fingerprints(gold).withColumnRenamed("pos", "gold_pos")
    return g.join(column_fingerprints(pred).withColumnRenamed("pos", "pred_pos"), ["n", "total"]).select("gold_pos", "pred_pos")


def permute(df: DataFrame, order: Sequence[int]) -> DataFrame:
    return df.select(*[df.columns[i] for i in order])


def permutations(matches: dict[int, list[int]], width: int, like: Sequence[int] = ()) -> Iterator[list[int]]:
    """Ways to give every gold column its own matching predicted column.

    ``like``: for each predicted column the first one that is the same in every row; of columns that are the same only
    one order is tried.
    """

    def extend(chosen: list[int]) -> Iterator[list[int]]:
        if len(chosen) == width:
            yield chosen
            return
        tried = set()
        for p in matches.get(len(chosen), []):
            kind = like[p] if like else p
            if p not in chosen and kind not in tried:
                tried.add(kind)
                yield from extend([*chosen, p])

    return extend([])


def same_columns(df: DataFrame) -> list[int]:
    """For each column the number of the first one with the same cell in every row: one job, numbers only."""
    names = df.columns
    pairs = [(i, j) for j in range(len(names)) for i in range(j)]
    if not pairs:
        return list(range(len(names)))
    kinds = {i: f.dataType for i, f in enumerate(df.schema.fields)}
    tests = [F.bool_and(F.col(names[i]).eqNullSafe(F.col(names[j]))) if kinds[i] == kinds[j] else F.lit(False) for i, j in pairs]
    found = df.agg(*[t.alias(f"t{k}") for k, t in enumerate(tests)]).first()
    first = list(range(len(names)))
    for (i, j), same in zip(pairs, found):
        if same:
            first[j] = min(first[j], first[i])
    return first


_ORDERS_PER_JOB = 64


def _cells(df: DataFrame) -> Column:
    return F.array(*[F.coalesce(typed_cell(f.name, f.dataType), F.lit("None:null")) for f in df.schema.fields])


def column_classes(gold: DataFrame, pred: DataFrame, pinned: int = 0) -> tuple[list[int], list[int]]:
    """Classes of the columns of both results, equal for columns that may stand for each other.

    First by the bag of a column's cells; then, round by round, by the bag of its cells each beside a signature of their
    row, which is a hash over the row's (class, cell) in no order of columns. Rounds end when no class is split any
    more; each is one job that returns a number per column. The last ``pinned`` columns are classes of their own.
    """
    width = len(gold.columns)
    g, p = aligned(gold, pred) if pinned else (_numbered(gold), _numbered(pred))
    both = g.select(F.lit(0).alias("side"), _cells(g).alias("cells")).unionAll(p.select(F.lit(1).alias("side"), _cells(p).alias("cells")))
    classes = [[-1 - i if i >= width - pinned else 0 for i in range(width)] for _ in range(2)]
    first = not pinned  # without any class yet, a row's signature says nothing of it
    while True:
        known = F.when(F.col("side") == 0, F.array(*[F.lit(c) for c in classes[0]])).otherwise(F.array(*[F.lit(c) for c in classes[1]]))
        named = F.zip_with(known, "cells", lambda k, c: F.concat_ws(":", k.cast("string"), c))
        rows = both.select("side", "cells", F.xxhash64(F.array_sort(named)).alias("row"))
        seen = [F.sum(F.xxhash64(F.get("cells", F.lit(i)), *([] if first else ["row"])).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
        sums = {r["side"]: r for r in rows.groupBy("side").agg(*seen).collect()}
        told = [[(classes[k][i], sums[k][f"s{i}"] if k in sums else None) for i in range(width)] for k in range(2)]
        number = {t: n for n, t in enumerate(sorted({t for side in told for t in side if t[0] >= 0}, key=str))}
        split = [[t[0] if t[0] < 0 else number[t] for t in side] for side in told]
        done = [len(set(a)) == len(set(b)) for a, b in zip(split, classes, strict=True)]
        classes = split
        if sorted(classes[0]) != sorted(classes[1]) or (all(done) and not first) or all(len(set(c)) == width for c in classes):
            return classes[0], classes[1]
        first = False


def equal_up_to_columns(gold: DataFrame, pred: DataFrame, pinned: int = 0) -> DataFrame:
    """Bag comparison under the best column order; the last ``pinned`` columns stay where they are.

    Only numbers per column reach the driver. Classes of columns (``column_classes``) usually leave one order, whose exact
    comparison is the answer. Columns of a class that are the same in every row take one order only; where several
    are left all the same, one job compares many of them.
    """
    width = len(gold.columns)
    if width != len(pred.columns):
        return bag_equal(gold, pred)
    of_gold, of_pred = column_classes(gold, pred, pinned)
    if sorted(of_gold) != sorted(of_pred):
        return bag_equal(gold, pred).withColumn("equal", (F.col("n_gold") == 0) & (F.col("n_pred") == 0))
    found = {i: [j for j in range(width) if of_pred[j] == c] for i, c in enumerate(of_gold)}
    several = any(len(v) > 1 for v in found.values())
    orders = permutations(found, width, same_columns(_numbered(pred)) if several else ())
    batch = list(islice(orders, _ORDERS_PER_JOB))
    order = batch[0]
    while len(batch) > 1:
        each = [bag_equal(gold, permute(pred, o)).select(F.lit(k).alias("k"), "equal") for k, o in enumerate(batch)]
        hit = union_all(each).filter("equal").agg(F.min("k")).first()[0]
        if hit is not None:
            order = batch[hit]
            break
        batch = list(islice(orders, _ORDERS_PER_JOB))
        order = batch[0] if batch else order
    return bag_equal(gold, permute(pred, order))


def ordered_equal(gold: DataFrame, pred: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Comparison row by row, up to the order of columns: both results carry their row number in ``ordinal``."""
    g = gold.select(*[c for c in gold.columns if c != ordinal], ordinal)
    p = pred.select(*[c for c in pred.columns if c != ordinal], ordinal)
    return equal_up_to_columns(g, p, pinned=1)


_PAIR = ["query_id", "db_id"]


def _signatures(rows: DataFrame, beside: Column) -> DataFrame:
    """(query_id, db_id, role, signs): for each column a hash total of its cells, each beside what ``beside`` says of its row."""
    cells = rows.select(*_PAIR, "role", beside.alias("__beside"), F.posexplode("cells").alias("pos", "cell"))
    total = F.sum(F.xxhash64("cell", "__beside").cast("decimal(38,0)"))
    per_column = cells.groupBy(*_PAIR, "role", "pos").agg(total.alias("total"))
    listed = F.array_sort(F.collect_list(F.struct("pos", F.col("total").cast("string").alias("total"))))  # as many as a result has columns
    return per_column.groupBy(*_PAIR, "role").agg(F.transform(listed, lambda x: x["total"]).alias("signs"))


def _orders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All orders of the columns in which only columns of equal signature change places, one row at a time."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            groups = [list(g) for _, g in groupby(sorted(range(len(row.signs)), key=lambda i: row.signs[i]), key=lambda i: row.signs[i])]
            for k, chosen in enumerate(product(*(arrange(g) for g in groups))):
                yield pd.DataFrame({"query_id": [row.query_id], "db_id": [row.db_id], "variant": [k], "order": [[i for g in chosen for i in g]]})


def _in_order(rows: DataFrame, orders: DataFrame, keys: Sequence[str]) -> DataFrame:
    placed = salted_join(rows, orders, keys)
    return placed.withColumn("cells", F.transform("order", lambda i: F.get("cells", i))).drop("order")


def suite_verdicts(results: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """Per query: equal on all databases, up to the order of columns.

    results: query_id, db_id, role (gold or pred), ``ordinal`` (the row's number, if results are in order) and the cells of
    one result row, as columns of their own or as an array ``cells`` of typed text (results of unlike widths).
    ``roster``: every (query_id, db_id) that was run; one without any row on both sides is equal. Its boolean ``ordered``
    tells which gold queries sort: there rows must agree in their places too.

    All pairs on all databases are compared together. A column's signature is a hash total of its cells, each beside the
    row's number where order counts, else beside a signature of the row that no order of columns changes, refined
    twice. Results whose columns' signatures differ are not equal; else columns are put in the order of their signatures
    and the rows are compared in full. Where unlike columns share a signature, their other orders are tried, for these
    pairs only.
    """
    if "cells" not in results.columns:
        rest = [c for c in results.columns if c not in (*_PAIR, "role", "ordinal")]
        cells = _cells(results.select(*rest))
        results = results.withColumn("cells", cells)
    rows = results.select(*_PAIR, "role", "cells", (F.col("ordinal") if "ordinal" in results.columns else F.lit(None)).cast("long").alias("ordinal"))
    run = roster if roster is not None else results.select(*_PAIR).distinct()
    run = run.select(*_PAIR, (F.coalesce("ordered", F.lit(False)) if "ordered" in run.columns else F.lit(False)).alias("ordered")).distinct()
    of = lambda role, c: F.max(F.when(F.col("role") == role, c))
    shapes = rows.groupBy(*_PAIR).agg(
        F.count_if(F.col("role") == "gold").alias("n_gold"), F.count_if(F.col("role") == "pred").alias("n_pred"),
        of("gold", F.size("cells")).alias("gold_width"), of("pred", F.size("cells")).alias("pred_width"),
    )
    shapes = run.join(shapes, _PAIR, "left").fillna(0, ["n_gold", "n_pred"])
    alike = (F.col("n_gold") == F.col("n_pred")) & (F.col("gold_width") == F.col("pred_width"))
    shapes = settled(shapes.select(*_PAIR, "ordered", F.when((F.col("n_gold") == 0) & (F.col("n_pred") == 0), True).when(~F.coalesce(alike, F.lit(False)), False).alias("decided")), "shapes")
    rows = salted_join(rows, shapes.where("decided IS NULL").select(*_PAIR, "ordered"), _PAIR)
    rows = settled(rows.withColumn("ordinal", F.when(F.col("ordered"), F.coalesce("ordinal", F.lit(-1)))).drop("ordered"), "rows")

    signs = _signatures(rows, F.col("ordinal"))
    for _ in range(2):
        signed = salted_join(rows, settled(signs, "signatures"), [*_PAIR, "role"])
        row = F.xxhash64(F.array_sort(F.zip_with("signs", "cells", lambda s, c: F.concat_ws(":", s, c))))
        signs = _signatures(signed, F.xxhash64(row, "ordinal"))
    signs = settled(signs, "signatures")
    places = F.transform(F.array_sort(F.transform("signs", lambda s, i: F.struct(s.alias("s"), i.alias("i")))), lambda x: x["i"])
    canonical = _in_order(rows, signs.select(*_PAIR, "role", places.alias("order")), [*_PAIR, "role"])

    def compared(gold_and_pred: DataFrame, by: Sequence[str]) -> DataFrame:
        sign = F.when(F.col("role") == "gold", 1).otherwise(-1)
        net = gold_and_pred.groupBy(*by, "ordinal", "cells").agg(F.sum(sign).alias("net"))
        return net.groupBy(*by).agg(F.bool_and(F.col("net") == 0).alias("equal"))

    sides = signs.groupBy(*_PAIR).agg(of("gold", F.array_sort("signs")).alias("g"), of("pred", F.array_sort("signs")).alias("p"))
    tied = sides.select(*_PAIR, (F.col("g") == F.col("p")).alias("may"), (F.size(F.array_distinct("p")) < F.size("p")).alias("tied"))
    first = settled(compared(canonical, _PAIR).join(tied, _PAIR).select(*_PAIR, (F.col("equal") & F.col("may")).alias("equal"), (~F.col("equal") & F.col("may") & F.col("tied")).alias("open")), "first")
    open_ = first.where("open").select(*_PAIR)
    kinds = {c: results.schema[c].dataType.simpleString() for c in _PAIR}
    orders = signs.where("role = 'pred'").join(open_, _PAIR, "left_semi").select(*_PAIR, "signs")
    orders = orders.mapInPandas(_orders, f"query_id {kinds['query_id']}, db_id {kinds['db_id']}, variant long, order array<int>")
    tried = _in_order(rows.where("role = 'pred'").select(*_PAIR, "role", "cells", "ordinal"), orders, _PAIR)
    golds = canonical.where("role = 'gold'").join(orders.select(*_PAIR, "variant"), _PAIR).select(*tried.columns)
    other = compared(tried.unionByName(golds), [*_PAIR, "variant"]).groupBy(*_PAIR).agg(F.bool_or("equal").alias("other"))
    told = first.join(other, _PAIR, "left").select(*_PAIR, (F.col("equal") | F.coalesce("other", F.lit(False))).alias("equal"))
    per_db = shapes.join(told, _PAIR, "left").select(*_PAIR, F.coalesce("decided", "equal").alias("equal"))
    return per_db.groupBy("query_id").agg(
        F.count("*").alias("n_databases"), F.count_if("equal").alias("n_equal"), F.bool_and("equal").alias("passed")
    )


def any_variant(verdicts: DataFrame) -> DataFrame:
    """Per query: some variant passes on all databases. verdicts: query_id, variant, db_id, equal."""
    per_variant = verdicts.groupBy("query_id", "variant").agg(F.bool_and("equal").alias("passed"))
    return per_variant.groupBy("query_id").agg(F.count("*").alias("n_variants"), F.bool_or("passed").alias("passed"))


def first_passing(queries: DataFrame, judge: Callable[[DataFrame], DataFrame], at_once: int = 4096) -> DataFrame:
    """Per query the first variant that passes on all databases: query_id, n_variants, first_variant (null if none), passed.

    queries: query_id, ``n`` (variants 0 to n - 1) and whatever ``judge`` needs to make verdicts (query_id, variant, db_id,
    equal) of rows with a ``variant``. Variants are dealt out in rounds that grow up to ``at_once``, and only to queries that none has
    passed for yet, so no row holds all of them and those behind the first that passes are not made.
    """
    open_ = settled(queries, "open")
    low, high, found = 0, 1, None
    while True:
        asked = open_.withColumn("variant", F.explode(F.sequence(F.lit(low).cast("long"), F.least(F.lit(high).cast("long"), F.col("n")) - 1)))
        per_variant = judge(asked).groupBy("query_id", "variant").agg(F.bool_and("equal").alias("passed"))
        passing = settled(per_variant.where("passed").groupBy("query_id").agg(F.min("variant").alias("first_variant")), "passing")
        found = passing if found is None else found.unionAll(passing)
        open_ = settled(open_.where(F.col("n") > high).join(passing, "query_id", "left_anti"), "open")
        if open_.isEmpty():
            break
        low, high = high, high + min(16 * high, at_once)
    told = queries.select("query_id", F.col("n").alias("n_variants")).join(found, "query_id", "left")
    return told.withColumn("passed", F.col("first_variant").isNotNull())


def keyed_columns_equal(gold: DataFrame, pred: DataFrame, ordinal: str) -> DataFrame:
    """Compare columns by name, whatever their order, keeping the row order.

    One line per column unit, True when every row agrees.
    """

    def cells(df: DataFrame) -> DataFrame:
        units = [f for f in df.schema.fields if f.name != ordinal]
        rows = F.array(
            *[
                F.struct(F.lit(f.name).alias("unit"), F.coalesce(typed_cell(f.name, f.dataType), F.lit("None:null")).alias("cell"))
                for f in units
            ]
        )
        return df.select(F.col(ordinal).alias("__at"), F.inline(rows))

    return _verdict(_signed(cells(gold), cells(pred)), ["unit", "__at", "cell"], ["unit"])


def reuse(pairs: DataFrame, store: DataFrame, judge) -> DataFrame:
    """Verdicts from the store where it has them, from ``judge`` for the rest.

    Keyed by (db_id, gold, pred). The last column tells whether the verdict was reused.
    """
    keys = ["db_id", "gold", "pred"]
    known = pairs.join(store.select(*keys, "verdict"), keys)
    fresh = judge(pairs.join(store, keys, "left_anti"))
    return known.withColumn("reused", F.lit(True)).unionByName(fresh.withColumn("reused", F.lit(False)))


def settle_status(attempts: DataFrame) -> DataFrame:
    """Add ``outcome``: what an attempt counts for.

    attempts: gold_ok, pred_ok, readable (the text could be cleaned) and equal. A failing gold
    query takes the attempt out of the count; any failure of the prediction is a fail.
    """
    return attempts.withColumn(
        "outcome",
        F.when(~F.col("gold_ok"), "skip")
        .when(~F.col("readable") | ~F.col("pred_ok"), "fail")
        .when(F.col("equal"), "pass")
        .otherwise("fail"),
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)
