"""Row numbers and running totals without sending a whole table through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillcheck.session import settled

_LOW_BITS = (1 << 33) - 1


def _dense(df: DataFrame, name: str) -> DataFrame:
    """Turn ``__mono`` (partition number and position) into 0, 1, 2, … ``name``.

    Only one row per partition, its size, meets in a single window.
    """
    part = F.shiftright("__mono", 33)
    sizes = df.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    return (
        df.withColumn("__part", part)
        .join(starts, "__part")
        .withColumn(name, F.col("__start") + F.col("__mono").bitwiseAND(F.lit(_LOW_BITS)))
        .drop("__part", "__start", "__mono")
    )


def with_ordinal(df: DataFrame, keys: Sequence[Column | str], name: str = "ordinal") -> DataFrame:
    """Number rows 0, 1, 2, … in the order of ``keys`` by a distributed range sort.

    The sorted rows are written once before they are numbered: the range bounds come from
    a sample, so a second run of the sort could cut the partitions elsewhere.
    """
    ranged = df.orderBy(*keys).withColumn("__mono", F.monotonically_increasing_id())
    return _dense(settled(ranged), name)


def file_line_numbers(df: DataFrame, name: str = "line_no", file: str | None = None) -> DataFrame:
    """Number the rows of a fresh file scan in the order of file names and of lines in them; ``file`` names a column for the file.

    Only one row per file split, its size and first row, meets in a single window.
    """
    rows = df.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at")
    ).withColumn("__mono", F.monotonically_increasing_id())
    splits = rows.groupBy("__file", "__at").agg(F.count("*").alias("__size"), F.min("__mono").alias("__first"))
    before = Window.orderBy("__file", "__at").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("__file", "__at", "__first", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    return (
        rows.join(starts, ["__file", "__at"])
        .withColumn(name, F.col("__start") + F.col("__mono") - F.col("__first"))
        .select(*df.columns, name, *([] if file is None else [F.col("__file").alias(file)]))
    )


def running(
    df: DataFrame, order: str, totals: dict[str, tuple[str, Column]], block: int = 1 << 20
) -> DataFrame:
    """Add running ``sum`` or ``max`` columns along ``order``, a unique integer column.

    The sorted rows are cut into blocks of ``block``, so no window holds more than ``block`` rows however sparse ``order``
    is and however the other columns are skewed. Block totals, one row each, are accumulated first and added to the
    totals inside the blocks.
    """
    fold = {"sum": F.sum, "max": F.max}
    work = with_ordinal(df, [order], "__at").withColumn("__block", F.floor(F.col("__at") / F.lit(block)))
    for name, (_, value) in totals.items():
        work = work.withColumn(f"__v_{name}", value)
    per_block = work.groupBy("__block").agg(
        *[fold[kind](f"__v_{name}").alias(f"__t_{name}") for name, (kind, _) in totals.items()]
    )
    earlier = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(
        "__block",
        *[fold[kind](f"__t_{name}").over(earlier).alias(f"__c_{name}") for name, (kind, _) in totals.items()],
    )
    inside = Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = work.select(
        *df.columns,
        "__block",
        *[fold[kind](f"__v_{name}").over(inside).alias(f"__i_{name}") for name, (kind, _) in totals.items()],
    ).join(carried, "__block")
    for name, (kind, _) in totals.items():
        here, carry = F.col(f"__i_{name}"), F.col(f"__c_{name}")
        both = here + carry if kind == "sum" else F.greatest(here, carry)
        out = out.withColumn(name, F.coalesce(both, here, carry))
    return out.select(*df.columns, *totals)
