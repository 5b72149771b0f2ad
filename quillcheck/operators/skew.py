"""A join whose hot keys are dealt out over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_PART = 50_000
MOST_HOT = 2000


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` for ``inner``, ``left`` or ``left_semi``, where few keys may hold much of ``left``.

    Keys with more than ``ROWS_PER_PART`` rows of ``left``, and more than a share of 1 / ``MOST_HOT`` of them, are counted
    beforehand (so never more than ``MOST_HOT`` rows are broadcast); their rows are dealt out, and the rows of
    ``right`` that they meet are there once per part. Null keys meet nothing.
    """
    on = list(on)
    sizes = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > ROWS_PER_PART)
    total = left.groupBy().agg(F.count(F.lit(1)).alias("__all"))
    hot = sizes.where(F.col("__n") * MOST_HOT > total.select("__all").scalar())
    hot = F.broadcast(hot.select(*on, F.ceil(F.col("__n") / ROWS_PER_PART).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = left.join(hot, on, "left").withColumn("__part", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("__parts")
    spread = right.join(hot, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(spread, [*on, "__part"], how).drop("__part")
