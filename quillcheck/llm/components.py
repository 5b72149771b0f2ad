"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcheck.session import settled


def _to_least(links: DataFrame, larger_only: bool) -> DataFrame:
    """Ties the neighbours of every node (or its smaller ones and itself) to the least of them.

    ``links`` are (a, b) with a > b. Only the least neighbour of a node is gathered, by an aggregate with map-side
    combine, so a node with any number of links needs no list.
    """
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger_only else links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
    tied = both.join(least, "a")
    if larger_only:
        moved = tied.where("b > a").select(F.col("b").alias("a"), F.col("to").alias("b"))
    else:
        moved = tied.where("b <> to").select(F.col("b").alias("a"), F.col("to").alias("b"))
        moved = moved.unionAll(least.select("a", F.col("to").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the component is its least node. Isolated nodes are absent.

    Alternates two star operations until the links no longer change, a number of rounds that grows with the logarithm
    of the number of nodes. Each round is written to the shared folder, so that lineage stays short.
    """
    state = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = settled(state, "links")
    mark = None
    while True:
        state = settled(_to_least(_to_least(state, True), False), "links")
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == mark:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = now
