"""Connected components in a number of rounds that grows with the logarithm of the number of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcheck.operators.skew import salted_join
from quillcheck.session import settled


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Ties the larger neighbours of every node, or the node and its smaller ones, to the least of them.

    ``links`` are (a, b) with a > b. Only the least neighbour of a node is gathered, as an aggregate; the links of a node
    with very many are dealt out before they meet it.
    """
    seen = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    met = salted_join(seen, least, ["a"])
    if large:
        tied = met.where("b > a").select(F.col("b").alias("x"), F.col("least").alias("y"))
    else:
        tied = met.where("b <> least").select(F.col("b").alias("x"), F.col("least").alias("y")).unionAll(least.select(F.col("a").alias("x"), F.col("least").alias("y")))
    return tied.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def connected_minimum(edges: DataFrame) -> DataFrame:
    """(node, canonical): each node of the undirected graph with the least node it is joined to.

    edges: a, b; repeated edges, loops and both directions are allowed, edges with a null are left out. Two star
    operations by turns until nothing changes; each round is written to the shared folder.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    nodes = edges.select(F.col("a").alias("node")).unionAll(edges.select(F.col("b").alias("node"))).distinct()
    links = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        links = settled(_star(_star(links, True), False), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    tied = links.select(F.col("a").alias("node"), F.col("b").alias("least"))
    return nodes.join(tied, "node", "left").select("node", F.coalesce("least", "node").alias("canonical"))
