"""Connected components of a link table, by repeated large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest node among it and them.

    Large star moves the neighbours above the node, small star those below it and the node itself.
    The smallest neighbour is found by an aggregation that combines before the exchange. Its result is
    exchanged once more, so that the join reads two plain exchanges: adaptive execution can then split
    the links of a node that has a large share of them.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least.repartition("a"), "a")
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links ``a``, ``b``; the component is its smallest node.

    Links may be in any direction and repeat; links of a node to itself say nothing. Each round is
    written to the shared folder, and the round before it is deleted; the end is reached when a round
    changes no link.
    """
    links = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialize(links, "links")
    mark = None
    while True:
        row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        now = (row["n"], row["h"])
        # nothing moved by the last round: stars around the smallest nodes
        if not row["n"] or now == mark:
            break
        mark, old = now, links
        links = materialize(_star(_star(links, large=True), large=False), "links")
        discard(old)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
