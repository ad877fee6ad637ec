"""Connected components of a graph given as links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import settle


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (a, b); the component is its smallest node.

    In each round every node moves to the neighbour (or stays, as it may be the one itself)
    that comes first in an order drawn anew by hashing, and links between moved nodes are
    kept. A random order shortens chains as well as stars, so few rounds are needed; every
    round's tables are stored. A node with many links is grouped by partial minima only.
    """
    links = settle(links.select("a", "b").where("a <> b"), "links")
    labels = None
    turn = 0
    while not links.isEmpty():
        turn += 1
        ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        first = ways.groupBy("a").agg(F.min(rank("b")).alias("near"))
        moves = settle(first.select(F.col("a").alias("node"), F.least(rank("a"), F.col("near"))["n"].alias("to")), "moves")
        left = moves.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = moves.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = links.join(left, "a").join(right, "b").where("x <> y")
        links = settle(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if labels is None:
            labels = moves.select("node", F.col("to").alias("at"))
        else:
            step = moves.select(F.col("node").alias("at"), "to")
            labels = settle(labels.join(step, "at", "left").select("node", F.coalesce("to", "at").alias("at")), "labels")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = labels.groupBy("at").agg(F.min("node").alias("component"))
    return settle(labels.join(least, "at").select("node", "component"), "components")
