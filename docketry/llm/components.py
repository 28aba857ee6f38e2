"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node below the node's smallest neighbour.

    The least neighbours are written first: the join then has plain shuffles on both sides, and
    adaptive execution splits the rows of a hub that has very many neighbours.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least-neighbours")
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours below the smallest of them (written first, as in _large_star)."""
    least = stored(edges.groupBy("b").agg(F.min("a").alias("m")), "least-neighbours")
    moved = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns ``node`` and ``root`` (the smallest node reachable) for every node of ``edges`` (a, b longs).

    Self loops and repeated or reversed edges are allowed; an empty edge list gives no rows.
    Every round is written to the shared folder, so plans stay short and lost executors cost
    one round at most. Only a count and a checksum reach the driver.
    """
    state = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    seen = None
    while True:
        state = stored(_small_star(_large_star(state)) if seen else state, "edges")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    return state.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        state.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
