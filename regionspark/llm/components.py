"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import MAX_BROADCAST_BYTES, materialize


def _mins(links: DataFrame) -> DataFrame:
    """The least of each node u and its neighbours v."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))


def _small(df: DataFrame, edges: int) -> DataFrame:
    """Marked for broadcast if two rows of two longs for each of so many edges fit; a hub's rows then stay where they are."""
    return F.broadcast(df) if 2 * 24 * edges <= MAX_BROADCAST_BYTES else df


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Larger neighbours of each node go to the least of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_small(_mins(both), n), F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Smaller neighbours of each node, and the node, go to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_small(_mins(down), n), F.col("u") == F.col("n"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs -> (node, component): the least node reachable; nodes without edges don't appear.

    Each round's edges are written to the shared folder, which cuts lineage. The
    number of rounds grows with the logarithm of the component size; nothing but
    two numbers a round reaches the driver. Null ends and loops are ignored. A
    node with very many neighbours is summed with partial aggregates; its rows
    stay where they are while the nodes fit a broadcast, and AQE splits them in
    the joins beyond that.
    """
    edges = materialize(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), "cc")
    seen, n = None, edges.count()
    for _ in itertools.count():
        # a round never has more than two rows an edge
        edges = materialize(_small_star(_large_star(edges, n), 2 * n), "cc")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            # stars: every node points at the least of its component
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen, n = tuple(mark), mark[0]
