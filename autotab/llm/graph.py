"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autotab.llm.common import stored
from autotab.session import release


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours.  It is joined to the edges of u as it is: a hub's
    side of that join is what Spark splits as skewed."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = _both(edges)
    return (both.join(_smallest(both), "u").filter("v > u AND v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _smallest(down)
    moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select("u", F.col("m").alias("v"))
    return moved.union(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node that is not the smallest of its component, with that smallest
    node, for undirected ``edges`` (u, v) with u <> v.

    Each round is written to the shared folder; the loop ends when a round
    leaves the edge set as it was.
    """
    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = stored(edges.select("u", "v"))
    seen = state(now)
    while seen[0]:
        last, now = now, stored(small_star(large_star(now)))
        release(last)
        after = state(now)
        if after == seen:
            break
        seen = after
    return now
