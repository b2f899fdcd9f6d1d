"""Connected components of a graph of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Rounds after which something must be wrong: each at least halves the length of the longest chain.
MOST_ROUNDS = 64
#: Links in a file of a round's table.
LINKS_IN_FILE = 200_000


def _are_stars(edges: DataFrame, size: int) -> bool:
    """Whether each u has one v, and no v is a u."""
    return edges.select("u").distinct().count() == size and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node it reaches) for each node of links.

    Large-star and small-star rounds (Kiveris et al., 2014): every node hands its larger neighbours, then its
    smaller ones, to the smallest node that it knows, until nothing changes.  Each round is two pre-aggregated
    minima and two joins, and ends in a table in the shared folder; all links of a node are never in one row, and a
    node of many links meets them by broadcast.  Links of a node with itself and repeated links are left out; nodes
    must not be null; without links the result is empty.
    """
    edges = C.materialize(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(edges)
    for _ in range(MOST_ROUNDS):
        size = before[0]
        if not size:
            break
        last = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("links"))
        # Only the rows with v > u are joined, but a node's larger neighbours are among all of its own.
        large = C.join_skewed(both.where("v > u"), least, "u", F.col("links"), 2 * size).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = C.materialize(large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().coalesce(max(1, -(-size // LINKS_IN_FILE))))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("links"))
        small = C.join_skewed(large, least, "u", F.col("links"), size).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # Files of a fair size: links get fewer from round to round, partitions of a shuffle do not.
        edges = C.materialize(small.where("u <> v").distinct().coalesce(max(1, -(-size // LINKS_IN_FILE))))
        C.discard(large, last)
        now = state(edges)
        # Both kinds of star keep the components.  When the links are stars, a node has one link down and is no centre.
        if now == before or _are_stars(edges, now[0]):
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
