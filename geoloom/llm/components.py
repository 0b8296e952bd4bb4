"""Connected components of links between ids, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch

#: Edges whose nodes may be broadcast, each with one number: some 40 MB.
BROADCAST = 300_000


def _star(edges: DataFrame, large: bool, settle) -> DataFrame:
    """edges (a, b). Large: every larger neighbour of a node moves to the node's least neighbour. Small: every
    neighbour that is not larger does."""
    if large:
        near = edges.union(edges.select("b", "a"))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = settle(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    moved = near.join(least, "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of each id in links (a, b): the smallest id reachable. Ids without links are not in it."""
    edges = scratch.write(links.where("a <> b").select("a", "b").distinct(), f"{name}0")
    last, step = None, 0
    while True:
        digest = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(digest) == last or not digest[0]:
            break
        last, step = tuple(digest), step + 1
        # few nodes are broadcast; else they are written first, as a node with very many neighbours can be split where
        # both sides of a join are plain rows
        few = digest[0] <= BROADCAST
        for large in (True, False):
            side = f"{name}{step}{'large' if large else 'small'}"
            settle = F.broadcast if few else lambda df: scratch.write(df, f"{side}-least")  # noqa: B023
            edges = scratch.write(_star(edges, large, settle), side)
    own = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return own.union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
