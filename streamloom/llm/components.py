"""Connected components of an undirected graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import forget, saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _unsettled(edges: DataFrame) -> DataFrame:
    """Nodes by which edges (u, v) aren't disjoint stars yet: those with several v, or with a v and a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every node that has an edge but isn't the smallest of its component itself;
    component is the smallest id of the node's component.

    Minima come from partial aggregates and the joins are ordinary equi-joins, so a node with very many
    edges is split by adaptive skew handling.  Each round is written to the shared folder; nothing but a
    node reaches the driver.  Empty input gives an empty result; null ends are ignored.  forget() may be
    told of the result.
    """
    now = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter(f"{a} <> {b}").distinct()
    now = saved(now, "components")
    while _unsettled(now).take(1):
        new = saved(_small_star(_large_star(now)), "components")
        forget(now)
        now = new
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out.streamloom_path = now.streamloom_path
    return out
