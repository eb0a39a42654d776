"""Fixpoints by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..core import cut


def shortest_paths(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """i, j, d: least distances of (i, j, d), by doubling path lengths until nothing changes."""
    now = cut(edges.groupBy("i", "j").agg(F.min("d").alias("d")))
    for _ in range(rounds):
        legs = now.select(F.col("j").alias("k"), F.col("i"), F.col("d").alias("d1")).join(now.select(F.col("i").alias("k"), F.col("j"), F.col("d").alias("d2")), "k")
        new = cut(now.unionByName(legs.select("i", "j", (F.col("d1") + F.col("d2")).alias("d"))).groupBy("i", "j").agg(F.min("d").alias("d")))
        same = new.agg(F.count("*"), F.sum("d")).first() == now.agg(F.count("*"), F.sum("d")).first()
        now = new
        if same:
            break
    return now
