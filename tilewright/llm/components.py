"""Connected components of an edge table by alternating large-star and small-star steps, all in joins and aggregates."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.shared import drop_table, stage_table


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (u, v), both bigint: the label is the smallest node of its component.

    Rounds grow with the logarithm of the longest path. A hub's edges meet one row in a join, which adaptive execution splits, and are aggregated before the
    shuffle.
    """
    now = stage_table(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = None
    for _ in itertools.count():
        after = stage_table(_small_star(_large_star(now)), "edges")
        seen = after.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        drop_table(now)
        now = after
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        mark = tuple(seen)
