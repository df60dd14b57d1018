"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadastra.operators.skew import join_groups


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))


def connected_components(edges: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of all nodes in ``edges`` (columns u, v: longs, undirected); a component is named by its smallest node.

    Alternates large-star and small-star steps until nothing changes: then every node points at its component's smallest node. ``save`` has
    to cut lineage (a checkpoint or a written table). Nodes of high degree are joined apart (join_groups).
    """
    def star(now: DataFrame, large: bool) -> DataFrame:
        if large:  # each larger neighbour of u moves to the smallest node near u
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            moved = join_groups(both, _mins(both), "u", "degree").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        else:  # u and its smaller neighbours move to the smallest of them
            moved = join_groups(now, _mins(now), "u", "degree")
            moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    now = save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        now = save(star(save(star(now, True)), False))
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last or not mark[0]:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
