"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _least(links: DataFrame) -> DataFrame:
    """(u, m, degree) per node: its smallest neighbour or itself, and how many links name it."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, known: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    Alternates large-star and small-star steps, each a pre-aggregated minimum and a join, until no link changes. Nodes of a
    large share of all links, hubs that is, meet their minimum by broadcast, so no task holds a hub's links. Smallest
    nodes and nodes without links aren't listed. Links and components never leave the executors. ``known`` are the components
    of earlier links; then ``links`` are the new ones, and the result is of both.
    """
    if known is not None:
        at = known.select(F.col("node").alias("_node"), F.col("component").alias("_own"))
        for end in (a, b):
            links = links.join(at, F.col(end) == F.col("_node"), "left").withColumn(end, F.coalesce("_own", end)).drop("_node", "_own")
        new = C.materialize(components(links, a, b, rounds), "new-components")
        onward = new.select(F.col("node").alias("_node"), F.col("component").alias("_own"))
        moved = known.join(onward, F.col("component") == F.col("_node"), "left")
        return moved.select("node", F.coalesce("_own", "component").alias("component")).unionByName(new)
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    edges = C.materialize(edges, "links")
    n = edges.count()
    if not n:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = C.join_groups(both.filter("v > u"), _least(both), "u", "degree", 2 * n)
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        small = C.join_groups(large, _least(large), "u", "degree", 2 * n)
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        before, edges = edges, C.materialize(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u > v").distinct(), "links")
        C.discard(before)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            break
        mark, n = now, now["n"]
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
