"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a group-by and a join on the executors; edges and components never reach the driver. A hot node's edges are spread by the
engine's handling of skewed joins, as the smallest neighbour is pre-aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of an edge (a, b), the component being its smallest node. Edges may repeat and point either way; an edge
    of a node to itself counts for nothing; no edges give an empty result."""
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        new = cut(_star(_star(now, True), False), "edges")
        drop(now)
        now, before, state = new, state, _state(new)
        if state == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = cut(stars.union(stars.select(F.col("component").alias("node"), "component").distinct()), "components")
    drop(now)
    return out
