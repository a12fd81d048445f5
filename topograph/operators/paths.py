"""Shortest paths with the tie-break of a first-in-first-out search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .graph import FRONTIER, Graph


def trails(graph: Graph, root: DataFrame, hops: int, goal: DataFrame | None = None) -> DataFrame:
    """(id, depth, trail): for each id reached from the root, the edge ids of the path that a queue finds first. With a goal, a frame of ids, the search ends where it is found.

    A queue discovers a level in order of the parents' discovery, then of edges; that is the lexicographic order of the trails, so the
    least trail of the least depth is the answer and no level needs a global ranking. As in Graph.levels, a step joins only what the one before found.
    """
    found = frontier = cut(root.select("id").withColumns({"depth": F.lit(0), "trail": F.array().cast("array<long>")}), "trails")
    steps = graph.edges.select("src", "dst", "edge_id")
    for k in range(hops):
        n = frontier.count()
        if not n or (goal is not None and not frontier.join(F.broadcast(goal.select("id")), "id", "left_semi").isEmpty()):
            break
        near = F.broadcast(frontier) if n <= FRONTIER else frontier
        reached = steps.join(near, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), F.concat("trail", F.array("edge_id")).alias("trail")).groupBy("id").agg(F.min("trail").alias("trail"))
        frontier = cut(reached.join(found.select("id"), "id", "left_anti").select("id", F.lit(k + 1).alias("depth"), "trail"), "trails")
        found = found.union(frontier)
    return found


def along(graph: Graph, found: DataFrame) -> DataFrame:
    """(step, src, dst, relation, edge_id) of one trail, a frame of one row."""
    steps = found.select(F.posexplode("trail").alias("step", "edge_id"))
    return graph.edges.join(F.broadcast(steps), "edge_id").select((F.col("step") + 1).alias("step"), "src", "dst", "relation", "edge_id")


def shortest_path(graph: Graph, start: DataFrame, goal: DataFrame, hops: int = 10) -> DataFrame:
    """along() from the start's id to the goal's, frames of one id; no rows without a path."""
    goal = goal.select("id").limit(1)
    return along(graph, trails(graph, start, hops, goal).join(F.broadcast(goal), "id", "left_semi"))
