"""Cycles in three modes.

dfs repeats a depth-first search with one cycle for each back edge, in one task, and is for one scope of a code graph; bounded lists all elementary cycles up to a
length by self-joins and scales out; strong_components gives the groups that cycles lie in, by trimming and colouring, and scales out as well.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import canonical_cycle
from ..storage import cut
from .graph import Graph

#: Edges that one depth-first search may take into a task.
DFS_EDGES = 2_000_000


def cycle_edges(graph: Graph, relation: str = "imports", scope: str | None = None, kind: str = "file") -> DataFrame:
    """Distinct (src, dst) between nodes of the kind, without loops, with their first edge_id."""
    nodes = graph.of_kind(kind)
    ids = (nodes.filter(F.col("file_path").startswith(scope)) if scope else nodes).select("id")
    pairs = graph.related(relation).filter("src <> dst").groupBy("src", "dst").agg(F.min("edge_id").alias("edge_id"))
    return pairs.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")


def bounded_cycles(edges: DataFrame, length: int) -> DataFrame:
    """(cycle array, length) of all elementary cycles of exactly so many edges, each once, the smallest id first."""
    e = edges.select("src", "dst").distinct()
    walk = e.filter("src < dst").select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("cycle"))
    for _ in range(length - 2):
        step = e.select(F.col("src").alias("last"), F.col("dst").alias("next"))
        walk = walk.join(step, "last").filter("next > first and not array_contains(cycle, next)").select("first", F.col("next").alias("last"), F.concat("cycle", F.array("next")).alias("cycle"))
    back = e.select(F.col("src").alias("last"), F.col("dst").alias("first"))
    return walk.join(back, ["last", "first"]).select("cycle", F.lit(length).alias("length"))


def cycle_members(edges: DataFrame, longest: int) -> DataFrame:
    """(id) of nodes on a cycle of at most so many edges."""
    out = None
    for n in range(2, longest + 1):
        own = bounded_cycles(edges, n).select(F.explode("cycle").alias("id"))
        out = own if out is None else out.union(own)
    return out.distinct()


def _search(rows: pd.DataFrame) -> pd.DataFrame:
    """Each back edge of a depth-first search closes a cycle."""
    rows = rows.sort_values(["src_seq", "edge_id"])
    after: dict[str, list[str]] = {}
    for src, dst in zip(rows["src"], rows["dst"], strict=True):
        after.setdefault(src, []).append(dst)
    found: dict[tuple, None] = {}
    state: dict[str, int] = {}
    for root in after:
        if root in state:
            continue
        trail, todo = [root], [iter(after[root])]
        state[root] = 1
        while todo:
            nxt = next(todo[-1], None)
            if nxt is None:
                state[trail.pop()] = 2
                todo.pop()
            elif state.get(nxt) == 1:
                cycle = trail[trail.index(nxt) :]
                k = cycle.index(min(cycle))
                found.setdefault(tuple(cycle[k:] + cycle[:k]))
            elif nxt not in state:
                state[nxt] = 1
                trail.append(nxt)
                todo.append(iter(after.get(nxt, ())))
    return pd.DataFrame({"cycle": pd.Series([[*c, c[0]] for c in found], dtype=object), "length": pd.Series([len(c) for c in found], dtype="int32"), "ord": pd.Series(range(len(found)), dtype="int32")})


def back_edge_cycles(graph: Graph, relation: str = "imports", scope: str | None = None) -> DataFrame:
    """(cycle, length, ord): closed cycles in order of length, then of discovery. For graphs of at most DFS_EDGES edges; beyond, use the other modes."""
    edges = cycle_edges(graph, relation, scope).join(graph.nodes.select(F.col("id").alias("src"), F.col("seq").alias("src_seq")), "src")
    if edges.limit(DFS_EDGES + 1).count() > DFS_EDGES:
        raise ValueError(f"over {DFS_EDGES} edges: use bounded_cycles or strong_components")
    return edges.groupBy(F.lit("all")).applyInPandas(_search, "cycle array<string>, length int, ord int").orderBy("length", "ord")


def circular(graph: Graph, relation: str = "imports", scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cycle, length, ord) and (file_path) of what lies on cycles. Graphs of over DFS_EDGES edges give their strong components, each as its smallest id and its size, in place of single cycles."""
    edges = cut(cycle_edges(graph, relation, scope), "cycle-edges")
    if edges.count() <= DFS_EDGES:
        found = cut(back_edge_cycles(graph, relation, scope), "cycles")
        return found, impacted_files(found)
    members = strong_components(edges)
    sizes = members.groupBy("component").agg(F.count("*").cast("int").alias("length"))
    groups = sizes.select(F.array("component", "component").alias("cycle"), "length", F.lit(0).alias("ord"))
    return groups, members.select(F.col("id").alias("file_path"))


def impacted_files(cycles: DataFrame) -> DataFrame:
    return cycles.select(F.explode("cycle").alias("file_path")).distinct()


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of each node on a cycle; the component is its smallest id.

    Rounds of trimming nodes without a way in or out, then of colouring: every node takes the smallest id that reaches it; the nodes of a colour that reach
    their colour's own node are its component and leave.
    """
    left, found = cut(edges.filter("src <> dst").select("src", "dst").distinct(), "edges"), None
    while True:
        while True:
            both = left.select(F.col("src").alias("id")).intersect(left.select(F.col("dst").alias("id")))
            kept = cut(left.join(both, F.col("src") == F.col("id"), "left_semi").join(both, F.col("dst") == F.col("id"), "left_semi"), "trimmed")
            if kept.count() == left.count():
                break
            left = kept
        if left.isEmpty():
            break
        colour = _spread(left, left.select(F.col("src").alias("id"), F.col("src").alias("colour")).distinct())
        same = left.join(colour.withColumnsRenamed({"id": "src", "colour": "a"}), "src").join(colour.withColumnsRenamed({"id": "dst", "colour": "b"}), "dst").filter("a = b")
        back = _spread(same.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("a").alias("of")), colour.filter("id = colour").select("id", "colour"))
        own = cut(back.select("id", F.col("colour").alias("component")), "component")
        found = own if found is None else found.union(own)
        left = cut(left.join(own, F.col("src") == F.col("id"), "left_anti").join(own, F.col("dst") == F.col("id"), "left_anti"), "left")
    if found is None:
        return edges.select(F.col("src").alias("id"), F.col("dst").alias("component")).filter(F.lit(False))
    sizes = found.groupBy("component").count().filter("count > 1").select("component")
    return found.join(sizes, "component", "left_semi").select("id", "component")


def _spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The least colour that reaches each id along the edges, to the fixpoint."""
    now = cut(seeds, "colours")
    total = lambda x: tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("id", "colour"))).first())
    state = total(now)
    while True:
        sent = edges.join(now.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "colour")
        new = cut(now.union(sent).groupBy("id").agg(F.min("colour").alias("colour")), "colours")
        after = total(new)
        if after == state:
            return new
        now, state = new, after


def closed(cycles: DataFrame) -> DataFrame:
    """With the first element repeated at the end."""
    return cycles.withColumn("cycle", F.concat("cycle", F.slice("cycle", 1, 1)))


def rotated(cycles: DataFrame) -> DataFrame:
    return cycles.withColumn("cycle", canonical_cycle(F.col("cycle")))
