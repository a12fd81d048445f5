"""A typed directed property multigraph as two DataFrames, with lookups, filters, updates and bounded traversal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_query
from ..schema import EDGES, MODULE_KINDS, NODES
from ..storage import cut

#: Ids of a frontier that a step broadcasts; a larger one meets the edges by a shuffle.
FRONTIER = 1_000_000
#: Best first: the classes of a lookup.
EXACT, FILE_SUFFIX, SYMBOL_SUFFIX, PATH_SUFFIX, FUZZY = range(1, 6)


def in_module(kind: Column) -> Column:
    return kind.isin(*MODULE_KINDS)


@dataclass(frozen=True)
class Graph:
    """nodes: unique ids, seq their order of first insertion. edges: a bag, edge_id their order; endpoints need not be nodes."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Graph:
        return Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))

    # Lookups

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node_id)

    def outbound(self, node_id: str) -> DataFrame:
        return self.edges.filter(F.col("src") == node_id)

    def inbound(self, node_id: str) -> DataFrame:
        return self.edges.filter(F.col("dst") == node_id)

    def related(self, *relations: str) -> DataFrame:
        return self.edges.filter(F.col("relation").isin(*relations))

    def of_kind(self, *kinds: str) -> DataFrame:
        return self.nodes.filter(F.col("kind").isin(*kinds))

    def in_scope(self, prefix: str) -> DataFrame:
        return self.nodes.filter(F.col("file_path").startswith(prefix))

    def size(self) -> int:
        return self.nodes.count()

    def ranked(self, query: str) -> DataFrame:
        """Nodes that match the query in any way, with the class of each."""
        raw, q = query.strip().lower(), clean_query(query)
        if not query.strip():
            return self.nodes.withColumn("tier", F.lit(EXACT)).filter(F.lit(False))
        i, name, path = F.lower("id"), F.lower("name"), F.translate(F.lower("file_path"), "\\", "/")
        tier = (
            F.when((i == q) | (name == q) | (path == q) | (i == raw) | (path == raw), EXACT)
            .when(name.endswith(f".{q}") | name.endswith(f"#{q}") | i.endswith(f"#{q}"), SYMBOL_SUFFIX)
            .when(in_module(F.col("kind")) & path.endswith(f"/{q}"), FILE_SUFFIX)
            .when(path.endswith(f"/{q}"), PATH_SUFFIX)
            .when(name.contains(q) | path.contains(q), FUZZY)
        )
        return self.nodes.withColumn("tier", tier).filter("tier is not null")

    def find(self, query: str) -> DataFrame:
        """The nodes of the best class that has any, in order of seq."""
        found = self.ranked(query)
        best = found.agg(F.min("tier").alias("best"))  # one row
        return found.join(F.broadcast(best), F.col("tier") == F.col("best"), "left_semi").drop("tier")

    def domain_seeds(self, query: str) -> DataFrame:
        """find(); if that is empty, nodes whose path, name or id contains the query."""
        q = query.strip().lower()
        found = self.find(query)
        none = found.agg((F.count("*") == 0).alias("none"))  # one row
        loose = self.nodes.filter(F.lower("file_path").contains(q) | F.lower("name").contains(q) | F.lower("id").contains(q))
        return found.unionByName(loose.join(F.broadcast(none), F.col("none"), "left_semi"))

    # Updates

    def with_nodes(self, more: DataFrame) -> Graph:
        """Upsert: of equal ids the last by seq wins and keeps the first one's seq."""
        own = Window.partitionBy("id")
        rows = self.nodes.unionByName(more).withColumns({"first_": F.min("seq").over(own), "rank_": F.row_number().over(own.orderBy(F.desc("seq")))})
        return Graph(rows.filter("rank_ = 1").withColumn("seq", F.col("first_")).drop("first_", "rank_"), self.edges)

    def with_edges(self, more: DataFrame) -> Graph:
        return Graph(self.nodes, self.edges.unionByName(more))

    def without_file(self, path: str) -> Graph:
        """Without the file's nodes and all edges at them or at the file itself."""
        return self.without_files(self.nodes.sparkSession.createDataFrame([(path,)], "path string"))

    def without_files(self, paths: DataFrame) -> Graph:
        """paths: a column of paths."""
        paths = paths.toDF("gone").distinct()
        dead = self.nodes.join(paths, F.col("file_path") == F.col("gone"), "left_semi").select(F.col("id").alias("gone")).union(paths).distinct()
        nodes = self.nodes.join(dead, F.col("id") == F.col("gone"), "left_anti")
        edges = self.edges.join(dead, F.col("src") == F.col("gone"), "left_anti").join(dead, F.col("dst") == F.col("gone"), "left_anti")
        return Graph(nodes, edges)

    # Traversal

    def levels(self, roots: DataFrame, direction: str = "both", depth: int = 2) -> DataFrame:
        """(id, depth) of what is reached from the roots, a frame with a column id, in at most so many steps.

        Each step joins only the ids found by the step before, broadcast if they are FRONTIER at most, and what it finds is written: edges
        aren't shuffled for a small frontier, and a step without new ids is the last. Ids without a node are passed through.
        """
        found = frontier = cut(roots.select("id").distinct().join(self.nodes.select("id"), "id", "left_semi").withColumn("depth", F.lit(0)), "level")
        for k in range(depth):
            n = frontier.count()
            if not n:
                break
            near = F.broadcast(frontier.select("id")) if n <= FRONTIER else frontier.select("id")
            reached = self.steps(direction).join(near, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct()
            frontier = cut(reached.join(found.select("id"), "id", "left_anti").withColumn("depth", F.lit(k + 1)), "level")
            found = found.union(frontier)
        return found

    def steps(self, direction: str) -> DataFrame:
        """(src, dst) of each way along an edge."""
        steps = self.edges.select("src", "dst")
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return {"outbound": steps, "inbound": back, "both": steps.union(back)}[direction]

    def kept(self) -> Graph:
        """The graph as written tables, for questions that read it several times."""
        return Graph(cut(self.nodes, "nodes"), cut(self.edges, "graph-edges"))

    def traverse(self, roots: DataFrame, direction: str = "both", depth: int = 2) -> tuple[DataFrame, DataFrame]:
        """Reached nodes with their depth, and the edges seen from those that were expanded."""
        levels = self.levels(roots, direction, depth)
        return self.nodes.join(levels, "id"), self.seen_edges(levels, direction, depth)

    def seen_edges(self, levels: DataFrame, direction: str, depth: int) -> DataFrame:
        inner = levels.filter(F.col("depth") < depth).select("id")
        if direction == "outbound":
            return self.edges.join(inner, F.col("src") == F.col("id"), "left_semi")
        if direction == "inbound":
            return self.edges.join(inner, F.col("dst") == F.col("id"), "left_semi")
        a, b = inner.select(F.col("id").alias("a_")), inner.select(F.col("id").alias("b_"))
        return self.edges.join(a, F.col("src") == F.col("a_"), "left").join(b, F.col("dst") == F.col("b_"), "left").filter("a_ is not null or b_ is not null").drop("a_", "b_")
