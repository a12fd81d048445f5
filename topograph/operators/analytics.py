"""Questions that architects ask of a graph, each as one Spark plan."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import glob_regex, instability_milli, is_entry_point, is_test_file
from ..schema import RULES
from .graph import Graph, in_module

# The rules where none are given.
DEFAULT_RULES = (
    ("core", "views", "The core has no business with views."),
    ("common", "modules", "What is common can't build on single modules."),
)
#: Rules that a join may broadcast.
BROADCAST_RULES = 10_000


# Coupling and degree


def module_metrics(graph: Graph) -> DataFrame:
    """(id, file_path, ca, ce, instability_milli, instability, seq) of each file and component, isolated ones too.

    Distinct pairs of modules are aggregated once per side; both sides count by pre-aggregated distinct edges.
    """
    modules = graph.nodes.filter(in_module(F.col("kind"))).select("id", "file_path", "seq")
    ids = modules.select("id")
    pairs = graph.related("imports").filter("src <> dst").select("src", "dst").distinct()
    pairs = pairs.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("a"), F.lit(0).alias("e")), F.struct(F.col("src").alias("id"), F.lit(0).alias("a"), F.lit(1).alias("e")))).alias("x"))
    counts = ends.groupBy("x.id").agg(F.sum("x.a").alias("ca"), F.sum("x.e").alias("ce"))
    out = modules.join(counts, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("ca", "ce")})
    out = out.withColumn("instability_milli", instability_milli(F.col("ca"), F.col("ce")))
    return out.withColumn("instability", F.col("instability_milli") / 1000).select("id", "file_path", "ca", "ce", "instability_milli", "instability", "seq")


def ranked_modules(graph: Graph) -> DataFrame:
    return module_metrics(graph).orderBy(F.desc("ca"), F.desc("ce"), "seq")


def degrees(graph: Graph) -> DataFrame:
    """(id, in_degree, out_degree, degree) of nodes with any edge; parallel edges count."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i")))).alias("x"))
    counts = ends.groupBy("x.id").agg(F.sum("x.i").cast("long").alias("in_degree"), (F.count("*") - F.sum("x.i")).cast("long").alias("out_degree"))
    return counts.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def top_hubs(graph: Graph, n: int = 10) -> DataFrame:
    """Ranked by ids and seq alone; only the n hubs meet the other columns of nodes."""
    hubs = degrees(graph).join(graph.nodes.select("id", "seq"), "id").orderBy(F.desc("degree"), "seq").limit(n)
    return graph.nodes.drop("seq").join(F.broadcast(hubs), "id").orderBy(F.desc("degree"), "seq").select("id", "name", "kind", "file_path", "degree", "in_degree", "out_degree")


def totals(graph: Graph) -> DataFrame:
    """One row: total_files, total_symbols, total_edges, average_instability_milli."""
    n = graph.nodes.agg(F.sum(in_module(F.col("kind")).cast("long")).alias("f"), F.count("*").alias("n"))
    m = module_metrics(graph).agg(F.avg("instability_milli").alias("i"))
    e = graph.edges.agg(F.count("*").alias("e"))
    one = n.join(F.broadcast(e)).join(F.broadcast(m))  # three frames of one row
    return one.select(F.coalesce("f", F.lit(0)).alias("total_files"), (F.col("n") - F.coalesce("f", F.lit(0))).alias("total_symbols"), F.col("e").alias("total_edges"), F.floor(F.coalesce("i", F.lit(0)) + 0.5).cast("long").alias("average_instability_milli"))


# Impact


def impact_tiers(graph: Graph, target: DataFrame, depth: int = 3) -> DataFrame:
    """Nodes with a tier for the target, a frame of one id: 0 direct users in other files, 1 in the target's file, 2 what reaches it within depth steps."""
    own = graph.nodes.join(target.select("id"), "id", "left_semi").select(F.col("id").alias("t_id"), F.col("file_path").alias("t_path")).limit(1)
    users = graph.edges.filter("relation <> 'contains'").join(F.broadcast(own), F.col("dst") == F.col("t_id")).select(F.col("src").alias("id"), "t_path").distinct()
    direct = graph.nodes.join(users, "id").select("id", F.when(F.col("file_path") == F.col("t_path"), 1).otherwise(0).alias("tier"))
    far = graph.levels(own.select(F.col("t_id").alias("id")), "inbound", depth).filter("depth > 0").select("id", F.lit(2).alias("tier"))
    tiers = direct.union(far).groupBy("id").agg(F.min("tier").alias("tier")).join(F.broadcast(own), F.col("id") == F.col("t_id"), "left_anti")
    return graph.nodes.join(tiers, "id")


def diff_impact(graph: Graph, changed: DataFrame, depth: int = 3) -> dict[str, DataFrame]:
    """For changed paths: changed_nodes, upstream_files, test_files, breaking_callers."""
    paths = changed.toDF("path").distinct()
    nodes = graph.nodes.join(paths, F.col("file_path") == F.col("path"), "left_semi")
    levels = graph.levels(nodes.select("id"), "inbound", depth)
    reached = graph.nodes.join(levels, "id")
    upstream = reached.select("file_path").distinct().join(paths, F.col("file_path") == F.col("path"), "left_anti")
    calls = graph.seen_edges(levels, "inbound", depth).filter("relation = 'calls'").select(F.col("src").alias("id")).distinct()
    callers = graph.nodes.join(calls, "id", "left_semi").join(paths, F.col("file_path") == F.col("path"), "left_anti")
    return {"changed_nodes": nodes, "upstream_files": upstream, "test_files": upstream.filter(is_test_file(F.col("file_path"))), "breaking_callers": callers}


# Audits


def orphans(graph: Graph, scope: str | None = None) -> DataFrame:
    """Files and components that nothing imports and that are no entry points."""
    nodes = graph.nodes.filter(in_module(F.col("kind")) & ~is_entry_point(F.col("file_path")))
    nodes = nodes.filter(F.col("file_path").startswith(scope)) if scope else nodes
    return nodes.join(graph.related("imports").select(F.col("dst").alias("used")), F.col("id") == F.col("used"), "left_anti")


def unused_symbols(graph: Graph, scope: str | None = None) -> DataFrame:
    """Functions, classes and interfaces outside entry points that nothing calls, implements or extends."""
    nodes = graph.of_kind("function", "class", "interface").filter(~is_entry_point(F.col("file_path")))
    nodes = nodes.filter(F.col("file_path").startswith(scope)) if scope else nodes
    return nodes.join(graph.related("calls", "implements", "extends").select(F.col("dst").alias("used")), F.col("id") == F.col("used"), "left_anti")


def dead_code(graph: Graph, scope: str | None = None) -> DataFrame:
    return orphans(graph, scope).withColumn("reason", F.lit("orphan")).unionByName(unused_symbols(graph, scope).withColumn("reason", F.lit("unused")))


def parsed_rules(rules: str | list[dict] | None) -> list[tuple[int, str, str, str | None]]:
    """(ord, from, to, description). Malformed JSON, JSON that is no list, and no rules give the default ones."""
    if isinstance(rules, str):
        try:
            rules = json.loads(rules)
        except ValueError:
            rules = None
    found = [(r["from"], r["to"], r.get("description")) for r in rules if isinstance(r, dict) and "from" in r and "to" in r] if isinstance(rules, list) else []
    return [(i, *r) for i, r in enumerate(found or DEFAULT_RULES)]


def violations(graph: Graph, rules: str | list[dict] | None = None, mode: str = "legacy") -> DataFrame:
    """(src, dst, relation, rule_from, rule_to, reason) of each edge between files and each rule that forbids it.

    A path matches few rules: the distinct paths of nodes are matched with the rules first, and edges meet rules by equal rule numbers of
    both ends, instead of each edge meeting each rule.
    """
    parsed = parsed_rules(rules)
    if len(parsed) > BROADCAST_RULES:
        raise ValueError(f"over {BROADCAST_RULES} rules")
    table = graph.nodes.sparkSession.createDataFrame(parsed, RULES)
    paths = graph.nodes.select("file_path").distinct()
    as_array = lambda side: F.array_compact(F.array(*(F.when(F.col("file_path").rlike(glob_regex(r[side], mode)), F.lit(r[0])) for r in parsed)))
    marked = paths.select("file_path", as_array(1).alias("from_rules"), as_array(2).alias("to_rules"))
    nodes = graph.nodes.select("id", "file_path").join(marked, "file_path")
    left = nodes.filter(F.size("from_rules") > 0).select(F.col("id").alias("src"), F.col("file_path").alias("src_path"), "from_rules")
    right = nodes.filter(F.size("to_rules") > 0).select(F.col("id").alias("dst"), F.col("file_path").alias("dst_path"), "to_rules")
    hit = graph.edges.join(left, "src").join(right, "dst").filter("src_path <> dst_path")
    hit = hit.withColumn("ord", F.explode(F.array_intersect("from_rules", "to_rules"))).join(F.broadcast(table), "ord")
    reason = F.coalesce("description", F.concat(F.lit("Forbidden layer boundary: `"), F.col("from"), F.lit("` -> `"), F.col("to"), F.lit("`")))
    return hit.select("edge_id", "src", "dst", "relation", F.col("from").alias("rule_from"), F.col("to").alias("rule_to"), reason.alias("reason"))


# Slices


def domain_slice(graph: Graph, seeds: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes within hops of the seeds both ways, and the out-edges of those with inside, whether they end in the slice too."""
    nodes = graph.nodes.join(graph.levels(seeds, "both", hops), "id")
    ids = nodes.select(F.col("id").alias("in_"))
    edges = graph.edges.join(ids, F.col("src") == F.col("in_"), "left_semi").join(ids, F.col("dst") == F.col("in_"), "left")
    return nodes, edges.withColumn("inside", F.col("in_").isNotNull()).drop("in_")


def cohesion(edges: DataFrame) -> DataFrame:
    """One row: internal, boundary, and cohesion in hundredths (100 without edges), half up."""
    n = edges.agg(F.coalesce(F.sum(F.col("inside").cast("long")), F.lit(0)).alias("internal"), F.coalesce(F.sum((~F.col("inside")).cast("long")), F.lit(0)).alias("boundary"))
    both = F.col("internal") + F.col("boundary")
    return n.withColumn("cohesion_centi", F.when(both == 0, F.lit(100)).otherwise(F.floor((200 * F.col("internal") + both) / (2 * both))).cast("long"))


# Contracts


def contracts(clients: DataFrame, servers: DataFrame) -> dict[str, DataFrame]:
    """clients and servers with file_path, url, method, line and norm_url: matched pairs and what is left of either side."""
    c = clients.select(F.col("file_path").alias("c_path"), F.col("url").alias("c_url"), F.col("method").alias("c_method"), F.col("line").alias("c_line"), "norm_url")
    s = servers.select(F.col("file_path").alias("s_path"), F.col("url").alias("s_url"), F.col("method").alias("s_method"), F.col("line").alias("s_line"), F.col("norm_url").alias("s_norm"))
    fits = (F.col("norm_url") == F.col("s_norm")) & ((F.col("s_method") == "ALL") | (F.col("c_method") == F.col("s_method")))
    named = lambda p, tag, line: F.concat(F.col(p), F.lit(f"#{tag}:"), F.col(line).cast("string"))
    matched = c.join(s, fits).withColumns({"client_id": named("c_path", "api_call", "c_line"), "server_id": named("s_path", "route_handler", "s_line")})
    return {"matched": matched, "unmatched_clients": c.join(s, fits, "left_anti"), "unmatched_servers": s.join(c, fits, "left_anti")}


def contract_graph(matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Virtual nodes and calls edges of matched contracts, to be added to a graph on demand."""
    c = matched.select(F.col("client_id").alias("id"), F.concat_ws(" ", "c_method", "c_url").alias("name"), F.col("c_path").alias("file_path"), F.col("c_line").alias("line"))
    s = matched.select(F.col("server_id").alias("id"), F.concat_ws(" ", F.lit("[Handler]"), "s_method", "s_url").alias("name"), F.col("s_path").alias("file_path"), F.col("s_line").alias("line"))
    nodes = c.union(s).dropDuplicates(["id"]).select("id", "name", F.lit("function").alias("kind"), "file_path", F.col("line").cast("int").alias("line"), F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("map<string,string>").alias("metadata"), F.xxhash64("id").alias("seq"))
    edges = matched.select(F.xxhash64("client_id", "server_id").alias("edge_id"), F.col("client_id").alias("src"), F.col("server_id").alias("dst"), F.lit("calls").alias("relation"))
    return nodes, edges


def first_by_seq(nodes: DataFrame, n: int = 1) -> DataFrame:
    return nodes.orderBy("seq").limit(n)


def last_writer_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("rank_", F.row_number().over(w)).filter("rank_ = 1").drop("rank_")
