"""Graphs projected from relational tables, and the same as SQL. Edge ids derive from the endpoints, so both engines agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import Graph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(df: DataFrame, node_id: Column, name: Column, kind: str | Column, path: Column, seq: Column) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    return df.select(
        node_id.cast("string").alias("id"), name.alias("name"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), path.alias("file_path"),
        none("int").alias("line"), none("int").alias("end_line"), none("map<string,string>").alias("metadata"), seq.cast("long").alias("seq"),
    )


def _edges(df: DataFrame, src: Column, dst: Column, relation: str) -> DataFrame:
    return df.select((src * F.lit(1 << 24) + dst).cast("long").alias("edge_id"), src.cast("string").alias("src"), dst.cast("string").alias("dst"), F.lit(relation).alias("relation"))


def g_part(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts as files; a part imports those on the next line of an order that it is on."""
    part = read(spark, sf_dir, "part")
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next"))
    pairs = line.join(after, ["l_orderkey", "l_linenumber"]).filter("l_partkey <> next").select("l_partkey", "next").distinct()
    nodes = _nodes(part, F.col("p_partkey"), F.col("p_name"), "file", F.concat_ws("/", "p_brand", "p_partkey"), F.col("p_partkey"))
    return Graph(nodes, _edges(pairs, F.col("l_partkey"), F.col("next"), "imports"))


def g_user(spark: SparkSession, sf_dir: str) -> Graph:
    """Users of events as files; a user imports that of the next event of the day."""
    events = read(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    w = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    pairs = events.withColumn("next", F.lead("user_id").over(w)).filter("user_id <> next").select("user_id", "next").distinct()
    users = events.select("user_id").distinct()
    name = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    return Graph(_nodes(users, F.col("user_id"), name, "file", F.concat(F.lit("users/"), name), F.col("user_id")), _edges(pairs, F.col("user_id"), F.col("next"), "imports"))


def g_nation(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations as files under their region; a supplier's nation imports a customer's if more lines than 1.35 times the mean pair's join them."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("a"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("b"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    n = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey").join(s, "l_suppkey").join(c, "o_custkey").groupBy("a", "b").agg(F.count("*").alias("n"))
    busy = n.join(F.broadcast(n.agg(F.sum("n").alias("total"))), F.col("n") * 625 * 100 >= 135 * F.col("total")).filter("a <> b")  # one row, and 625 pairs at most
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    nodes = _nodes(named, F.col("n_nationkey"), F.col("n_name"), "file", F.concat_ws("/", "r_name", "n_name"), F.col("n_nationkey"))
    return Graph(nodes, _edges(busy, F.col("a").cast("long"), F.col("b").cast("long"), "imports"))


#: Kinds of the star's nodes, and what their keys are offset by.
STAR = {"region": ("component", "r", 0), "nation": ("file", "n", 1), "customer": ("class", "c", 2), "supplier": ("interface", "s", 3), "orders": ("function", "o", 4), "part": ("variable", "p", 5)}


def g_star(spark: SparkSession, sf_dir: str) -> Graph:
    """Six tables as six kinds of nodes: regions contain nations, nations customers and suppliers; customers call orders, orders import parts and suppliers."""
    t = {n: read(spark, sf_dir, n) for n in (*STAR, "lineitem")}

    def nodes(table: str, key: str, name: Column, path: Column) -> DataFrame:
        kind, tag, k = STAR[table]
        return _nodes(t[table], F.concat(F.lit(tag), F.col(key).cast("string")), name, kind, path, F.col(key) * 8 + k)

    def edges(df: DataFrame, a: str, x: str, b: str, y: str, relation: str, k: int) -> DataFrame:
        eid = (F.xxhash64(F.lit(k), F.col(x).cast("long"), F.col(y).cast("long"))).alias("edge_id")
        return df.select(eid, F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"), F.lit(relation).alias("relation"))

    all_nodes = nodes("region", "r_regionkey", F.col("r_name"), F.col("r_name"))
    for table, key, name, path in (
        ("nation", "n_nationkey", F.col("n_name"), F.concat(F.lit("nation/"), F.col("n_name"))),
        ("customer", "c_custkey", F.col("c_name"), F.concat(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("/customer"))),
        ("supplier", "s_suppkey", F.col("s_name"), F.concat(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("/supplier"))),
        ("orders", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.concat(F.lit("orders/"), F.col("o_orderstatus"), F.lit("/index.ts"))),
        ("part", "p_partkey", F.col("p_name"), F.concat(F.lit("part/"), F.col("p_brand"))),
    ):
        all_nodes = all_nodes.union(nodes(table, key, name, path))
    line = t["lineitem"]
    all_edges = (
        edges(t["nation"], "r", "n_regionkey", "n", "n_nationkey", "contains", 0)
        .union(edges(t["customer"], "n", "c_nationkey", "c", "c_custkey", "contains", 1))
        .union(edges(t["supplier"], "n", "s_nationkey", "s", "s_suppkey", "contains", 2))
        .union(edges(t["orders"], "c", "o_custkey", "o", "o_orderkey", "calls", 3))
        .union(edges(line.select("l_orderkey", "l_partkey").distinct(), "o", "l_orderkey", "p", "l_partkey", "imports", 4))
        .union(edges(line.select("l_orderkey", "l_suppkey").distinct(), "o", "l_orderkey", "s", "l_suppkey", "imports", 5))
    )
    return Graph(all_nodes, all_edges)


def g_page(spark: SparkSession, sf_dir: str) -> Graph:
    """Pages as components that import what they link to (nodes or not), each link once."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    links = pages.select("url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1)))).alias("href"))
    edges = links.select(F.xxhash64("url", "href").alias("edge_id"), F.col("url").alias("src"), F.col("href").alias("dst"), F.lit("imports").alias("relation"))
    return Graph(_nodes(pages, F.col("url"), F.regexp_extract("url", "://([^/]*)", 1), "component", F.col("url"), F.col("page_id")), edges)


# The same as SQL

PART_SQL = """
part_nodes AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, 'file' AS kind, concat_ws('/', p_brand, p_partkey) AS file_path, p_partkey AS seq FROM part),
part_pairs AS (SELECT DISTINCT a.l_partkey AS x, b.l_partkey AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey),
part_edges AS (SELECT x * 16777216 + y AS edge_id, CAST(x AS VARCHAR) AS src, CAST(y AS VARCHAR) AS dst, 'imports' AS relation FROM part_pairs)
"""
USER_SQL = """
user_next AS (SELECT user_id AS x, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS y FROM events),
user_edges AS (SELECT DISTINCT x * 16777216 + y AS edge_id, CAST(x AS VARCHAR) AS src, CAST(y AS VARCHAR) AS dst, 'imports' AS relation FROM user_next WHERE x <> y),
user_nodes AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id, 'user' || user_id AS name, 'file' AS kind, 'users/user' || user_id AS file_path, user_id AS seq FROM events)
"""
NATION_SQL = """
nation_nodes AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, 'file' AS kind, r_name || '/' || n_name AS file_path, CAST(n_nationkey AS BIGINT) AS seq FROM nation JOIN region ON n_regionkey = r_regionkey),
nation_n AS (SELECT s_nationkey AS a, c_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
nation_edges AS (SELECT CAST(a AS BIGINT) * 16777216 + b AS edge_id, CAST(a AS VARCHAR) AS src, CAST(b AS VARCHAR) AS dst, 'imports' AS relation FROM nation_n WHERE a <> b AND n * 625 * 100 >= 135 * (SELECT sum(n) FROM nation_n))
"""
STAR_SQL = """
star_nodes AS (
  SELECT 'r' || r_regionkey AS id, r_name AS name, 'component' AS kind, r_name AS file_path, CAST(r_regionkey AS BIGINT) * 8 AS seq FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'file', 'nation/' || n_name, CAST(n_nationkey AS BIGINT) * 8 + 1 FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name, 'class', 'nation' || c_nationkey || '/customer', c_custkey * 8 + 2 FROM customer
  UNION ALL SELECT 's' || s_suppkey, s_name, 'interface', 'nation' || s_nationkey || '/supplier', s_suppkey * 8 + 3 FROM supplier
  UNION ALL SELECT 'o' || o_orderkey, 'order ' || o_orderkey, 'function', 'orders/' || o_orderstatus || '/index.ts', o_orderkey * 8 + 4 FROM orders
  UNION ALL SELECT 'p' || p_partkey, p_name, 'variable', 'part/' || p_brand, p_partkey * 8 + 5 FROM part
),
star_edges AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'contains' AS relation FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'contains' FROM customer
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'contains' FROM supplier
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'calls' FROM orders
  UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 'imports' FROM lineitem
  UNION ALL SELECT DISTINCT 'o' || l_orderkey, 's' || l_suppkey, 'imports' FROM lineitem
)
"""
PAGE_SQL = """
page_nodes AS (SELECT url AS id, regexp_extract(url, '://([^/]*)', 1) AS name, 'component' AS kind, url AS file_path, page_id AS seq FROM pages),
page_edges AS (SELECT url AS src, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS dst, 'imports' AS relation FROM pages)
"""
