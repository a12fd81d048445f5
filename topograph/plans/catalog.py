"""Queries over the driver's tables, one or more for each operator, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import analytics as A
from ..operators import cycles, link, paths
from ..operators.graph import Graph
from ..sources import projections as P
from ..sources.projections import read
from ..streaming import incremental, watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NODE = ("id", "name", "kind", "file_path", "seq")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def ids(spark: SparkSession, *values: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "id string")


def edge_rows(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", "relation")


# Metrics

METRICS_SQL = f"""
WITH {P.PART_SQL},
ends AS (SELECT dst AS id, 1 AS a, 0 AS e FROM part_edges UNION ALL SELECT src, 0, 1 FROM part_edges),
counted AS (SELECT id, sum(a) AS ca, sum(e) AS ce FROM ends GROUP BY id),
metrics AS (
  SELECT n.id, n.file_path, CAST(coalesce(ca, 0) AS BIGINT) AS ca, CAST(coalesce(ce, 0) AS BIGINT) AS ce, n.seq FROM part_nodes n LEFT JOIN counted c ON n.id = c.id
),
m AS (SELECT *, CAST(CASE WHEN ca + ce = 0 THEN 0 ELSE (2000 * ce + ca + ce) // (2 * (ca + ce)) END AS BIGINT) AS instability_milli FROM metrics)
"""


@query(METRICS_SQL + "SELECT id, file_path, ca, ce, instability_milli FROM m")
def coupling_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.module_metrics(P.g_part(spark, sf_dir)).select("id", "file_path", "ca", "ce", "instability_milli")


@query(METRICS_SQL + "SELECT id, ca, ce FROM m ORDER BY ca DESC, ce DESC, seq LIMIT 25")
def ranked_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ranked_modules(P.g_part(spark, sf_dir)).limit(25).select("id", "ca", "ce")


@query(
    METRICS_SQL
    + """, s AS (SELECT CASE WHEN instability_milli = 0 THEN 'very stable' WHEN instability_milli >= 800 THEN 'fragile' ELSE 'balanced' END AS stability FROM m)
SELECT stability, count(*) AS modules FROM s GROUP BY stability"""
)
def stability_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.module_metrics(P.g_part(spark, sf_dir)).groupBy(C.stability(F.col("instability_milli")).alias("stability")).agg(F.count("*").alias("modules"))


@query(
    METRICS_SQL
    + """SELECT (SELECT count(*) FROM part_nodes) AS total_files, CAST(0 AS BIGINT) AS total_symbols, (SELECT count(*) FROM part_edges) AS total_edges,
CAST(floor(avg(instability_milli) + 0.5) AS BIGINT) AS average_instability_milli FROM m"""
)
def graph_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.totals(P.g_part(spark, sf_dir))


@query(
    f"""WITH {P.STAR_SQL},
ends AS (SELECT dst AS id, 1 AS i FROM star_edges UNION ALL SELECT src, 0 FROM star_edges),
d AS (SELECT id, count(*) AS degree, CAST(sum(i) AS BIGINT) AS in_degree FROM ends GROUP BY id)
SELECT n.id, name, kind, file_path, degree, in_degree, degree - in_degree AS out_degree FROM star_nodes n JOIN d ON n.id = d.id ORDER BY degree DESC, seq LIMIT 10"""
)
def top_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_hubs(P.g_star(spark, sf_dir))


@query(
    f"""WITH {P.STAR_SQL},
ends AS (SELECT dst AS id, 1 AS i FROM star_edges UNION ALL SELECT src, 0 FROM star_edges)
SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(count(*) - sum(i) AS BIGINT) AS out_degree, count(*) AS degree FROM ends GROUP BY id"""
)
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.degrees(P.g_star(spark, sf_dir))


@query(f"WITH {P.STAR_SQL} SELECT kind, count(*) AS nodes FROM star_nodes GROUP BY kind")
def nodes_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.g_star(spark, sf_dir).nodes.groupBy("kind").agg(F.count("*").alias("nodes"))


# Lookups


def find_sql(nodes: str, source: str, q: str, raw: str) -> str:
    return f"""WITH {source}, t AS (
  SELECT *, CASE
    WHEN lower(id) = '{q}' OR lower(name) = '{q}' OR lower(file_path) = '{q}' OR lower(id) = '{raw}' OR lower(file_path) = '{raw}' THEN 1
    WHEN ends_with(lower(name), '.{q}') OR ends_with(lower(name), '#{q}') OR ends_with(lower(id), '#{q}') THEN 3
    WHEN kind IN ('file', 'component') AND ends_with(lower(file_path), '/{q}') THEN 2
    WHEN ends_with(lower(file_path), '/{q}') THEN 4
    WHEN contains(lower(name), '{q}') OR contains(lower(file_path), '{q}') THEN 5 END AS tier FROM {nodes}
) SELECT id, name, kind, file_path, seq FROM t WHERE tier = (SELECT min(tier) FROM t)"""


@query(find_sql("star_nodes", P.STAR_SQL, "asia", "asia"))
def find_nodes_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.g_star(spark, sf_dir).find("ASIA").select(*NODE)


@query(find_sql("part_nodes", P.PART_SQL, "77", "./77"))
def find_nodes_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.g_part(spark, sf_dir).find("./77").select(*NODE)


@query(find_sql("star_nodes", P.STAR_SQL, "nation1/customer", "nation1/customer"))
def find_nodes_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.g_star(spark, sf_dir).find("nation1/customer").select(*NODE)


@query(find_sql("part_nodes", P.PART_SQL, "brand#1", "brand#1"))
def find_nodes_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.g_part(spark, sf_dir).find("brand#1").select(*NODE)


@query(find_sql("page_nodes", P.PAGE_SQL, "example.org", "example.org"))
def find_nodes_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.g_page(spark, sf_dir).find("example.org").select(*NODE)


@query(f"WITH {P.STAR_SQL} SELECT id, name, kind, file_path, seq FROM star_nodes WHERE id <> 'c10' AND contains(lower(id), 'c10')")
def domain_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is found by name or path, so ids decide."""
    graph = P.g_star(spark, sf_dir)
    return Graph(graph.nodes.filter("id <> 'c10'"), graph.edges).domain_seeds("c10").select(*NODE)


@query(f"WITH {P.STAR_SQL} SELECT id, name, kind, file_path, seq FROM star_nodes WHERE id = 'n7'")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.g_star(spark, sf_dir).node("n7").select(*NODE)


@query(f"WITH {P.PART_SQL} SELECT src, dst, relation FROM part_edges WHERE src = '7'")
def out_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_rows(P.g_part(spark, sf_dir).outbound("7"))


@query(f"WITH {P.PART_SQL} SELECT src, dst, relation FROM part_edges WHERE dst = '7'")
def in_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_rows(P.g_part(spark, sf_dir).inbound("7"))


@query(f"WITH {P.STAR_SQL} SELECT src, dst, relation FROM star_edges WHERE relation IN ('calls', 'contains')")
def relation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_rows(P.g_star(spark, sf_dir).related("calls", "contains"))


@query(f"WITH {P.PART_SQL} SELECT id, name, kind, file_path, seq FROM part_nodes WHERE starts_with(file_path, 'Brand#2')")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.g_part(spark, sf_dir).in_scope("Brand#2").select(*NODE)


@query(
    f"""WITH {P.STAR_SQL}, dead AS (SELECT id FROM star_nodes WHERE file_path = 'nation3/customer' UNION SELECT 'nation3/customer')
SELECT src, dst, relation FROM star_edges WHERE src NOT IN (SELECT id FROM dead) AND dst NOT IN (SELECT id FROM dead)"""
)
def remove_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_rows(P.g_star(spark, sf_dir).without_file("nation3/customer").edges)


@query(
    """SELECT conv_id, role, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1"""
)
def last_writer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.last_writer_wins(read(spark, sf_dir, "conversations"), ["conv_id", "role"], "turn").select("conv_id", "role", "turn", "text")


@query(
    f"""WITH {P.STAR_SQL}, more AS (SELECT id, 'renamed' AS name, kind, file_path, seq + 1000000000 AS seq FROM star_nodes WHERE kind = 'file'),
merged AS (SELECT * FROM star_nodes UNION ALL SELECT * FROM more),
r AS (SELECT id, name, kind, file_path, min(seq) OVER (PARTITION BY id) AS seq, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM merged)
SELECT id, name, kind, file_path, seq FROM r WHERE k = 1"""
)
def upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = P.g_star(spark, sf_dir)
    more = graph.of_kind("file").withColumns({"name": F.lit("renamed"), "seq": F.col("seq") + 1_000_000_000})
    return graph.with_nodes(more).nodes.select(*NODE)


# Traversal


def levels_sql(source: str, nodes: str, edges: str, roots: str, direction: str, depth: int) -> str:
    """reached(id, depth): the least depth of each id."""
    step = {"outbound": f"SELECT src AS a, dst AS b FROM {edges}", "inbound": f"SELECT dst AS a, src AS b FROM {edges}", "both": f"SELECT src AS a, dst AS b FROM {edges} UNION ALL SELECT dst, src FROM {edges}"}[direction]
    return f"""WITH RECURSIVE {source}, steps AS ({step}),
walk(id, depth) AS (SELECT id, 0 FROM {nodes} WHERE id IN ({roots}) UNION SELECT b, depth + 1 FROM walk JOIN steps ON id = a WHERE depth < {depth}),
reached AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""


def seen_sql(edges: str, direction: str, depth: int) -> str:
    inner = f"(SELECT id FROM reached WHERE depth < {depth})"
    where = {"outbound": f"src IN {inner}", "inbound": f"dst IN {inner}", "both": f"src IN {inner} OR dst IN {inner}"}[direction]
    return f"SELECT src, dst, relation FROM {edges} WHERE {where}"


@query(levels_sql(P.USER_SQL, "user_nodes", "user_edges", "'1'", "outbound", 2) + "SELECT id, depth FROM reached")
def traverse_out_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.g_user(spark, sf_dir).kept().levels(ids(spark, "1"), "outbound", 2)


@query(levels_sql(P.USER_SQL, "user_nodes", "user_edges", "'1'", "inbound", 2) + "SELECT id, depth FROM reached")
def traverse_in_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.g_user(spark, sf_dir).kept().levels(ids(spark, "1"), "inbound", 2)


@query(levels_sql(P.PART_SQL, "part_nodes", "part_edges", "'7', '9'", "both", 2) + "SELECT id, depth FROM reached")
def traverse_both_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.g_part(spark, sf_dir).kept().levels(ids(spark, "7", "9"), "both", 2)


@query(levels_sql(P.PART_SQL, "part_nodes", "part_edges", "'7'", "both", 2) + seen_sql("part_edges", "both", 2))
def traverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_rows(P.g_part(spark, sf_dir).kept().traverse(ids(spark, "7"), "both", 2)[1])


@query(levels_sql(P.STAR_SQL, "star_nodes", "star_edges", "'c7'", "outbound", 3) + "SELECT n.id, name, kind, file_path, seq, depth FROM star_nodes n JOIN reached r ON n.id = r.id")
def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.g_star(spark, sf_dir).kept().traverse(ids(spark, "c7"), "outbound", 3)[0].select(*NODE, "depth")


@query(levels_sql(P.STAR_SQL, "star_nodes", "star_edges", "'o7'", "both", 3) + "SELECT n.id, name, kind, file_path, seq, depth FROM star_nodes n JOIN reached r ON n.id = r.id")
def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.g_star(spark, sf_dir).kept().traverse(ids(spark, "o7"), "both", 3)[0].select(*NODE, "depth")


@query(
    f"""WITH {P.PART_SQL}, shown AS (SELECT id FROM part_nodes ORDER BY seq LIMIT 20)
SELECT src, dst, relation FROM part_edges WHERE src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown)"""
)
def dependencies_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = P.g_part(spark, sf_dir)
    shown = A.first_by_seq(graph.nodes, 20).select("id")
    return edge_rows(graph.edges.join(shown, F.col("src") == F.col("id"), "left_semi").join(shown, F.col("dst") == F.col("id"), "left_semi"))


# Impact

IMPACT_SQL = (
    levels_sql(P.STAR_SQL, "star_nodes", "star_edges", "'p7'", "inbound", 3)
    + """, direct AS (SELECT DISTINCT n.id, CASE WHEN n.file_path = t.file_path THEN 1 ELSE 0 END AS tier
  FROM star_edges e JOIN star_nodes n ON n.id = e.src JOIN star_nodes t ON t.id = 'p7' WHERE e.dst = 'p7' AND e.relation <> 'contains'),
tiers AS (SELECT id, min(tier) AS tier FROM (SELECT * FROM direct UNION ALL SELECT id, 2 FROM reached WHERE depth > 0) GROUP BY id)
"""
)


@query(IMPACT_SQL + "SELECT n.id, name, kind, file_path, seq, tier FROM star_nodes n JOIN tiers t ON n.id = t.id WHERE n.id <> 'p7'")
def impact_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.impact_tiers(P.g_star(spark, sf_dir).kept(), ids(spark, "p7")).select(*NODE, "tier")


@query(IMPACT_SQL + "SELECT tier, count(*) AS nodes FROM star_nodes n JOIN tiers t ON n.id = t.id WHERE n.id <> 'p7' GROUP BY tier")
def impact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.impact_tiers(P.g_star(spark, sf_dir).kept(), ids(spark, "p7")).groupBy("tier").agg(F.count("*").alias("nodes"))


CHANGED_SQL = (
    f"WITH RECURSIVE {P.STAR_SQL}, changed AS (SELECT id FROM star_nodes WHERE file_path = 'part/Brand#11'), "
    "walk(id, depth) AS (SELECT id, 0 FROM changed UNION SELECT src, depth + 1 FROM walk JOIN star_edges ON id = dst WHERE depth < 3), reached AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id) "
)


def _diff(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return A.diff_impact(P.g_star(spark, sf_dir).kept(), spark.createDataFrame([("part/Brand#11",)], "path string"), 3)


@query(CHANGED_SQL + "SELECT DISTINCT file_path FROM star_nodes n JOIN reached r ON n.id = r.id WHERE file_path <> 'part/Brand#11'")
def diff_upstream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)["upstream_files"]


@query(CHANGED_SQL + "SELECT id, name, kind, file_path, seq FROM star_nodes WHERE file_path = 'part/Brand#11'")
def diff_changed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)["changed_nodes"].select(*NODE)


@query(CHANGED_SQL + "SELECT id, name, kind, file_path, seq FROM star_nodes WHERE id IN (SELECT src FROM star_edges WHERE relation = 'calls' AND dst IN (SELECT id FROM reached WHERE depth < 3)) AND file_path <> 'part/Brand#11'")
def diff_breaking_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)["breaking_callers"].select(*NODE)


@query(
    """WITH p AS (SELECT DISTINCT 'src/' || replace(lower(p_type), ' ', '/') || CASE WHEN p_size % 3 = 0 THEN '.spec.ts' WHEN p_size % 3 = 1 THEN '_test.go' ELSE '/main.py' END AS file_path FROM part)
SELECT file_path, contains(file_path, '.spec.') OR contains(file_path, '.test.') OR contains(file_path, '__tests__') OR ends_with(file_path, '_test.go') OR ends_with(file_path, 'Test.java') OR ends_with(file_path, 'Tests.java') AS is_test,
  regexp_matches(file_path, '(?i)(index|main|app|server|cli)\\.[a-z]+$|vite\\.config|webpack\\.config') AS is_entry FROM p"""
)
def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("p_size") % 3 == 0, ".spec.ts").when(F.col("p_size") % 3 == 1, "_test.go").otherwise("/main.py")
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("src/"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("/")), end).alias("file_path")).distinct()
    return p.select("file_path", C.is_test_file(F.col("file_path")).alias("is_test"), C.is_entry_point(F.col("file_path")).alias("is_entry"))


# Paths


def path_sql(tail: str) -> str:
    return f"""WITH RECURSIVE {P.USER_SQL},
walk(id, depth, trail) AS (SELECT '1', 0, CAST([] AS BIGINT[]) UNION ALL
  SELECT e.dst, w.depth + 1, list_append(w.trail, e.edge_id) FROM (SELECT id, depth, min(trail) AS trail FROM walk GROUP BY id, depth) w JOIN user_edges e ON e.src = w.id WHERE w.depth < 10),
best AS (SELECT id, depth, min(trail) AS trail FROM walk GROUP BY id, depth QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth) = 1)
{tail}"""


@query(path_sql("SELECT id, depth FROM best"))
def shortest_path_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.trails(P.g_user(spark, sf_dir).kept(), ids(spark, "1"), 10).select("id", "depth")


@query(path_sql(", goal AS (SELECT id, trail FROM best ORDER BY depth DESC, id LIMIT 1), s AS (SELECT unnest(trail) AS edge_id, unnest(range(1, len(trail) + 1)) AS step FROM goal) SELECT CAST(step AS INTEGER) AS step, src, dst, relation FROM s JOIN user_edges USING (edge_id)"))
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = P.g_user(spark, sf_dir).kept()
    far = paths.trails(graph, ids(spark, "1"), 10).orderBy(F.desc("depth"), "id").limit(1)
    return paths.along(graph, far).select("step", "src", "dst", "relation")


# Cycles

CYCLE_2 = "SELECT a.src || ',' || a.dst AS cycle, 2 AS length FROM {e} a JOIN {e} b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst"
CYCLE_3 = "SELECT a.src || ',' || b.src || ',' || c.src AS cycle, 3 AS length FROM {e} a JOIN {e} b ON a.dst = b.src JOIN {e} c ON b.dst = c.src AND c.dst = a.src WHERE a.src < b.src AND a.src < c.src AND b.src <> c.src"


def _flat(cycles_: DataFrame) -> DataFrame:
    return cycles_.select(F.array_join("cycle", ",").alias("cycle"), "length")


@query(f"WITH {P.USER_SQL} " + CYCLE_2.format(e="user_edges"))
def cycles_len2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(cycles.bounded_cycles(P.g_user(spark, sf_dir).edges, 2))


@query(f"WITH {P.NATION_SQL} " + CYCLE_3.format(e="nation_edges"))
def cycles_len3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(cycles.bounded_cycles(P.g_nation(spark, sf_dir).edges, 3))


@query(f"WITH {P.NATION_SQL}, c AS ({CYCLE_2.format(e='nation_edges')} UNION ALL {CYCLE_3.format(e='nation_edges')}) SELECT DISTINCT unnest(string_split(cycle, ',')) AS id FROM c")
def cycle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.cycle_members(P.g_nation(spark, sf_dir).edges, 3)


@query(
    f"""WITH RECURSIVE {P.NATION_SQL}, walk(a, b) AS (SELECT src, dst FROM nation_edges UNION SELECT a, dst FROM walk JOIN nation_edges ON b = src)
SELECT x.a AS id, min(x.b) AS component FROM walk x JOIN walk y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(*) > 1"""
)
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.strong_components(P.g_nation(spark, sf_dir).edges)


@query()
def back_edge_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(cycles.back_edge_cycles(P.g_nation(spark, sf_dir)))


# Audits


@query(f"WITH {P.STAR_SQL} SELECT id, name, kind, file_path, seq FROM star_nodes n WHERE kind IN ('file', 'component') AND NOT EXISTS (SELECT 1 FROM star_edges e WHERE e.dst = n.id AND relation = 'imports')")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.orphans(P.g_star(spark, sf_dir)).select(*NODE)


@query(
    f"""WITH {P.STAR_SQL} SELECT id, name, kind, file_path, seq FROM star_nodes n WHERE kind IN ('function', 'class', 'interface') AND NOT regexp_matches(file_path, '(?i)index\\.[a-z]+$')
AND NOT EXISTS (SELECT 1 FROM star_edges e WHERE e.dst = n.id AND relation IN ('calls', 'implements', 'extends'))"""
)
def unused_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.unused_symbols(P.g_star(spark, sf_dir)).select(*NODE)


RULES = [{"from": "ASIA/**", "to": "EUROPE/*", "description": "Asia must not import Europe."}, {"from": "A*/", "to": "MIDDLE"}]


@query(
    f"""WITH {P.NATION_SQL}, r(f, t, rule_from, rule_to, reason) AS (VALUES ('ASIA/.[^/]*', 'EUROPE/[^/]*', 'ASIA/**', 'EUROPE/*', 'Asia must not import Europe.'),
  ('A[^/]*/', 'MIDDLE', 'A*/', 'MIDDLE', 'Forbidden layer boundary: `A*/` -> `MIDDLE`'))
SELECT src, dst, relation, rule_from, rule_to, reason FROM nation_edges e JOIN nation_nodes a ON a.id = src JOIN nation_nodes b ON b.id = dst JOIN r ON regexp_matches(a.file_path, f) AND regexp_matches(b.file_path, t) WHERE a.file_path <> b.file_path"""
)
def lint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.violations(P.g_nation(spark, sf_dir), RULES).drop("edge_id")


# Slices

SLICE_SQL = levels_sql(P.NATION_SQL, "nation_nodes", "nation_edges", "'2', '3'", "both", 2) + ", sliced AS (SELECT id FROM reached JOIN nation_nodes USING (id)), s AS (SELECT src, dst, relation, dst IN (SELECT id FROM sliced) AS inside FROM nation_edges WHERE src IN (SELECT id FROM sliced))"


@query(SLICE_SQL + "SELECT src, dst, relation, inside FROM s")
def slice_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.domain_slice(P.g_nation(spark, sf_dir).kept(), ids(spark, "2", "3"), 2)[1].select("src", "dst", "relation", "inside")


@query(
    SLICE_SQL
    + """, c AS (SELECT CAST(coalesce(sum(CAST(inside AS INTEGER)), 0) AS BIGINT) AS internal, CAST(coalesce(sum(CAST(NOT inside AS INTEGER)), 0) AS BIGINT) AS boundary FROM s)
SELECT internal, boundary, CAST(CASE WHEN internal + boundary = 0 THEN 100 ELSE (200 * internal + internal + boundary) // (2 * (internal + boundary)) END AS BIGINT) AS cohesion_centi FROM c"""
)
def slice_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cohesion(A.domain_slice(P.g_nation(spark, sf_dir).kept(), ids(spark, "2", "3"), 2)[1])


# Contracts

CLIENT_SQL = r"""clients AS (
  SELECT 'client/' || event_type || '.ts' AS c_path, '/api/' || event_type || '/:' || regexp_extract(props, '"([a-zA-Z]+)"', 1) || CASE WHEN event_id % 5 = 0 THEN '/' ELSE '' END AS c_url,
    CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS c_method, CAST(event_id AS INTEGER) AS c_line FROM events),
servers(s_path, s_url, s_method, s_line) AS (VALUES ('srv/a.java', '/api/click/{id}', 'GET', 3), ('srv/a.java', '/api//view/{x}', 'ALL', 9), ('srv/b.py', '/api/purchase/{id}', 'POST', 4), ('srv/c.go', '/api/none/{id}', 'GET', 5)),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(c_url), '\{[^}]+\}', '*', 'g'), ':[a-zA-Z0-9_]+', '*', 'g'), '/+', '/', 'g'), '/$', '') AS norm_url FROM clients),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(s_url), '\{[^}]+\}', '*', 'g'), ':[a-zA-Z0-9_]+', '*', 'g'), '/+', '/', 'g'), '/$', '') AS s_norm FROM servers)
"""
FITS = "norm_url = s_norm AND (s_method = 'ALL' OR c_method = s_method)"
SERVERS = [("srv/a.java", "/api/click/{id}", "GET", 3), ("srv/a.java", "/api//view/{x}", "ALL", 9), ("srv/b.py", "/api/purchase/{id}", "POST", 4), ("srv/c.go", "/api/none/{id}", "GET", 5)]


def _contracts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    e = read(spark, sf_dir, "events")
    url = F.concat(F.lit("/api/"), "event_type", F.lit("/:"), F.regexp_extract("props", '"([a-zA-Z]+)"', 1), F.when(F.col("event_id") % 5 == 0, "/").otherwise(""))
    clients = e.select(F.concat(F.lit("client/"), "event_type", F.lit(".ts")).alias("file_path"), url.alias("url"), F.when(F.col("event_id") % 3 == 0, "POST").otherwise("GET").alias("method"), F.col("event_id").cast("int").alias("line"))
    servers = spark.createDataFrame(SERVERS, "file_path string, url string, method string, line int")
    return A.contracts(*(x.withColumn("norm_url", C.api_path(F.col("url"))) for x in (clients, servers)))


@query(f"WITH {CLIENT_SQL} SELECT c_path || '#api_call:' || c_line AS client_id, s_path || '#route_handler:' || s_line AS server_id, c_url AS url, c_method AS method FROM c JOIN s ON {FITS}")
def contracts_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir)["matched"].select("client_id", "server_id", F.col("c_url").alias("url"), F.col("c_method").alias("method"))


@query(f"WITH {CLIENT_SQL} SELECT c_path, c_url, c_method, c_line FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE {FITS})")
def contracts_unmatched_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir)["unmatched_clients"].select("c_path", "c_url", "c_method", "c_line")


@query(f"WITH {CLIENT_SQL} SELECT s_path, s_url, s_method, s_line FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE {FITS})")
def contracts_unmatched_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir)["unmatched_servers"].select("s_path", "s_url", "s_method", "s_line")


# Text


@query("WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS text, unnest(range(1, len(regexp_split_to_array(text, '\\r?\\n')) + 1)) AS line FROM documents) SELECT doc_id, CAST(line AS INTEGER) AS line, text FROM l")
def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.lines(F.col("text"))).alias("line", "text")).withColumn("line", F.col("line") + 1)


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", C.content_hash(F.col("text")).alias("sha256"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-zA-Z0-9_-]+)\\b', 1)) AS tag FROM pages) GROUP BY tag")
def page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = read(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(r"<([a-zA-Z0-9_-]+)(?![A-Za-z0-9_])"), F.lit(1))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


@query(
    """WITH k AS (SELECT DISTINCT replace(lower(p_type), ' ', '-') AS kebab FROM part)
SELECT kebab, array_to_string(list_transform(list_filter(string_split(kebab, '-'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), '') AS pascal FROM k"""
)
def kebab_pascal(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = read(spark, sf_dir, "part").select(F.replace(F.lower("p_type"), F.lit(" "), F.lit("-")).alias("kebab")).distinct()
    return k.select("kebab", C.kebab_to_pascal(F.col("kebab")).alias("pascal"))


@query("SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), '\n\n') AS script FROM pages")
def script_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1)), "\n\n").alias("script"))


@query(
    """WITH s AS (SELECT page_id, unnest(regexp_extract_all(array_to_string(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), ' '), '\\b([a-zA-Z0-9_]+(\\.[a-zA-Z0-9_]+)*)\\s*\\(', 1)) AS callee FROM pages)
SELECT callee, count(*) AS calls FROM s GROUP BY callee"""
)
def script_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1)), " ")
    calls = read(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all(body, F.lit(C.CALL), F.lit(1))).alias("callee"))
    return calls.groupBy("callee").agg(F.count("*").alias("calls"))


@query("WITH u AS (SELECT DISTINCT '/api/' || n_name || '/{' || lower(r_name) || '}//:' || n_nationkey || '/' AS url FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT url, '/api/' || regexp_extract(url, '^/api/([^/]*)', 1) || '/*/*' AS norm_url FROM u")
def normalize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    url = F.concat(F.lit("/api/"), "n_name", F.lit("/{"), F.lower("r_name"), F.lit("}//:"), F.col("n_nationkey").cast("string"), F.lit("/"))
    return n.select(url.alias("url")).distinct().select("url", C.api_path(F.col("url")).alias("norm_url"))


@query(
    """SELECT conv_id, turn, role, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING), -1) AS scope_turn FROM conversations"""
)
def scope_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce(F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w), F.lit(-1)).alias("scope_turn"))


# Incremental

DELTA_SQL = """old AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0),
new AS (SELECT doc_id, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0),
delta AS (SELECT CAST(coalesce(n.doc_id, o.doc_id) AS VARCHAR) AS path, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'modified' END AS status FROM new n FULL JOIN old o ON n.doc_id = o.doc_id)
"""


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    now = d.filter("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    stamp = F.lit(None).cast("timestamp").alias("mtime")
    return incremental.delta(now.select("path", C.content_hash(F.col("text")).alias("sha256"), stamp), d.filter("doc_id % 7 <> 0").select("path", C.content_hash(F.col("text")).alias("sha256"), stamp))


@query(f"WITH {DELTA_SQL} SELECT path, status FROM delta")
def file_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta(spark, sf_dir).select("path", "status")


@query(f"WITH {DELTA_SQL} SELECT count(*) FILTER (status <> 'deleted') AS total, count(*) FILTER (status = 'unchanged') AS cached, count(*) FILTER (status IN ('added', 'modified')) AS indexed, count(*) FILTER (status = 'deleted') AS deleted FROM delta")
def delta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.stats(_delta(spark, sf_dir))


@query(
    """WITH e AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS first FROM events),
g AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, count(*) AS events, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS paths FROM g GROUP BY user_id, s"""
)
def debounce_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "ts", F.col("event_type").alias("path"))
    return watch.debounce(e, "2 hours", "user_id").select("user_id", "events", F.array_join(F.array_sort("paths"), ",").alias("paths"))


# Linking

LINK_SQL = """named AS (SELECT *, p_name || ' ' || p_brand AS full_name, 'f' || (p_partkey % 40) AS home FROM part),
symbols AS (SELECT 'f' || p_size AS file_path, full_name AS name, p_partkey AS seq FROM named),
s AS (SELECT file_path, name, max(seq) AS seq FROM symbols GROUP BY 1, 2),
u AS (SELECT name, min(file_path) AS file_path FROM s GROUP BY name HAVING count(*) = 1),
calls AS (SELECT p_partkey AS call_id, home AS file_path, full_name AS callee FROM named),
bb AS (SELECT home AS file_path, full_name AS local_name, max('f' || p_size) AS source_path, max(full_name) AS imported_name FROM named WHERE p_partkey % 3 = 0 GROUP BY 1, 2)
"""


def _link_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = lambda c: F.concat(F.lit("f"), c.cast("string"))
    p = read(spark, sf_dir, "part").select("*", F.concat_ws(" ", "p_name", "p_brand").alias("name"), f(F.col("p_partkey") % 40).alias("home"), f(F.col("p_size")).alias("own"))
    symbols = p.select(F.col("own").alias("file_path"), "name", F.col("p_partkey").alias("seq"), F.concat_ws("#", "own", "name").alias("id"))
    calls = p.select(F.col("p_partkey").alias("call_id"), F.col("home").alias("file_path"), F.lit("caller").alias("caller_id"), F.col("name").alias("callee_name"), F.lit(None).cast("string").alias("callee_object"))
    bindings = p.filter("p_partkey % 3 = 0").groupBy(F.col("home").alias("file_path"), F.col("name").alias("local_name")).agg(F.max("own").alias("source_path"), F.max("name").alias("imported_name")).withColumn("is_namespace", F.lit(False))
    return symbols, calls, bindings


@query(
    f"""WITH {LINK_SQL}
SELECT call_id, coalesce(t1.file_path || '#' || t1.name, t2.file_path || '#' || t2.name, u.file_path || '#' || u.name) AS target_id,
  CASE WHEN t1.name IS NOT NULL THEN 1 WHEN t2.name IS NOT NULL THEN 2 ELSE 4 END AS tier
FROM calls c LEFT JOIN s t1 ON t1.file_path = c.file_path AND t1.name = c.callee LEFT JOIN bb ON bb.file_path = c.file_path AND bb.local_name = c.callee
  LEFT JOIN s t2 ON t2.file_path = bb.source_path AND t2.name = bb.imported_name LEFT JOIN u ON u.name = c.callee
WHERE coalesce(t1.name, t2.name, u.name) IS NOT NULL"""
)
def link_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, calls, bindings = _link_tables(spark, sf_dir)
    return link.link_calls(calls, symbols, bindings).select("call_id", "target_id", "tier")


@query(f"WITH {LINK_SQL} SELECT name, file_path FROM u")
def unique_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.unique_definitions(_link_tables(spark, sf_dir)[0]).select("name", F.col("def_path").alias("file_path"))


@query(
    f"""WITH {LINK_SQL}, f AS (SELECT name, arg_min(file_path, seq) AS file_path FROM s GROUP BY name)
SELECT call_id, coalesce(t1.file_path || '#' || t1.name, t2.file_path || '#' || t2.name, f.file_path || '#' || f.name) AS target_id
FROM calls c LEFT JOIN s t1 ON t1.file_path = c.file_path AND t1.name = c.callee LEFT JOIN bb ON bb.file_path = c.file_path AND bb.local_name = c.callee
  LEFT JOIN s t2 ON t2.file_path = bb.source_path AND t2.name = bb.imported_name LEFT JOIN f ON f.name = c.callee
WHERE coalesce(t1.name, t2.name, f.name) IS NOT NULL"""
)
def heritage_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, calls, bindings = _link_tables(spark, sf_dir)
    pending = calls.select("call_id", "file_path", F.lit("x").alias("source_id"), F.col("callee_name").alias("target_name"), F.lit("extends").alias("relation"))
    return link.link_heritages(pending, symbols, bindings).select("call_id", "target_id")
