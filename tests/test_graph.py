"""Graph operators on hand-built graphs with exact answers, and the catalogue against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from topograph.functions import columns as C
from topograph.operators import analytics as A
from topograph.operators import cycles, paths
from topograph.operators.graph import Graph
from topograph.plans import catalog, source_catalog  # noqa: F401  the latter adds its queries
from topograph.plans.render import mermaid
from topograph.schema import EDGES, NODES
from topograph.streaming import incremental, watch


def graph(spark, nodes, edges):
    """nodes: (id, kind, path); edges: (src, dst, relation)."""
    n = [(i, i.rpartition("#")[2], kind, path, None, None, None, k) for k, (i, kind, path) in enumerate(nodes)]
    return Graph(spark.createDataFrame(n, NODES), spark.createDataFrame([(k, *e) for k, e in enumerate(edges)], EDGES))


def files(spark, names, edges):
    return graph(spark, [(x, "file", x) for x in names], [(a, b, "imports") for a, b in edges])


def ids(df):
    return {r["id"] for r in df.collect()}


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def test_chain(spark):
    g = files(spark, ["a", "b", "c"], [("a", "b"), ("b", "c"), ("c", "ghost"), ("ghost", "a")])
    assert ids(g.traverse(frame(spark, "a"), "outbound", 1)[0]) == {"a", "b"}
    assert ids(g.traverse(frame(spark, "a"), "outbound", 2)[0]) == {"a", "b", "c"}
    assert ids(g.traverse(frame(spark, "c"), "inbound", 2)[0]) == {"a", "b", "c"}
    assert ids(g.traverse(frame(spark, "a"), "both", 0)[0]) == {"a"} and g.traverse(frame(spark, "nowhere"), "both", 3)[0].count() == 0
    nodes, edges = g.traverse(frame(spark, "c"), "outbound", 2)  # through an id without a node
    assert ids(nodes) == {"c", "a"} and {(r["src"], r["dst"]) for r in edges.collect()} == {("c", "ghost"), ("ghost", "a")}


def test_remove_and_upsert(spark):
    g = graph(spark, [("x.ts", "file", "x.ts"), ("x.ts#f", "function", "x.ts"), ("y.ts", "file", "y.ts"), ("y.ts#g", "function", "y.ts")], [("x.ts", "y.ts", "imports"), ("x.ts#f", "y.ts#g", "calls"), ("y.ts", "y.ts#g", "contains")])
    left = g.without_file("y.ts")
    assert ids(left.nodes) == {"x.ts", "x.ts#f"} and left.edges.count() == 0
    more = g.nodes.filter("id = 'x.ts'").withColumns({"name": F.lit("new"), "seq": F.lit(99).cast("long")})
    row = g.with_nodes(more).nodes.filter("id = 'x.ts'").collect()
    assert [(r["name"], r["seq"]) for r in row] == [("new", 0)] and g.with_edges(g.edges).edges.count() == 6 and Graph.empty(spark).size() == 0


def test_find(spark):
    g = graph(spark, [("src/a.ts", "file", "src/a.ts"), ("src/a.ts#Box.open", "function", "src/a.ts"), ("lib/src/a.ts", "file", "lib/src/a.ts"), ("lib/b.py#opener", "function", "lib/b.py")], [])
    assert ids(g.find("./a.ts")) == {"src/a.ts", "lib/src/a.ts"} and ids(g.find("open")) == {"src/a.ts#Box.open"} and ids(g.find("OPENER")) == {"lib/b.py#opener"}
    assert ids(g.find("b.py")) == {"lib/b.py#opener"} and ids(g.find("pen")) == {"src/a.ts#Box.open", "lib/b.py#opener"} and not ids(g.find("zzz")) and not ids(g.find("  "))
    assert ids(g.domain_seeds("#box")) == {"src/a.ts#Box.open"}


def test_slice(spark):
    g = files(spark, ["d/1", "d/2", "d/3", "common", "ext"], [("d/1", "d/2"), ("d/2", "d/3"), ("d/3", "common"), ("common", "ext")])
    nodes, edges = A.domain_slice(g, g.domain_seeds("d/"), 1)
    assert ids(nodes) == {"d/1", "d/2", "d/3", "common"} and A.cohesion(edges).first().asDict() == {"internal": 3, "boundary": 1, "cohesion_centi": 75}
    assert A.cohesion(edges.limit(0)).first()["cohesion_centi"] == 100


def test_paths(spark):
    g = graph(spark, [(x, "function", "f.ts") for x in "abcdez"], [("a", "c", "calls"), ("a", "b", "calls"), ("b", "d", "calls"), ("c", "d", "calls"), ("d", "e", "calls"), ("a", "c", "imports")])
    steps = paths.shortest_path(g, frame(spark, "a"), frame(spark, "e")).orderBy("step").collect()
    assert [(r["src"], r["dst"], r["relation"]) for r in steps] == [("a", "c", "calls"), ("c", "d", "calls"), ("d", "e", "calls")]
    assert paths.shortest_path(g, frame(spark, "a"), frame(spark, "z")).count() == 0 and paths.shortest_path(g, frame(spark, "a"), frame(spark, "e"), 2).count() == 0


def test_cycles(spark):
    g = files(spark, list("abcdefgh"), [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "b"), ("e", "e"), ("f", "g"), ("g", "h"), ("a", "b")])
    two, three = (sorted(r["cycle"] for r in cycles.bounded_cycles(g.edges, n).collect()) for n in (2, 3))
    assert two == [["a", "b"]] and three == [["b", "c", "d"]]
    found = [(r["cycle"], r["length"]) for r in cycles.back_edge_cycles(g).collect()]
    assert found == [(["a", "b", "a"], 2), (["b", "c", "d", "b"], 3)]
    assert {(r["id"], r["component"]) for r in cycles.strong_components(g.edges).collect()} == {(x, "a") for x in "abcd"}
    assert cycles.strong_components(g.edges.limit(0)).count() == 0 and cycles.impacted_files(cycles.back_edge_cycles(g)).count() == 4
    rotated = cycles.rotated(spark.createDataFrame([(["c", "a", "b"],)], "cycle array<string>")).first()["cycle"]
    assert rotated == ["a", "b", "c"] and cycles.closed(cycles.rotated(spark.createDataFrame([(["b", "a"],)], "cycle array<string>"))).first()["cycle"] == ["a", "b", "a"]


def test_metrics(spark):
    g = graph(spark, [("a", "file", "a"), ("b", "component", "b"), ("c", "file", "c"), ("a#f", "function", "a")], [("a", "b", "imports"), ("a", "b", "imports"), ("a", "a", "imports"), ("a", "a#f", "contains"), ("b", "gone", "imports")])
    got = {r["id"]: (r["ca"], r["ce"], r["instability_milli"]) for r in A.module_metrics(g).collect()}
    assert got == {"a": (0, 1, 1000), "b": (1, 0, 0), "c": (0, 0, 0)}
    assert [r["id"] for r in A.top_hubs(g, 2).collect()] == ["a", "b"] and A.totals(g).first()["total_symbols"] == 1
    assert spark.range(1).select(C.instability_milli(F.lit(77), F.lit(3))).first()[0] == 38  # 3/80 = 0.0375, half up


def test_impact_and_dead_code(spark):
    g = graph(
        spark,
        [("src/index.ts", "file", "src/index.ts"), ("u.ts", "file", "u.ts"), ("u.ts#f", "function", "u.ts"), ("dead.ts", "file", "dead.ts"), ("dead.ts#g", "function", "dead.ts"), ("u.ts#h", "function", "u.ts"), ("t.spec.ts", "file", "t.spec.ts"), ("t.spec.ts#t", "function", "t.spec.ts")],
        [("src/index.ts", "u.ts", "imports"), ("u.ts", "u.ts#f", "contains"), ("u.ts#h", "u.ts#f", "calls"), ("t.spec.ts#t", "u.ts#f", "calls"), ("t.spec.ts", "t.spec.ts#t", "contains"), ("t.spec.ts", "u.ts", "imports")],
    )
    tiers = {r["id"]: r["tier"] for r in A.impact_tiers(g, frame(spark, "u.ts#f")).collect()}
    assert tiers == {"u.ts#h": 1, "t.spec.ts#t": 0, "u.ts": 2, "src/index.ts": 2, "t.spec.ts": 2}
    assert ids(A.orphans(g)) == {"dead.ts", "t.spec.ts"} and ids(A.unused_symbols(g)) == {"dead.ts#g", "u.ts#h", "t.spec.ts#t"} and ids(A.dead_code(g, "dead")) == {"dead.ts", "dead.ts#g"}
    d = A.diff_impact(g, spark.createDataFrame([("u.ts",)], "path string"))
    assert {r["file_path"] for r in d["upstream_files"].collect()} == {"src/index.ts", "t.spec.ts"} and {r["file_path"] for r in d["test_files"].collect()} == {"t.spec.ts"} and ids(d["breaking_callers"]) == {"t.spec.ts#t"}


def test_lint(spark):
    g = files(spark, ["views/a/b.vue", "infra/x/db.ts", "core/q.ts"], [("views/a/b.vue", "infra/x/db.ts"), ("core/q.ts", "views/a/b.vue"), ("core/q.ts", "gone")])
    assert [r["reason"] for r in A.violations(g, [{"from": "views/**", "to": "infra/**", "description": "no"}]).collect()] == ["no"]
    for bad in ("{not json", '{"from": "a"}', "[]", None):
        assert [r["rule_from"] for r in A.violations(g, bad).collect()] == ["core"]
    assert C.glob_regex("a/**/b.*") == r"a/.[^/]*/b\.[^/]*" and C.glob_regex("a/**/b?", "strict") == "^a/.*/b[^/]$"


def test_scalars(spark):
    one = spark.createDataFrame([(" /api//users/{id}/:x/ ", "my-side-Bar", "<My-Box/><nav/><Foo.bar><b-c x>")], "u string, k string, m string")
    r = one.select(C.api_path(F.col("u")).alias("u"), C.kebab_to_pascal(F.col("k")).alias("k"), C.component_tags(F.col("m")).alias("m")).first()
    assert r["u"] == "/api/users/*/*" and r["k"] == "MySideBar" and r["m"] == ["My-Box", "Foo", "b-c", "BC"]
    assert C.clean_query(" ./src\\A.ts ") == "src/a.ts" and C.mermaid_label('a"<b>') == "a'b"


def test_mermaid():
    n, e = [{"id": "a", "name": "A", "file_path": "a"}, {"id": "b", "name": "", "file_path": "b"}], [{"src": "a", "dst": "b", "relation": "calls"}] * 2
    assert mermaid(n, 2, e).count("-->") == 1 and mermaid(n, 26, e) is None and mermaid(n, 2, [{"src": "a", "dst": "b", "relation": "contains"}]) is None and mermaid([], 0, e) is None


def test_delta(spark):
    t = "timestamp'2024-01-01'"
    now = spark.sql(f"select * from values ('a','1',{t}),('b','2',null),('c','9',timestamp'2025-01-01'),('n','1',null) v(path, sha256, mtime)")
    old = spark.sql(f"select * from values ('a','0',{t}),('b','2',{t}),('c','3',{t}),('d','4',{t}) v(path, sha256, mtime)")
    got = {r["path"]: r["status"] for r in incremental.delta(now, old).collect()}
    assert got == {"a": "unchanged", "b": "unchanged", "c": "modified", "n": "added", "d": "deleted"}
    assert incremental.stats(incremental.delta(now, now)).first().asDict() == {"total": 4, "cached": 4, "indexed": 0, "deleted": 0}


def test_watch(spark, tmp_path):
    rows = [("src/library/a.ts", "2024-01-01 00:00:00"), ("src/library/a.ts", "2024-01-01 00:00:00.05"), ("b.py", "2024-01-01 00:00:00.12"), ("lib/x.ts", "2024-01-01 00:00:00.1"), ("notes.txt", "2024-01-01 00:00:01"), ("tsconfig.json", "2024-01-01 00:00:05"), (".git/c.py", "2024-01-01 00:00:05")]
    events = spark.createDataFrame(rows, "path string, t string").select("path", F.col("t").cast("timestamp").alias("ts"))
    flushes = sorted(sorted(r["paths"]) for r in watch.debounce(watch.watched(events)).collect())
    assert flushes == [["b.py", "src/library/a.ts"], ["tsconfig.json"]]
    events.write.parquet(str(tmp_path / "in" / "1"))
    late = spark.createDataFrame([("z.ts", "2024-01-01 01:00:00")], "path string, t string").select("path", F.col("t").cast("timestamp").alias("ts"))
    late.write.parquet(str(tmp_path / "in" / "2"))
    seen = []
    stream = spark.readStream.schema("path string, ts timestamp").option("maxFilesPerTrigger", 100).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = watch.on_changes(stream, lambda df, _: seen.extend(sorted(r["paths"]) for r in df.collect()), str(tmp_path / "state"), availableNow=True)
    q.awaitTermination(120)
    assert sorted(seen) == flushes


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_catalogue(spark, sf_dir, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(catalog.SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda x: sorted(map(repr, x[columns].astype(object).where(x[columns].notna(), None).values.tolist()))
    assert rows(ours) == rows(theirs)
