"""Source fixtures: exact symbols and links."""

import pytest

from topograph.operators import extract
from topograph.operators.extract import Registry
from topograph.plans.engine import Engine
from topograph.plans.render import markdown
from topograph.sources.config import Config, without_comments

FILES = {
    "pkg/util.py": "import os\n\n\ndef shout(text):\n    return text.upper()\n",
    "pkg/service.py": "from .util import shout\n\n\nclass Base:\n    pass\n\n\nclass Greeter(Base):\n    def greet(self, name):\n        self.note(name)\n        return shout(name)\n\n    def note(self, name):\n        print(name)\n",
    "db/conn.go": "package db\n\nimport (\n\t\"fmt\"\n)\n\nfunc Open() {\n\tfmt.Println()\n}\n",
    "models/user.go": 'package models\n\nimport "app/db"\n\ntype User struct {\n}\n\ntype Store interface {\n}\n\nfunc (u *User) Save() {\n\tdb.Open()\n}\n',
    "src/auth.rs": "pub fn check() -> bool { true }\n",
    "src/model.rs": "use crate::auth::check;\n\npub struct Point;\n\npub trait Shape {\n}\n\nimpl Shape for Point {\n    fn area(&self) {\n        check();\n    }\n}\n\nfn free() {\n    check();\n}\n",
    "com/acme/Util.java": "package com.acme;\n\npublic class Util {\n    public static String twice(String s) {\n        return s;\n    }\n}\n",
    "com/acme/Service.java": "package com.acme;\n\nimport com.acme.Util;\n\npublic class Service extends Base implements Named {\n    public String run(String s) {\n        return Util.twice(s);\n    }\n}\n\nclass Base {\n}\n\ninterface Named {\n}\n",
    "web/util.ts": "export function helper(a: number): number {\n  return a + 1;\n}\nexport const twice = (a: number) => helper(helper(a));\nexport type Id = string;\n",
    "web/other.ts": "export function helper() { return 0 }\n",
    "web/index.ts": "import { helper } from './util';\nexport * from './util';\ninterface Shape { area(): number }\nclass Base { x = 1 }\nexport class Box extends Base implements Shape {\n  area(): number {\n    return helper(2);\n  }\n  size() { return this.area(); }\n}\nfunction main() {\n  const b = new Box();\n  b.size();\n  helper(1);\n}\n",
    "web/Card.vue": "<template>\n  <div><side-bar/><Plain/></div>\n</template>\n<script setup lang=\"ts\">\nimport SideBar from './SideBar.vue'\nconst load = async () => { await fetch('/api/users/1') }\n</script>\n",
    "web/SideBar.vue": "<template><p>x</p></template>\n<script>\nexport default {}\n</script>\n",
    "srv/Api.java": '@RestController\npublic class Api {\n    @GetMapping("/api/users/{id}")\n    public String user() {\n        return "";\n    }\n}\n',
    "client.ts": "export async function user() {\n  return axios.get('/api/users/:id');\n}\n",
}


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.index_texts(FILES)
    return e


@pytest.fixture(scope="module")
def edges(engine):
    return {(r["src"], r["relation"], r["dst"]) for r in engine.graph.edges.collect()}


@pytest.fixture(scope="module")
def nodes(engine):
    return {r["id"]: r for r in engine.graph.nodes.collect()}


def test_files_and_phantoms(nodes):
    assert set(FILES) <= set(nodes)
    assert nodes["web/Card.vue"]["kind"] == "component" and nodes["os.py"]["metadata"] == {"phantom": "true"}
    assert len({r["seq"] for r in nodes.values()}) == len(nodes)


def test_python(edges, nodes):
    assert nodes["pkg/service.py#Greeter.greet:9"]["kind"] == "function"
    assert ("pkg/service.py#Greeter:8", "extends", "pkg/service.py#Base:4") in edges
    assert ("pkg/service.py#Greeter.greet:9", "calls", "pkg/util.py#shout:4") in edges
    assert ("pkg/service.py#Greeter.greet:9", "calls", "pkg/service.py#Greeter.note:13") in edges
    assert ("pkg/service.py#Greeter:8", "contains", "pkg/service.py#Greeter.greet:9") in edges
    assert ("pkg/service.py", "imports", "pkg/util.py") in edges


def test_go(edges, nodes):
    assert nodes["models/user.go#User:5"]["kind"] == "class" and nodes["models/user.go#Store:8"]["kind"] == "interface"
    assert ("models/user.go#User:5", "contains", "models/user.go#User.Save:11") in edges
    assert ("models/user.go#User.Save:11", "calls", "db/conn.go#Open:7") in edges


def test_rust(edges, nodes):
    assert ("src/model.rs#Point:3", "implements", "src/model.rs#Shape:5") in edges
    assert ("src/model.rs#Point.area:9", "calls", "src/auth.rs#check:1") in edges
    assert "src/model.rs#free:14" in nodes


def test_java(edges):
    assert ("com/acme/Service.java#Service:5", "extends", "com/acme/Service.java#Base:11") in edges
    assert ("com/acme/Service.java#Service:5", "implements", "com/acme/Service.java#Named:14") in edges
    assert ("com/acme/Service.java#Service.run:6", "calls", "com/acme/Util.java#Util.twice:4") in edges


def test_script(edges, nodes):
    assert nodes["web/util.ts#twice:4"]["kind"] == "function" and nodes["web/util.ts#Id:5"]["kind"] == "type" and nodes["web/util.ts#helper:1"]["end_line"] == 3
    assert ("web/index.ts#Box:5", "extends", "web/index.ts#Base:4") in edges and ("web/index.ts#Box:5", "implements", "web/index.ts#Shape:3") in edges
    assert ("web/index.ts#Box.area:6", "calls", "web/util.ts#helper:1") in edges and ("web/index.ts#main:11", "calls", "web/util.ts#helper:1") in edges
    assert ("web/index.ts#main:11", "calls", "web/index.ts#Box.size:9") in edges and ("web/index.ts#Box.size:9", "calls", "web/index.ts#Box.area:6") in edges
    assert not any(d.startswith("web/other.ts#") and r == "calls" for _, r, d in edges)
    assert ("web/index.ts", "contains", "web/index.ts#Box.area:6") not in edges


def test_components(edges):
    assert ("web/Card.vue", "imports", "web/SideBar.vue") in edges and ("web/Card.vue", "calls", "web/SideBar.vue") in edges


def test_contracts(engine):
    r = engine.query("api_contracts")
    assert [(x["client_id"], x["server_id"]) for x in r.payload["matched"].collect()] == [("client.ts#api_call:2", "srv/Api.java#route_handler:3")]
    assert [x["c_path"] for x in r.payload["unmatched_clients"].collect()] == ["web/Card.vue"]
    assert "1 requests meet a route; 1 requests have no route, and 0 routes no request" in r.summary
    assert "| **GET** | `/api/users/:id` |" in markdown(r)


def test_actions(engine):
    assert "Depth 3 reaches" in engine.query("dependencies", "web/index.ts").summary
    assert {x["file_path"] for x in engine.query("dependencies", "web/index.ts", depth=0).nodes.collect()} == {"web/index.ts"}
    found = engine.query("path", "main", "web/util.ts#helper:1")
    assert [x["dst"] for x in found.payload["steps"].collect()] == ["web/util.ts#helper:1"] and "1. `main`" in markdown(found)
    assert "one node" in engine.query("path", "main", "main").summary
    assert "Error" in engine.query("path", "main").summary and "Error" in engine.query("slice").summary and "Error" in engine.query("call_graph").summary
    assert "Nothing is called" in engine.query("impact", "nowhere-at-all").summary
    impact = engine.query("impact", "web/util.ts#helper:1")
    assert {(x["id"], x["tier"]) for x in impact.payload["tiers"].collect()} >= {("web/util.ts#twice:4", 1), ("web/index.ts#main:11", 0)}
    assert "0: users in other files" in markdown(impact)
    assert "the first are shown" in engine.query("dependencies").summary and "**Starting from" in markdown(engine.query("call_graph", "main"))
    assert "mean instability" in engine.query("metrics").summary and "Most connected" in markdown(engine.query("metrics"))
    assert "No file" in engine.query("circular").summary and "There are none" in markdown(engine.query("circular"))
    dead = engine.query("unused")
    assert {x["file_path"] for x in dead.payload["dead"].filter("reason = 'orphan'").collect()} >= {"web/other.ts", "web/Card.vue"} and "nothing imports" in markdown(dead)
    lint = engine.query("lint", rules=[{"from": "models", "to": "db"}])
    assert "edges break one of 1 rules" in lint.summary and "Forbidden layer boundary" in markdown(lint)
    diff = engine.query("diff_impact", changed=["web/util.ts"])
    assert {x["file_path"] for x in diff.payload["upstream_files"].collect()} == {"web/index.ts"} and "Changed: 1" in markdown(diff)
    s = engine.query("slice", "web/util.ts", depth=1)
    assert "stay inside" in s.summary and "Cohesion" in markdown(s)
    with pytest.raises(ValueError, match="unknown action"):
        engine.query("nothing")


def test_warm_equals_cold(spark):
    warm, cold = Engine(spark), Engine(spark)
    small = {k: FILES[k] for k in ("pkg/util.py", "pkg/service.py", "web/util.ts")}
    assert warm.index_texts(small)["indexed"] == 3
    later = {**small, "web/index.ts": FILES["web/index.ts"], "pkg/util.py": FILES["pkg/util.py"] + "\n\ndef more():\n    pass\n"}
    del later["pkg/service.py"]
    assert warm.index_texts(later) == {"total": 3, "cached": 1, "indexed": 2, "deleted": 1}
    cold.index_texts(later)
    for part in ("nodes", "edges"):
        a, b = (sorted(map(str, getattr(e.graph, part).collect())) for e in (warm, cold))
        assert a == b


def test_snapshot(spark, engine, tmp_path):
    from topograph.streaming.incremental import load

    engine.save(str(tmp_path / "snap"))
    facts, files = load(spark, str(tmp_path / "snap"))
    assert files.count() == len(FILES) and facts.count() == engine.facts.count()
    assert load(spark, str(tmp_path / "none")) is None
    again = Engine(spark)
    assert not again.load(str(tmp_path / "none")) and again.load(str(tmp_path / "snap"))
    for part in ("nodes", "edges"):
        assert sorted(map(str, getattr(again.graph, part).collect())) == sorted(map(str, getattr(engine.graph, part).collect()))
    assert again.query("api_contracts").payload["matched"].count() == 1


def test_scope(engine):
    """A scope is an index of that folder alone."""
    found = engine.query("dependencies", "Service.java", scope="com/acme")
    assert {x["file_path"] for x in found.nodes.collect()} == {"com/acme/Service.java", "com/acme/Util.java"}
    assert "Nothing is called" in engine.query("impact", "web/util.ts", scope="./com/").summary
    assert engine.query("api_contracts", scope="srv").payload["matched"].count() == 0
    assert {x["file_path"] for x in engine.query("unused", scope="models").payload["dead"].collect()} == {"models/user.go"}
    assert "web" in engine.query("metrics", scope="web").payload["modules"].first()["file_path"]


def test_cycles_beyond_one_task(spark, monkeypatch):
    from topograph.operators import cycles

    e = Engine(spark)
    e.index_texts({"a.py": "import b\n", "b.py": "import c\n", "c.py": "import a\n", "d.py": "import a\n"})
    one = e.query("circular")
    assert [x["cycle"] for x in one.payload["cycles"].collect()] == [["a.py", "b.py", "c.py", "a.py"]]
    monkeypatch.setattr(cycles, "DFS_EDGES", 2)
    many = e.query("circular")
    assert [(x["cycle"][0], x["length"]) for x in many.payload["cycles"].collect()] == [("a.py", 3)] and many.summary == one.summary


def test_scan_and_git(spark, tmp_path):
    import subprocess

    for path in ("src/a.py", "node_modules/x.js", ".hidden/b.py", "notes.pdf", "src/library/c.ts"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x = 1\n")
    e = Engine(spark)
    assert e.index(str(tmp_path))["total"] == 2
    assert {r["path"] for r in e.files.collect()} == {"src/a.py", "src/library/c.ts"}
    (tmp_path / "src/odd[1]{a}.py").write_text("def f():\n    pass\n")
    from topograph.sources.files import scan

    assert [r["path"] for r in scan(spark, str(tmp_path), only=spark.createDataFrame([("src/odd[1]{a}.py",), ("gone.py",)], "path string")).collect()] == ["src/odd[1]{a}.py"]
    (tmp_path / "src/odd[1]{a}.py").unlink()
    from topograph.sources.files import changed_paths

    assert changed_paths(str(tmp_path)) == []
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q"), run("add", "src"), run("commit", "-qm", "x")
    (tmp_path / "src/a.py").write_text("y = 2\n")
    assert "src/a.py" in changed_paths(str(tmp_path)) and changed_paths(str(tmp_path), "HEAD") == ["src/a.py"]
    with pytest.raises(ValueError):
        changed_paths(str(tmp_path), "--output=x")


def test_registry():
    r = Registry()
    assert all(map(r.supports, ("a.ts", "a.vue", "a.svelte", "a.py", "a.go", "a.rs", "a.JAVA"))) and not r.supports("a.pdf")
    r.register("lines", (".txt",), lambda content, facts: facts.symbol(content.strip(), "function", 1))
    assert r.facts("x.txt", "hello")[0]["name"] == "hello"


def test_config():
    c = Config.of('{ // a comment\n "compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["app/*"], "**/x": ["y"],}} /* end */ }', "module example.org/app\n", 'name = "crate"\n')
    assert c.expand("@/a/b") == ["src/app/a/b"] and c.go_module == "example.org/app" and c.rust_crate == "crate"
    assert Config.of("{ not json").aliases == () and without_comments('{"a": "//"}') == '{"a": "//"}'


def test_sfc_blocks():
    script, lang, tags, lines = extract.sfc_blocks("<script>let a</script>\n<NavBar/><my-button/><div/>\n<style>x{}</style>", "a.svelte")
    assert (script, lang, tags, lines) == ("let a", "ts", ["NavBar", "my-button", "MyButton"], 3)


def test_watch(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def old():\n    pass\n")
    (src / "b.py").write_text("from .a import old\n\n\ndef run():\n    old()\n")
    e = Engine(spark)
    e.index(str(src))
    (src / "a.py").write_text("def new():\n    pass\n")
    (src / "b.py").unlink()
    spark.createDataFrame([("a.py", 0), ("b.py", 0), ("c.py", 100)], "path string, t long").selectExpr("path", "timestamp_seconds(1700000000 + t) as ts").coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema("path string, ts timestamp").parquet(str(tmp_path / "events"))
    q = e.watch(stream, str(tmp_path / "state"), availableNow=True)
    q.awaitTermination(240)
    assert q.exception() is None
    assert {r["id"] for r in e.graph.nodes.collect()} == {"a.py", "a.py#new:1"}
    e.cancel()
    e.clear()
    assert e.graph.size() == 0
