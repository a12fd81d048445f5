"""Queries over a literal source tree: from texts to facts, resolved paths, graphs and answers of the engine. Their SQL states the rows expected, one by one."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import analytics as A
from ..operators import build, cycles, extract, resolve
from ..sources import files as sources
from ..sources.config import Config, without_comments
from ..storage import cut, shared_dir
from ..streaming import incremental, watch
from .catalog import Query, query
from .engine import Engine

TREE = {
    "pkg/util.py": "import os, json as j\n# def hidden():\ndef shout(text):\n    return text.upper()\n",
    "pkg/service.py": "from .util import shout as loud, missing\n\nclass Base(object):\n    pass\n\nclass Greeter(Base, Mixin):\n    async def greet(self, name):\n        self.note(name)\n        return loud(name)\n    def note(self, name):\n        print(name)\n\ndef run():\n    Greeter()\n",
    "db/conn.go": "package db\nimport (\n\t\"fmt\"\n\tlog \"example.org/app/log\"\n)\nfunc Open() {\n\tfmt.Println()\n}\n",
    "models/user.go": "package models\nimport \"app/db\"\ntype User struct {\n}\ntype Store interface {\n}\nfunc (u *User) Save() {\n\tdb.Open()\n}\nfunc (Store) Load() {\n}\n",
    "src/auth.rs": "pub fn check() -> bool { true }\n",
    "src/model.rs": "use crate::auth::check as ok;\nmod auth;\npub struct Point;\npub(crate) trait Shape {\n}\nenum Side { A }\nimpl Shape for Point {\n    fn area(&self) {\n        ok();\n    }\n}\nfn free() {\n    Point::area();\n}\n",
    "com/acme/Util.java": "package com.acme;\npublic class Util {\n    public static String twice(String s) {\n        return s;\n    }\n}\n",
    "com/acme/Service.java": "package com.acme;\nimport com.acme.Util;\nimport java.util.*;\npublic class Service extends Base<String> implements Named {\n    @Override\n    public String run(String s) throws Exception {\n        return Util.twice(s);\n    }\n}\nclass Base extends Object {\n}\ninterface Named extends Any {\n}\nenum Kind { A }\n",
    "web/util.ts": "export function helper(a: number): number {\n  return a + 1;\n}\nexport const twice = (a: number) => helper(helper(a));\nexport type Id = string;\n",
    "web/index.ts": "import { helper as h } from './util';\nimport * as u from './util';\nexport * from './util';\ninterface Shape { area(): number }\nclass Base { x = 1 }\nexport class Box extends Base implements Shape {\n  area(): number {\n    return h(2);\n  }\n  size() { return this.area(); }\n}\nfunction main() {\n  const b = new Box();\n  b.size();\n  u.twice(1);\n}\n",
    "web/Card.vue": "<template>\n  <div><side-bar/><SideBar/><p/></div>\n</template>\n<script setup lang=\"ts\">\nimport SideBar from './SideBar.vue'\nconst load = async () => { await fetch('/api/users/1') }\n</script>\n",
    "web/SideBar.vue": "<template><p>x</p></template>\n<script>\nexport default {}\n</script>\n",
    "web/Panel.svelte": "<script lang='js'>\nimport Card from './Card.vue'\n</script>\n<Card/>\n<style>b{}</style>\n",
    "srv/Api.java": "@RestController\npublic class Api {\n    @GetMapping(\"/api/users/{id}\")\n    public String user() {\n        return \"\";\n    }\n    @RequestMapping(value = \"/api/any\")\n    public String any() {\n        return \"\";\n    }\n}\n",
    "srv/api.py": "@app.post(\"/api/items/\")\ndef add():\n    pass\n@router.delete('/api/items/{item}')\ndef drop():\n    pass\n",
    "srv/main.go": "package main\nfunc Routes() {\n\tr.GET(\"/api/ping\", ping)\n}\n",
    "web/client.ts": "export async function user() {\n  return axios.get('/api/users/:id');\n}\nexport function more() {\n  axios.post(`/api/items`); http.delete('https://h/api/items/3'); fetch('local.txt');\n}\n",
    "loop/a.py": "from .b import x\n", "loop/b.py": "from .c import x\n", "loop/c.py": "from .a import x\nfrom .b import y\n",
}
TSCONFIG = '{ // aliases\n "compilerOptions": {"baseUrl": "web", "paths": {"@/*": ["*"], "~lib": ["util", "other"],}} }'
GO_MOD, CARGO = "module app\n\ngo 1.22\n", '[package]\nname = "crate_of_tests"\n'


def config() -> Config:
    return Config.of(TSCONFIG, GO_MOD, CARGO)


def files(spark: SparkSession) -> DataFrame:
    return sources.from_texts(spark, TREE)


def facts(spark: SparkSession, fact: str, like: str = "%") -> DataFrame:
    return extract.facts_of(files(spark)).filter((F.col("fact") == fact) & F.col("file_path").like(like))


@lru_cache(maxsize=2)
def _engine(spark: SparkSession) -> Engine:
    e = Engine(spark)
    e.index_texts(TREE, config())
    return e


def engine(spark: SparkSession) -> Engine:
    """The tree's index, made once for a session; made anew if its files are gone."""
    try:
        _engine(spark).graph.nodes.limit(1).count()
    except Exception:  # of a folder that was cleared meanwhile
        _engine.cache_clear()
    return _engine(spark)


def rows(columns: str, table: str):
    """SQL of a table of literal rows: columns with their types, and one line for each row, fields set apart by bars; a dash is null, and so is no text."""
    names, types = zip(*(c.split() for c in columns.split(", ")), strict=True)
    lines = [[None if x.strip() == "-" else x.strip() for x in line.split("|")] for line in table.strip().splitlines()]
    value = lambda x, t: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if t == "VARCHAR" else x
    body = ",\n".join("(" + ", ".join(f"CAST({value(x, t)} AS {t})" for x, t in zip(line, types, strict=True)) + ")" for line in lines)
    return query(f"SELECT * FROM (VALUES {body}) AS t({', '.join(names)})")


SYMBOL = "file_path VARCHAR, name VARCHAR, kind VARCHAR, line INTEGER, end_line INTEGER, parent VARCHAR"


def _symbols(like: str) -> Query:
    return lambda spark, sf_dir: facts(spark, "symbol", like).select("file_path", "name", "kind", "line", "end_line", "parent")


def _named(name: str, f: Query) -> Query:
    f.__name__ = name
    return f


#: Name, columns and frame of each query; EXPECTED has the rows.
QUESTIONS: dict[str, tuple[str, Query]] = {
    "source_symbols_python": (SYMBOL, _symbols("%.py")),
    "source_symbols_go": (SYMBOL, _symbols("%.go")),
    "source_symbols_rust": (SYMBOL, _symbols("%.rs")),
    "source_symbols_java": (SYMBOL, _symbols("%.java")),
    "source_symbols_script": (SYMBOL, _symbols("web/%")),
    "source_bindings": ("file_path VARCHAR, specifier VARCHAR, imported_name VARCHAR, local_name VARCHAR, is_namespace BOOLEAN", lambda spark, d: facts(spark, "binding").select("file_path", "specifier", "imported_name", "local_name", "is_namespace")),
    "source_heritages": ("file_path VARCHAR, name VARCHAR, target_name VARCHAR, relation VARCHAR", lambda spark, d: facts(spark, "heritage").select("file_path", "name", "target_name", "relation")),
    "source_calls": ("file_path VARCHAR, caller VARCHAR, target_name VARCHAR, callee_object VARCHAR", lambda spark, d: facts(spark, "call").select("file_path", F.col("parent").alias("caller"), "target_name", "callee_object")),
    "source_component_tags": ("file_path VARCHAR, name VARCHAR", lambda spark, d: facts(spark, "tag").select("file_path", "name")),
    "source_client_calls": ("file_path VARCHAR, line INTEGER, method VARCHAR, url VARCHAR, norm_url VARCHAR", lambda spark, d: extract.client_calls(files(spark)).select("file_path", "line", "method", "url", "norm_url")),
    "source_server_endpoints": ("file_path VARCHAR, line INTEGER, method VARCHAR, url VARCHAR, norm_url VARCHAR", lambda spark, d: extract.server_endpoints(files(spark)).select("file_path", "line", "method", "url", "norm_url")),
    "source_resolution": ("file_path VARCHAR, specifier VARCHAR, resolved VARCHAR, is_phantom BOOLEAN", lambda spark, d: resolve.resolved(facts(spark, "import").unionByName(_aliased(spark), allowMissingColumns=True), files(spark).select("path"), config())),
    "source_graph_nodes": ("id VARCHAR, name VARCHAR, kind VARCHAR, file_path VARCHAR, line INTEGER", lambda spark, d: engine(spark).graph.nodes.select("id", "name", "kind", "file_path", F.coalesce("line", F.lit(0)).alias("line"))),
    "source_graph_edges": ("src VARCHAR, relation VARCHAR, dst VARCHAR, n BIGINT", lambda spark, d: engine(spark).graph.edges.groupBy("src", "relation", "dst").agg(F.count("*").alias("n"))),
    "source_node_order": ("place INTEGER, id VARCHAR", lambda spark, d: engine(spark).graph.nodes.filter("kind in ('file', 'component') and metadata is null").select(F.row_number().over(Window.orderBy("seq")).alias("place"), "id")),
    "source_project_files": ("item VARCHAR, value VARCHAR", lambda spark, d: spark.createDataFrame([*((f"alias {x}", ",".join(config().expand(x))) for x in ("@/a/b", "~lib", "other")), ("go", config().go_module), ("rust", config().rust_crate), ("base", config().base), ("json", without_comments('{"a": "//", /* b */ "c": [1,]}'))], "item string, value string")),
    "directory_scan": ("path VARCHAR, sha256 VARCHAR", lambda spark, d: sources.scan(spark, _written(spark)).select("path", "sha256")),
    "index_refresh": ("run INTEGER, total BIGINT, cached BIGINT, indexed BIGINT, deleted BIGINT", lambda spark, d: _refreshes(spark)),
    "reload_one_file": ("id VARCHAR", lambda spark, d: _reloaded(spark)),
    "snapshot_roundtrip": ("src VARCHAR, relation VARCHAR, dst VARCHAR", lambda spark, d: _restored(spark)),
    "engine_dependencies": ("id VARCHAR, depth INTEGER", lambda spark, d: engine(spark).query("dependencies", "web/index.ts", depth=1).nodes.select("id", "depth")),
    "engine_call_graph": ("src VARCHAR, relation VARCHAR, dst VARCHAR", lambda spark, d: engine(spark).query("call_graph", "main", depth=1).edges.select("src", "relation", "dst")),
    "engine_impact": ("id VARCHAR, tier INTEGER", lambda spark, d: engine(spark).query("impact", "web/util.ts#helper:1").payload["tiers"].select("id", "tier")),
    "engine_path": ("step INTEGER, src VARCHAR, dst VARCHAR, relation VARCHAR", lambda spark, d: engine(spark).query("path", "main", "web/util.ts#helper:1").payload["steps"].select(F.col("step").cast("int").alias("step"), "src", "dst", "relation")),
    "engine_circular": ("place INTEGER, cycle VARCHAR, length INTEGER", lambda spark, d: engine(spark).query("circular").payload["cycles"].select(F.row_number().over(Window.orderBy("length", "ord")).alias("place"), F.array_join("cycle", ">").alias("cycle"), "length")),
    "engine_metrics": ("total_files BIGINT, total_symbols BIGINT, total_edges BIGINT, average_instability_milli BIGINT", lambda spark, d: engine(spark).query("metrics").payload["totals"]),
    "engine_unused": ("reason VARCHAR, id VARCHAR", lambda spark, d: engine(spark).query("unused").payload["dead"].select("reason", "id")),
    "engine_lint": ("src VARCHAR, dst VARCHAR, rule_from VARCHAR, rule_to VARCHAR", lambda spark, d: engine(spark).query("lint", rules='[{"from": "web/**", "to": "web/util"}, {"from": "x"}, 3]').payload["violations"].select("src", "dst", "rule_from", "rule_to")),
    "engine_slice": ("id VARCHAR, depth INTEGER", lambda spark, d: engine(spark).query("slice", "models/user.go", depth=1).nodes.select("id", "depth")),
    "engine_diff_impact": ("part VARCHAR, file_path VARCHAR", lambda spark, d: _diff(spark)),
    "engine_contracts": ("client_id VARCHAR, server_id VARCHAR", lambda spark, d: engine(spark).query("api_contracts").payload["matched"].select("client_id", "server_id")),
    "engine_scope": ("id VARCHAR", lambda spark, d: engine(spark).within("./com").graph.nodes.select("id")),
    "rules_json": ("ord INTEGER, rule_from VARCHAR, rule_to VARCHAR, description VARCHAR", lambda spark, d: spark.createDataFrame(A.parsed_rules('[{"from": "a", "to": "b", "description": "no"}, {"to": "x"}, 7, {"from": "c/**", "to": "d"}]'), "ord int, rule_from string, rule_to string, description string")),
    "mermaid_labels": ("label VARCHAR, shown VARCHAR", lambda spark, d: spark.createDataFrame([(x, C.mermaid_label(x)) for x in LABELS], "label string, shown string")),
    "cycle_rotation": ("cycle VARCHAR", lambda spark, d: cycles.rotated(spark.createDataFrame([(["c", "a", "b"],), (["b", "a"],), (["x"],)], "cycle array<string>")).select(F.array_join("cycle", ">").alias("cycle"))),
    "watched_paths": ("path VARCHAR", lambda spark, d: watch.watched(spark.createDataFrame([(p,) for p in WATCHED], "path string")).select("path")),
}
LABELS = ('say "hi"', "a[b]{c}", "<T>(x)", "plain")
WATCHED = ("src/a.ts", "src\\b.PY", "node_modules/x.js", ".git/c.py", "./d.rs", "a/tsconfig.json", "notes.txt", "lib/e.go", "library/f.go")


def _aliased(spark: SparkSession) -> DataFrame:
    more = [("web/index.ts", "@/client"), ("web/index.ts", "~lib"), ("web/index.ts", "react"), ("web/index.ts", "./none"), ("web/index.ts", "../srv/none.js"), ("models/user.go", "app/models"), ("pkg/service.py", "pkg.util")]
    return spark.createDataFrame(more, "file_path string, specifier string")


def _written(spark: SparkSession) -> str:
    """A folder with a few files, some of them not to be indexed, written by way of the shared file system."""
    jvm, root = spark._jvm, f"{shared_dir(spark)}/tree"
    for path in ("a.py", "src/b.ts", "src/deep/c.GO", "node_modules/d.js", ".git/e.py", "src/.f.py", "notes.txt", "library/g.rs", "build/h.java"):
        to = jvm.org.apache.hadoop.fs.Path(f"{root}/{path}")
        out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, True)
        out.write(bytearray(f"// {path}\n".encode()))
        out.close()
    return root


def _refreshes(spark: SparkSession) -> DataFrame:
    """Three runs over a tree: all new, nothing changed, and one file each added, changed and deleted."""
    own, tree, done = Engine(spark), {k: TREE[k] for k in ("pkg/util.py", "pkg/service.py", "web/util.ts")}, []
    done.append(own.index_texts(tree))
    done.append(own.index_texts(tree))
    tree |= {"pkg/util.py": TREE["pkg/util.py"] + "x = 1\n", "web/index.ts": TREE["web/index.ts"]}
    del tree["web/util.ts"]
    done.append(own.index_texts(tree))
    return spark.createDataFrame([(i, *(d[k] for k in ("total", "cached", "indexed", "deleted"))) for i, d in enumerate(done, 1)], "run int, total long, cached long, indexed long, deleted long")


def _reloaded(spark: SparkSession) -> DataFrame:
    own = Engine(spark)
    own.index_texts({k: TREE[k] for k in ("pkg/util.py", "pkg/service.py")})
    own.reload(sources.from_texts(spark, {"pkg/util.py": "def whisper():\n    pass\n"}))
    return own.graph.nodes.filter("file_path = 'pkg/util.py'").select("id")


def _restored(spark: SparkSession) -> DataFrame:
    own, path = Engine(spark), f"{shared_dir(spark)}/snapshot-of-tree"
    own.index_texts({k: v for k, v in TREE.items() if k.startswith("models/") or k.startswith("db/")}, config())
    own.save(path)
    again = Engine(spark)
    again.config = config()
    assert again.load(path)
    return again.graph.edges.select("src", "relation", "dst")


def _diff(spark: SparkSession) -> DataFrame:
    parts = engine(spark).query("diff_impact", changed=["web/util.ts"]).payload
    return parts["changed_files"].select(F.lit("changed").alias("part"), "file_path").union(parts["upstream_files"].select(F.lit("upstream"), "file_path")).union(parts["breaking_callers"].select(F.lit("caller"), "id"))


# Expected rows, by query.
EXPECTED = r"""
@ source_symbols_python
pkg/service.py | Base | class | 3 | 3 | -
pkg/service.py | Greeter | class | 6 | 6 | -
pkg/service.py | Greeter.greet | function | 7 | 7 | Greeter:6
pkg/service.py | Greeter.note | function | 10 | 10 | Greeter:6
pkg/service.py | run | function | 13 | 13 | -
pkg/util.py | shout | function | 3 | 3 | -
srv/api.py | add | function | 2 | 2 | -
srv/api.py | drop | function | 5 | 5 | -
@ source_symbols_go
db/conn.go | Open | function | 6 | 6 | -
models/user.go | Store | interface | 5 | 5 | -
models/user.go | Store.Load | function | 10 | 10 | Store:5
models/user.go | User | class | 3 | 3 | -
models/user.go | User.Save | function | 7 | 7 | User:3
srv/main.go | Routes | function | 2 | 2 | -
@ source_symbols_rust
src/auth.rs | check | function | 1 | 1 | -
src/model.rs | Point | class | 3 | 3 | -
src/model.rs | Point.area | function | 8 | 8 | Point:3
src/model.rs | Shape | interface | 4 | 4 | -
src/model.rs | Side | class | 6 | 6 | -
src/model.rs | free | function | 12 | 12 | -
@ source_symbols_java
com/acme/Service.java | Base | class | 10 | 10 | -
com/acme/Service.java | Kind | class | 14 | 14 | -
com/acme/Service.java | Named | interface | 12 | 12 | -
com/acme/Service.java | Service | class | 4 | 4 | -
com/acme/Service.java | Service.run | function | 6 | 6 | Service:4
com/acme/Util.java | Util | class | 2 | 2 | -
com/acme/Util.java | Util.twice | function | 3 | 3 | Util:2
srv/Api.java | Api | class | 2 | 2 | -
srv/Api.java | Api.any | function | 8 | 8 | Api:2
srv/Api.java | Api.user | function | 4 | 4 | Api:2
@ source_symbols_script
web/Card.vue | load | function | 3 | 3 | -
web/client.ts | more | function | 4 | 6 | -
web/client.ts | user | function | 1 | 3 | -
web/index.ts | Base | class | 5 | 5 | -
web/index.ts | Box | class | 6 | 11 | -
web/index.ts | Box.area | function | 7 | 9 | Box:6
web/index.ts | Box.size | function | 10 | 10 | Box:6
web/index.ts | Shape | interface | 4 | 4 | -
web/index.ts | b | variable | 13 | 13 | -
web/index.ts | main | function | 12 | 16 | -
web/util.ts | Id | type | 5 | 5 | -
web/util.ts | helper | function | 1 | 3 | -
web/util.ts | twice | function | 4 | 4 | -
@ source_bindings
com/acme/Service.java | com.acme.Util | Util | Util | false
com/acme/Service.java | java.util.* | * | util | true
db/conn.go | example.org/app/log | * | log | true
db/conn.go | fmt | * | fmt | true
loop/a.py | .b | x | x | false
loop/b.py | .c | x | x | false
loop/c.py | .a | x | x | false
loop/c.py | .b | y | y | false
models/user.go | app/db | * | db | true
pkg/service.py | .util | missing | missing | false
pkg/service.py | .util | shout | loud | false
pkg/util.py | json | * | j | true
pkg/util.py | os | * | os | true
src/model.rs | auth | * | auth | true
src/model.rs | crate::auth::check | check | ok | false
web/Card.vue | ./SideBar.vue | default | SideBar | false
web/Panel.svelte | ./Card.vue | default | Card | false
web/index.ts | ./util | * | u | true
web/index.ts | ./util | helper | h | false
@ source_heritages
com/acme/Service.java | Named | Any | extends
com/acme/Service.java | Service | Base | extends
com/acme/Service.java | Service | Named | implements
pkg/service.py | Greeter | Base | extends
pkg/service.py | Greeter | Mixin | extends
src/model.rs | Point | Shape | implements
web/index.ts | Box:6 | Base | extends
web/index.ts | Box:6 | Shape | implements
@ source_calls
com/acme/Service.java | Service.run:6 | twice | Util
db/conn.go | Open:6 | Println | fmt
models/user.go | User.Save:7 | Open | db
pkg/service.py | Greeter.greet:7 | loud | -
pkg/service.py | Greeter.greet:7 | note | Greeter
pkg/service.py | Greeter.note:10 | print | -
pkg/service.py | run:13 | Greeter | -
pkg/util.py | shout:3 | upper | text
src/model.rs | Point.area:8 | ok | -
src/model.rs | free:12 | area | Point
srv/Api.java | Api.user:4 | RequestMapping | -
srv/main.go | Routes:2 | GET | r
web/Card.vue | load:3 | fetch | -
web/client.ts | more:4 | fetch | -
web/client.ts | more:4 | post | axios
web/client.ts | user:1 | get | axios
web/index.ts | Box.area:7 | h | -
web/index.ts | Box.size:10 | area | -
web/index.ts | main:12 | size | b
web/index.ts | main:12 | twice | u
web/util.ts | twice:4 | helper | -
web/util.ts | twice:4 | helper | -
@ source_component_tags
web/Card.vue | SideBar
web/Card.vue | side-bar
web/Panel.svelte | Card
@ source_client_calls
web/Card.vue | 6 | GET | /api/users/1 | /api/users/1
web/client.ts | 2 | GET | /api/users/:id | /api/users/*
web/client.ts | 5 | POST | /api/items | /api/items
@ source_server_endpoints
srv/Api.java | 3 | GET | /api/users/{id} | /api/users/*
srv/Api.java | 7 | ALL | /api/any | /api/any
srv/api.py | 1 | POST | /api/items/ | /api/items
srv/api.py | 4 | DELETE | /api/items/{item} | /api/items/*
srv/main.go | 3 | GET | /api/ping | /api/ping
@ source_resolution
com/acme/Service.java | com.acme.Util | com/acme/Util.java | false
com/acme/Service.java | java.util.* | java/util.java | true
loop/a.py | .b | loop/b.py | false
loop/b.py | .c | loop/c.py | false
loop/c.py | .a | loop/a.py | false
loop/c.py | .b | loop/b.py | false
models/user.go | app/db | db | true
models/user.go | app/models | models | true
pkg/service.py | .util | pkg/util.py | false
pkg/service.py | pkg.util | pkg/util.py | false
pkg/util.py | json | json.py | true
pkg/util.py | os | os.py | true
src/model.rs | auth | src/auth.rs | false
src/model.rs | crate::auth::check | src/auth.rs | false
web/Card.vue | ./SideBar.vue | web/SideBar.vue | false
web/Panel.svelte | ./Card.vue | web/Card.vue | false
web/index.ts | ../srv/none.js | srv/none.js | true
web/index.ts | ./util | web/util.ts | false
web/index.ts | @/client | web/client.ts | false
web/index.ts | ~lib | web/util.ts | false
@ source_graph_nodes
com/acme/Service.java | com/acme/Service.java | file | com/acme/Service.java | 0
com/acme/Service.java#Base:10 | Base | class | com/acme/Service.java | 10
com/acme/Service.java#Kind:14 | Kind | class | com/acme/Service.java | 14
com/acme/Service.java#Named:12 | Named | interface | com/acme/Service.java | 12
com/acme/Service.java#Service.run:6 | Service.run | function | com/acme/Service.java | 6
com/acme/Service.java#Service:4 | Service | class | com/acme/Service.java | 4
com/acme/Util.java | com/acme/Util.java | file | com/acme/Util.java | 0
com/acme/Util.java#Util.twice:3 | Util.twice | function | com/acme/Util.java | 3
com/acme/Util.java#Util:2 | Util | class | com/acme/Util.java | 2
db | db | file | db | 0
db/conn.go | db/conn.go | file | db/conn.go | 0
db/conn.go#Open:6 | Open | function | db/conn.go | 6
java/util.java | java/util.java | file | java/util.java | 0
json.py | json.py | file | json.py | 0
loop/a.py | loop/a.py | file | loop/a.py | 0
loop/b.py | loop/b.py | file | loop/b.py | 0
loop/c.py | loop/c.py | file | loop/c.py | 0
models/user.go | models/user.go | file | models/user.go | 0
models/user.go#Store.Load:10 | Store.Load | function | models/user.go | 10
models/user.go#Store:5 | Store | interface | models/user.go | 5
models/user.go#User.Save:7 | User.Save | function | models/user.go | 7
models/user.go#User:3 | User | class | models/user.go | 3
os.py | os.py | file | os.py | 0
pkg/service.py | pkg/service.py | file | pkg/service.py | 0
pkg/service.py#Base:3 | Base | class | pkg/service.py | 3
pkg/service.py#Greeter.greet:7 | Greeter.greet | function | pkg/service.py | 7
pkg/service.py#Greeter.note:10 | Greeter.note | function | pkg/service.py | 10
pkg/service.py#Greeter:6 | Greeter | class | pkg/service.py | 6
pkg/service.py#run:13 | run | function | pkg/service.py | 13
pkg/util.py | pkg/util.py | file | pkg/util.py | 0
pkg/util.py#shout:3 | shout | function | pkg/util.py | 3
src/auth.rs | src/auth.rs | file | src/auth.rs | 0
src/auth.rs#check:1 | check | function | src/auth.rs | 1
src/model.rs | src/model.rs | file | src/model.rs | 0
src/model.rs#Point.area:8 | Point.area | function | src/model.rs | 8
src/model.rs#Point:3 | Point | class | src/model.rs | 3
src/model.rs#Shape:4 | Shape | interface | src/model.rs | 4
src/model.rs#Side:6 | Side | class | src/model.rs | 6
src/model.rs#free:12 | free | function | src/model.rs | 12
srv/Api.java | srv/Api.java | file | srv/Api.java | 0
srv/Api.java#Api.any:8 | Api.any | function | srv/Api.java | 8
srv/Api.java#Api.user:4 | Api.user | function | srv/Api.java | 4
srv/Api.java#Api:2 | Api | class | srv/Api.java | 2
srv/api.py | srv/api.py | file | srv/api.py | 0
srv/api.py#add:2 | add | function | srv/api.py | 2
srv/api.py#drop:5 | drop | function | srv/api.py | 5
srv/main.go | srv/main.go | file | srv/main.go | 0
srv/main.go#Routes:2 | Routes | function | srv/main.go | 2
web/Card.vue | web/Card.vue | component | web/Card.vue | 0
web/Card.vue#load:3 | load | function | web/Card.vue | 3
web/Panel.svelte | web/Panel.svelte | component | web/Panel.svelte | 0
web/SideBar.vue | web/SideBar.vue | component | web/SideBar.vue | 0
web/client.ts | web/client.ts | file | web/client.ts | 0
web/client.ts#more:4 | more | function | web/client.ts | 4
web/client.ts#user:1 | user | function | web/client.ts | 1
web/index.ts | web/index.ts | file | web/index.ts | 0
web/index.ts#Base:5 | Base | class | web/index.ts | 5
web/index.ts#Box.area:7 | Box.area | function | web/index.ts | 7
web/index.ts#Box.size:10 | Box.size | function | web/index.ts | 10
web/index.ts#Box:6 | Box | class | web/index.ts | 6
web/index.ts#Shape:4 | Shape | interface | web/index.ts | 4
web/index.ts#b:13 | b | variable | web/index.ts | 13
web/index.ts#main:12 | main | function | web/index.ts | 12
web/util.ts | web/util.ts | file | web/util.ts | 0
web/util.ts#Id:5 | Id | type | web/util.ts | 5
web/util.ts#helper:1 | helper | function | web/util.ts | 1
web/util.ts#twice:4 | twice | function | web/util.ts | 4
@ source_graph_edges
com/acme/Service.java | contains | com/acme/Service.java#Base:10 | 1
com/acme/Service.java | contains | com/acme/Service.java#Kind:14 | 1
com/acme/Service.java | contains | com/acme/Service.java#Named:12 | 1
com/acme/Service.java | contains | com/acme/Service.java#Service.run:6 | 1
com/acme/Service.java | contains | com/acme/Service.java#Service:4 | 1
com/acme/Service.java | imports | com/acme/Util.java | 1
com/acme/Service.java | imports | java/util.java | 1
com/acme/Service.java#Service.run:6 | calls | com/acme/Util.java#Util.twice:3 | 1
com/acme/Service.java#Service:4 | contains | com/acme/Service.java#Service.run:6 | 1
com/acme/Service.java#Service:4 | extends | com/acme/Service.java#Base:10 | 1
com/acme/Service.java#Service:4 | implements | com/acme/Service.java#Named:12 | 1
com/acme/Util.java | contains | com/acme/Util.java#Util.twice:3 | 1
com/acme/Util.java | contains | com/acme/Util.java#Util:2 | 1
com/acme/Util.java#Util:2 | contains | com/acme/Util.java#Util.twice:3 | 1
db/conn.go | contains | db/conn.go#Open:6 | 1
loop/a.py | imports | loop/b.py | 1
loop/b.py | imports | loop/c.py | 1
loop/c.py | imports | loop/a.py | 1
loop/c.py | imports | loop/b.py | 1
models/user.go | contains | models/user.go#Store.Load:10 | 1
models/user.go | contains | models/user.go#Store:5 | 1
models/user.go | contains | models/user.go#User.Save:7 | 1
models/user.go | contains | models/user.go#User:3 | 1
models/user.go | imports | db | 1
models/user.go#Store:5 | contains | models/user.go#Store.Load:10 | 1
models/user.go#User.Save:7 | calls | db/conn.go#Open:6 | 1
models/user.go#User:3 | contains | models/user.go#User.Save:7 | 1
pkg/service.py | contains | pkg/service.py#Base:3 | 1
pkg/service.py | contains | pkg/service.py#Greeter.greet:7 | 1
pkg/service.py | contains | pkg/service.py#Greeter.note:10 | 1
pkg/service.py | contains | pkg/service.py#Greeter:6 | 1
pkg/service.py | contains | pkg/service.py#run:13 | 1
pkg/service.py | imports | pkg/util.py | 2
pkg/service.py#Greeter.greet:7 | calls | pkg/service.py#Greeter.note:10 | 1
pkg/service.py#Greeter.greet:7 | calls | pkg/util.py#shout:3 | 1
pkg/service.py#Greeter:6 | contains | pkg/service.py#Greeter.greet:7 | 1
pkg/service.py#Greeter:6 | contains | pkg/service.py#Greeter.note:10 | 1
pkg/service.py#Greeter:6 | extends | pkg/service.py#Base:3 | 1
pkg/service.py#run:13 | calls | pkg/service.py#Greeter:6 | 1
pkg/util.py | contains | pkg/util.py#shout:3 | 1
pkg/util.py | imports | json.py | 1
pkg/util.py | imports | os.py | 1
src/auth.rs | contains | src/auth.rs#check:1 | 1
src/model.rs | contains | src/model.rs#Point.area:8 | 1
src/model.rs | contains | src/model.rs#Point:3 | 1
src/model.rs | contains | src/model.rs#Shape:4 | 1
src/model.rs | contains | src/model.rs#Side:6 | 1
src/model.rs | contains | src/model.rs#free:12 | 1
src/model.rs | imports | src/auth.rs | 2
src/model.rs#Point.area:8 | calls | src/auth.rs#check:1 | 1
src/model.rs#Point:3 | contains | src/model.rs#Point.area:8 | 1
src/model.rs#Point:3 | implements | src/model.rs#Shape:4 | 1
src/model.rs#free:12 | calls | src/model.rs#Point.area:8 | 1
srv/Api.java | contains | srv/Api.java#Api.any:8 | 1
srv/Api.java | contains | srv/Api.java#Api.user:4 | 1
srv/Api.java | contains | srv/Api.java#Api:2 | 1
srv/Api.java#Api:2 | contains | srv/Api.java#Api.any:8 | 1
srv/Api.java#Api:2 | contains | srv/Api.java#Api.user:4 | 1
srv/api.py | contains | srv/api.py#add:2 | 1
srv/api.py | contains | srv/api.py#drop:5 | 1
srv/main.go | contains | srv/main.go#Routes:2 | 1
web/Card.vue | calls | web/SideBar.vue | 1
web/Card.vue | contains | web/Card.vue#load:3 | 1
web/Card.vue | imports | web/SideBar.vue | 1
web/Panel.svelte | calls | web/Card.vue | 1
web/Panel.svelte | imports | web/Card.vue | 1
web/client.ts | contains | web/client.ts#more:4 | 1
web/client.ts | contains | web/client.ts#user:1 | 1
web/index.ts | contains | web/index.ts#Base:5 | 1
web/index.ts | contains | web/index.ts#Box:6 | 1
web/index.ts | contains | web/index.ts#Shape:4 | 1
web/index.ts | contains | web/index.ts#b:13 | 1
web/index.ts | contains | web/index.ts#main:12 | 1
web/index.ts | imports | web/util.ts | 3
web/index.ts#Box.area:7 | calls | web/util.ts#helper:1 | 1
web/index.ts#Box.size:10 | calls | web/index.ts#Box.area:7 | 1
web/index.ts#Box:6 | contains | web/index.ts#Box.area:7 | 1
web/index.ts#Box:6 | contains | web/index.ts#Box.size:10 | 1
web/index.ts#Box:6 | extends | web/index.ts#Base:5 | 1
web/index.ts#Box:6 | implements | web/index.ts#Shape:4 | 1
web/index.ts#main:12 | calls | web/index.ts#Box.size:10 | 1
web/index.ts#main:12 | calls | web/util.ts#twice:4 | 1
web/util.ts | contains | web/util.ts#Id:5 | 1
web/util.ts | contains | web/util.ts#helper:1 | 1
web/util.ts | contains | web/util.ts#twice:4 | 1
web/util.ts#twice:4 | calls | web/util.ts#helper:1 | 2
@ source_node_order
1 | com/acme/Service.java
2 | com/acme/Util.java
3 | db/conn.go
4 | loop/a.py
5 | loop/b.py
6 | loop/c.py
7 | models/user.go
8 | pkg/service.py
9 | pkg/util.py
10 | src/auth.rs
11 | src/model.rs
12 | srv/Api.java
13 | srv/api.py
14 | srv/main.go
15 | web/Card.vue
16 | web/Panel.svelte
17 | web/SideBar.vue
18 | web/client.ts
19 | web/index.ts
20 | web/util.ts
@ source_project_files
alias @/a/b | web/a/b
alias other |
alias ~lib | web/util,web/other
base | web
go | app
json | {"a": "//",  "c": [1]}
rust | crate_of_tests
@ directory_scan
a.py | 9ee959f53189504c360f26608f025f3a9432f75e328cc57cf8396068e60081d8
library/g.rs | 37990af58850e89971efb37611cb2f3fb7cf170e7106aa50e16ddd778b3542bd
src/b.ts | 9df34a336ea8671b11197c58eec6a8f15dea28ec4dfe6dda31953c600affbc99
src/deep/c.GO | 59e1a24a4264db95a6c5f530bac2112cade9f2ad5f297d00de4d39d3033efa01
@ index_refresh
1 | 3 | 0 | 3 | 0
2 | 3 | 3 | 0 | 0
3 | 3 | 1 | 2 | 1
@ reload_one_file
pkg/util.py
pkg/util.py#whisper:1
@ snapshot_roundtrip
db/conn.go | contains | db/conn.go#Open:6
models/user.go | contains | models/user.go#Store.Load:10
models/user.go | contains | models/user.go#Store:5
models/user.go | contains | models/user.go#User.Save:7
models/user.go | contains | models/user.go#User:3
models/user.go | imports | db
models/user.go#Store:5 | contains | models/user.go#Store.Load:10
models/user.go#User.Save:7 | calls | db/conn.go#Open:6
models/user.go#User:3 | contains | models/user.go#User.Save:7
@ engine_dependencies
web/index.ts | 0
web/index.ts#Base:5 | 0
web/index.ts#Box.area:7 | 0
web/index.ts#Box.size:10 | 0
web/index.ts#Box:6 | 0
web/index.ts#Shape:4 | 0
web/index.ts#b:13 | 0
web/index.ts#main:12 | 0
web/util.ts | 1
web/util.ts#helper:1 | 1
web/util.ts#twice:4 | 1
@ engine_call_graph
web/index.ts | contains | web/index.ts#main:12
web/index.ts#main:12 | calls | web/index.ts#Box.size:10
web/index.ts#main:12 | calls | web/util.ts#twice:4
@ engine_impact
web/index.ts | 2
web/index.ts#Box.area:7 | 0
web/index.ts#Box.size:10 | 2
web/index.ts#Box:6 | 2
web/index.ts#main:12 | 2
web/util.ts | 2
web/util.ts#twice:4 | 1
@ engine_path
1 | web/index.ts#main:12 | web/util.ts#twice:4 | calls
2 | web/util.ts#twice:4 | web/util.ts#helper:1 | calls
@ engine_circular
1 | loop/b.py>loop/c.py>loop/b.py | 2
2 | loop/a.py>loop/b.py>loop/c.py>loop/a.py | 3
@ engine_metrics
24 | 43 | 91 | 361
@ engine_unused
orphan | com/acme/Service.java
orphan | db/conn.go
orphan | models/user.go
orphan | pkg/service.py
orphan | src/model.rs
orphan | srv/Api.java
orphan | srv/api.py
orphan | web/Panel.svelte
orphan | web/client.ts
unused | com/acme/Service.java#Kind:14
unused | com/acme/Service.java#Service.run:6
unused | com/acme/Service.java#Service:4
unused | com/acme/Util.java#Util:2
unused | models/user.go#Store.Load:10
unused | models/user.go#Store:5
unused | models/user.go#User.Save:7
unused | models/user.go#User:3
unused | pkg/service.py#Greeter.greet:7
unused | pkg/service.py#run:13
unused | src/model.rs#Point:3
unused | src/model.rs#Side:6
unused | src/model.rs#free:12
unused | srv/Api.java#Api.any:8
unused | srv/Api.java#Api.user:4
unused | srv/Api.java#Api:2
unused | srv/api.py#add:2
unused | srv/api.py#drop:5
unused | web/Card.vue#load:3
unused | web/client.ts#more:4
unused | web/client.ts#user:1
@ engine_lint
web/index.ts | web/util.ts | web/** | web/util
web/index.ts | web/util.ts | web/** | web/util
web/index.ts | web/util.ts | web/** | web/util
web/index.ts#Box.area:7 | web/util.ts#helper:1 | web/** | web/util
web/index.ts#main:12 | web/util.ts#twice:4 | web/** | web/util
@ engine_slice
db | 1
db/conn.go#Open:6 | 1
models/user.go | 0
models/user.go#Store.Load:10 | 0
models/user.go#Store:5 | 0
models/user.go#User.Save:7 | 0
models/user.go#User:3 | 0
@ engine_diff_impact
caller | web/index.ts#Box.area:7
caller | web/index.ts#Box.size:10
caller | web/index.ts#main:12
changed | web/util.ts
upstream | web/index.ts
@ engine_contracts
web/client.ts#api_call:2 | srv/Api.java#route_handler:3
web/client.ts#api_call:5 | srv/api.py#route_handler:1
@ engine_scope
com/acme/Service.java
com/acme/Service.java#Base:10
com/acme/Service.java#Kind:14
com/acme/Service.java#Named:12
com/acme/Service.java#Service.run:6
com/acme/Service.java#Service:4
com/acme/Util.java
com/acme/Util.java#Util.twice:3
com/acme/Util.java#Util:2
java/util.java
@ rules_json
0 | a | b | no
1 | c/** | d | -
@ mermaid_labels
<T>(x) | T(x)
a[b]{c} | a[b]{c}
plain | plain
say "hi" | say 'hi'
@ cycle_rotation
a>b
a>b>c
x
@ watched_paths
./d.rs
a/tsconfig.json
library/f.go
src/a.ts
src\b.PY
"""

for _block in EXPECTED.strip().split("@ ")[1:]:
    _name, _, _table = _block.partition("\n")
    rows(QUESTIONS[_name][0], _table)(_named(_name, QUESTIONS[_name][1]))
