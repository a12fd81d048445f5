"""From files to a graph: extract, resolve, link."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.config import Config
from ..storage import cut
from . import link, resolve
from .extract import Registry, facts_of
from .graph import Graph

#: Facts of one file are fewer than this; with the file's number they make ordinals.
PER_FILE = 1 << 24


@dataclass(frozen=True)
class Indexed:
    """facts: extracted rows. graph: their graph."""

    facts: DataFrame
    graph: Graph


def numbered(files: DataFrame) -> DataFrame:
    """(path, file_no) in order of path: ranges of paths are sorted apart, and each range is offset by the sizes of those before it."""
    spark = files.sparkSession
    ranged = cut(files.select("path").distinct().repartitionByRange(max(1, spark.sparkContext.defaultParallelism), "path").sortWithinPartitions("path").select("path", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "paths")
    starts = ranged.groupBy("part").agg(F.min("at").alias("low"), F.count("*").alias("n")).orderBy("part").collect()  # a row for each range
    before, rows = 0, []
    for r in starts:
        rows.append((r["part"], before - r["low"]))
        before += r["n"]
    shift = spark.createDataFrame(rows, "part int, shift long")
    return ranged.join(F.broadcast(shift), "part").select("path", (F.col("at") + F.col("shift")).alias("file_no"))


def file_kind(path: Column) -> Column:
    return F.when(path.endswith(".vue") | path.endswith(".svelte"), "component").otherwise("file")


def is_script(path: Column) -> Column:
    out = F.lit(False)
    for e in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte"):
        out = out | F.lower(path).endswith(e)
    return out


def assemble(files: DataFrame, facts: DataFrame, config: Config) -> Graph:
    """The graph of all facts. Links need every file's symbols, so this is where facts meet by name."""
    numbers = numbered(files)
    facts = facts.join(numbers.select(F.col("path").alias("file_path"), "file_no"), "file_path").withColumn("seq", (F.col("file_no") + 1) * PER_FILE + F.col("ord") * 4)
    local = lambda c: F.concat("file_path", F.lit("#"), c)
    none = F.lit(None)
    node = lambda df, i, name, kind, line, end, meta, seq: df.select(i.alias("id"), name.alias("name"), kind.alias("kind"), "file_path", line.cast("int").alias("line"), end.cast("int").alias("end_line"), meta.cast("map<string,string>").alias("metadata"), seq.cast("long").alias("seq"))

    symbols = facts.filter("fact = 'symbol'").withColumn("id", local(F.concat("name", F.lit(":"), "line")))
    paths = resolve.resolved(facts.filter("fact in ('import', 'binding')"), files, config)
    imports = facts.filter("fact = 'import'").join(paths, ["file_path", "specifier"])
    bindings = resolve.last_bindings(facts.filter("fact = 'binding'").join(paths.select("file_path", "specifier", F.col("resolved").alias("source_path")), ["file_path", "specifier"]))

    file_nodes = node(numbers.withColumnRenamed("path", "file_path"), F.col("file_path"), F.col("file_path"), file_kind(F.col("file_path")), none, none, none, (F.col("file_no") + 1) * PER_FILE - 1)
    phantoms = imports.filter("is_phantom").groupBy(F.col("resolved").alias("file_path")).agg(F.min("seq").alias("seq"))
    phantom_nodes = node(phantoms, F.col("file_path"), F.col("file_path"), file_kind(F.col("file_path")), none, none, F.create_map(F.lit("phantom"), F.lit("true")), F.col("seq"))
    own = symbols.groupBy("id").agg(F.max(F.struct("ord", "name", "kind", "file_path", "line", "end_line")).alias("x"), F.min("seq").alias("seq")).select("id", "x.*", "seq")
    symbol_nodes = node(own, F.col("id"), F.col("name"), F.col("kind"), F.col("line"), F.col("end_line"), none, F.col("seq"))

    edge = lambda df, k, src, dst, rel: df.select((F.col("seq") + k).alias("edge_id"), src.alias("src"), dst.alias("dst"), rel.alias("relation"))
    in_file = symbols.filter(~is_script(F.col("file_path")) | F.col("parent").isNull())
    edges = edge(in_file, 0, F.col("file_path"), F.col("id"), F.lit("contains"))
    edges = edges.union(edge(symbols.filter("parent is not null"), 1, local("parent"), F.col("id"), F.lit("contains")))
    edges = edges.union(edge(imports, 0, F.col("file_path"), F.col("resolved"), F.lit("imports")))

    names = symbols.select("file_path", "name", "id", "seq").union(facts.filter("fact = 'alias'").select("file_path", "name", local("parent").alias("id"), "seq"))
    calls = facts.filter("fact = 'call'").select("file_path", "seq", local("parent").alias("caller_id"), F.col("target_name").alias("callee_name"), "callee_object")
    edges = edges.union(edge(link.link_calls(calls, names, bindings), 0, F.col("caller_id"), F.col("target_id"), F.lit("calls")))
    pending = facts.filter("fact = 'heritage'").select("file_path", "seq", local("parent").alias("source_id"), "target_name", "relation")
    edges = edges.union(edge(link.link_heritages(pending, names, bindings), 0, F.col("source_id"), F.col("target_id"), F.col("relation")))
    tags = facts.filter("fact = 'tag'").select("file_path", F.col("name").alias("local_name"), "seq").join(bindings.select("file_path", "local_name", "source_path"), ["file_path", "local_name"])
    edges = edges.union(edge(tags, 0, F.col("file_path"), F.col("source_path"), F.lit("calls")))
    return Graph(file_nodes.union(phantom_nodes).union(symbol_nodes), edges)


def index(files: DataFrame, config: Config | None = None, registry: Registry | None = None) -> Indexed:
    """files: path, content. Facts and graph are written once, as many questions follow."""
    facts = cut(facts_of(files, registry), "facts")
    graph = assemble(files.select("path"), facts, config or Config())
    return Indexed(facts, Graph(cut(graph.nodes, "nodes"), cut(graph.edges, "graph-edges")))
