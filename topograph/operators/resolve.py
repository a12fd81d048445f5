"""Module resolution: which file an import means.

Each specifier gives an ordered list of exact paths, an ordered list of path endings, and perhaps a path to fall back on. Both lists are joined with
the files; the first hit wins, exact ones before endings. All files are known, whatever the order in which they are read.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EXTENSIONS
from ..sources.config import Config

FOLDER_FILES = ("__init__.py", "mod.rs")


def variants(path: str, extensions: tuple[str, ...]) -> list[str]:
    """The file itself, an index in the folder of that name, or the name with an extension."""
    inside = [f"{path}/index{extensions[0]}", *(f"{path}/{f}" for f in FOLDER_FILES), *(f"{path}/index{e}" for e in extensions[1:])]
    return [path, *inside, *(path + e for e in extensions)]


def norm(path: str) -> str:
    return posixpath.normpath(path).lstrip("/")


def wanted(path: str, specifier: str, config: Config) -> tuple[list[str], list[tuple[int, str]], list[str], str | None]:
    """Exact paths, endings with their ranks, inner runs of path parts, and the path to fall back on."""
    folder, language = posixpath.dirname(path), posixpath.splitext(path)[1]
    exact: list[str] = []
    if language == ".py":
        rest = specifier.lstrip(".")
        dots = len(specifier) - len(rest)
        base = "/".join([folder, *[".."] * (dots - 1)]) if dots else ""
        target = norm(posixpath.join(base, rest.replace(".", "/"))) if rest or base else norm(folder or ".")
        return variants(target, (".py",)), [], [], target if target.endswith(".py") else f"{target}.py"
    if language == ".java":
        rel = specifier.removesuffix(".*").replace(".", "/")
        return [*variants(f"src/main/java/{rel}", (".java",)), *variants(rel, (".java",))], [(0, f"{rel}.java")], [], f"{rel}.java"
    if language == ".go":
        if config.go_module and (specifier == config.go_module or specifier.startswith(config.go_module)):
            return [], [], [], norm(specifier[len(config.go_module) :].lstrip("/") or ".")
        inner = [specifier]
    else:
        inner = []
    if language == ".rs":
        parts = specifier.removeprefix("crate::").removeprefix("self::").split("::")
        for n in range(len(parts), 0, -1):
            for base in (f"src/{'/'.join(parts[:n])}", "/".join(parts[:n])):
                exact += variants(norm(base), (".rs",))
    fallback = None
    if specifier.startswith(("./", "../")):
        target = norm(posixpath.join(folder, specifier))
        exact += variants(target, EXTENSIONS)
        if target.endswith(EXTENSIONS):
            fallback = target
    for target in config.expand(specifier):
        exact += variants(norm(target), EXTENSIONS)
    endings = [(0, specifier), *((i, specifier + e) for i, e in enumerate(EXTENSIONS))]
    return exact, endings, inner, fallback


def resolved(imports: DataFrame, files: DataFrame, config: Config) -> DataFrame:
    """(file_path, specifier, resolved, is_phantom) of distinct imports (file_path, specifier) that mean a path; phantom if there is no such file. files: path."""
    distinct = imports.select("file_path", "specifier").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, spec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                exact, endings, inner, fallback = wanted(path, spec, config) if spec else ([], [], [], None)
                keys = [(i, "=" + p) for i, p in enumerate(exact)] + [(1_000_000 + i, "<" + p) for i, p in endings] + [(500_000, "~" + p) for p in inner]
                rows.append({"file_path": path, "specifier": spec, "keys": [{"rank": i, "key": k} for i, k in keys], "fallback": fallback})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file_path", pa.string()), ("specifier", pa.string()), ("keys", pa.list_(pa.struct([("rank", pa.int32()), ("key", pa.string())]))), ("fallback", pa.string())]))

    keyed = distinct.mapInArrow(run, "file_path string, specifier string, keys array<struct<rank:int,key:string>>, fallback string")
    parts = F.split("path", "/")
    n = F.size(parts)
    ends = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("<"), F.array_join(F.slice(parts, i, n), "/")))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.concat(F.lit("~"), F.array_join(F.slice(parts, i, k), "/")))))
    go = F.when(F.lower("path").endswith(".go"), runs).otherwise(F.array().cast("array<string>"))
    known = files.select("path", F.explode(F.concat(F.array(F.concat(F.lit("="), "path")), ends, go)).alias("key")).groupBy("key").agg(F.min("path").alias("path"))
    hits = keyed.select("file_path", "specifier", F.explode("keys").alias("k")).select("file_path", "specifier", "k.rank", "k.key").join(known, "key")
    best = hits.groupBy("file_path", "specifier").agg(F.min(F.struct("rank", "path")).alias("x")).select("file_path", "specifier", F.col("x.path").alias("hit"))
    out = keyed.select("file_path", "specifier", "fallback").join(best, ["file_path", "specifier"], "left").withColumn("resolved", F.coalesce("hit", "fallback")).filter("resolved is not null")
    return out.join(files.select(F.col("path").alias("resolved"), F.lit(True).alias("is_file")).distinct(), "resolved", "left").select("file_path", "specifier", "resolved", F.col("is_file").isNull().alias("is_phantom"))


def last_bindings(bindings: DataFrame) -> DataFrame:
    w = Window.partitionBy("file_path", "local_name").orderBy(F.desc("ord"))
    return bindings.withColumn("rank_", F.row_number().over(w)).filter("rank_ = 1").drop("rank_")
