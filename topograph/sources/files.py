"""Sources of files: directory trees, texts, and what version control says has changed."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import content_hash
from ..schema import EXTENSIONS, IGNORED_DIRECTORIES

#: Paths that one reader takes.
READ = 20_000


def wanted_path(path: Column) -> Column:
    """Whether a path, relative to its root, is a source file outside ignored directories and dot-entries."""
    parts = F.split(path, "/")
    ignored = F.exists(parts, lambda p: p.isin(*IGNORED_DIRECTORIES) | p.startswith("."))
    return ~ignored & F.lower(F.concat(F.lit("."), F.element_at(F.split(F.element_at(parts, -1), r"\."), -1))).isin(*EXTENSIONS)


def scan(spark: SparkSession, root: str, scope: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """(path, content, mtime, sha256) of source files below root, paths relative to it; scope is a prefix of paths, only a frame of paths to read.

    The files are listed without their content, and read, decoded and hashed on the executors by tasks of READ files each: of ignored directories, and of files that aren't asked for, nothing is read.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("full"), F.col("modificationTime").alias("mtime"))  # without content the reader opens no file
    listed = listed.withColumn("path", F.substr("full", F.lit(len(base) + 2))).filter(wanted_path(F.col("path")))
    if scope:
        listed = listed.filter(F.col("path").startswith(scope))
    if only is not None:
        listed = listed.join(only.select("path"), "path", "left_semi")
    names = [r["full"] for r in listed.select("full").toLocalIterator()]  # as many names as the driver lists anyway
    if not names:
        return with_hash(spark.createDataFrame([], "path string, content string, mtime timestamp"))
    found = None
    for at in range(0, len(names), READ):
        part = spark.read.format("binaryFile").load([escaped(n) for n in names[at : at + READ]])
        found = part if found is None else found.union(part)
    found = found.withColumn("path", F.substr("path", F.lit(len(base) + 2)))
    return with_hash(found.select("path", F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("mtime")))


def escaped(path: str) -> str:
    """A path that the reader takes for itself and not for a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def from_texts(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    return with_hash(spark.createDataFrame(list(texts.items()), "path string, content string").withColumn("mtime", F.lit(None).cast("timestamp")))


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("sha256", content_hash(F.col("content")))


def changed_paths(root: str, commit: str | None = None) -> list[str]:
    """Paths that differ from a commit, or else from HEAD in the working tree (renames: the new path). An unknown commit, or no repository, gives none."""

    def git(*args: str) -> str:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False)
        return done.stdout if done.returncode == 0 else ""

    if commit is not None:
        if commit.startswith("-"):
            raise ValueError(f"not a commit: {commit}")
        return [x for x in git("diff", "--name-only", "-z", commit, "--").split("\0") if x]
    out, parts = [], iter(git("status", "--porcelain", "-z").split("\0"))
    for x in parts:
        if x:
            out.append(x[3:])
            if x[0] in "RC":
                next(parts, None)
    return sorted(set(out))
