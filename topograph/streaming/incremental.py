"""Incremental indexing: what changed between two states of a file set, and snapshots of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT_VERSION = "1.0.0"


def delta(now: DataFrame, known: DataFrame) -> DataFrame:
    """(path, status, sha256, mtime) over the union of paths: added, modified, deleted or unchanged.

    Equal times mean unchanged; else the hash decides, and an unchanged file gets its new time. Both frames have path, sha256 and mtime.
    """
    n = now.select("path", F.col("sha256").alias("n_hash"), F.col("mtime").alias("n_time"), F.lit(1).alias("n"))
    k = known.select("path", F.col("sha256").alias("k_hash"), F.col("mtime").alias("k_time"), F.lit(1).alias("k"))
    same = (F.col("n_time") == F.col("k_time")) | (F.col("n_hash") == F.col("k_hash"))
    status = F.when(F.col("k").isNull(), "added").when(F.col("n").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return n.join(k, "path", "full_outer").select("path", status.alias("status"), F.coalesce("n_hash", "k_hash").alias("sha256"), F.coalesce("n_time", "k_time").alias("mtime"))


def stats(changes: DataFrame) -> DataFrame:
    """One row: total, cached, indexed, deleted."""
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    return changes.agg(n("added", "modified", "unchanged").alias("total"), n("unchanged").alias("cached"), n("added", "modified").alias("indexed"), n("deleted").alias("deleted"))


def refreshed(cached: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """Cached rows of unchanged files and fresh rows of the others; both have a column file_path."""
    kept = changes.filter("status = 'unchanged'").select(F.col("path").alias("file_path"))
    new = changes.filter("status in ('added', 'modified')").select(F.col("path").alias("file_path"))
    return cached.join(kept, "file_path", "left_semi").unionByName(fresh.join(new, "file_path", "left_semi"))


def save(facts: DataFrame, files: DataFrame, path: str) -> None:
    """A snapshot: extracted facts, and the files that they come from with their texts."""
    facts.write.mode("overwrite").parquet(f"{path}/facts")
    files.select("path", "content", "mtime", "sha256").withColumn("version", F.lit(SNAPSHOT_VERSION)).write.mode("overwrite").parquet(f"{path}/files")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Facts and files of a snapshot; None if there is none, or one of another version."""
    try:
        files = spark.read.parquet(f"{path}/files")
        facts = spark.read.parquet(f"{path}/facts")
    except Exception as missing:  # AnalysisException of either session kind
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return None
        raise
    if not files.filter(F.col("version") != SNAPSHOT_VERSION).isEmpty():
        return None
    return facts, files.drop("version")
