"""Linking: from names to nodes, by tiers of equi-joins.

symbols: file_path, name, id, seq. bindings: file_path, local_name, source_path, imported_name, is_namespace. Names are skewed ("get"), so symbols are reduced to one row
for each file and name before any join, and the global tiers to one row for each name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_file(symbols: DataFrame) -> DataFrame:
    """The last definition of each name in each file."""
    last = symbols.groupBy("file_path", "name").agg(F.max(F.struct("seq", "id")).alias("x"))
    return last.select("file_path", "name", F.col("x.id").alias("id"), F.col("x.seq").alias("seq"))


def unique_definitions(symbols: DataFrame) -> DataFrame:
    """(name, def_path, def_id) of names that exactly one file defines."""
    defs = by_file(symbols).groupBy("name").agg(F.count("*").alias("files"), F.first("file_path").alias("def_path"), F.first("id").alias("def_id"))
    return defs.filter("files = 1").drop("files")


def first_definitions(symbols: DataFrame) -> DataFrame:
    """(name, def_id): the definition in the file that comes first."""
    return by_file(symbols).groupBy("name").agg(F.min_by("id", F.struct("seq", "id")).alias("def_id"))


def _look(rows: DataFrame, table: DataFrame, path: Column, name: Column, out: str) -> DataFrame:
    """rows with the id that a file has for a name."""
    t = table.select(F.col("file_path").alias("look_path"), F.col("name").alias("look_name"), F.col("id").alias(out))
    return rows.withColumns({"want_path": path, "want_name": name}).join(t, (F.col("want_path") == F.col("look_path")) & (F.col("want_name") == F.col("look_name")), "left").drop("want_path", "want_name", "look_path", "look_name")


def _bound(rows: DataFrame, bindings: DataFrame, name: Column) -> DataFrame:
    b = bindings.select(F.col("file_path").alias("b_file"), F.col("local_name").alias("b_local"), "source_path", "imported_name", F.coalesce("is_namespace", F.lit(False)).alias("is_namespace"))
    return rows.withColumn("want", name).join(b, (F.col("file_path") == F.col("b_file")) & (F.col("want") == F.col("b_local")), "left").drop("want", "b_file", "b_local")


def link_calls(calls: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """calls (call_id, file_path, caller_id, callee_name, callee_object) with target_id and tier, for those that resolve to another node.

    1 the file itself, 2 an imported name, 3 a member of an imported class or namespace, 4 the only file that defines the name.
    """
    table = by_file(symbols)
    callee, obj, src, imported = (F.col(c) for c in ("callee_name", "callee_object", "source_path", "imported_name"))
    plain = obj.isNull()
    rows = _look(calls, table, F.col("file_path"), F.concat_ws(".", obj, callee), "own_full")
    rows = _look(rows, table, F.col("file_path"), callee, "own_short")
    rows = _bound(rows, bindings, F.coalesce(obj, callee))
    usable = F.when(plain & F.col("is_namespace"), F.lit(None)).otherwise(src)
    rows = _look(rows, table, usable, F.when(plain, imported).otherwise(F.concat_ws(".", imported, callee)), "far_1")
    rows = _look(rows, table, F.when(~plain, src), F.concat_ws(".", obj, callee), "far_2")
    rows = _look(rows, table, usable, callee, "far_3")
    rows = rows.join(unique_definitions(symbols).withColumnRenamed("name", "callee_name"), "callee_name", "left")
    near, far = F.coalesce("own_full", "own_short"), F.coalesce("far_1", "far_2", "far_3")
    tier = F.when(near.isNotNull(), 1).when(far.isNotNull(), F.when(plain, 2).otherwise(3)).otherwise(4)
    linked = rows.withColumns({"target_id": F.coalesce(near, far, "def_id"), "tier": tier})
    return linked.filter(F.col("target_id").isNotNull() & (F.col("target_id") != F.col("caller_id"))).select(*calls.columns, "target_id", "tier")


def link_heritages(pending: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """pending (file_path, source_id, target_name, relation, …) with target_id: the file itself, an imported name, or the first file that has it."""
    table = by_file(symbols)
    target = F.col("target_name")
    rows = _bound(_look(pending, table, F.col("file_path"), target, "own"), bindings, target)
    rows = _look(_look(rows, table, F.col("source_path"), F.col("imported_name"), "far_1"), table, F.col("source_path"), target, "far_2")
    rows = rows.join(first_definitions(symbols).withColumnRenamed("name", "target_name"), "target_name", "left")
    return rows.withColumn("target_id", F.coalesce("own", "far_1", "far_2", "def_id")).filter("target_id is not null").select(*pending.columns, "target_id")
