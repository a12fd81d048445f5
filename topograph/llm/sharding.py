"""Sharding: a two-pass external shuffle.

Pass one scatters the rows into memory-sized buckets: rendezvous hashing of the key over the shards (each key goes to
the shard with the largest seeded hash), then a seeded hash over the buckets of a shard. Pass two takes each bucket into one task's
memory, puts it in a fixed order, permutes it by Fisher-Yates with a seed of its own, and writes it. A shard is its buckets in order.

The law is ``key``: the key and the shard count decide the shard, and one more shard takes rows only into itself, as the largest hash
of a row changes only if the new shard's is larger. The sizes of shards differ by chance only.

Defined cases: a null text has no bytes, so its size is 16 and its text_crc32 null; a null key is a key like any other;
repeated rows stay and may swap places among themselves; equal texts under different keys are not kept together; an empty table
gives an empty result; other columns are written along, and columns named like result columns are replaced. The order depends on the seed and the rows alone, but for rows of a key and
text that come more than REPEATS times: these are spread over the buckets of their shard by where they are read, as one bucket might not hold them.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, widened

#: Text bytes that a bucket should hold: a task needs a few times as much memory.
BUCKET_BYTES = 48 << 20
#: Rows of one key and text that one bucket takes.
REPEATS = 10_000
#: Tasks that the buckets are dealt to, at most; of more buckets a task takes one after the other.
TASKS = 50_000
#: Buckets whose first slots a join may broadcast; more are joined by a shuffle.
BROADCAST_BUCKETS = 1_000_000
OWN = ("shard", "grown_shard", "bucket", "place", "slot", "size", "text_crc32", "law")


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard with the largest seeded hash of the key; ties, which 64 bits make unlikely, go to the higher shard."""
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(F.xxhash64(F.lit(seed), key, i).alias("h"), i.alias("i"))))["i"]


def external_shuffle(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write df's rows in shuffled order into the shared folder and return what was written, with shard, slot and the other columns of OWN.

    The slots of a shard are gapless from 0. write_shards() makes one folder for each shard of it.
    """
    spark = df.sparkSession
    df = df.drop(*OWN)
    total = df.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 16)).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    k = F.col(f"`{key}`")
    salt = F.lit(0)
    if buckets > 1:
        tag = F.xxhash64(k, F.col(f"`{text}`"))
        often = df.groupBy(tag.alias("tag")).count().filter(F.col("count") > REPEATS).select("tag").collect()  # one of REPEATS rows at most
        if often:
            salt = F.when(reduce(lambda a, b: a | b, (tag.isin([r["tag"] for r in often[i : i + 1000]]) for i in range(0, len(often), 1000))), F.spark_partition_id()).otherwise(0)
    dealt = df.withColumns({
        "shard": rendezvous(k, shards, seed),
        "grown_shard": rendezvous(k, shards + 1, seed),
        "bucket": F.pmod(F.xxhash64(F.lit(seed + 1), k, F.col(f"`{text}`"), salt), F.lit(buckets)).cast("long"),
        "size": (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long"),
        "text_crc32": F.crc32(text),
    })
    schema = widened(dealt, place="long")

    def permute(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by([(key, "ascending"), ("text_crc32", "ascending"), ("size", "ascending"), (text, "ascending")])
        own = np.random.default_rng([seed, rows["shard"][0].as_py(), rows["bucket"][0].as_py()])
        return rows.take(pa.array(own.permutation(rows.num_rows))).append_column("place", pa.array(np.arange(rows.num_rows)))  # permutation() is Fisher-Yates

    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    dealt.repartition(min(TASKS, shards * buckets), "shard", "bucket").groupBy("shard", "bucket").applyInArrow(permute, schema).write.parquet(path)
    written = spark.read.schema(schema).parquet(path)
    if buckets == 1:
        return written.withColumns({"slot": F.col("place"), "law": F.lit("key")})
    counts = written.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    if buckets * shards <= BROADCAST_BUCKETS:
        starts = F.broadcast(starts)
    return written.join(starts, ["shard", "bucket"]).withColumns({"slot": F.col("start") + F.col("place"), "law": F.lit("key")}).drop("start")


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder for each shard, whose files hold its rows in order of slot."""
    shuffled.repartition("shard", "bucket").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
