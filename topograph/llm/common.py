"""Shared helpers: the shared folder, cutting lineage, keys and Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

GOLDEN = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a new one if all run in one process, as in tests; else an error."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("topograph.shared.dir", None)
    if not known:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="topograph-")
        spark.conf.set("topograph.shared.dir", known)
    return known.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again, so that later stages survive lost executors without recomputing it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what cut() wrote, once nothing reads it any more."""
    path, spark = getattr(df, "_cut_path", None), df.sparkSession
    if path:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have the files of shuffles that no frame reads any more deleted now. Spark does so only when the driver's garbage is collected, which may be half an hour later."""
    gc.collect()
    spark._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """A name like this that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def widened(df: DataFrame, **more: str) -> StructType:
    """df's schema and further columns, given by DDL types."""
    return StructType([*df.schema.fields, *(StructField(k, _parse_datatype_string(v)) for k, v in more.items())])


def letters_lower(c: Column) -> Column:
    """A-Z to a-z; other characters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str, budget: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the text of a slice stays near budget bytes; a longer text has a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > budget:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


#: Bytes of texts that go to a Python worker at once.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, whose session sends batches of BATCH_BYTES at most from now on, as 10,000 texts take too much memory on either side."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    known = conf.get(name, None)
    if known is None or (known.isdigit() and not 0 < int(known) <= BATCH_BYTES):
        conf.set(name, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Return freed memory of a Python worker, which later stages use again, to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: StructType | str, budget: int = 4 << 20, done: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow over slices of bounded text; done is called at the end of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, budget):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
        if done:
            done()
        give_back()

    return bounded_batches(df).mapInArrow(run, schema)


#: Ids that a join may broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 4_000_000


def without(df: DataFrame, ids: DataFrame, key: Column) -> DataFrame:
    """df's rows whose key is not among ids, a frame of one column. Rows with a null key stay."""
    name = unused(df, "gone")
    gone = cut(ids.toDF(name).distinct(), "gone")
    return df.join(gone if gone.count() > BROADCAST_IDS else F.broadcast(gone), key == F.col(name), "left_anti")
