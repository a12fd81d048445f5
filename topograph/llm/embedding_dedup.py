"""Embedding near-dedup by product quantisation with an exact rerank.

Vectors are compared within a label only. Equal vectors form a class that is searched once and counted with its size. A coarse quantiser (spherical k-means)
files each vector's residual under its nearest centroid as codes of subspaces, with the length of the residual that the codes miss. A query probes every
list that can hold a vector within reach: a vector at distance D lies beyond the plane between two centroids only if the query is within D of that plane. In
a list, table lookups give the distance to each coded vector; what it leaves possible, given the coded vector's missed length, is compared by the exact cosine in double
precision. Neither step can lose a link, so the search needs no tuning for recall. Centroids are fitted on a bounded sample (SAMPLE rows by seeded hash);
all vectors are indexed. Lists and their visitors are cut into blocks of bounded size, so that no task holds a whole hot list.

Defined cases: a vector that is null, zero or empty, or holds null or non-finite components, and a row with a null label, link with nothing and are
components of their own; vectors of different lengths aren't linked; repeated rows are vectors linked with one another; an empty table gives an empty result;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

SAMPLE = 8192
#: Vectors that a list should hold, lists at most, subspaces and centroids of each.
PER_LIST, LISTS, SUBSPACES, CODES = 400, 1024, 8, 32
#: Rows of a list, and visitors of it, that a task compares.
BLOCK, VISITORS = 4000, 20_000
#: Lengths of vectors that may occur, each with an index of its own.
LENGTHS = 64
#: Room for rounding in the bounds; links are decided by the exact cosine.
SLACK = 1e-5


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1)[None] - 2 * x @ c.T, 1)
        for j in range(len(c)):
            if (own := x[near == j]).size:
                c[j] = own.mean(0)
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return np.unique(c, axis=0)


def units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors in double precision."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = values.flatten().to_numpy().astype(np.float64).reshape(len(values), -1)
    x /= np.abs(x).max(1, keepdims=True)  # else squares of tiny components vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Index:
    def __init__(self, sample: np.ndarray, lists: int, threshold: float):
        rng = np.random.default_rng(8)
        self.reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
        self.centroids = k_means(sample, lists, 8, rng, True)
        squares = (self.centroids * self.centroids).sum(1)
        self.apart = np.sqrt(np.maximum(0, squares[:, None] + squares[None] - 2 * self.centroids @ self.centroids.T))
        residuals = sample - self.centroids[np.argmax(sample @ self.centroids.T, 1)]
        self.parts = [p for p in np.array_split(np.arange(sample.shape[1]), SUBSPACES) if len(p)]
        self.books = [k_means(residuals[:, p], CODES, 6, rng, False) for p in self.parts]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
        """List, codes, missed length, and the further lists to probe (each pair of lists is probed from one side)."""
        dots = x @ self.centroids.T
        own = dots.argmax(1)
        residual = x - self.centroids[own]
        codes, missed = np.zeros((len(x), len(self.parts)), np.uint8), np.zeros(len(x))
        for m, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            d = (residual[:, p] ** 2).sum(1)[:, None] + (book * book).sum(1)[None] - 2 * residual[:, p] @ book.T
            codes[:, m] = d.argmin(1)
            missed += np.maximum(0, d.min(1))
        margin = dots[np.arange(len(x)), own][:, None] - dots
        probes = (margin <= self.reach * self.apart[own] + SLACK) & (np.arange(dots.shape[1])[None] > own[:, None])
        return own, codes, np.sqrt(missed), [np.flatnonzero(r).tolist() for r in probes]

    def possible(self, queries: np.ndarray, of: int, codes: np.ndarray, missed: np.ndarray) -> np.ndarray:
        """Which coded vectors of a list may be within reach of each query, by table lookups."""
        residual = queries - self.centroids[of]
        d = np.zeros((len(codes), len(queries)), np.float32)
        for m, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            lookup = np.maximum(0, (book * book).sum(1)[:, None] + (residual[:, p] ** 2).sum(1)[None] - 2 * book @ residual[:, p].T)
            d += lookup.astype(np.float32)[codes[:, m]]  # a code's row has all queries on end
        return np.ascontiguousarray((np.sqrt(d) <= (self.reach + missed + SLACK)[:, None]).T)


def search(index: Index, threshold: float, rows: pa.Table) -> pa.Table:
    """Of one block of a list: how many vectors each class is linked with, and links that join what all links join."""
    role = rows["role"].to_numpy()
    members, visitors = rows.filter(pa.array(role == 1)), rows.filter(pa.array(role == 0))
    keys, counts, others = [], [], []
    if members.num_rows:
        key, weight = members["key"].to_numpy(), members["weight"].to_numpy()
        codes = np.frombuffer(b"".join(members["code"].to_pylist()), np.uint8).reshape(len(key), -1)
        missed, x, of = members["missed"].to_numpy(), units(members["vector"]), rows["list"][0].as_py()
        joined, linked = np.arange(len(key)), np.zeros(len(key), np.int64)
        inner = bool(rows["inner"][0].as_py())
        sides = ([(key, weight, x, True)] if inner else []) + ([(visitors["key"].to_numpy(), visitors["weight"].to_numpy(), units(visitors["vector"]), False)] if visitors.num_rows else [])
        for q_key, q_weight, q, same in sides:
            q_linked = np.zeros(len(q_key), np.int64)
            for a in range(0, len(q), 256):
                maybe = index.possible(q[a : a + 256], of, codes, missed)
                if same:
                    maybe &= np.arange(len(key))[None] > np.arange(a, a + len(maybe))[:, None]
                for i in np.flatnonzero(maybe.any(1)):
                    near = np.flatnonzero(maybe[i])
                    near = near[x[near] @ q[a + i] >= threshold]
                    if not len(near):
                        continue
                    q_linked[a + i] += weight[near].sum()
                    linked[near] += q_weight[a + i]
                    groups, first = np.unique(joined[near], return_index=True)
                    if same:
                        new = groups != joined[a + i]
                        groups, first = groups[new], first[new]
                    keys.extend([int(q_key[a + i])] * len(first))
                    others.extend(key[near[first]].tolist())
                    counts.extend([0] * len(first))
                    if len(groups) and (same or len(groups) > 1):
                        to = joined[a + i] if same else groups[0]
                        joined[np.isin(joined, groups)] = to
            if same:
                linked += q_linked
            else:
                use = q_linked > 0
                keys.extend(q_key[use].tolist()), counts.extend(q_linked[use].tolist()), others.extend([None] * int(use.sum()))
        use = linked > 0
        keys.extend(key[use].tolist()), counts.extend(linked[use].tolist()), others.extend([None] * int(use.sum()))
    return pa.table({"key": pa.array(keys, pa.int64()), "n": pa.array(counts, pa.int64()), "other": pa.array(others, pa.int64())})


def found_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(key, n, other) of classes (key, label, vector, weight) whose vectors are equally long: counts of linked vectors to add up, and links."""
    spark = classes.sparkSession
    total = classes.count()
    take = (1 << 53) * min(1.0, SAMPLE / max(1, total))
    sample = classes.filter(F.shiftrightunsigned(F.xxhash64(F.lit(8), "key"), 11) < F.lit(int(take))).select("key", "vector").toPandas().sort_values("key")["vector"]
    if not len(sample):
        sample = classes.select("vector").limit(1).toPandas()["vector"]
    index = spark.sparkContext.broadcast(Index(units(pa.array(sample.tolist())), max(1, min(LISTS, total // PER_LIST, len(sample) // 8)), threshold))

    def place(batches):
        for batch in batches:
            own, codes, missed, probes = index.value.place(units(batch.column("vector")))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "label", "vector", "weight")), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed), pa.array(probes, pa.list_(pa.int32()))],
                names=["key", "label", "vector", "weight", "list", "code", "missed", "probes"],
            )

    label = classes.schema["label"].dataType.simpleString()
    placed = cut(classes.mapInArrow(place, f"key long, label {label}, vector array<float>, weight long, list int, code binary, missed double, probes array<int>"), "placed")
    sizes = placed.groupBy("label", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(sizes, ["label", "list"]).withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    common = ("label", "list", "block", "key", "weight", "vector")
    to_lists = placed.select("label", F.explode("probes").alias("list"), "key", "weight", "vector").join(sizes, ["label", "list"])
    to_lists = to_lists.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*common)
    to_blocks = placed.filter("block + 1 < blocks").withColumn("block", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1))).select(*common)
    visitors = to_lists.union(to_blocks)
    probed = placed.select("label", F.explode("probes").alias("list")).groupBy("label", "list").agg(F.count("*").alias("v"))
    loads = sizes.join(probed, ["label", "list"], "left").select("label", "list", (F.ceil((F.coalesce("v", F.lit(0)) + F.col("blocks") * BLOCK) / VISITORS)).cast("int").alias("chunks"))
    visits = visitors.join(loads, ["label", "list"]).select(*common, F.pmod(F.xxhash64(F.lit(1), "key"), "chunks").cast("int").alias("chunk"), F.lit(0).alias("role"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("missed"))
    held = placed.join(loads, ["label", "list"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*common, "chunk", F.lit(1).alias("role"), "code", "missed")
    rows = held.union(visits).withColumn("inner", F.col("chunk") == 0)
    return rows.groupBy("label", "list", "block", "chunk").applyInArrow(lambda t: search(index.value, threshold, t), "key long, n long, other long")


def near_duplicates(df: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    v = F.col("vector")
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<float>").alias("vector"), F.col(f"`{label}`").alias("label"))
    fine = F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = cut(rows.withColumn("key", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64("label", "vector"))), "vectors")
    # one key for equal vectors under one label; should two others share a key, 64 bits apart, the smaller would stand for both
    classes = cut(rows.filter("key is not null").groupBy("key").agg(F.min(F.struct("label", "vector")).alias("x"), F.count("*").alias("weight"), F.min("vec_id").alias("rep_id")).select("key", "x.label", "x.vector", "weight", "rep_id"), "classes")
    lengths = [r[0] for r in classes.groupBy(F.size("vector")).count().orderBy(F.size("vector")).limit(LENGTHS + 1).collect()]
    if len(lengths) > LENGTHS:
        raise ValueError(f"over {LENGTHS} lengths of vectors")
    thin = rows.select("vec_id", "key")
    if not lengths:
        return thin.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = None
    for n in lengths:
        own = found_links(classes.filter(F.size("vector") == n).select("key", "label", "vector", "weight"), threshold)
        found = own if found is None else found.union(own)
    found = cut(found, "found")
    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    joined = components(found.filter("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("key"), "component")
    named = classes.select("key", "rep_id", "weight").join(counts, "key", "left").join(joined, "key", "left").withColumn("part", F.coalesce("component", "key"))
    least = named.groupBy("part").agg(F.min("rep_id").alias("component_id"))
    named = named.join(least, "part").select("key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = thin.join(named, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
