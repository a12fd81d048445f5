"""N-gram Jaccard join: a universe-partition pigeonhole with exact verification (after Deng et al., 2015).

Sets of shingle hashes are filed by size band. A band splits the universe of hashes into m segments. Linked sets of a band
and the next differ in at most H elements, so with more than H segments one at least is equal: each set indexes a hash of its subset in each
segment of its own band, and probes the segments of the band below. Where the cost model finds it cheaper, segments are fewer and larger and some
match with one element missing (one-deletion neighbourhoods), each of which stands for two of the H + 1 mismatches to rule out.
Empty subsets, which many sets share, get no allocation: m holds as many spare segments as are likely to be empty, and a set with more empty ones
than that files them all. The first allocation goes by the number of documents in a band, which is counted over the whole table.

Equal sets have one key and stand for one another throughout. Signatures that few sets share give all their pairs. For those that many share ("hot"),
as frequent passages make them, the allocation is made anew for each set, now by the measured length of each signature's list: the larger set of a pair has to probe only as many
segments as rule out the differences that its own size allows, and leaves out its hottest ones beyond that. In what is still needed of hot signatures, a few sets of each list are first
compared with all others; what these links join needs no further comparison, and only pairs across what is still
apart follow, from blocks of bounded size: the sets outside a list's largest part against all. Pairs pass a filter that loses nothing (sizes, and the parities of hashed elements, in
about two bits for each element) and are verified on whole sets. A set travels once to each group of pairs that needs it.

Defined cases: a text without words, empty or null, has an empty set and is linked with nothing, its own component; ties cannot arise, as the threshold
is compared in integers; repeated rows are copies of one another and each keeps its row; a very long text is one set like any other; an empty table gives an empty result; other columns,
whatever their names, are not read. A null id names no component, but its row's text links like any other; a component without any id has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, GOLDEN, bounded_batches, cut, drop, free_shuffles, give_back, map_texts, mix, slices, unused
from .components import components
from .shingles import SLICE, shingle_sets

#: Bits of a sketch for each element, at least; sketches have so many bits at least and at most.
DENSITY, LEAST_BITS, MOST_BITS = 2, 64, 1 << 17
#: A signature of at most so many sets gives all their pairs.
FEW = 8
#: Sets of a hot signature that are compared with all its others first: of lists of up to so many sets, and of longer ones.
PIVOTS, SHORT, SHORT_PIVOTS = 3, 64, 1
#: Sets that a block of a hot signature holds, and pairs that a group verifies.
BLOCK, GROUP = 1000, 512
#: How often an element of a set is taken to be in another set by accident, in the first allocation; frequent passages are left to the second one.
ACCIDENT = 0.01
#: Sets of a thread's past of which it remembers that they were filed already.
SEEN = 100_000
#: Rows of a signature from which a task stops holding them together.
HELD = 4096
#: The slack of a set that has to probe all it filed.
NONE_TO_SPARE = -(1 << 30)
OWN, EXACT = 2, 1


@lru_cache(maxsize=512)
def segments(band: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower borders and salts of a band's segments."""
    return np.array([-(-s * 2**64 // m) for s in range(m)], np.uint64), mix(np.arange(m, dtype=np.uint64) + np.uint64((band + 1) << 32))


class Bands:
    """Size bands for a threshold of num / den, and the allocation of each. documents: how many have about so many words, by band."""

    def __init__(self, num: int, den: int, documents: dict[int, int], largest: int):
        self.num, self.den = num, den
        lo, self.lo, self.hi, self.plans = 1, [], [], []
        while lo <= max(1, largest):
            hi = max(lo, lo * den // num)
            self.lo.append(lo)
            self.hi.append(hi)
            self.plans.append(self.plan(hi, documents.get(len(self.plans), 0)))
            lo = hi + 1
        self.starts = np.array(self.lo)

    def most(self, x: int, y: int) -> int:
        """Elements in which linked sets of x and y elements can differ."""
        return (x + y) * (self.den - self.num) // (self.den + self.num)

    def plan(self, hi: int, documents: int) -> tuple[int, int, int] | None:
        """Segments, spare ones among them, and those with one-deletion neighbourhoods."""
        h = self.most(hi, hi * self.den // self.num)
        if h == 0:
            return None  # only equal sets are linked
        best = None
        for deletions in sorted({0, 1, 2, (h + 1) // 4, (h + 1) // 2}):
            if 2 * deletions > h + 1:
                continue
            exact = h + 1 - 2 * deletions
            spare = 0
            while exact:
                empty = exact * np.exp(-hi / 1.2 / (exact + spare + deletions))
                if spare >= empty + 4 * np.sqrt(empty):
                    break
                spare += 1
            m = exact + spare + deletions
            size = hi / m
            cost = exact + spare + deletions * (size + 1) + documents * m * ACCIDENT ** max(1.0, size)
            if best is None or cost < best[0]:
                best = cost, m, spare, deletions
        return best[1:]

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.starts, n, "right")) - 1

    def file(self, h: np.ndarray, band: int, own: bool) -> tuple[np.ndarray, int | None, int | None]:
        """Of a sorted set in a band's universe: its signatures; how many exact ones it can do without against smaller sets; and its segments with
        one-deletion neighbourhoods. The lowest bits of a signature tell whether it is the set's own band and whether the segment is exact."""
        if band < 0 or (plan := self.plans[band]) is None:
            return np.zeros(0, np.uint64), None, None
        m, spare, deletions = plan
        borders, salts = segments(band, m)
        at = np.append(np.searchsorted(h, borders), len(h))
        parts = mix(h ^ np.uint64(GOLDEN))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(parts, dtype=np.uint64)])
        subset = sums[at[1:]] - sums[at[:-1]]
        filled = at[1:] > at[:-1]
        filed = int(filled[deletions:].sum())
        slack = filed + 2 * deletions - 1 - self.most(len(h), min(len(h), self.hi[band]))
        if m - deletions - filed > spare:
            filled[:] = True
            slack = NONE_TO_SPARE
        filled[:deletions] = True
        kind = np.uint64(OWN * own)
        whole = (mix(subset + salts) & ~np.uint64(OWN | EXACT)) | kind
        whole[deletions:] |= np.uint64(EXACT)
        out = [whole[filled]]
        for s in range(deletions):
            out.append((mix(subset[s] - parts[at[s] : at[s + 1]] + salts[s]) & ~np.uint64(OWN | EXACT)) | kind)
        return np.concatenate(out), slack, deletions

    def files(self, h: np.ndarray) -> tuple[tuple, tuple]:
        """file() in the set's own band and in the one below."""
        band = self.band(len(h))
        below = band - 1 if band and len(h) * self.num <= (self.lo[band] - 1) * self.den else -1
        return self.file(h, band, True), self.file(h, below, False)

    def signatures(self, h: np.ndarray) -> np.ndarray:
        return np.concatenate([x[0] for x in self.files(h)])


def set_key(h: np.ndarray) -> int:
    return int(mix(np.array([mix(h + np.uint64(GOLDEN)).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64)).view(np.int64)[0])


def sketch(h: np.ndarray) -> bytes:
    """For each of a power of two of bins, whether an odd number of elements falls into it: sets differ in as many elements as sketches in bits, or more."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (DENSITY * len(h) - 1).bit_length()))
    return np.packbits(np.bincount((h >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(sketches: np.ndarray, length: int) -> np.ndarray:
    """Sketches (rows of bytes) as those of so many bytes."""
    while sketches.shape[1] > length:
        bits = np.unpackbits(sketches, axis=1)
        sketches = np.packbits(bits[:, ::2] ^ bits[:, 1::2], axis=1)
    return sketches


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which rows of bytes differ; x may be one row."""
    return np.bitwise_count(np.ascontiguousarray(x).view(np.uint64) ^ np.ascontiguousarray(y).view(np.uint64)).sum(1, dtype=np.int64)


def stacked(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, length)


def row_tag(text: str) -> Column:
    """What tells apart the texts of rows with one id."""
    return F.xxhash64(F.col(f"`{text}`"))


def thin_table(docs: DataFrame, doc_id: str, text: str, k: int, bands: Bands) -> DataFrame:
    """For each row: id, tag, size, key and sketch of its set, and what the set can do without in its own band and in the one below."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("text"), k)
        filed = [bands.files(h) if len(h) else ((None, None, None),) * 2 for h in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tag"), pa.array([len(h) for h in sets], pa.int64()), pa.array([set_key(h) if len(h) else None for h in sets], pa.int64()), pa.array([sketch(h) if len(h) else None for h in sets], pa.binary()),
             *(pa.array([x[side][part] for x in filed], pa.int32()) for side in (0, 1) for part in (1, 2))],
            names=["doc_id", "tag", "n_shingles", "key", "sketch", "own_slack", "own_near", "below_slack", "below_near"],
        )

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), row_tag(text).alias("tag"), F.col(f"`{text}`").alias("text"))
    return map_texts(rows, "text", run, "doc_id long, tag long, n_shingles long, key long, sketch binary, own_slack int, own_near int, below_slack int, below_near int", SLICE)


def signature_rows(docs: DataFrame, text: str, k: int, bands: Bands) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sigs, keys = [], []
                for h in shingle_sets(part.column("text"), k):
                    if not len(h) or (key := set_key(h)) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    sigs.append(bands.signatures(h))
                    keys.append(np.full(len(sigs[-1]), key, np.int64))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(keys))], names=["sig", "key"])
        seen.clear()
        give_back()

    return bounded_batches(docs.select(F.col(f"`{text}`").alias("text"))).mapInArrow(run, "sig long, key long")


def candidate_rows(rows: DataFrame) -> DataFrame:
    """(hot, a, b, bits) from signatures: a pair of sets, or else a hot signature, one of its sets, and the lowest bits."""

    def out(hot: bool, a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), hot)), pa.array(a), pa.array(b), pa.array(bits.astype(np.int8))], names=["hot", "a", "b", "bits"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_sig, held_key, going = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for sig, key, last in _with_last(batches):
            sig, key = np.concatenate([held_sig, sig]), np.concatenate([held_key, key])
            if not len(sig):
                continue
            new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])])
            sig, key = sig[new], key[new]
            name = sig >> 2
            starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            ends = np.append(starts[1:], len(sig))
            if going is not None and name[0] == going:  # a hot run goes on
                yield out(True, name[: ends[0]], key[: ends[0]], sig[: ends[0]] & 3)
                starts, ends = starts[1:], ends[1:]
            keep = 0
            if len(starts) and not last:
                going, keep, a = None, ends[-1] - starts[-1], starts[-1]
                if keep > HELD:  # a hot run that may go on
                    yield out(True, name[a:], key[a:], sig[a:] & 3)
                    going, keep = int(name[a]), 0
                starts, ends = starts[:-1], ends[:-1]
            held_sig, held_key = sig[len(sig) - keep :], key[len(key) - keep :]
            sizes = ends - starts
            left, right = [], []
            for c in range(2, FEW + 1):
                at = starts[sizes == c]
                for i in range(c - 1) if len(at) else ():
                    for j in range(i + 1, c):
                        use = (sig[at + j] & OWN) > 0  # in order, so the later one of a pair is of its own band if either is
                        left.append(key[at + i][use])
                        right.append(key[at + j][use])
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                if len(pairs):
                    yield out(False, pairs[:, 0].copy(), pairs[:, 1].copy(), np.zeros(len(pairs)))
            many = (sizes > FEW) & ((sig[ends - 1] & OWN) > 0) if len(ends) else np.zeros(0, bool)
            if many.any():
                at = np.concatenate([np.arange(a, b) for a, b in zip(starts[many], ends[many], strict=True)])
                yield out(True, name[at], key[at], sig[at] & 3)

    return rows.repartition(F.shiftright("sig", 2)).sortWithinPartitions("sig", "key").mapInArrow(runs, "hot boolean, a long, b long, bits byte")


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    for batch in batches:
        yield batch.column(0).to_numpy(), batch.column(1).to_numpy(), False
    yield np.zeros(0, np.int64), np.zeros(0, np.int64), True


def hot_members(hot: DataFrame, reps: DataFrame) -> DataFrame:
    """(sig, key, own, probe, pivots): the allocation of each set by the lengths of its hot signatures' lists. A set probes the shortest lists that it can't do without; hot
    lists that no set has to probe are left out. pivots: sets of the list's own band, chosen alike in all lists."""
    costs = hot.groupBy("sig").agg(F.sum(F.when(F.col("bits") >= OWN, 1).otherwise(0)).alias("cost")).filter("cost > 0")
    rows = hot.join(costs, "sig").select("sig", "key", "cost", (F.col("bits") >= OWN).alias("own"), (F.col("bits") % 2 == EXACT).alias("exact"))
    filed = Window.partitionBy("key", "own")
    rows = rows.withColumns({
        "rank": F.row_number().over(Window.partitionBy("key", "own", "exact").orderBy("cost", "sig")),
        "n_exact": F.sum(F.col("exact").cast("int")).over(filed),
        "n_near": F.sum((~F.col("exact")).cast("int")).over(filed),
    })
    rows = rows.join(reps.select("key", "own_slack", "own_near", "below_slack", "below_near"), "key")
    slack, near = (F.when(F.col("own"), F.col(f"own_{x}")).otherwise(F.col(f"below_{x}")) for x in ("slack", "near"))
    lacking = F.col("n_exact") - slack
    with_near = F.greatest(F.lit(0), lacking)  # exact lists to probe, if all hot ones of one-deletion neighbourhoods are probed as well
    without_near = F.greatest(F.lit(0), lacking + 2 * F.least(near, F.col("n_near")))  # each of those left out may cost a segment's two mismatches
    leave = without_near <= F.least(F.col("n_exact"), with_near + F.col("n_near"))
    probe = F.when(F.col("exact"), F.col("rank") <= F.when(leave, without_near).otherwise(with_near)).otherwise(~leave)
    marked = cut(rows.select("sig", "key", "own", probe.alias("probe")), "marked")
    pivots = F.array_distinct(F.array(*(F.min(F.when(F.col("own"), F.struct(F.xxhash64(F.lit(r), "key").alias("h"), "key")))["key"] for r in range(PIVOTS))))
    live = marked.groupBy("sig").agg(F.max("probe").alias("any"), F.count("*").alias("n"), pivots.alias("pivots")).filter("any")
    live = live.select("sig", F.when(F.col("n") <= SHORT, F.slice("pivots", 1, SHORT_PIVOTS)).otherwise(F.col("pivots")).alias("pivots"))
    members = cut(marked.filter("own or probe").join(live, "sig"), "members")
    drop(marked)
    return members


def filter_pairs(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs of keys that sizes and sketches allow."""
    side = lambda x: reps.select(F.col("key").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2 = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            near = np.minimum(n1, n2) * den >= np.maximum(n1, n2) * num
            most = (n1 + n2) * (den - num) // (den + num)
            lengths = [pc.binary_length(batch.column(c)).to_numpy().astype(np.int64) for c in ("s_a", "s_b")]
            both = lengths[0] << 32 | lengths[1]
            for kind in np.unique(both[near]).tolist():
                at = np.flatnonzero(near & (both == kind))
                x, y = (stacked(batch.column(c).take(pa.array(at)), n) for c, n in (("s_a", kind >> 32), ("s_b", kind & (1 << 32) - 1)))
                least = min(x.shape[1], y.shape[1])
                near[at] = apart(folded(x, least), folded(y, least)) <= most[at]
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return bounded_batches(pairs.distinct().join(side("a"), "a").join(side("b"), "b")).mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, text: str, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) among the pairs that join the same sets as all true links among them do."""
    pairs = cut(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("key"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("key"), F.col("a").alias("other")))
    home = ends.groupBy("key").agg(F.min(F.least("key", "other")).alias("home"), F.count("*").alias("n"))
    load = pairs.join(home.select(F.col("key").alias("a"), "home"), "a")
    blocks = load.groupBy("home").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("blocks"))
    dealt = cut(load.join(blocks, "home").select("home", F.pmod(F.xxhash64("b"), "blocks").alias("block"), "a", "b"), "dealt")
    needed = cut(home.select("key").join(reps.select("key", "tag"), "key").select("tag").distinct(), "needed")
    many = needed.count() > BROADCAST_IDS
    texts = docs.select(row_tag(text).alias("tag"), F.col(f"`{text}`").alias("text")).join(needed if many else F.broadcast(needed), "tag")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = {set_key(h): h for h in shingle_sets(batch.column("text"), k) if len(h)}
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array([h.tobytes() for h in found.values()], pa.binary())], names=["key", "members"])

    members = map_texts(texts.select("text"), "text", sets, "key long, members binary", SLICE)
    wanted = dealt.select("home", "block", F.col("a").alias("key")).union(dealt.select("home", "block", F.col("b").alias("key"))).distinct()
    sent = wanted.join(members, "key").select(F.col("home").alias("to_home"), F.col("block").alias("to_block"), "key", "members")

    def verify(near: pa.Table, own: pa.Table) -> pa.Table:
        held = {key: np.frombuffer(x.as_buffer(), np.uint64) for key, x in zip(own["key"].to_pylist(), own["members"], strict=True)}
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        found = []
        for a, b in zip(near["a"].to_pylist(), near["b"].to_pylist(), strict=True):
            ra, rb = top(a), top(b)
            if ra == rb:
                continue
            x, y = held[a], held[b]
            common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            if den * common >= num * (len(x) + len(y) - common):
                parent[max(ra, rb)] = min(ra, rb)
                found.append((a, b))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    links = cut(dealt.groupBy("home", "block").cogroup(sent.groupBy("to_home", "to_block")).applyInArrow(verify, "a long, b long"), "links")
    for x in (pairs, dealt, needed):
        drop(x)
    return links


def across(members: DataFrame, joined: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of sets in one hot list, one of which has to probe it, that no links join so far and that sizes and sketches allow."""
    part = members.join(joined, F.col("key") == F.col("node"), "left").select("sig", "key", "own", "probe", F.coalesce("component", "key").alias("part"))
    sizes = part.groupBy("sig", "part").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("sig").agg(F.max(F.struct("n", "part")).alias("x"), F.sum("n").alias("n"), F.count("*").alias("parts")).filter("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.select("sig", F.col("x.part").alias("main"), blocks(F.col("x.n")).alias("mains"), blocks(F.col("n") - F.col("x.n")).alias("others"))
    rows = part.join(mixed, "sig").withColumn("is_main", F.col("part") == F.col("main"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    # each block of others meets those of the main part, as -1 and below, and the others from its own on
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    where = F.when(F.col("is_main"), F.transform(upto(F.col("others")), lambda i: F.struct(i.alias("i"), (-1 - F.col("block")).alias("j")))).otherwise(
        F.concat(
            F.transform(upto(F.col("mains")), lambda j: F.struct(F.col("block").alias("i"), (-1 - j).alias("j"))),
            F.transform(upto(F.col("others")), lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j"))),
        )
    )
    rows = rows.join(reps.select("key", "n_shingles", "sketch"), "key").withColumn("at", F.explode(where))
    rows = rows.select("sig", "at.i", "at.j", "is_main", "block", "key", "own", "probe", "part", "n_shingles", "sketch")

    def between(x: pa.Table, y: pa.Table) -> Iterator[np.ndarray]:
        """Pairs of a probing set of x and a set of y's own band, no larger, of another part."""
        x, y = x.filter(x["probe"]), y.filter(y["own"]).sort_by("n_shingles")
        if not x.num_rows or not y.num_rows:
            return
        n, key, part, lengths = y["n_shingles"].to_numpy(), y["key"].to_numpy(), y["part"].to_numpy(), pc.binary_length(y["sketch"]).to_numpy()
        own = {int(b): (a := int(np.searchsorted(lengths, b)), int(np.searchsorted(lengths, b, "right")), stacked(y["sketch"].slice(a, int((lengths == b).sum())), int(b))) for b in np.unique(lengths)}
        for s, m, k, p in zip(x["sketch"].to_pylist(), x["n_shingles"].to_pylist(), x["key"].to_pylist(), x["part"].to_pylist(), strict=True):
            lo, hi = int(np.searchsorted(n, -(-m * num // den))), int(np.searchsorted(n, m, "right"))
            for length, (a, b, sketches) in own.items():
                a_, b_ = max(lo, a), min(hi, b)
                if a_ >= b_ or length > len(s):
                    continue
                near = apart(folded(np.frombuffer(s, np.uint8)[None], length), sketches[a_ - a : b_ - a]) <= (n[a_:b_] + m) * (den - num) // (den + num)
                found = key[a_:b_][near & (part[a_:b_] != p)]
                yield np.stack([np.minimum(found, k), np.maximum(found, k)], 1)

    def pairs(rows: pa.Table) -> pa.Table:
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        if i == j:
            found = [*between(rows, rows)]
        else:
            left = pc.and_(pc.invert(rows["is_main"]), pc.equal(rows["block"], i))
            x, y = rows.filter(left), rows.filter(pc.invert(left))
            found = [*between(x, y), *between(y, x)]
        every = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
        return pa.table({"a": every[:, 0].copy(), "b": every[:, 1].copy()})

    return rows.groupBy("sig", "i", "j").applyInArrow(pairs, "a long, b long").distinct()


def grouped(docs: DataFrame, k: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tag, n_shingles, part, component_id) for each row; part tells components apart and is null for empty sets."""
    sizes = docs.select(F.greatest(F.lit(1), F.octet_length(text) - F.octet_length(F.translate(text, " \n\t\r\f\v", "")) + 2 - k).alias("n")).filter("n is not null")
    step = float(np.log(den / num))
    counted = sizes.groupBy(F.floor(F.log("n") / step).alias("g")).agg(F.count("*").alias("c"), F.max("n").alias("most")).collect()  # a row for each power of den / num
    largest = max((r["most"] for r in counted), default=1)
    bands = Bands(num, den, {}, int(largest) * 2 + 16)
    by_band: dict[int, int] = {}
    for r in counted:
        by_band[bands.band(int(r["most"]))] = by_band.get(bands.band(int(r["most"])), 0) + r["c"]
    bands = Bands(num, den, by_band, int(largest) * 2 + 16)

    thin = cut(thin_table(docs, doc_id, text, k, bands), "thin")
    same = ("tag", "n_shingles", "sketch", "own_slack", "own_near", "below_slack", "below_near")
    reps = cut(thin.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep_id"), *(F.first(c).alias(c) for c in same)), "reps")
    found = cut(candidate_rows(signature_rows(docs, text, k, bands)), "candidates")
    free_shuffles(docs.sparkSession)  # those of all signatures
    hot = cut(found.filter("hot").select(F.col("a").alias("sig"), F.col("b").alias("key"), "bits").distinct(), "hot")
    pairs, args = found.filter("not hot").select("a", "b"), (reps, docs, text, k, num, den)
    members = None if hot.isEmpty() else hot_members(hot, reps)
    if members is not None:
        pivot = members.select("key", F.explode("pivots").alias("p")).filter("key <> p")
        pairs = pairs.union(pivot.select(F.least("key", "p"), F.greatest("key", "p")))
    links = verified(filter_pairs(pairs, reps, num, den), *args)
    joined = components(links)
    drop(found), drop(hot)
    if members is not None:
        more = verified(across(members, joined, reps, num, den), *args)
        if not more.isEmpty():
            drop(joined)
            joined = components(links.union(more))
        drop(members), drop(more)
    named = reps.select("key", "rep_id").join(joined, F.col("key") == F.col("node"), "left").select("key", "rep_id", F.coalesce("component", "key").alias("part"))
    least = named.groupBy("part").agg(F.min("rep_id").alias("component_id"))
    named = named.join(least, "part").select("key", "part", "component_id")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = cut(thin.join(named, "key", "left").select("doc_id", "tag", "n_shingles", "part", component.alias("component_id")), "grouped")
    for x in (thin, reps, links, joined):
        drop(x)
    return out


def jaccard_components(docs: DataFrame, k: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: documents are linked when den * intersection >= num * union of their k-word shingle sets."""
    return grouped(docs, k, num, den, doc_id, text).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, k: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component, that of the smallest id, a null id last; between different texts with that id, that of the smallest hash; of rows
    with equal id and text any one. Rows without words all stay. Columns are those of docs."""
    found = grouped(docs, k, num, den, doc_id, text).filter("part is not null")
    order = lambda: F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")
    found = found.groupBy("part", "doc_id", "tag").agg(F.count("*").alias("rows"))
    kept = found.groupBy("part").agg(F.min(order()).alias("first"))
    found = cut(found.join(kept, "part").select("doc_id", "tag", "rows", (order() == F.col("first")).alias("kept")), "kept")
    a, b = unused(docs, "id"), unused(docs, "tag")
    keys = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(a)) & (row_tag(text) == F.col(b))
    gone = found.filter("not kept").select(F.col("doc_id").alias(a), F.col("tag").alias(b))
    out = docs.join(gone if gone.count() > BROADCAST_IDS // 2 else F.broadcast(gone), keys, "left_anti")
    again = found.filter("kept and rows > 1").select(F.col("doc_id").alias(a), F.col("tag").alias(b))
    if again.isEmpty():
        return out
    again = again if again.count() > BROADCAST_IDS // 2 else F.broadcast(again)
    once = out.join(again, keys, "inner").dropDuplicates([a, b]).select(*docs.columns)
    return out.join(again, keys, "left_anti").unionByName(once)
