"""SentencePiece encoding and decoding by batched numpy Viterbi (see pieces.py for the segmentation rule).

The distinct words of a batch of texts that are equally long advance together: rolling hashes of all substrings of one length
probe the sorted hashes of the pieces of that length (hits are compared code by code), and the maximum over the lengths, taken for all words
at once, stores the backpointers. Words over LONG characters advance one by one, with the same rule. Each task keeps the ids of
REMEMBERED words at most; forgetting them changes nothing but the time.

Defined cases: a null text has null ids, no pieces and a null decoded text; an empty text has no pieces and decodes to itself; a text of any
length is encoded whole; repeated rows are encoded one by one; other columns are kept, and columns named like result columns are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, widened
from .pieces import DEFAULT_MODEL, Vocabulary, vocabulary, words

LONG = 64
REMEMBERED = 250_000
#: Words that advance together, so that their arrays stay in the cache.
TOGETHER = 2000
BASE = np.uint64(0xD6E8FEB86659FD93)


def code_points(words_: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words_).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words_), length)


class Viterbi:
    def __init__(self, path: str):
        self.v: Vocabulary = vocabulary(path)
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(LONG, BASE, np.uint64)]), dtype=np.uint64)
        by_length: dict[int, list[str]] = {}
        for p in self.v.ids:
            by_length.setdefault(len(p), []).append(p)
        self.tables = {}
        for k, group in sorted(by_length.items()):
            codes = code_points(group, k)
            keys = self.prefix_hashes(codes)[:, k]
            order = np.argsort(keys)
            if len(np.unique(keys)) < len(keys):
                raise ValueError("two pieces have one hash; change BASE")
            first = np.searchsorted(keys[order], np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)).astype(np.int32)
            most = int(np.bincount((keys >> np.uint64(48)).astype(np.int64)).max())
            padded = np.concatenate([keys[order], np.full(most, ~keys[order[-1]], np.uint64)])
            self.tables[k] = (padded, first, most), codes[order], np.array([self.v.ids[group[i]] for i in order], np.int32), np.array([self.v.scores[group[i]] for i in order], np.float64)
        self.known: dict[str, bytes] = {}
        self.lengths = np.array([len(x) for x in self.v.strings], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.v.strings), np.uint8)

    @staticmethod
    def prefix_hashes(codes: np.ndarray) -> np.ndarray:
        n, length = codes.shape
        out = np.zeros((n, length + 1), np.uint64)
        spread = (codes.astype(np.uint64) + np.uint64(0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
        spread ^= spread >> np.uint64(29)
        for j in range(length):
            out[:, j + 1] = out[:, j] * BASE + spread[:, j]
        return out

    def segment(self, group: list[str], length: int) -> list[bytes]:
        """Ids of equally long words, as bytes of int32. Arrays are by place, then by word."""
        n, codes = len(group), code_points(group, length)
        prefix = np.ascontiguousarray(self.prefix_hashes(codes).T)
        longest, found = min(self.v.longest, length), {}
        for k in range(1, longest + 1):
            if k not in self.tables:
                continue
            keys, pieces, ids, scores = self.tables[k]
            subs = prefix[k:] - prefix[:-k] * self.power[k]
            sorted_keys, first, most = keys
            low = first[subs >> np.uint64(48)]  # where keys of these upper bits begin; most of them share such bits
            hit, at = sorted_keys[low] == subs, low
            for step in range(1, most):
                next_ = sorted_keys[low + step] == subs
                at = np.where(next_, low + step, at)
                hit |= next_
            starts, rows = np.nonzero(hit)
            at = at[starts, rows]
            if k > 1:
                same = codes[rows, starts] == pieces[at, 0]
                for j in range(1, k):
                    same &= codes[rows, starts + j] == pieces[at, j]
                starts, rows, at = starts[same], rows[same], at[same]
            score, piece = np.full(subs.shape, -np.inf), np.full(subs.shape, -1, np.int32)
            score[starts, rows], piece[starts, rows] = scores[at], ids[at]
            found[k] = score, piece
        if 1 not in found:
            found[1] = np.full((length, n), -np.inf), np.full((length, n), -1, np.int32)
        found[1][0][found[1][1] < 0] = self.v.unknown
        best = np.zeros((length + 1, n))
        back, piece = np.zeros((length + 1, n), np.int8), np.full((length + 1, n), -1, np.int32)
        for end in range(1, length + 1):
            top, step, own = np.full(n, -np.inf), np.zeros(n, np.int8), np.full(n, -1, np.int32)
            for k in range(min(longest, end), 0, -1):
                if k in found:
                    total = best[end - k] + found[k][0][end - k]
                    better = total > top
                    np.copyto(top, total, where=better)
                    np.copyto(own, found[k][1][end - k], where=better)
                    step[better] = k
            best[end], back[end], piece[end] = top, step, own
        chosen, place, end, every = np.zeros((n, length), np.int32), np.full(n, length), np.full(n, length), np.arange(n)
        odd = np.zeros(n, bool)
        live = every
        while len(live):
            e = end[live]
            p = piece[e, live]
            odd[live[p < 0]] = True
            place[live] -= 1
            chosen[live, place[live]] = p
            end[live] = e - back[e, live]
            live = live[end[live] > 0]
        data, width = chosen.tobytes(), 4 * length
        out = [data[i * width + 4 * k : (i + 1) * width] for i, k in enumerate(place.tolist())]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.segment_one(group[i])
        return out

    def segment_one(self, word: str) -> bytes:
        """Ids of one word, which is long or has characters without a piece."""
        v, length = self.v, len(word)
        best, back = [0.0] + [float("-inf")] * length, [0] * (length + 1)
        for end in range(1, length + 1):
            for start in range(max(0, end - v.longest), end):
                score = v.scores.get(word[start:end])
                if score is None:
                    if start < end - 1:
                        continue
                    score = v.unknown
                if best[start] + score > best[end]:
                    best[end], back[end] = best[start] + score, start
        ids, end = [], length
        while end:
            piece = word[back[end] : end]
            ids.extend([v.ids[piece]] if piece in v.ids else v.spell(piece)[::-1])
            end = back[end]
        return np.array(ids[::-1], np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids as bytes of int32."""
        split = [None if t is None else words(t) for t in texts]
        fresh = {w for ws in split if ws for w in ws if w not in self.known}
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = {w for ws in split if ws for w in ws}
        by_length: dict[int, list[str]] = {}
        for w in fresh:
            by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            if length > LONG:
                self.known.update((w, self.segment_one(w)) for w in group)
            else:
                for i in range(0, len(group), TOGETHER):
                    self.known.update(zip(group[i : i + TOGETHER], self.segment(group[i : i + TOGETHER], length), strict=True))
        known = self.known
        return [None if ws is None else b"".join([known[w] for w in ws]) for ws in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the pieces, without the space in front."""
        lengths = self.lengths[ids]
        begin = np.cumsum(lengths) - lengths
        at = np.repeat(self.starts[ids] - begin, lengths) + np.arange(lengths.sum())
        return self.bytes[at][1:].tobytes()


def lists(ids: list[bytes | None]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x or b"") // 4 for x in ids])]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join([x for x in ids if x]), np.int32))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([x is None for x in ids]))


@lru_cache(maxsize=2)
def viterbi(path: str) -> Viterbi:
    return Viterbi(path)


def _with(batch: pa.RecordBatch, ids: list[bytes | None], **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, lists(ids), pa.array([len(x or b"") // 4 for x in ids], pa.int64()), *more.values()], names=[*batch.schema.names, "piece_ids", "n_pieces", *more])


def encode(df: DataFrame, text: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """df with piece_ids and n_pieces. The model's path has to be readable on every executor."""
    kept = df.drop("piece_ids", "n_pieces")
    schema = widened(kept, piece_ids="array<int>", n_pieces="long")
    return map_texts(kept, text, lambda batch: _with(batch, viterbi(model).encode(batch.column(text).to_pylist())), schema, 2 << 20, lambda: viterbi(model).known.clear())


def decode(df: DataFrame, ids: str = "piece_ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """df with decoded, the text of the ids. Control and unknown pieces stand for nothing; bytes that are no UTF-8 become U+FFFD."""
    kept = df.drop("decoded")
    schema = widened(kept, decoded="string")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [None if not x.is_valid else viterbi(model).decode(x.values.to_numpy()).decode("utf-8", "replace") for x in part.column(ids)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return kept.mapInArrow(run, schema)


def encode_decode(df: DataFrame, text: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """df with piece_ids, n_pieces and round_trip: whether decoding the ids gives the text again (null for a null text)."""
    kept = df.drop("piece_ids", "n_pieces", "round_trip")
    schema = widened(kept, piece_ids="array<int>", n_pieces="long", round_trip="boolean")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, texts = viterbi(model), batch.column(text).to_pylist()
        ids = own.encode(texts)
        same = [None if t is None else own.decode(np.frombuffer(x, np.int32)) == t.encode() for t, x in zip(texts, ids, strict=True)]
        return _with(batch, ids, round_trip=pa.array(same, pa.bool_()))

    return map_texts(kept, text, run, schema, 2 << 20, lambda: viterbi(model).known.clear())
