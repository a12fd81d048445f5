"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders, so that a question with other parameters has the same template. Windows of WINDOW template tokens,
of which LITERALS at least are words, are hash-joined with those of the benchmark items in three readings: names are slots but where they open a sentence or line, names are
slots everywhere, and names are words whatever their case. One window in common puts an item on trial: its tokens are aligned with the document's, on one shift or, with gaps, by the
windows on shifts close together. A document leaks an item when COVER of the item's tokens agree, LITERALS words among them, and the slots agree: each value of the item stands for
one value of the document, and the other way round. A name is a capitalised word, in a passage without capitals any word; a unit is a unit's word behind a number.

An item without a window of enough words (numbers, one or two words) is leaked where its whole token sequence, values and operators included and case not, is in the document;
one of one or two tokens, which ordinary sentences hold, where it is a sentence or line of its own.

Defined cases: null and empty texts leak nothing; an item shorter than a window is one window of its own length; repeated rows are judged one by one; between two alignments that
match equally well the first counts; empty tables give an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import string
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, map_texts, mix
from .shingles import PLACE

WINDOW, LITERALS, COVER = 5, 3, 0.8
#: Bytes of benchmark text that one pass holds on every executor; a larger benchmark takes more passes.
PASS_BYTES = 16 << 20
REMEMBERED = 200_000
TOKEN = re.compile(r"\S+|\n")
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
# Words taken for units behind a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g gram grams kg kilograms t ton tons lb lbs pound pounds oz ounce ounces "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent % dollar dollars euro euros cent cents usd eur hz khz mhz ghz w kw v a j n pa k c f degrees degree kb mb gb tb meter meters metre metres mph kph".split()
)
PUNCTUATION = string.punctuation + "“”‘’«»„…–—¿¡·"
CLOSERS, AROUND_NUMBERS = "\"')]}”’»*#", "\"'()[]{}*#!?;,."
AROUND_WHOLE = "\"'“”‘’«»!?;:,."
WORD, NUM, UNIT, CAPITAL, NOTHING, LINE = range(6)
SLOT = {kind: int(mix(np.array([kind + 7], np.uint64))[0]) for kind in (NUM, UNIT, CAPITAL)}


class Templates(NamedTuple):
    """Of all texts on end; offsets tell where each begins (with the end)."""

    readings: list[tuple[np.ndarray, np.ndarray]]  # codes, and whether each is a slot; the last one's names are words
    words: np.ndarray
    value: np.ndarray  # numbers and units
    capital: np.ndarray
    opens: np.ndarray
    at: np.ndarray  # numbers of the tokens
    offsets: np.ndarray
    whole: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # all tokens with operators: hashes, whether they open or close a sentence or line, offsets


class Canon:
    """Templates of texts. Remembers tokens, REMEMBERED at most."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.cores: list[str] = []
        self.fresh: list[tuple[int, int, bool, int]] = []  # of tokens that the columns lack: hash, kind, whether a sentence ends, hash with operators and signs
        self.columns = [np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool), np.zeros(0, np.uint64)]

    def learn(self, token: str) -> None:
        plain = token.isalpha()
        bare = token if plain else token.strip(PUNCTUATION)
        core, ends = bare.lower(), False
        if not plain:
            ends = token == "\n" or token.rstrip(CLOSERS).endswith((".", "!", "?", ":"))
        if token == "\n":
            kind, core = LINE, ""
        elif not plain and NUMBER.fullmatch(token.strip(AROUND_NUMBERS)):
            kind, core = NUM, core or token
        elif not core:
            kind = NOTHING
        elif core in UNITS:
            kind = UNIT
        else:
            kind = CAPITAL if bare[0].isupper() else WORD
        whole = "" if kind == LINE else core if plain else token.strip(AROUND_WHOLE).lower()
        self.known[token] = len(self.cores)
        self.cores.append(core)
        self.fresh.append((xxhash.xxh3_64_intdigest(core.encode("utf-8", "surrogatepass")), kind, ends, xxhash.xxh3_64_intdigest(whole.encode("utf-8", "surrogatepass")) | 1 if whole else 0))

    def numbers(self, text: str) -> np.ndarray:
        tokens = TOKEN.findall(text)
        try:
            return np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            for t in tokens:
                if t not in self.known:
                    self.learn(t)
            return np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))

    def templates(self, texts: list[str]) -> Templates:
        if len(self.known) > REMEMBERED:
            self.__init__()
        each = [self.numbers(t) for t in texts]
        offsets = np.cumsum([0, *map(len, each)])
        at = np.concatenate([*each, np.zeros(0, np.int64)])
        if self.fresh:
            self.columns = [np.concatenate([c, np.array([f[j] for f in self.fresh], c.dtype)]) for j, c in enumerate(self.columns)]
            self.fresh = []
        codes, kinds, ends, whole = (c[at] for c in self.columns)
        opens = np.ones(len(at), bool)
        opens[1:] = ends[:-1]
        begins = offsets[:-1][np.diff(offsets) > 0]
        opens[begins] = True
        some = whole != 0
        closes = np.ones(len(at), bool)
        closes[:-1] = opens[1:] | (kinds[1:] == LINE)
        whole_parts = whole[some], opens[some], closes[some], np.concatenate([[0], np.cumsum(some)])[offsets]
        use = kinds < NOTHING
        offsets = np.concatenate([[0], np.cumsum(use)])[offsets]
        codes, kinds, opens, at = codes[use], kinds[use], opens[use], at[use]
        behind = np.zeros(len(at), bool)
        behind[1:] = kinds[:-1] == NUM
        behind[offsets[:-1][np.diff(offsets) > 0]] = False
        words = codes.copy()
        value = np.zeros(len(codes), bool)
        for kind, here in ((NUM, kinds == NUM), (UNIT, (kinds == UNIT) & behind)):
            codes[here] = SLOT[kind]
            value |= here
        capital = kinds == CAPITAL
        inner, every = codes.copy(), codes.copy()
        inner[capital & ~opens] = every[capital] = SLOT[CAPITAL]
        return Templates([(inner, value | (capital & ~opens)), (every, value | capital), (codes, value)], words, value, capital, opens, at, offsets, whole_parts)

    @staticmethod
    def windows(codes: np.ndarray, slot: np.ndarray, offsets: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows, and which lie in one text and have enough words."""
        n = len(codes) - w + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = np.full(n, w, np.uint64)
        for j in range(w):
            h += codes[j : j + n] * PLACE[j]
        words = np.concatenate([[0], np.cumsum(~slot)])
        last = np.repeat(offsets[1:], np.diff(offsets))[:n]
        return mix(h ^ np.uint64(GOLDEN)), (words[w:] - words[:-w] >= LITERALS) & (np.arange(n) + w <= last)


class Index:
    """Entries by hashes of windows of one size."""

    def __init__(self, entries: dict[int, list]):
        self.keys, self.entries = np.array(sorted(entries), np.uint64), dict(entries)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True

    def near(self, h: np.ndarray, use: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.maybe[h >> np.uint64(44)] & use)
        return at[np.isin(h[at], self.keys)]


class Benchmark:
    def __init__(self, items: list[tuple[int, str]]):
        canon = Canon()
        self.items, self.exact = {}, {}
        where, whole = defaultdict(lambda: defaultdict(list)), defaultdict(lambda: defaultdict(list))
        for number, (item, text) in enumerate(items):
            t = canon.templates([text])
            w = min(WINDOW, len(t.words))
            found = False
            for r, (codes, slot) in enumerate(t.readings):
                if w < LITERALS:
                    break
                h, use = canon.windows(codes, slot, t.offsets, w)
                found |= bool(use.any())
                for q in np.flatnonzero(use).tolist():
                    where[r, w][int(h[q])].append((number, q))
            if found:
                self.items[number] = item, w, t.readings[2][0], t.value, t.capital, t.opens, [canon.cores[i] for i in t.at]
            elif n := len(t.whole[0]):
                self.exact[number] = item, t.whole[0]
                w = min(WINDOW, n)
                whole[w][int(canon.windows(t.whole[0], np.zeros(n, bool), t.whole[3], w)[0][0])].append(number)
        self.by_size = {k: Index(x) for k, x in where.items()}
        self.by_whole = {w: Index(x) for w, x in whole.items()}

    def leaks(self, texts: list[str], canon: Canon) -> list[list[tuple[int, float, bool, int]]]:
        """For each text: item, cover, whether all values are the item's, and how many values there are."""
        t = canon.templates(texts)
        hits: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        for (r, w), index in self.by_size.items():
            h, use = canon.windows(*t.readings[r], t.offsets, w)
            near = index.near(h, use)
            for p, i in zip(near.tolist(), (np.searchsorted(t.offsets, near, "right") - 1).tolist(), strict=True):
                for number, q in index.entries[int(h[p])]:
                    hits[i][number].add((p - int(t.offsets[i]), q))
        out: list[list[tuple[int, float, bool, int]]] = [[] for _ in texts]
        for i, own in hits.items():
            a, b = t.offsets[i], t.offsets[i + 1]
            out[i] = self.confirmed(own, t.readings[2][0][a:b], t.value[a:b], t.capital[a:b], [canon.cores[k] for k in t.at[a:b].tolist()])
        whole, opens, closes, offsets = t.whole
        found = set()
        for w, index in self.by_whole.items():
            h, _ = canon.windows(whole, np.zeros(len(whole), bool), offsets, w)
            for p in index.near(h, np.ones(len(h), bool)).tolist():
                i = int(np.searchsorted(offsets, p, "right")) - 1
                for number in index.entries[int(h[p])]:
                    item, own = self.exact[number]
                    end = p + len(own)
                    if end <= offsets[i + 1] and np.array_equal(whole[p:end], own) and (len(own) >= LITERALS or (opens[p] and closes[end - 1])):
                        found.add((i, number))
        for i, number in sorted(found):
            out[i].append((self.exact[number][0], 1.0, True, 0))
        return out

    def confirmed(self, hits: dict[int, set[tuple[int, int]]], codes: np.ndarray, value: np.ndarray, capital: np.ndarray, words: list[str]) -> list[tuple[int, float, bool, int]]:
        found = []
        for number, pairs in hits.items():
            item, w, own, values, names, opens, cores = self.items[number]
            n = len(own)
            by_shift: dict[int, list[int]] = defaultdict(list)
            for p, q in sorted(pairs):
                by_shift[p - q].append(q)
            shifts, reach, best = sorted(by_shift), max(w, int((1 - COVER) * n)), None
            inner = {cores[q] for q in np.flatnonzero(names & ~opens).tolist()}
            for gaps in (False, True):
                for base in shifts:
                    if not gaps:
                        places = np.arange(n) + base
                        places[(places < 0) | (places >= len(codes))] = -1
                    else:
                        near = sorted((s for s in shifts if abs(s - base) <= reach), key=lambda s: abs(s - base))
                        if len(near) == 1:
                            continue
                        places = np.full(n, -1)
                        for s in near:
                            for q in by_shift[s]:
                                part = places[q : q + w]
                                part[part < 0] = np.arange(q, q + w)[part < 0] + s
                    here = np.flatnonzero(places >= 0)
                    p = places[here]
                    same = codes[p] == own[here]
                    word = ~values[here] & ~value[p]
                    caseless = not capital[p].any()
                    agree = same | (names[here] & word & (capital[p] | caseless))
                    cover = int(agree.sum()) / n
                    plain = int((same & word & ~(names[here] & ~opens[here] & capital[p])).sum())
                    if cover < COVER or (best and cover <= best[0]):
                        continue
                    if plain < LITERALS and not (same & ~values[here]).sum() == (~values).sum():
                        continue
                    forth, back = defaultdict(set), defaultdict(set)
                    for k in np.flatnonzero(agree & (values[here] | names[here])).tolist():
                        q, x, y = here[k], cores[here[k]], words[p[k]]
                        if own[q] == SLOT[NUM] and q + 1 < n and own[q + 1] == SLOT[UNIT] and p[k] + 1 < len(words):  # equal numbers of different units are different values
                            x, y = (x, cores[q + 1]), (y, words[p[k] + 1])
                        if values[q] or x != y or not opens[q] or x in inner:
                            forth[x].add(y), back[y].add(x)
                    if all(len(x) == 1 for x in (*forth.values(), *back.values())):
                        best = cover, all(x in y for x, y in forth.items()), len(forth)
            if best:
                found.append((item, *best))
        return found


_held: list[Canon] = []  # of the running task


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, cover, same_values, n_values) for each document and each item that it leaks."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, cover double, same_values boolean, n_values int"
    items = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-total // PASS_BYTES)
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    out = None
    for k in range(passes):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).toPandas().sort_values(["item_id", "text"])
        held = spark.sparkContext.broadcast(Benchmark(list(block.itertuples(index=False, name=None))))

        def run(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            found = held.value.leaks(batch.column("text").to_pylist(), _canon())
            rows = [(i, *x) for i, own in zip(batch.column("doc_id").to_pylist(), found, strict=True) for x in own]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int32()), strict=True)], names=["doc_id", "item_id", "cover", "same_values", "n_values"])

        own = map_texts(docs, "text", run, schema, 2 << 20, _forget)
        out = own if out is None else out.union(own)
    return out if out is not None else spark.createDataFrame([], schema)


def _canon() -> Canon:
    if not _held:
        _held.append(Canon())
    return _held[0]


def _forget() -> None:
    _held.clear()
