"""Token counts by a count-only Viterbi (see pieces.py for the segmentation rule).

An Aho-Corasick automaton over the vocabulary lists the pieces that end at each character; dynamic programming carries the best score and the
number of pieces of the best segmentation, and no backpointers. Ties are the tokenizer's: matches are tried from the longest, and a later
one has to be strictly better. Each task keeps the counts of REMEMBERED words at most; forgetting them changes nothing but the time.

Defined cases: a null or empty text has 0 tokens; a text of any length is counted whole; repeated rows are counted one by one; other columns
are kept, and a column named like the result column is replaced.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, widened
from .pieces import DEFAULT_MODEL, vocabulary, words

REMEMBERED = 300_000


class Counter:
    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.v.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.known: dict[str, int] = {}

    def count_word(self, word: str) -> int:
        v, length = self.v, len(word)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(length + 1)]
        for last, match in self.automaton.iter(word):
            ending[last + 1].append(match)
        best, count = [0.0] * (length + 1), [0] * (length + 1)
        for end in range(1, length + 1):
            matches = sorted(ending[end], reverse=True)
            top, pieces = float("-inf"), 0
            for k, score in matches:
                if best[end - k] + score > top:
                    top, pieces = best[end - k] + score, count[end - k] + 1
            if (not matches or matches[-1][0] > 1) and best[end - 1] + v.unknown > top:
                top, pieces = best[end - 1] + v.unknown, count[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
            best[end], count[end] = top, pieces
        return count[length]

    def count(self, text: str | None) -> int:
        ws, known = words(text), self.known
        if len(known) > REMEMBERED:
            known.clear()
        total = 0
        for w in ws:
            n = known.get(w)
            if n is None:
                n = known[w] = self.count_word(w)
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_count(df: DataFrame, text: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """df with n_tokens. The model's path has to be readable on every executor."""
    kept = df.drop("n_tokens")
    schema = widened(kept, n_tokens="long")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = counter(model)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([own.count(t) for t in batch.column(text).to_pylist()], pa.int64())], names=[*batch.schema.names, "n_tokens"])

    return map_texts(kept, text, run, schema, done=lambda: counter(model).known.clear())
