"""Word shingles of whole texts as sets of 64-bit hashes, computed over UTF-8 bytes by numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. A set holds the distinct k-word
shingles of a text; with fewer words, the whole sequence as one; without words or without text, nothing. Two different
shingles of two texts of n shingles each have one hash with a chance of n * n / 2^64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import GOLDEN, mix

#: Texts are taken in slices of about so many bytes, as each byte takes some 60 bytes of memory for a moment.
SLICE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256)
_lower[ord("A") : ord("Z") + 1] += 32
BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(GOLDEN))[_lower] | np.uint64(1)
BYTE[SPACE] = 0
POWER = np.uint64(0x9E3779B185EBCA87)
INVERSE = np.uint64(pow(int(POWER), -1, 1 << 64))
PLACE = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(GOLDEN)) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE + SLICE // 2)
        for name, base in (("up", POWER), ("down", INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
        if n > 2 * SLICE:  # of a very long text; not kept
            return _powers.pop("up"), _powers.pop("down")
    return _powers["up"], _powers["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, from 0, and bytes of a string column; a null is empty."""
    column = column.fill_null("")
    if column.type not in (pa.large_string(), pa.large_binary()):
        column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and for each text the place of its first word (with the end)."""
    offsets, data = buffers(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    borders = offsets[:-1][offsets[:-1] < len(data)]
    first[borders] = word[borders]
    starts = np.flatnonzero(first)
    up, down = powers(len(data))
    terms = BYTE[data]
    terms *= up[: len(data)]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    ends = np.append(starts[1:], len(data))  # spaces add nothing
    return mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    words, at = word_hashes(column)
    n = len(words)
    full = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        full += words[j : n - k + 1 + j] * PLACE[j] if n >= k else np.uint64(0)
    full = mix(full + np.uint64(k))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(full[a : b - k + 1]))
        elif b > a:
            out.append(mix(np.array([(words[a:b] * PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
