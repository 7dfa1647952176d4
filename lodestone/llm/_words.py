"""Words and word n-grams of whole Arrow text columns as 64-bit hashes, in numpy.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r; A-Z count as a-z. A text is
worked through in pieces of a few MB that end at white space, so memory does not grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 17
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_STEP = _RNG.integers(0, 2**63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
GRAM = 5


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(values: np.ndarray, solid: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each run of solid values; a run also ends at each of cuts (starts of texts)."""
    if not len(values) or not solid.any():
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(values))]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = 1 << max(PIECE.bit_length(), int(len(values)).bit_length())
    up, down = powers(size)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _LENGTH), start, end


def _piece(raw: np.ndarray, cuts: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of raw."""
    return runs(_BYTE[raw], ~space[raw], cuts)


def letters_only() -> np.ndarray:
    """Separators for words of letters: every ASCII byte that is no letter."""
    space = np.zeros(256, bool)
    space[:128] = [not chr(i).isalpha() for i in range(128)]
    return space


def pieces_of(raw: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-byte substrings of words raw[start:end], and the index of each one's word."""
    count = np.maximum(end - start - n + 1, 0)
    word = np.repeat(np.arange(len(start)), count)
    at = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + start[word]
    up = powers(1 << PIECE.bit_length())[0]
    x = np.full(len(at), n, np.uint64)
    for k in range(n):
        x += _BYTE[raw[at + k]] * up[k]
    return mixed(x), word


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and len + 1 offsets into them; null is empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def groups(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about PIECE bytes; a longer text is a run of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def hashed(raw: np.ndarray, at: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts raw[at[i]:at[i+1]]: word hashes, word starts and ends in raw, and each text's first word (len + 1)."""
    if len(at) != 2 or len(raw) <= 2 * PIECE:
        h, s, e = _piece(raw, at[:-1], space)
        return h, s, e, np.searchsorted(s, at)
    out, i = [], 0
    while i < len(raw):
        j = min(len(raw), i + PIECE)
        while j < len(raw):  # on to the next white space
            gap = np.flatnonzero(space[raw[j : j + 65536]])
            j = j + int(gap[0]) if len(gap) else min(len(raw), j + 65536)
            if len(gap):
                break
        h, s, e = _piece(raw[i:j], np.zeros(0, np.int64), space)
        out.append((h, s + i, e + i))
        i = j
    h, s, e = (np.concatenate(x) for x in zip(*out, strict=True))
    return h, s, e, np.array([0, len(h)])


def texts_of(texts: pa.Array, space: np.ndarray = _SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts: first and last index, their bytes, word hashes, starts, ends, and each text's first word."""
    raw, at = buffers(texts)
    for i, j in groups(raw, at):
        part = raw[at[i] : at[j]]
        yield i, j, part, *hashed(part, at[i : j + 1] - at[i], space)


def grams(words: np.ndarray) -> np.ndarray:
    """Hashes of the 5-word shingles of one text; fewer words are one shingle; no words, none."""
    n = len(words)
    if not n:
        return words
    k = min(n, GRAM)
    x = words[: n - k + 1] * _STEP[0]
    for i in range(1, k):
        x = x + words[i : n - k + 1 + i] * _STEP[i]
    return mixed(x + np.uint64(k))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for i, j, _, h, _, _, first in texts_of(texts):
        for k in range(j - i):
            g = grams(h[first[k] : first[k + 1]])
            g.sort()
            yield g[np.concatenate(([True], g[1:] != g[:-1]))] if len(g) > 1 else g
