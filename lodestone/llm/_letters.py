"""Words of letters in any script and their character n-grams as 64-bit hashes, in numpy over code points.

A word is a run of letters and marks (Unicode categories L and M; with `digits` also N), lower-cased one code point at a time. Long texts are worked
through in pieces, which end at an ASCII character that is no letter or digit, or after LONGEST bytes without one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from ._words import PIECE, buffers, groups, mixed, powers, runs

POINTS = 0x110000
LONGEST = 4 * PIECE


@lru_cache(1)
def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letter, number, lower = np.zeros(POINTS, bool), np.zeros(POINTS, bool), np.arange(POINTS, dtype=np.uint64)
    for i in range(POINTS):
        c = chr(i)
        kind = unicodedata.category(c)[0]
        letter[i], number[i] = kind in "LM", kind == "N"
        if kind in "LN" and len(x := c.lower()) == 1:
            lower[i] = ord(x)
    return letter, letter | number, mixed(lower + np.uint64(0x51ED270B))


def tables(digits: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether it is part of words, and the hash of its lower case."""
    letter, both, hashes = _kinds()
    return both if digits else letter, hashes


def _points(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts raw[at[i]:at[i+1]] and offsets into them; bytes that are no UTF-8 become U+FFFD."""
    whole = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    if before[-1] == len(whole):
        return whole, before[at]
    parts = [np.frombuffer(raw[i:j].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for i, j in zip(at, at[1:], strict=False)]
    return np.concatenate([*parts, np.zeros(0, np.uint32)]), np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)


def _cut(raw: np.ndarray, i: int) -> int:
    """Where a piece of a long text from byte i on ends."""
    if i + PIECE >= len(raw):
        return len(raw)
    ahead = raw[i + PIECE : i + LONGEST]
    letter = ((ahead | 32) >= 97) & ((ahead | 32) <= 122) | (ahead >= 128) | (ahead >= 48) & (ahead <= 57)
    if len(gap := np.flatnonzero(~letter)):
        return i + PIECE + int(gap[0])
    j = min(len(raw), i + LONGEST)
    while j < len(raw) and raw[j] & 0xC0 == 0x80:
        j += 1
    return j


def words_of(texts: pa.Array, digits: bool = False, whole: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts, or pieces of a long one (one run of all its pieces if whole): first and last index, code points, word hashes, starts, ends, and each text's first word (len + 1)."""
    word, hashes = tables(digits)
    raw, at = buffers(texts)
    for i, j in groups(raw, at):
        part, cuts = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        found, k, passed = [], 0, 0
        while True:
            end = _cut(part, k) if j == i + 1 else len(part)
            points, offsets = _points(part[k:end], cuts if j > i + 1 else np.array([0, end - k]))
            h, s, e = runs(hashes[points], word[points], offsets[:-1])
            if whole and j == i + 1:
                found.append((points, h, s + passed, e + passed))
                passed += len(points)
            else:
                yield i, j, points, h, s, e, np.searchsorted(s, offsets)
            k = end
            if k >= len(part):
                break
        if found:
            points, h, s, e = (np.concatenate(x) for x in zip(*found, strict=True))
            yield i, j, points, h, s, e, np.array([0, len(h)])


def pieces(points: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-character substrings of words points[start:end], and the index of each one's word."""
    count = np.maximum(end - start - n + 1, 0)
    word = np.repeat(np.arange(len(start)), count)
    at = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + start[word]
    up, hashes = powers(1 << PIECE.bit_length())[0], tables()[1]
    x = np.full(len(at), n, np.uint64)
    for k in range(n):
        x += hashes[points[at + k]] * up[k]
    return mixed(x), word
