"""Runs of repeated words: stretches of a text that repeat a block of words several times over, and the text without the repeats.

Method (Gusfield and Stoye's for all tandem repeats, on words): LZ blocks of the sequence give, by longest common extensions
at their borders, a set of squares that covers the leftmost ones; walks along suffix links from each, which go on while the next rotation is a square
too, complete the vocabulary of squares; each square's locus is an interval of the suffix array, whose leaves are all its occurrences;
occurrences of one period at consecutive places merge into a run. Only squares of primitive roots are followed, as a run's period is its smallest.
The suffix tree is held as suffix array, common prefixes and their minima over powers of two; the ranks of doubled prefixes, from which
the array is sorted, answer extensions to both sides.

The sequences worked on are the parts of a text in which a run can lie at all. A run of period q and length l repeats its grams of w <= q words at
distance q over l - q - w + 1 places, so places whose gram occurred at most D words before must follow each other for as long as the shortest such run
with q <= D; the test is made for each power of two D, whole texts at a time. It loses nothing, and the words of such a part are compared by their bytes.

Results for odd input: a null, empty or blank text has no runs and an empty collapsed text; ids may be null or repeat, every row has its own result;
other columns are not looked at. A text is one task's work, in memory of some 100 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._words import mixed, texts_of

#: Runs have this length over their period and this many words at least.
EXPONENT, SHORTEST = 4, 6
_SPACES = r"[\x20\x09-\x0D]+"
_OWN = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.zeros((0, 3), np.int64)


class Suffixes:
    """Suffix array of a sequence of whole numbers, with common extensions to both sides and loci."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = self.n = len(symbols)
        self.ranks = [np.unique(symbols, return_inverse=True)[1]]
        while self.ranks[-1].max() < n - 1:
            last, step = self.ranks[-1], 1 << (len(self.ranks) - 1)
            after = np.zeros(n, np.int64)
            after[:-step] = last[step:] + 1
            self.ranks.append(np.unique(last * (n + 1) + after, return_inverse=True)[1])
        self.place = self.ranks[-1]
        self.array = np.argsort(self.place)
        self.least = [self.ahead(self.array[:-1], self.array[1:])]
        while 2 << (len(self.least) - 1) < n:
            last, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-step], last[step:]))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of the suffixes at i and j, which differ."""
        length, end = np.zeros(len(i), np.int64), self.n - np.maximum(i, j)
        for k in range(len(self.ranks) - 1, -1, -1):
            can = np.flatnonzero(length < end)
            at = length[can]
            length[can] += (self.ranks[k][i[can] + at] == self.ranks[k][j[can] + at]).astype(np.int64) << k
        return length

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common suffixes of what ends at i and at j, themselves included."""
        length, start = np.zeros(len(i), np.int64), np.minimum(i, j)
        for k in range(len(self.ranks) - 1, -1, -1):
            can = np.flatnonzero(length + (1 << k) <= start + 1)
            at = length[can] + (1 << k) - 1
            length[can] += (self.ranks[k][i[can] - at] == self.ranks[k][j[can] - at]).astype(np.int64) << k
        return length

    def loci(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last index in the suffix array of the suffixes that begin as start does for length."""
        low, high = self.place[start].copy(), self.place[start].copy()
        for k in range(len(self.least) - 1, -1, -1):
            step, least = 1 << k, self.least[k]
            can = np.flatnonzero(low >= step)
            low[can] -= step * (least[low[can] - step] >= length[can])
            can = np.flatnonzero(high + step < self.n)
            high[can] += step * (least[high[can]] >= length[can])
        return low, high

    def blocks(self) -> np.ndarray:
        """Starts of the LZ blocks, and n: each is the longest stretch that also begins earlier, or one new symbol."""
        before, after, open_ = [-1] * self.n, [-1] * self.n, []
        for p in self.array.tolist():  # nearest smaller positions to both sides hold the longest earlier match
            while open_ and open_[-1] > p:
                after[open_.pop()] = p
            before[p] = open_[-1] if open_ else -1
            open_.append(p)
        here, longest = np.arange(self.n), np.zeros(self.n, np.int64)
        for other in (np.array(before), np.array(after)):
            has = np.flatnonzero(other >= 0)
            longest[has] = np.maximum(longest[has], self.ahead(here[has], other[has]))
        starts, longest = [0], longest.tolist()
        while starts[-1] < self.n:
            starts.append(starts[-1] + max(1, longest[starts[-1]]))
        return np.array(starts)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each of counts' items, and 0.. within it."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def _covering(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares, among them the leftmost of each stretch of squares around the border of a block."""
    starts = s.blocks()
    size = np.diff(starts)
    found = []
    for border, reach, side in ((starts[1:-1], size[:-1], -1), (starts[:-1], size + np.append(size[1:], 0), 1)):
        of, k = _spread(reach)
        k = k + 1
        h = border[of]
        q = h + side * k
        ok = (q >= 0) & (q < s.n)
        h, q, k = h[ok], q[ok], k[ok]
        right, left = s.ahead(h, q), np.zeros(len(h), np.int64)
        inner = np.flatnonzero(np.minimum(h, q) > 0)
        left[inner] = s.behind(h[inner] - 1, q[inner] - 1)
        first = np.minimum(h, q)
        ok = (right > 0) & (right + left >= k)
        found.append((np.maximum(first - left, first - k + 1)[ok], k[ok]))
    start, period = (np.concatenate(x) for x in zip(*found, strict=True))
    return start, period


def _primitive(s: Suffixes, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the root of each square is no power: for no prime divisor r of its length does it have the period length / r."""
    most = int(period.max(initial=1))
    least = np.arange(most + 1)
    for d in range(2, int(most**0.5) + 1):
        if least[d] == d:
            least[d * d :: d] = np.minimum(least[d * d :: d], d)
    out, rest = np.ones(len(start), bool), period.copy()
    while (open_ := np.flatnonzero(rest > 1)).size:
        r = least[rest[open_]]
        part = period[open_] // r
        out[open_] &= s.ahead(start[open_], start[open_] + part) < period[open_] - part
        while (more := rest[open_] % r == 0).any():
            rest[open_[more]] //= r[more]
    return out


def runs(symbols: np.ndarray, exponent: float = EXPONENT, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (start, length, period) of the maximal repetitions of a sequence whose length is at least max(shortest, exponent * period), exponent at least 2; by start and period."""
    if len(symbols) < 2:
        return _EMPTY
    s = Suffixes(symbols)
    start, period = _covering(s)
    ok = _primitive(s, start, period)
    start, period = start[ok], period[ok]
    end = start + s.ahead(start, start + period) - period + 1  # where the walk from the square ends
    order = np.lexsort((start, end, period))
    start, period, end = start[order], period[order], end[order]
    first = np.ones(len(start), bool)  # a walk that meets one before ends where that does
    first[1:] = (period[1:] != period[:-1]) | (end[1:] != end[:-1])
    of, step = _spread((end - start)[first])
    at, period = start[first][of] + step, period[first][of]
    low, high = s.loci(at, 2 * period)
    _, one = np.unique(low * (2 * s.n + 1) + 2 * period, return_index=True)  # a row for each word of the vocabulary
    of, step = _spread((high - low + 1)[one])
    found = np.unique(period[one][of] * s.n + s.array[low[one][of] + step])
    period, at = found // s.n, found % s.n
    new = np.ones(len(found), bool)
    new[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(found) - 1) if len(found) else np.zeros(0, np.int64)
    out = np.stack([at[new], at[last] - at[new] + 2 * period[new], period[new]], 1)
    out = out[(out[:, 1] >= shortest) & (out[:, 1] >= exponent * out[:, 2])]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _shortest_repeat(low: int, high: int, exponent: float, shortest: int) -> int:
    """Least length without its first period of a run with a period in low..high."""
    turn = shortest / exponent
    return min(int(np.ceil(max(shortest, exponent * q))) - q for q in {low, high, *(min(max(low, int(x)), high) for x in (turn, turn + 1))})


def parts(words: np.ndarray, first: np.ndarray, exponent: float, shortest: int) -> list[tuple[int, int, int]]:
    """(text, start, end) of the stretches of word hashes in which runs can lie; text k is words[first[k]:first[k + 1]]."""
    n, size = len(words), int(np.diff(first).max(initial=0))
    if n < shortest:
        return []
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    gram, w, found, d, far = mixed(words + (text.astype(np.uint64) + np.uint64(1)) * _OWN), 1, [], 1, None
    while d * exponent < 2 * size:
        low = d // 2 + 1
        while 2 * w <= min(low, 8):
            grown = gram.copy()
            grown[:-w] = mixed(gram[:-w] * np.uint64(3) + gram[w:])
            grown[-w:] = mixed(gram[-w:] + np.arange(1, w + 1, dtype=np.uint64))
            gram, w = grown, 2 * w
        if d <= 8:
            near = np.zeros(n, bool)
            for q in range(1, min(d, n - 1) + 1):
                near[q:] |= gram[q:] == gram[:-q]
            at = np.flatnonzero(near)
        else:
            if far is None:  # distance to the same gram before, of grams that have one
                order = np.argsort(gram, kind="stable")
                same = np.flatnonzero(gram[order[1:]] == gram[order[:-1]])
                place = order[same + 1]
                by = np.argsort(place)
                place, far = place[by], (place - order[same])[by]
            at = place[far <= d]
        if len(at):
            begin = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
            long = np.diff(np.append(begin, len(at)))
            enough = long >= _shortest_repeat(low, d, exponent, shortest) - w + 1
            start = at[begin[enough]]
            k = text[start]
            found.append(np.stack([k, np.maximum(start - d, first[k]), np.minimum(start + long[enough] + w - 1, first[k + 1])], 1))
        d *= 2
    if not found:
        return []
    found, out = np.concatenate(found), []
    for k, a, b in found[np.lexsort((found[:, 1],))].tolist():
        if out and out[-1][0] == k and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([k, a, b])
    return [tuple(x) for x in out]


def _in_batch(texts: pa.Array, exponent: float, shortest: int) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of each text."""
    found: list[np.ndarray] = [_EMPTY] * len(texts)
    changed: dict[int, str] = {}
    for i, _, raw, h, s, e, first in texts_of(texts):
        by_text: dict[int, list[np.ndarray]] = {}
        for k, a, b in parts(h, first, exponent, shortest):
            ids: dict[bytes, int] = {}
            symbols = np.array([ids.setdefault(raw[x:y].tobytes(), len(ids)) for x, y in zip(s[a:b], e[a:b], strict=True)])
            if len(got := runs(symbols, exponent, shortest)):
                by_text.setdefault(k, []).append(got + [a - first[k], 0, 0])
        for k, some in by_text.items():
            own = np.concatenate(some)
            found[i + k] = own[np.lexsort((own[:, 2], own[:, 0]))]
            a, b = first[k], first[k + 1]
            edge = np.zeros(b - a + 1, np.int64)
            np.add.at(edge, own[:, 0] + own[:, 2], 1)
            np.add.at(edge, own[:, 0] + own[:, 1], -1)
            keep = a + np.flatnonzero(np.cumsum(edge)[:-1] == 0)
            changed[i + k] = b" ".join(raw[x:y].tobytes() for x, y in zip(s[keep], e[keep], strict=True)).decode()
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    rows = np.concatenate([_EMPTY, *found])
    spans = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], ["start", "length", "period"])
    plain = pc.utf8_trim(pc.replace_substring_regex(pc.fill_null(texts.cast(pa.string()), ""), _SPACES, " "), " ")
    if changed:
        mask = np.zeros(len(texts), bool)
        mask[sorted(changed)] = True
        plain = pc.replace_with_mask(plain, pa.array(mask), pa.array([changed[k] for k in sorted(changed)], pa.string()))
    return pa.ListArray.from_arrays(pa.array(offsets), spans), plain


def repetitions(docs: DataFrame, exponent: float = EXPONENT, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed): runs (start, length, period) in words from 0, of at least `exponent` periods and `shortest` words, by start and
    period; collapsed: the words joined by one space without those that a run holds after its first period."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), *_in_batch(batch.column("text"), exponent, shortest)], ["id", "runs", "collapsed"])

    out = rows.mapInArrow(found, f"id {kind}, runs array<struct<start bigint, length bigint, period bigint>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def collapsed(docs: DataFrame, exponent: float = EXPONENT, shortest: int = SHORTEST, text_col: str = "text") -> DataFrame:
    """docs with every text that holds runs in its collapsed form; texts without runs and nulls stay as they are."""
    names = docs.columns
    at = names.index(text_col)

    def shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            spans, plain = _in_batch(texts, exponent, shortest)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pc.if_else(pc.greater(pc.list_value_length(spans), 0), plain, texts.cast(pa.string())), *batch.columns[at + 1 :]], names)

    return docs.mapInArrow(shorter, docs.schema)
