"""Language identification, word first with back-off to shorter and shorter letter n-grams.

Method: a word that the model knows scores by its log frequency in each language. A word that it doesn't
know falls back to its pieces of 5 characters, averaged over those that are known, then of 4, and so on to
single characters. A text's languages are compared by the sum over its words. Words are runs of letters and marks of
any script, lower-cased; each count is smoothed by a share of the whole.

The fit takes at most 1.25 * SAMPLE distinct rows (picked by a hash of text and language) with text and language outside the held-out fold to the
driver and keeps the MOST most frequent entries of each length, which bounds the model; what it leaves
out is met by the back-off. Every row is scored, whole. A text that is null or has no letter is `und` with
score 0, and so is every text where there is no row to learn from. Ties go to the language that comes first by code point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ._fit import fetched, hash_sample, held_out
from ._letters import pieces, words_of

SAMPLE = 6000
MOST = 1 << 17
LENGTHS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def _summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows."""
    if not len(keys):
        return keys, rows
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(rows[order], first, axis=0)


class Model:
    """tables: for words, then each of LENGTHS, sorted hashes and their log frequencies by language."""

    def __init__(self, languages: list[str], tables: list[tuple[np.ndarray, np.ndarray]]):
        self.languages, self.tables = languages, tables

    def word_rows(self, points, h, start, end) -> np.ndarray:
        """Log frequencies of words by language; zeros where not even a character is known."""
        out = np.zeros((len(h), len(self.languages)))
        known, table = self.tables[0]
        at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        hit = known[at] == h if len(known) else np.zeros(len(h), bool)
        out[hit] = table[at[hit]]
        open_ = np.flatnonzero(~hit)
        for n, (known, table) in zip(LENGTHS, self.tables[1:], strict=True):
            if not len(open_) or not len(known):
                continue
            g, word = pieces(points, start[open_], end[open_], n)
            at = np.minimum(np.searchsorted(known, g), len(known) - 1)
            hit = known[at] == g
            count = np.bincount(word[hit], minlength=len(open_))
            some = count > 0
            for k in range(len(self.languages)):
                total = np.bincount(word[hit], table[at[hit], k], len(open_))
                out[open_[some], k] = total[some] / count[some]
            open_ = open_[~some]
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        for i, j, points, h, start, end, first in words_of(texts):
            if not len(h):
                continue
            distinct, some, which = np.unique(h, return_index=True, return_inverse=True)
            rows = self.word_rows(points, distinct, start[some], end[some])
            text = np.repeat(np.arange(j - i), np.diff(first))
            for k in range(len(self.languages)):
                out[i:j, k] += np.bincount(text, rows[which, k], j - i)
        return out


def fit(texts: pa.Array, languages: list[str], most: int = MOST) -> Model:
    names = sorted(set(languages))
    mine = np.array([names.index(x) for x in languages], np.int64)
    found: list[list] = [[] for _ in range(len(LENGTHS) + 1)]

    def add(k, keys, rows):
        found[k].append(_summed(keys, rows))
        if len(found[k]) > 40:
            found[k] = [_summed(*(np.concatenate(x) for x in zip(*found[k], strict=True)))]

    for i, _, points, h, start, end, first in words_of(texts):
        if not len(h):
            continue
        one = np.eye(len(names), dtype=np.float32)[mine[i + np.repeat(np.arange(len(first) - 1), np.diff(first))]]
        distinct, some, which = np.unique(h, return_index=True, return_inverse=True)
        rows = np.stack([np.bincount(which, one[:, k], len(distinct)) for k in range(len(names))], 1).astype(np.float32)
        add(0, distinct, rows)
        for k, n in enumerate(LENGTHS, 1):
            g, word = pieces(points, start[some], end[some], n)
            add(k, g, rows[word])
    tables = []
    for k, parts in enumerate(found):
        if not parts:
            tables.append((np.zeros(0, np.uint64), np.zeros((0, len(names)), np.float32)))
            continue
        keys, rows = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        if not k:  # a word met once says less than its pieces
            keys, rows = keys[rows.sum(1) > 1], rows[rows.sum(1) > 1]
        total = rows.sum(0) + 1
        top = np.sort(np.lexsort((keys, -rows.sum(1)))[:most])
        keys, rows = keys[top], rows[top]
        share = (rows.sum(1, keepdims=True) + 1) / total.sum()
        tables.append((keys, np.log((rows + 2 * share) / (total + 2)).astype(np.float32)))
    return Model(names, tables)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    got = fetched(hash_sample(rows.select("text", "lang"), ["text", "lang"], sample, rows.count()).sort("text", "lang"))
    return fit(got["text"].combine_chunks(), got["lang"].to_pylist()) if len(got) else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row; score: the language's share among all by likelihood a word."""
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.languages, model.tables))

    def run(batches):
        own = None if shared.value is None else Model(*shared.value)
        for b in batches:
            texts = b.column("text")
            spoken = np.array([x is not None and bool(_LETTER.search(x)) for x in map(pa.StringScalar.as_py, texts)], bool)
            if own is None:
                names, p = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            else:
                z = own.scores(texts)
                best = z.argmax(1)
                e = np.exp(z - z.max(1, keepdims=True))
                p = np.where(spoken, e[np.arange(len(z)), best] / e.sum(1), 0.0)
                names = [own.languages[k] if s else UNKNOWN for k, s in zip(best.tolist(), spoken.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(p)], ["id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def language(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs))
