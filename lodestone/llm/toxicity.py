"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy.

Method: a word, a run of letters and digits, is the bag of its own hash and of its character n-grams (3 to 5, those at its beginning
apart), so that an unseen spelling shares most vectors with the known one. The vectors of a window of
words are averaged and a linear softmax gives clean or toxic. A text's score is that of its most toxic
window: a few words in a long text would vanish in an average over all of it. Embeddings and softmax are
trained together by AdaGrad: first on averages of whole texts, then on the worst window of each text.

The fit takes at most MAX_TOXIC and MAX_CLEAN labelled rows (picked by a hash of the id) to the driver; rows
with a null id or label or of the held-out fold never take part. Every row of docs is scored, whole. Null
and empty texts have no words and get the model's bias, held below 0.5. Without labelled rows of both
classes every score is 0. Repeated rows each get their row; repeated labels of an id count as the largest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._blocks import tidied
from ._fit import fetched, hash_sample, held_out
from ._letters import pieces, words_of
from ._words import mixed

MAX_TOXIC, MAX_CLEAN = 2500, 5000
BUCKETS = 1 << 18
WIDTH, STRIDE = 16, 8
CLEAN_WEIGHT = 1.0
DIM = 4


def subwords(points: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of words and the word of each, in order of word."""
    ids, word = [h], [np.arange(len(h))]
    for n in (3, 4, 5):
        g, w = pieces(points, start, end, n)
        ids.append(g)
        word.append(w)
        long = np.flatnonzero(end - start > n)
        g, w = pieces(points, start[long], start[long] + n, n)
        ids.append(mixed(g + np.uint64(77)))
        word.append(long[w])
    ids, word = np.concatenate(ids), np.concatenate(word)
    order = np.argsort(word, kind="stable")
    return (ids[order] % np.uint64(BUCKETS)).astype(np.int32), word[order]


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every window over texts whose words begin at first; the last one may be short."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(-(-(n - WIDTH) // STRIDE), 0) + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    start = first[:-1][text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    return start, np.minimum(start + WIDTH, first[1:][text]), text


class Model:
    """Scores a subword bucket by one number, the embedding under the softmax's difference of classes."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def word_scores(self, points, h, start, end) -> np.ndarray:
        if not len(h):
            return np.zeros(0)
        _, some, which = np.unique(h, return_index=True, return_inverse=True)
        ids, word = subwords(points, h[some], start[some], end[some])
        return (np.bincount(word, self.table[ids], len(some)) / np.bincount(word, minlength=len(some)))[which]

    def text_logits(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.full(len(first) - 1, min(self.bias, -1e-6))
        start, end, text = windows(first)
        if len(start):
            total = np.concatenate(([0.0], np.cumsum(scores)))
            mean = (total[end] - total[start]) / (end - start)
            at = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
            out[text[at]] = np.maximum.reduceat(mean, at) + self.bias
        return out

    def logits(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, j, points, h, start, end, first in words_of(texts, digits=True, whole=True):
            out[i:j] = self.text_logits(self.word_scores(points, h, start, end), first)
        return out


def _vocabulary(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts as numbers by first occurrence, each text's first word (len + 1), and the subword buckets of the distinct words: flat, and how many each has.

    Beside four bytes a word it holds what is distinct: the driver fits the model."""
    known = np.zeros(0, np.uint64)
    part: list[np.ndarray] = []
    for _, _, _, h, _, _, _ in words_of(texts, digits=True, whole=True):
        part.append(np.unique(h))
        if len(part) == 32:
            known, part = np.unique(np.concatenate([known, *part])), []
    known = np.unique(np.concatenate([known, *part]))
    number, count = np.full(len(known), -1, np.int32), 0
    words, firsts, flat, sizes = [np.zeros(0, np.int32)], [0], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for _, _, points, h, start, end, first in words_of(texts, digits=True, whole=True):
        at = np.searchsorted(known, h)
        fresh, where = np.unique(at, return_index=True)
        where = np.sort(where[number[fresh] < 0])
        number[at[where]] = np.arange(count, count + len(where), dtype=np.int32)
        count += len(where)
        ids, word = subwords(points, h[where], start[where], end[where])
        flat.append(ids)
        sizes.append(np.bincount(word, minlength=len(where)))
        words.append(number[at])
        firsts += (first[1:] + firsts[-1]).tolist()
    return np.concatenate(words), np.array(firsts), np.concatenate(flat), np.concatenate(sizes)


def fit(texts: pa.Array, labels: np.ndarray, rounds: int = 24, rate: float = 0.5, seed: int = 7) -> Model:
    """Joint AdaGrad of embeddings and softmax over the labelled texts."""
    rng = np.random.default_rng(seed)
    words, first, flat, size = _vocabulary(texts)
    at = np.concatenate(([0], np.cumsum(size)))
    start, end, text = windows(first)
    head = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if len(text) else np.zeros(0, int)
    tail = np.append(head[1:], len(text))
    full = text[head]
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = np.zeros((DIM, 2), np.float32)
    soft[:, 1], soft[:, 0] = rng.normal(0, 0.3, DIM), rng.normal(0, 0.3, DIM)
    bias = np.zeros(2, np.float32)
    g_embed, g_soft, g_bias = np.full(BUCKETS, 1e-4, np.float32), np.full_like(soft, 1e-3), np.full_like(bias, 1e-3)
    weight = np.where(labels == 1, 1.0, CLEAN_WEIGHT)

    def spans(lo, hi):
        """Words and spans of words[lo:hi] for each span."""
        n = hi - lo
        return words[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())], np.repeat(np.arange(len(lo)), n), n

    def step(lo, hi, y, w):
        nonlocal embed, soft, bias
        part, span, n = spans(lo, hi)
        kind, back = np.unique(part, return_inverse=True)
        bag, word, m = _bags(flat, at, kind)
        head_ = np.concatenate(([0], np.cumsum(m)[:-1]))
        vec = np.stack([np.add.reduceat(embed[bag, k], head_) for k in range(DIM)], 1) / m[:, None]
        mean = np.add.reduceat(vec[back], np.concatenate(([0], np.cumsum(n)[:-1])), axis=0) / n[:, None]
        z = mean @ soft + bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= w[:, None] / len(y)
        d_soft, d_bias, d_mean = mean.T @ p, p.sum(0), (p @ soft.T) / n[:, None]
        d_word = np.stack([np.bincount(back, d_mean[span, k], len(kind)) for k in range(DIM)], 1) / m[:, None]
        hit = np.flatnonzero(np.bincount(bag, minlength=BUCKETS))
        d_hit = np.stack([np.bincount(bag, d_word[word, k], BUCKETS)[hit] for k in range(DIM)], 1)
        g_embed[hit] += (d_hit**2).mean(1)
        embed[hit] -= (rate * d_hit / np.sqrt(g_embed[hit])[:, None]).astype(np.float32)
        g_soft[:] += d_soft**2
        g_bias[:] += d_bias**2
        soft = soft - rate * d_soft / np.sqrt(g_soft) * 0.3
        bias = bias - rate * d_bias / np.sqrt(g_bias) * 0.3

    def score_words():
        table, out = embed @ (soft[:, 1] - soft[:, 0]), np.empty(len(size), np.float32)
        for i in range(0, len(size), 16_384):
            j = min(len(size), i + 16_384)
            out[i:j] = np.add.reduceat(table[flat[at[i] : at[j]]], at[i:j] - at[i]) / size[i:j]
        return out

    def worst_windows():
        """The window of each text with the largest mean, some texts at a time."""
        scores, out = score_words(), []
        for k in range(0, len(head), 512):
            i, j = head[k], tail[min(k + 512, len(head)) - 1]
            lo, hi = start[i:j] - start[i], end[i:j] - start[i]
            total = np.concatenate(([0.0], np.cumsum(scores[words[start[i] : start[i] + hi.max()]], dtype=np.float64)))
            mean = (total[hi] - total[lo]) / (hi - lo)
            out += [x + int(np.argmax(mean[x - i : y - i])) for x, y in zip(head[k : k + 512].tolist(), tail[k : k + 512].tolist(), strict=True)]
        return np.array(out, np.int64)

    for r in range(rounds):
        if r < 4:
            lo, hi, y, w = first[full], first[full + 1], labels[full], weight[full]
        else:
            worst = worst_windows()
            other = rng.integers(head, tail)[labels[full] == 0]  # a clean text is clean everywhere
            pick = np.concatenate([worst, other])
            lo, hi, y, w = start[pick], end[pick], labels[text[pick]], weight[text[pick]]
        for part in np.array_split(rng.permutation(len(lo)), max(1, len(lo) // min(256, max(16, len(lo) // 24)))):
            step(lo[part], hi[part], y[part], w[part])
    return Model(embed @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]))


def _bags(flat, at, kind):
    m = at[kind + 1] - at[kind]
    word = np.repeat(np.arange(len(kind), dtype=np.int32), m)
    skip = (at[kind] - np.concatenate(([0], np.cumsum(m)[:-1]))).astype(np.int32)  # the driver's bags are well below 2^31
    place = np.arange(m.sum(), dtype=np.int32)
    place += skip[word]
    return flat[place], word, m


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model | None:
    """A model of the labelled rows outside the held-out fold; None without both classes."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    counts = {int(r["y"] >= 1): r["count"] for r in known.groupBy(F.expr("if(y >= 1, 1, 0)").alias("y")).count().collect()}
    toxic, clean = hash_sample(known.where("y >= 1"), ["id"], max_toxic, counts.get(1, 0)), hash_sample(known.where("y < 1"), ["id"], max_clean, counts.get(0, 0))
    picked = F.broadcast(toxic.unionAll(clean))  # at most 1.25 * (max_toxic + max_clean) rows
    rows = fetched(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id").select("id", "text", "y").dropDuplicates(["id"]))
    rows = rows.sort_by("id")
    y, texts = (rows["y"].to_numpy() >= 1).astype(int), rows["text"].combine_chunks()
    del rows
    pa.default_memory_pool().release_unused()  # the driver holds the texts once
    return fit(texts, y) if 0 < y.sum() < len(y) else None


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row."""
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.table, model.bias))

    def run(batches):
        own = None if shared.value is None else Model(*shared.value)
        for b in batches:
            p = np.zeros(b.num_rows) if own is None else 1 / (1 + np.exp(-np.clip(own.logits(b.column("text")), -700, 700)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    return rows.mapInArrow(tidied(run), f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def kept(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.table, model.bias))

    def run(batches):
        own = None if shared.value is None else Model(*shared.value)
        for b in batches:
            yield b if own is None else b.filter(pa.array(own.logits(b.column(text_col)) < 0))

    return docs.mapInArrow(tidied(run), docs.schema)
