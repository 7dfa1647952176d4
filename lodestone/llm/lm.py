"""LM scoring: masked pseudo-likelihood by a bidirectional window network trained in numpy.

Method: each token is masked and predicted from the WINDOW tokens on both sides: position-wise embeddings
of the neighbours are summed, go through tanh, and a two-level softmax (class, then word in the class)
gives the token's conditional log-probability. The sum over all tokens of a text is its score.

Counts of all words of all documents give the network's tokens (the VOCAB - RARE most frequent words; others share RARE
tokens by hash). A shared token's probability is split among its words by their counts, which are kept for every word in
blocks and joined with the words to score in Spark, so they grow with the corpus: n of N + 1, one part for all words that
training has not seen. Training reads all documents: in every round each task starts from the shared parameters, takes AdaGrad
steps on the tokens of its documents that are due, and the tasks' parameters are averaged, weighed by tokens, in Spark by
blocks; the driver sees one set of parameters a round, of fixed size. The token at position p of a text is due in the rounds
r = p modulo STRIDE; STRIDE is no more than ROUNDS, so every token is a target. All tokens of all texts are scored.

Words are runs of anything but ASCII white space, A-Z as a-z. Null, empty and blank texts have no tokens, score 0 and mean null.
Repeated rows each get their row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._store import written
from ._words import mixed, texts_of
from ._blocks import BLOCKS, _blocks, packed, unpacked

CLASSES = PER_CLASS = 64
VOCAB, RARE = CLASSES * PER_CLASS, PER_CLASS
WINDOW, DIM = 2, 16
ROUNDS, STRIDE, BATCH, RATE = 2, 2, 2048, 0.1
AVERAGED = 16
#: Logits up to this size need no shift before the exponential in 32 bits.
SAFE, ONES = 80.0, np.ones(PER_CLASS, np.float32)
#: The first 16 bits of a hash.
HEAD = np.uint64(48)
_SHAPES = {"embed": (2 * WINDOW, VOCAB + 1, DIM), "bias": (DIM,), "top": (CLASSES, DIM), "top_bias": (CLASSES,), "low": (CLASSES, PER_CLASS, DIM), "low_bias": (CLASSES, PER_CLASS)}


def _counts(parts: int):
    def run(batches):
        keys, sizes, held = [], [], 0

        def summed():
            k, which = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(which, np.concatenate(sizes)).astype(np.int64)

        for b in batches:
            for _, _, _, h, _, _, _ in texts_of(b.column("text")):
                k, n = np.unique(h, return_counts=True)
                keys.append(k)
                sizes.append(n)
                held += len(k)
            if held > 4_000_000:
                k, n = summed()
                if len(k) > 2_000_000:
                    yield _blocks(0, list(packed(k, parts, k, n)))
                    keys, sizes, held = [], [], 0
                else:
                    keys, sizes, held = [k], [n], len(k)
        if held:
            k, n = summed()
            yield _blocks(0, list(packed(k, parts, k, n)))

    return run


def _sums(blocks: list[bytes], kind: str, size: str) -> tuple[np.ndarray, np.ndarray]:
    k, n = unpacked(blocks, kind, size)
    k, which = np.unique(k, return_inverse=True)
    return k, np.bincount(which, n, len(k)).astype(size)


def _summed(parts: int):
    def run(batches):
        blocks = [x for b in batches for x in b.column("block").to_pylist()]
        if blocks:
            k, n = _sums(blocks, "u8", "i8")
            yield _blocks(0, list(packed(k, parts, k, n)))

    return run


def _top(batches):
    for b in batches:
        k, n = unpacked(b.column("block").to_pylist(), "u8", "i8")
        best = np.lexsort((k, -n))[: VOCAB - RARE]
        yield pa.RecordBatch.from_arrays([pa.array(k[best].view(np.int64)), pa.array(n[best])], ["word", "n"])


def _parts(docs: DataFrame) -> int:
    return 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def counted(docs: DataFrame, parts: int) -> DataFrame:
    """Counts of all words of docs (text), in blocks of (word, n) by the word modulo parts."""
    return written(docs.mapInArrow(_counts(parts), BLOCKS).repartition("part").mapInArrow(_summed(parts), BLOCKS), "counts")


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> np.ndarray:
    """Hashes of the most frequent words of docs (text), most frequent first."""
    counts = counted(docs, _parts(docs)) if counts is None else counts
    tops = written(counts.mapInArrow(_top, "word long, n long"), "tops")
    left, least = VOCAB - RARE, 1
    for r in tops.groupBy(F.length(F.bin("n")).alias("bits")).count().orderBy(F.desc("bits")).collect():  # at most 63 rows
        left, least = left - r["count"], 2 ** (r["bits"] - 1)
        if left <= 0:
            break
    rows = tops.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(VOCAB - RARE).toArrow()
    return rows["word"].to_numpy().view(np.uint64)


class Rare:
    """The words that share tokens: their counts in blocks by the word modulo parts, and the sum of counts of each shared token."""

    def __init__(self, counts: DataFrame, parts: int, words: np.ndarray):
        self.counts, self.parts = counts, parts
        known = counts.sparkSession.sparkContext.broadcast(words)

        def run(batches):
            net = Network(known.value)
            for b in batches:
                k, n = unpacked(b.column("block").to_pylist(), "u8", "i8")
                t = net.tokens(k) - (VOCAB - RARE)
                yield pa.RecordBatch.from_arrays([pa.array(range(RARE), pa.int32()), pa.array(np.bincount(t[t >= 0], n[t >= 0], RARE).astype(np.int64))], ["token", "n"])

        self.totals = np.zeros(RARE)
        for r in counts.mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():  # RARE rows
            self.totals[r["token"]] = r["n"]

    def logs(self, asked: DataFrame) -> DataFrame:
        """(key, more): the summed log shares of the words of each row of asked (key, words: packed hashes), where there are any."""
        parts, totals = self.parts, self.totals

        def ask(batches):
            keys, words, held = [], [], 0
            for b in batches:
                for key, x in zip(b.column("key").to_pylist(), b.column("words"), strict=True):
                    h = np.frombuffer(x.as_buffer(), np.uint64)
                    keys.append(np.full(len(h), key, np.int64))
                    words.append(h)
                    held += len(h)
                    if held >= 1_000_000:
                        h = np.concatenate(words)
                        yield _blocks(1, list(packed(h, parts, h, np.concatenate(keys))))
                        keys, words, held = [], [], 0
            if held:
                h = np.concatenate(words)
                yield _blocks(1, list(packed(h, parts, h, np.concatenate(keys))))

        def answer(batches):  # counts come before what is asked
            counts, found, out, held = [], None, [], 0

            def dealt():
                key, x = (np.concatenate(c) for c in zip(*out, strict=True))
                return _blocks(0, list(packed(mixed(key.view(np.uint64)), parts, key, x)))

            for b in batches:
                for kind, block in zip(b.column("kind").to_pylist(), b.column("block"), strict=True):
                    if kind == 0:
                        counts.append(block.as_py())
                        continue
                    if found is None:
                        found = _sums(counts, "u8", "i8")
                    (k, n), (h, key) = found, unpacked([block.as_py()], "u8", "i8")
                    own = np.ones(len(h))
                    if len(k):
                        at = np.minimum(np.searchsorted(k, h), len(k) - 1)
                        own = np.where(k[at] == h, n[at], 1)
                    x = np.log(own / (totals[(h % np.uint64(RARE)).astype(np.int64)] + 1))
                    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                    out.append((key[start], np.add.reduceat(x, start)))
                    held += len(start)
                    if held >= 1_000_000:
                        yield dealt()
                        out, held = [], 0
            if held:
                yield dealt()

        def add(batches):
            blocks = [x for b in batches for x in b.column("block").to_pylist()]
            if blocks:
                k, x = _sums(blocks, "i8", "f8")
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(x)], ["key", "more"])

        both = self.counts.unionAll(asked.mapInArrow(ask, BLOCKS)).repartition("part").sortWithinPartitions("kind")
        return both.mapInArrow(answer, BLOCKS).repartition("part").mapInArrow(add, "key long, more double")


class Network:
    rare: Rare | None = None  # without it, a rare word has the probability of its shared token

    def __init__(self, words: np.ndarray, flat: np.ndarray | None = None, seed: int = 11):
        order = np.argsort(words)
        self.words, self.sorted, self.order = words, words[order], order
        self.first = np.searchsorted(self.sorted >> HEAD, np.arange(2**16 + 1, dtype=np.uint64))
        self.most = int(np.diff(self.first).max())  # words with the same head; some 3, as hashes are mixed
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = rng.normal(0, 0.1, sum(int(np.prod(s)) for s in _SHAPES.values())).astype(np.float32)
        self.flat, at = flat, 0
        for name, shape in _SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n
        self.embed_rows, self.sides = self.embed.reshape(-1, DIM), np.arange(2 * WINDOW)[:, None] * (VOCAB + 1)

    def tokens(self, h: np.ndarray) -> np.ndarray:
        out = (VOCAB - RARE + h % np.uint64(RARE)).astype(np.int64)
        if len(self.sorted):
            at = self.first.take((h >> HEAD).view(np.int64))
            for k in range(self.most):
                hit = np.flatnonzero(self.sorted.take(at + k, mode="clip") == h)
                out[hit] = self.order.take(at[hit] + k, mode="clip")
        return out

    @staticmethod
    def contexts(ids: np.ndarray, first: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The 2 * WINDOW neighbours of each token (of those at, if given) within its text; VOCAB where there is none."""
        n, text = len(ids), np.repeat(np.arange(len(first) - 1), np.diff(first))
        at, text = (np.arange(n), text) if at is None else (at, text[at])
        lo, hi = first[:-1][text], first[1:][text]
        out = []
        for k in (*range(-WINDOW, 0), *range(1, WINDOW + 1)):
            j = at + k
            out.append(np.where((j >= lo) & (j < hi), ids[np.clip(j, 0, max(n - 1, 0))], VOCAB))
        return np.stack(out) if n else np.zeros((2 * WINDOW, 0), np.int64)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        total = self.embed[0].take(around[0], 0)
        for k in range(1, len(around)):
            total += self.embed[k].take(around[k], 0)
        total += self.bias
        return np.tanh(total, out=total)

    def by_class(self, ids):
        """The order of ids by class, and (class, start, end) in it of the classes that occur."""
        which = ids // PER_CLASS
        order = np.argsort(which.astype(np.uint8), kind="stable")  # by radix
        cuts = np.searchsorted(which[order], np.arange(CLASSES + 1)).tolist()
        return which, order, [(c, cuts[c], cuts[c + 1]) for c in range(CLASSES) if cuts[c] < cuts[c + 1]]

    def low_logits(self, h: np.ndarray, groups) -> np.ndarray:
        z = np.empty((len(h), PER_CLASS), np.float32)
        for c, i, j in groups:
            np.matmul(h[i:j], self.low[c].T, out=z[i:j])
            z[i:j] += self.low_bias[c]
        return z

    def log_probs(self, ids: np.ndarray, around: np.ndarray) -> np.ndarray:
        h = self.hidden(around)
        which, order, groups = self.by_class(ids)

        def logs(z, own, bound):
            if bound > SAFE:
                z -= z.max(1, keepdims=True)
            said = z[np.arange(len(own)), own]
            return (said - np.log(np.exp(z, out=z) @ ONES)).astype(np.float64)

        bounds = self.bounds()
        out = logs(h @ self.top.T + self.top_bias, which, bounds[0])
        out[order] += logs(self.low_logits(h.take(order, 0), groups), ids[order] % PER_CLASS, bounds[1])
        return out

    def bounds(self) -> tuple[float, float]:
        """What no logit of classes, and of words in a class, exceeds in size: all of `hidden` is within -1 and 1."""
        return float((np.abs(self.top) @ ONES[:DIM] + np.abs(self.top_bias)).max()), float((np.abs(self.low) @ ONES[:DIM] + np.abs(self.low_bias)).max())

    def step(self, ids: np.ndarray, around: np.ndarray, memory: Network, rate: float) -> None:
        """One AdaGrad step up the mean log-probability; memory holds the sums of squares."""
        h, n = self.hidden(around), len(ids)
        which, order, groups = self.by_class(ids)

        def softmax(z, own, bound):
            if bound > SAFE:
                z -= z.max(1, keepdims=True)
            e = np.exp(z, out=z)
            e *= (1 / (n * (e @ ONES)))[:, None]
            e[np.arange(len(own)), own] -= np.float32(1 / n)
            return e

        def moved(seen, grad):  # seen becomes the sum of squares
            seen += grad * grad
            root = np.sqrt(seen + 1e-8)
            grad *= np.divide(rate, root, out=root)
            return grad

        def move(name, at, grad):
            m = getattr(memory, name)
            if at is ...:
                moved(m, grad)
            else:
                seen = m[at]
                moved(seen, grad)
                m[at] = seen
            getattr(self, name)[at] -= grad

        bounds = self.bounds()
        d = softmax(h @ self.top.T + self.top_bias, which, bounds[0])
        back = d @ self.top
        move("top", ..., d.T @ h)
        move("top_bias", ..., d.sum(0))
        own, low = h.take(order, 0), np.zeros_like(self.low)
        d = softmax(self.low_logits(own, groups), ids[order] % PER_CLASS, bounds[1])
        through = np.empty_like(own)
        for c, i, j in groups:
            np.matmul(d[i:j], self.low[c], out=through[i:j])
            np.matmul(d[i:j].T, own[i:j], out=low[c])
        back[order] += through
        held = [c for c, _, _ in groups] if len(groups) < CLASSES else ...
        move("low", held, low[held])
        move("low_bias", held, np.add.reduceat(d, [i for _, i, _ in groups]))
        back *= 1 - h * h
        move("bias", ..., back.sum(0))
        rows = (around + self.sides).astype(np.uint16).ravel()  # of embed, all sides in one
        order = np.argsort(rows, kind="stable")  # by radix
        rows = rows[order]
        start = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        grad, rows = np.add.reduceat(back.take(order % n, 0), start), rows[start]
        seen = memory.embed_rows.take(rows, 0)
        self.embed_rows[rows] -= moved(seen, grad)
        memory.embed_rows[rows] = seen


def due(first: np.ndarray, turn: int, stride: int) -> np.ndarray:
    """The tokens at positions of their text that are turn modulo stride."""
    at = np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))
    return np.flatnonzero(at % stride == turn % stride)


def _trained(words, flat, turn: int, stride: int):
    def run(batches):
        net = Network(words, flat.copy())
        memory = Network(words, np.full_like(flat, 1e-6))
        ids, around, held, total = [], [], 0, 0
        for b in batches:
            for _, _, _, h, _, _, first in texts_of(b.column("text")):
                t = net.tokens(h)
                pick = due(first, turn, stride)
                total += len(t)
                if not len(pick):
                    continue
                ids.append(t[pick])
                around.append(net.contexts(t, first, pick))
                held += len(pick)
                if held >= BATCH:
                    i, a = np.concatenate(ids), np.concatenate(around, axis=1)
                    for k in range(0, held - BATCH + 1, BATCH):
                        net.step(i[k : k + BATCH], a[:, k : k + BATCH], memory, RATE)
                    rest = held % BATCH
                    ids, around, held = [i[held - rest :]], [a[:, held - rest :]], rest
        if held:
            net.step(np.concatenate(ids), np.concatenate(around, axis=1), memory, RATE)
        if total:
            parts = np.array_split(net.flat, AVERAGED)
            yield pa.RecordBatch.from_arrays([pa.array(range(AVERAGED), pa.int32()), pa.array([float(total)] * AVERAGED), pa.array([x.tobytes() for x in parts], pa.binary())], ["block", "weight", "x"])

    return run


def _averaged(batches):
    sums: dict[int, list] = {}
    for b in batches:
        for block, weight, x in zip(b.column("block").to_pylist(), b.column("weight").to_pylist(), b.column("x"), strict=True):
            s = sums.setdefault(block, [0.0, 0.0])
            s[0], s[1] = s[0] + weight, s[1] + weight * np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
    for block, (weight, x) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(x / weight).astype(np.float32).tobytes()], pa.binary())], ["block", "x"])


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, stride: int = STRIDE) -> Network:
    if stride > rounds:
        raise ValueError(f"with stride {stride}, {rounds} rounds leave tokens out")
    docs = docs.select(F.col(text_col).alias("text"))
    parts = _parts(docs)
    counts = counted(docs, parts)
    net = Network(vocabulary(docs, counts))
    rare = Rare(counts, parts, net.words)
    sc = docs.sparkSession.sparkContext
    for r in range(rounds):
        shared = sc.broadcast((net.words, net.flat))

        def run(batches, r=r, shared=shared):
            yield from _trained(*shared.value, r, stride)(batches)

        own = docs.mapInArrow(run, "block int, weight double, x binary").repartition("block")
        rows = own.mapInArrow(_averaged, "block int, x binary").collect()  # AVERAGED rows
        if rows:
            net = Network(net.words, np.concatenate([np.frombuffer(r["x"], np.float32) for r in sorted(rows, key=lambda r: r["block"])]).copy())
    net.rare = rare
    return net


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, log_prob, mean_log_prob) for every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("key"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((net.words, net.flat))

    def run(batches):
        own = Network(*shared.value)
        for b in batches:
            n, total, words = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows), []
            for i, j, _, h, _, _, first in texts_of(b.column("text")):
                ids = own.tokens(h)
                around, p = own.contexts(ids, first), np.zeros(len(ids))
                for k in range(0, len(ids), 8192):
                    p[k : k + 8192] = own.log_probs(ids[k : k + 8192], around[:, k : k + 8192])
                n[i:j] = np.diff(first)
                total[i:j] = np.bincount(np.repeat(np.arange(j - i), n[i:j]), p, j - i)
                rare = ids >= VOCAB - RARE
                raw, cuts = memoryview(h[rare].tobytes()), (8 * np.concatenate(([0], np.cumsum(rare)))[first]).tolist()
                words += [raw[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array(n), pa.array(total), pa.array(words, pa.binary())], ["id", "key", "n_tokens", "log_prob", "words"])

    out = rows.mapInArrow(run, f"id {kind}, key long, n_tokens long, log_prob double, words binary")
    if net.rare is not None:
        out = written(out, "scores")  # keys are settled once
        more = net.rare.logs(out.where(F.length("words") > 0).select("key", "words"))
        out = out.drop("words").join(more, "key", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return out.select(F.col("id").alias(id_col), "n_tokens", "log_prob", mean.alias("mean_log_prob"))


def scored(docs: DataFrame) -> DataFrame:
    return score(docs, train(docs))
