"""Runs of repeated words against a search over all periods, with the query's periodic texts, and odd input."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import queries, repetition


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_hand(w, exponent=4, shortest=6):
    """(start, length, period) of the maximal stretches with their smallest period."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            own = w[i : j + q]
            if j > i and len(own) >= max(shortest, exponent * q) and not any(own[r:] == own[:-r] for r in range(1, q)):
                out.append((i, len(own), q))
            i = max(j, i) + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def without(w, runs):
    dropped = {x for s, n, q in runs for x in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in dropped)


def sequences(seed, count):
    rnd = random.Random(seed)
    for _ in range(count):
        w = [rnd.randint(0, rnd.randint(1, 3)) for _ in range(rnd.randint(0, 40))]
        if rnd.random() < 0.5:
            block = [rnd.randint(0, 5) for _ in range(rnd.randint(1, 6))]
            k = rnd.randint(0, len(w))
            w = w[:k] + (block * 20)[: rnd.randint(0, 40)] + w[k:]
        yield w


@pytest.mark.parametrize(("exponent", "shortest"), [(2, 2), (4, 6), (3, 1)])
def test_runs_of_sequences(exponent, shortest):
    for w in sequences(exponent, 500):
        assert [tuple(x) for x in repetition.runs(np.array(w, np.int64), exponent, shortest).tolist()] == by_hand(w, exponent, shortest), w


def mixed_texts():
    rnd = random.Random(9)
    for _ in range(300):
        w = [str(rnd.randint(0, rnd.choice([1, 2, 50, 500]))) for _ in range(rnd.randint(0, 120))]
        for _ in range(rnd.randint(0, 3)):
            q = rnd.randint(1, 25)
            block, k = [str(rnd.randint(0, 200)) for _ in range(q)], rnd.randint(0, len(w))
            w = w[:k] + (block * 20)[: rnd.randint(0, q * 8)] + w[k:]
        yield w


@pytest.mark.parametrize(("exponent", "shortest"), [(4, 6), (2, 2), (2.5, 4), (3, 10)])
def test_no_part_with_a_run_is_passed_over(exponent, shortest):
    texts = list(mixed_texts())
    spans, plain = repetition._in_batch(pa.array([random.Random(i).choice([" ", "\n", " \t"]).join(w) for i, w in enumerate(texts)]), exponent, shortest)
    for w, got, text in zip(texts, spans.to_pylist(), plain.to_pylist(), strict=True):
        want = by_hand(w, exponent, shortest)
        assert [(r["start"], r["length"], r["period"]) for r in got] == want and text == without(w, want)


def test_odd_input(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (None, "a a a a a a"), (None, "a a a a a a"), (4, "A a A a a A"), (5, "é b " * 9), (6, "ab " * 30_000), (7, "x y " * 2 + "x"), (8, " ".join(map(str, range(3000))) + " " + "w " * 7)]
    d = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, runs string, start int, collapsed string")
    got = repetition.repetitions(d)
    assert got.columns == ["doc_id", "runs", "collapsed"]
    found = {(r["doc_id"], r["collapsed"]): [tuple(x) for x in r["runs"]] for r in got.collect()}
    assert len(got.collect()) == len(rows) and found[1, ""] == found[2, ""] == found[3, ""] == []
    assert found[None, "a"] == [(0, 6, 1)] and found[4, "A a A a a A"] == [] and found[5, "é b"] == [(0, 9, 1)] and found[6, "ab"] == [(0, 30_000, 1)] and found[7, "x y x y x"] == []
    assert found[8, " ".join(map(str, range(3000))) + " w"] == [(3000, 7, 1)]
    kept = repetition.collapsed(d)
    assert kept.columns == d.columns and {(r[0], r[1], r[2]) for r in kept.collect()} >= {(1, None, "x"), (3, " \n ", "x"), (None, "a", "x"), (7, "x y x y x", "x")}
    assert repetition.repetitions(d.limit(0)).collect() == [] and repetition.collapsed(d.limit(0)).collect() == []
    with pytest.raises(ValueError):
        repetition.repetitions(d, exponent=1.5)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, sf).collect()}
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), 0
    assert len(got) == len(docs)
    for doc_id, text in docs:
        w, h = words(text), zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
        if n > 400:  # the search by hand is quadratic
            continue
        runs, seen = by_hand(w), seen + 1
        top = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(got[doc_id]) == (doc_id, len(runs), *top, None if top[0] is None else 1000 * top[1] // top[2], digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(without(w, runs)))
    assert seen > 50
