import random
import re

import numpy as np

from lodestone.llm import _words
from lodestone.llm.ngram_join import needed, ngram_join, prefix, trie_overlaps

SCHEMA = "doc_id long, text string, sid int, id string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    out = []
    for i, r in enumerate(rows):
        ids = [x[0] for k, x in enumerate(rows) if top(k) == top(i) and x[0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids and sets[i] else r[0]))
    return sorted(out, key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    prose = lambda n: [rng.choice(words) + rng.choice(words) for _ in range(n)]
    rows, common = [], prose(60)
    for base in range(12):
        text = prose(rng.choice([3, 5, 6, 9, 30, 120, 300]))
        for _ in range(rng.choice([1, 2, 9])):
            t = list(text)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = rng.choice(words).upper()
            rows.append(" ".join(t))
    rows += [" ".join(common + prose(rng.randint(5, 30))) for _ in range(30)]
    rows += [None, "", " \t\n", "One", "one", "ONE\n", "same same same same same same same", "same same same same same"]
    return [(i, t, 7, "x") for i, t in enumerate(rows)] + [(None, rows[0], 1, "y"), (3, rows[3], 1, "y")]


def test_against_brute_force(spark):
    rows = corpus()
    got = ngram_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_second_pass_links_what_the_leaders_miss(spark):
    """A chain of texts, each like the next only."""
    rng = random.Random(5)
    words = [f"v{i}" for i in range(4000)]
    text, rows = [rng.choice(words) for _ in range(200)], []
    for i in range(25):
        rows.append((1000 - i, " ".join(text), 0, ""))
        for _ in range(3):
            text[rng.randrange(len(text))] = rng.choice(words)
    got = ngram_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_table(spark):
    assert ngram_join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_trie_overlaps():
    rng = np.random.default_rng(1)
    probe = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
    sets = []
    for n in (0, 5, 20, 40, 70, 200):
        s = np.unique(np.concatenate([rng.permutation(probe)[: len(probe) - n], rng.integers(0, 2**64, n // 2, dtype=np.uint64)]))
        sets += [s, s]
    for s, got in zip(sets, trie_overlaps(probe, sets), strict=True):
        both = len(np.intersect1d(s, probe))
        assert got == (both if both >= needed(len(s), len(probe)) else -1)
    assert [prefix(n) for n in (1, 2, 5, 10)] == [1, 1, 2, 3]


def test_long_text_in_pieces(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"a{i % 97}b{i % 13}" for i in range(5000))
    whole = next(_words.shingle_sets(pa.array([text])))
    monkeypatch.setattr(_words, "PIECE", 512)
    assert (next(_words.shingle_sets(pa.array([text]))) == whole).all() and len(whole) == len(shingles(text))


def test_large_loose_group(spark):
    """Copies of one text with few to many edits: a component of over LARGE sets, and sets around it at the threshold."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 5])):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(text), 0, ""))
    want = brute(rows)
    assert max(sum(r[2] == x[2] for x in want) for r in want) > 64
    got = ngram_join(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == want
