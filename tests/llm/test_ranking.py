"""Grouped ranking against sorting by hand, its maps against counting, and odd input."""

import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from lodestone.llm import ranking

NAMES = "g long, h long, p long, q long, t long, pos int, k_c0 string, tied string"


def table_of(spark, rows, parts=7):
    """rows: (g, h, p, q, t); the other columns clash with names that the operator uses or returns."""
    return spark.createDataFrame([(*r, 7, "x", "y") for r in rows], NAMES).repartition(parts)


def null_last(x):
    return x is None, x or 0


def by_hand(rows, k):
    groups, out = defaultdict(list), []
    for r in rows:
        groups[r[:2]].append(r)
    for own in groups.values():
        own.sort(key=lambda r: tuple(map(null_last, r[2:])))
        out += [(*r, i + 1, sum(x[2:4] == r[2:4] for x in own)) for i, r in enumerate(own[:k])]
    return sorted(out, key=str)


def some_rows(seed=1):
    rnd = random.Random(seed)
    pick = lambda n: rnd.choice([None, *range(n)])
    return [(pick(3), pick(2), pick(3), pick(4), pick(5)) for _ in range(2000)] + [(9, 9, 1, 1, 1)] * 1500 + [(None,) * 5] * 300


@pytest.mark.parametrize("k", [1, 2, 5])
def test_places(spark, k):
    rows = some_rows(k)
    got = ranking.ranked(table_of(spark, rows), ["g", "h"], ["p", "q"], ["t"], k)
    assert got.columns == ["g", "h", "p", "q", "t", "pos", "tied"]
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows, k)


def test_small_chunks_and_a_deep_tree(spark, monkeypatch):
    monkeypatch.setattr(ranking, "CHUNK", 50)
    monkeypatch.setattr(ranking, "HELD", 10)
    monkeypatch.setattr(ranking, "FAN", 2)
    rows = some_rows()
    got = ranking.ranked(table_of(spark, rows, 9), ["g", "h"], ["p", "q"], ["t"], 3, ("pos", "tied"))
    assert got.columns == ["g", "h", "p", "q", "t", "pos", "tied", "pos_", "tied_"]
    assert sorted(map(tuple, got.drop("pos", "tied").collect()), key=str) == by_hand(rows, 3)


def test_ties_of_one_row_over_many_ranges(spark):
    rows = [(1, 1, 1, 1, 1)] * 4000 + [(2, 1, 1, 1, i) for i in range(50)]
    got = sorted(tuple(r) for r in ranking.ranked(table_of(spark, rows), ["g", "h"], ["p", "q"], ["t"], 100).collect())
    assert [r[5] for r in got if r[0] == 1] == list(range(1, 101)) and {r[6] for r in got if r[0] == 1} == {4000}
    assert [(r[4], r[5]) for r in got if r[0] == 2] == [(i, i + 1) for i in range(50)]


def test_empty_table(spark):
    assert ranking.ranked(table_of(spark, []), ["g", "h"], ["p", "q"], ["t"], 2).collect() == []


def test_texts_as_keys(spark):
    d = spark.createDataFrame([("b", "y", 1), ("b", "x", 2), ("b", "x", 1), (None, None, 3), ("é", "z", 1)], "g string, p string, t int")
    got = sorted((tuple(r) for r in ranking.ranked(d, ["g"], ["p"], ["t"], 2).collect()), key=str)
    assert got == sorted([("b", "x", 1, 1, 2), ("b", "x", 2, 2, 2), (None, None, 3, 1, 1), ("é", "z", 1, 1, 1)], key=str)


def test_maps_are_exact_and_mergeable(spark):
    rows = some_rows(4)
    got = {}
    for r in ranking.maps(table_of(spark, rows).select("g", "p"), ["g"], ["p"], 2).collect():
        got.setdefault(r["g"], []).append((r["p"], r["n"], r["lines"]))
    for g in {r[0] for r in rows}:
        counts = Counter(r[2] for r in rows if r[0] == g)
        best = sorted(counts, key=null_last)[:2]
        assert [(p, n) for p, n, _ in sorted(got[g], key=lambda x: null_last(x[0]))] == [(p, counts[p]) for p in best]
        assert sum(x[2] for x in got[g]) == sum(counts.values())
    entry = lambda ps: pa.table({"b": pa.array([0] * len(ps), pa.int32()), "g": [1] * len(ps), "p": ps, "n": [1] * len(ps), "lines": [1] * len(ps)})
    cut = lambda t: ranking.truncated(t, ["b", "g"], ["p"], 2)
    a, b = cut(entry([5, 3, 4, 3])), cut(entry([4, 4, 9]))
    both = cut(pa.concat_tables([a, b]))
    assert both.select(["p", "n"]).to_pylist() == [{"p": 3, "n": 2}, {"p": 4, "n": 3}] and sum(both["lines"].to_pylist()) == 7
