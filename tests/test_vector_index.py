"""The vector index and tables of queries against full scans."""

import numpy as np
import pytest

from lodestone.operators import index as index_module, retrieval, vector_index as module
from lodestone.operators.index import Index
from lodestone.operators.vector_index import VectorIndex, nearest_of_each

SCHEMA = "id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 3
    m = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16))
    out = [(i, [float(np.float32(x)) for x in v], i % 3) for i, v in enumerate(m)]
    out += [(2000 + i, out[5][1], 0) for i in range(30)]  # copies
    return [*out, (3000, [0.0] * 16, 1), (3001, [1.0, 0.0], 1), (3002, [0.0, 2.0], 2), (3003, None, 0), (3004, [], 0)]


@pytest.fixture(scope="module")
def made(spark, rows, tmp_path_factory):
    return VectorIndex.create(spark.createDataFrame(rows, SCHEMA).repartition(4), f"file://{tmp_path_factory.mktemp('v')}/ix", keep=("label",), lists=30)


def pairs(df):
    return [(r["id"], round(r["distance"], 9), r["rank"]) for r in df.collect()]


def scanned(spark, rows, q, k):
    return pairs(retrieval.dense_top(spark.createDataFrame(rows, SCHEMA), q, k))


def test_exact_search_reads_a_part(spark, rows, made):
    shares = []
    for i in (0, 5, 77, 600, 1499):
        q = rows[i][1]
        assert pairs(made.nearest(q, 10)) == scanned(spark, rows, q, 10)
        shares.append(made.read_lists[0] / made.read_lists[1])
    assert min(shares) < 0.6
    assert pairs(made.nearest([0.0, 1.0], 5)) == scanned(spark, rows, [0.0, 1.0], 5)
    assert pairs(made.nearest(rows[0][1], 2000)) == scanned(spark, rows, rows[0][1], 2000)  # zero vectors come last
    assert made.nearest([1.0] * 5, 3).collect() == [] and pairs(made.nearest([0.0] * 16, 3)) == scanned(spark, rows, [0.0] * 16, 3)


def test_recall_of_a_few_lists(spark, rows, made):
    hits = 0
    for i in range(0, 400, 20):
        q = rows[i][1]
        want = {r[0] for r in scanned(spark, rows, q, 10)}
        hits += len(want & {r[0] for r in pairs(made.nearest(q, 10, probes=8))})
        assert made.read_lists[0] == 8
    assert hits / 200 >= 0.95


def test_changes_and_filters(spark, rows, tmp_path):
    frame = lambda some: spark.createDataFrame(some, SCHEMA)
    one = VectorIndex.create(frame(rows[:700]), f"file://{tmp_path}/ix", keep=("label",))
    two = one.insert(frame(rows[700:1530])).delete(frame(rows[100:200]).select("id"))
    again = two.insert(frame(rows[150:160]))  # deleted ids come again
    left = rows[:100] + rows[150:160] + rows[200:1530]
    q = rows[155][1]
    assert pairs(again.nearest(q, 20)) == scanned(spark, left, q, 20)
    assert pairs(again.nearest(q, 20, among=again.vectors(16).where("label = 1").select("id"))) == scanned(spark, [r for r in left if r[2] == 1], q, 20)
    assert pairs(one.nearest(q, 20)) == scanned(spark, rows[:700], q, 20)
    with pytest.raises(ValueError):
        again.insert(frame([(9, [1.0, 2.0, 3.0], 0)]))


def test_empty_index(spark, tmp_path):
    ix = VectorIndex.create(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/ix")
    assert ix.version == 1 and ix.nearest([1.0, 2.0], 3).collect() == []


@pytest.mark.parametrize("block", [1 << 22, 64])
def test_many_vectors_at_once(spark, rows, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    queries = spark.createDataFrame([(f"q{i}", rows[i][1]) for i in (0, 5, 300, 1532, 1533, 1534)] + [("zero", [0.0] * 16)], "query_id string, vector array<float>")
    got = {}
    for r in nearest_of_each(queries, spark.createDataFrame(rows, SCHEMA).repartition(5), 7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["distance"], 9), r["rank"]))
    for q in queries.collect():
        assert got.get(q["query_id"], []) == (scanned(spark, rows, q["vector"], 7) if q["vector"] else []), q["query_id"]
    assert nearest_of_each(queries.limit(0), spark.createDataFrame(rows, SCHEMA), 3).collect() == []


def test_a_thousand_queries_equal_single_ones(spark, rows):
    queries = spark.createDataFrame([(i, rows[i][1]) for i in range(1000)], "query_id long, vector array<float>")
    got = {}
    for r in nearest_of_each(queries, spark.createDataFrame(rows, SCHEMA), 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    assert len(got) == 1000
    for i in (0, 5, 499, 999):
        assert [x for _, x in sorted(got[i])] == [r[0] for r in scanned(spark, rows, rows[i][1], 3)]


@pytest.mark.parametrize("block", [1024, 2])
def test_many_texts_at_once(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(index_module, "QUERIES", block)
    monkeypatch.setattr(index_module, "BLOCK", 4)
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 20) if x < 60)) for i in range(150)]
    d = spark.createDataFrame(texts, "id long, text string").repartition(3)
    ix = Index.create(d.where("id < 100"), f"file://{tmp_path}/ix").insert(d.where("id >= 100")).delete(d.where("id % 10 = 3").select("id"))
    asked = [(0, "w1 w2"), (1, "W7 w1 w30"), (2, "none"), (3, ""), (4, None), (5, "w2 w2")]
    got = {}
    for r in ix.top_of_each(spark.createDataFrame(asked, "query_id int, query string"), 6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 9), r["rank"]))
    for i, text in asked:
        assert got.get(i, []) == ([(r["id"], round(r["score"], 9), r["rank"]) for r in ix.top(text, 6).collect()] if text else [])
