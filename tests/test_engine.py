from datetime import datetime

import pytest

from lodestone.operators import registry as R
from lodestone.plans.engine import Engine
from lodestone.plans.ingest import from_html, from_shards, with_vectors


@pytest.fixture(scope="module")
def engine(spark):
    docs = spark.createDataFrame(
        [("d1", "c1", "Alpha Guide", "A", 12, 1000, "ready", 2, 2, 0, 0.5, "{}", 3), ("d2", "c2", "Beta", "B", 1, 10, "parsing", 2, 1, 1, None, "{}", 5), ("d3", "c1", "Gamma", "B", 1, 10, "failed", None, 0, 0, None, "{}", 1)],
        "id string, collection_id string, title string, author string, page_count int, byte_size long, state string, total_shards int, shards_done int, shards_failed int, completeness double, metadata string, updated_at int",
    )
    chunks = spark.createDataFrame(
        [("p", "d1", "c1", None, True, 0, 1, 10, "whole " * 200, None), ("x", "d1", "c1", "p", False, 1, 1, 3, "alpha", [1.0, 0.0]), ("y", "d1", "c1", "p", False, 2, 4, 8, "beta", [0.0, 1.0]), ("z", "d2", "c2", None, False, 0, 1, 1, "alpha beta", [1.0, 1.0])],
        "id string, doc_id string, collection_id string, parent_id string, is_parent boolean, seq int, page_start int, page_end int, text string, embedding array<float>",
    ).selectExpr("*", "cast(null as array<string>) as heading_path")
    cols = spark.createDataFrame([("c1", "m", 1), ("c2", "m", 2), ("c3", None, 3)], "id string, embedding_model_id string, created_at int")
    shards = spark.createDataFrame([("d1", "done"), ("d2", "failed"), ("d2", "pending")], "doc_id string, state string")
    return Engine(docs, chunks, cols, shards, lambda model, query: [1.0, 0.0])


def test_verbs(engine):
    ids = lambda df, c="id": [r[c] for r in df.collect()]
    assert ids(engine.search("alpha", ["c1"]), "chunk_id") == ["x", "y"]
    assert set(ids(engine.search("alpha"), "chunk_id")) == {"x", "y", "z"}
    assert ids(engine.search("alpha", ["c1"], top_k=1, scorer=lambda q, t: [x == "beta" for x in t]), "chunk_id") == ["y"]
    assert ids(engine.list_documents()) == ["d2", "d1", "d3"] and ids(engine.list_documents(collection="c1", title="gui")) == ["d1"] and ids(engine.list_documents(page=2, size=2)) == ["d3"]
    assert ids(engine.get_document("d1")) == ["d1"] and ids(engine.get_document("nope")) == []
    assert [(r["id"], r["documents"]) for r in engine.list_collections().collect()] == [("c1", 2), ("c2", 1), ("c3", 0)]
    listed = engine.list_chunks("d1").collect()
    assert [r["id"] for r in listed] == ["p", "x", "y"] and listed[0]["text"].endswith("…") and len(listed[0]["text"]) == 501
    assert ids(engine.chunk_context("x")) == ["x", "y"] and ids(engine.preview_chunk("p")) == ["p"]
    assert engine.read_pages("d1", 5, 99).first()["text"].startswith("whole")
    snap = engine.pipeline().first()
    assert (snap["documents"], snap["awaiting_embed"], snap["active"], snap["shards_pending"]) == (3, 1, 1, 1)
    assert {r["collection_id"]: (r["documents"], r["chunks"]) for r in engine.stats().collect()} == {"c1": (2, 2), "c2": (1, 1), "c3": (0, 0)}
    scoped = Engine(engine.documents, engine.chunks, engine.collections, engine.shards, engine.embed, ["c2"])
    assert ids(scoped.search("alpha"), "chunk_id") == ["z"] and ids(scoped.get_document("d1")) == [] and scoped.search("alpha", ["c1"]).count() == 0


def test_registries(spark, engine):
    models = spark.createDataFrame([("m", 2), ("n", 1)], "id string, created_at int")
    keys = spark.createDataFrame([("a", "h", None), ("b", "h", 1), ("c", "h", 5)], "id string, key_hash string, last_used_at int")
    full = Engine(engine.documents, engine.chunks, engine.collections, embedding_models=models, rerank_models=models.where("id = 'n'"), keys=keys)
    assert [r["id"] for r in full.list_models().collect()] == ["n", "m"] and [r["id"] for r in full.list_models(rerank=True).collect()] == ["n"]
    assert [tuple(r) for r in full.list_keys().collect()] == [("c", 5), ("b", 1), ("a", None)]


def test_ingest_plans(spark):
    from lodestone.operators.embedding import HashEmbedder

    shards = spark.createDataFrame([("d", 0, 1, 2, "# A\n\n" + "text one. " * 60), ("d", 1, 3, 4, "## B\n\n" + "text two. " * 60)], "doc_id string, idx int, page_start int, page_end int, payload string")
    rows = with_vectors(from_shards(shards), HashEmbedder).collect()
    assert all(r["page_start"] is not None and (r["embedding"] is None) == r["is_parent"] for r in rows) and {r["page_end"] for r in rows} <= {1, 2, 3, 4}
    html = spark.createDataFrame([(1, "<h1>T</h1><p>body</p>")], "page_id int, html string")
    assert {r["heading_path"][0] if r["heading_path"] else None for r in from_html(html).collect()} <= {"T", None}


def test_registry():
    m = R.EmbeddingModel("m", "tei", "x", "u", "u", 0)
    assert m.confirmed(64).vector_dim == 64 and m.faults() and not m.confirmed(64).faults()
    with pytest.raises(ValueError):
        m.confirmed(64).confirmed(32)
    models = {"r": "model"}
    assert R.reranker(None, models, {"c": "r"}, ["c"]) == "model" and R.reranker(None, models, {"c": "r"}, ["c", "d"]) is None and R.reranker(False, models, {"c": "r"}, ["c"]) is None and R.reranker("r", models, {}, None) == "model"
    for bad in (True, "nope"):
        with pytest.raises(ValueError):
            R.reranker(bad, models, {}, ["c"])
    now = datetime(2024, 1, 1)
    assert R.key_expiry("7d", now) == datetime(2024, 1, 8) and R.key_expiry("never", now) is None
    assert R.allowed([], ["a"]) == ["a"] and R.allowed(["a"], None) == ["a"]
    with pytest.raises(PermissionError):
        R.allowed(["a"], ["b"])


def test_prefix_dimension_and_bound_reranker(spark, engine):
    import dataclasses

    from lodestone.plans.ingest import DimensionMismatch

    asked = []

    def embed(model, text):
        asked.append((model, text))
        return [1.0, 0.0]

    models = spark.createDataFrame([("m", "search_query: ", 2), ("n", "", 3)], "id string, query_prefix string, vector_dim int")
    bound = engine.collections.selectExpr("*", "if(id = 'c1', 'r', null) as rerank_model_id")
    full = dataclasses.replace(engine, collections=bound, embed=embed, embedding_models=models, scorers={"r": lambda q, t: [x == "beta" for x in t], "s": lambda q, t: [x == "alpha" for x in t]})
    first = lambda **more: full.search("alpha", ["c1"], top_k=1, **more).first()["chunk_id"]
    assert first() == "y" and first(rerank=False) == "x" and first(rerank="s") == "x" and asked[0] == ("m", "search_query: alpha")
    assert {r["chunk_id"] for r in full.search("alpha").collect()} == {"x", "y", "z"} and not full.search("alpha").first()["reranked"]
    for bad in ({"rerank": "unknown"}, {"targets": ["c2"], "rerank": True}, {"rerank": True}):
        with pytest.raises(ValueError):
            full.search("alpha", **bad)
    with pytest.raises(DimensionMismatch):
        dataclasses.replace(full, collections=bound.selectExpr("id", "'n' as embedding_model_id", "created_at", "rerank_model_id")).search("alpha", ["c1"])


def test_lookups(spark, engine):
    keys = spark.createDataFrame([("a", "h1", None), ("b", "h2", 1)], "id string, key_hash string, revoked_at int")
    models = spark.createDataFrame([("m", 2), ("n", 1)], "id string, created_at int")
    shards = spark.createDataFrame([("d1", 0, "done"), ("d1", 1, "failed")], "doc_id string, idx int, state string")
    full = Engine(engine.documents, engine.chunks, engine.collections, shards, embedding_models=models, rerank_models=models.limit(0), keys=keys)
    assert full.get_shard("d1", 1).first()["state"] == "failed" and full.get_shard("d2", 1).count() == 0
    assert full.get_model("n").first()["created_at"] == 1 and full.get_model("n", rerank=True).count() == 0
    assert [tuple(r) for r in full.get_key("h1").collect()] == [("a", None)] and full.get_key("h2").count() == 0


def test_search_by_index_equals_search_by_texts(spark, engine, tmp_path):
    import dataclasses

    from lodestone.operators.index import Index

    made = Index.create(engine.chunks.where("not is_parent"), f"file://{tmp_path}/ix", "id", ("text",), ("collection_id", "doc_id"))
    with_index = dataclasses.replace(engine, index=made)
    for targets, scope in ((["c1"], None), (None, None), (["c1", "c2"], ["c2"])):
        a, b = (dataclasses.replace(x, scope=scope).search("alpha beta", targets).select("chunk_id", "score").collect() for x in (engine, with_index))
        assert a == b and a
    plan = with_index.search("alpha", ["c1"])._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan


def test_scan_keeps_its_tasks_under_a_reranker(spark):
    from lodestone.operators.retrieval import reranked

    rows = spark.range(0, 100, 1, 8).selectExpr("id as chunk_id", "cast(id as string) as text", "cast(id as double) as score", "false as reranked")
    plan = reranked(rows, "q", lambda q, t: [1.0] * len(t), 3)._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and "Exchange" in plan
