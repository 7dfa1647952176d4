"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import hashlib
import math

import duckdb
import pytest

from lodestone import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7) + 0.0
    return v.tolist() if hasattr(v, "tolist") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    at = [want.columns.index(c) for c in columns]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_every_document_has_its_hash(spark, tmp_path):
    spaces = "\x0b\x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    texts = [f"{c}ein{c} {c}Wort{c}" for c in spaces] + ["ein Wort", "", "\u3000", None, "ein\u200bWort"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, text in enumerate(texts):
        h = hashlib.sha256(" ".join((text or "").split()).encode()).hexdigest()
        want[h] = (min(i, want.get(h, (i, 0))[0]), want.get(h, (i, 0))[1] + 1)
    got = catalog.chunk_hash_dedupe(spark, str(tmp_path)).collect()
    assert len(got) == len(want) == 3 and {r["hash"]: (r["first_id"], r["n"]) for r in got} == want


def test_whole_documents_are_embedded(spark, tmp_path):
    from lodestone.functions.text import embedding_text
    from lodestone.operators.chunks import chunked
    from lodestone.operators.embedding import HashEmbedder

    texts = [" ".join(f"Word{i} is here." + "\n\n" * (i % 9 == 8) for i in range(900)), "short", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["id"]: r["embedding"] for r in catalog.embed_documents(spark, str(tmp_path)).collect()}
    rows = chunked(docs).where("not is_parent").select("id", "doc_id", embedding_text("header_breadcrumb", "text").alias("text")).collect()
    assert {r["doc_id"] for r in rows} == {"0", "1"} and set(got) >= {r["id"] for r in rows}
    assert {w for r in rows for w in r["text"].split()} == {w for t in texts for w in (t or "").split()}
    assert all(got[r["id"]] == pytest.approx(HashEmbedder()([r["text"]])[0], abs=1e-6) for r in rows)


def test_entry_does_without_the_subpackage():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark):
    plan = catalog.list_documents_page(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src3)" in plan and "ReadSchema: struct<doc_id:bigint,text:string,source:string,n_chars:bigint>" in plan
    plan = catalog.dense_topk(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" in plan and "label" not in plan
