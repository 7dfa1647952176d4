"""The pipeline stage by stage against plain Python, and the queries that have SQL against DuckDB."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_ngram_join import shingles
from test_operators import corpus, leaks_brute, lower, words

import corpus_pipeline
from lodestone.llm import queries, toxicity

TABLES = "documents pages benchmark labels conversations sale_lines".split()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(9)
    rows, labels = corpus(120, seed=4)
    texts = [r[1] for r in rows]
    bench = [(i, " ".join(rng.choice(texts).split()[:20])) for i in range(3)]
    extra = [texts[3].upper(), texts[3], texts[7] + " tail"]
    long = [t for t in texts if len(t.split()) > 80][:3]
    extra += [" ".join(w if k != 40 else "edited" for k, w in enumerate(t.split())) for t in long]
    extra += [f"start words here {bench[0][1]} and the end", None, "", " "]
    rows += [(500 + i, t, "en", rng.choice(["b", None])) for i, t in enumerate(extra)]
    out = tmp_path_factory.mktemp("sf")
    d = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": [r[2] for r in rows], "source": [r[3] for r in rows], "n_chars": [len(r[1] or "") for r in rows]})
    pq.write_table(d, out / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [x[0] for x in labels], "quality": [1] * len(labels), "toxic": [x[2] for x in labels]}), out / "labels.parquet")
    pq.write_table(pa.table({"item_id": [b[0] for b in bench], "text": [b[1] for b in bench]}), out / "benchmark.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    by_stage, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame(stage(spark, now, folder).collect(), (out := stage(spark, now, folder)).schema)
        by_stage[name] = now
        if name != "mixing":
            assert out.columns == docs.columns
    rows = {n: [(r["doc_id"], r["text"]) for r in d.collect()] if "text" in d.columns else d.collect() for n, d in by_stage.items()}
    all_rows = [(r["doc_id"], r["text"]) for r in docs.collect()]

    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    logits = model.logits(pa.array([t for _, t in all_rows], pa.string()))
    clean = [r for r, z in zip(all_rows, logits, strict=True) if z < 0]
    assert sorted(rows["toxicity"], key=str) == sorted(clean, key=str) and len(clean) < len(all_rows)

    last = {}
    for i, t in clean:
        last[lower(t)] = max(last.get(lower(t), -1), i)
    distinct = [(i, t) for i, t in clean if last[lower(t)] == i]
    assert sorted(rows["exact_dedup"], key=str) == sorted(distinct, key=str) and len(distinct) < len(clean)

    sets = {i: shingles(t) for i, t in distinct}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    single = [(i, t) for i, t in distinct if top(i) == i]
    assert sorted(rows["ngram_join"], key=str) == sorted(single, key=str) and len(single) < len(distinct)

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    dirty = {x[0] for x in leaks_brute(single, items)}
    left = [(i, t) for i, t in single if i not in dirty]
    assert sorted(rows["decontamination"], key=str) == sorted(left, key=str) and len(left) < len(single)

    assert sorted((r["doc_id"], r["size"]) for r in rows["mixing"]) == sorted((i, len(words(t))) for i, t in left)
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, rows["mixing"]))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_no_stage_is_left_out():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "decontamination", "mixing"]
    assert [f"op{n}_" for n in range(1, 11)] == [next(f"op{n}_" for q in queries.QUERIES if q.startswith(f"op{n}_")) for n in range(1, 11)]
