"""The search index against reading all texts, its versions, and what its plans read."""

import math
import random
import re

import pytest

from lodestone.operators import index as index_module, retrieval
from lodestone.operators.index import Clause, Index, clause
from lodestone.sources.versions import Conflict, Versions, fingerprint

SCHEMA = "id long, doc_id string, collection_id string, title string, text string"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    out = [(i, f"d{i // 3}", f"c{i % 3}", rnd.choice(["alpha", "beta gamma", None]), " ".join(rnd.choices(vocabulary, [1 / (j + 1) for j in range(40)], k=rnd.randint(0, 60)))) for i in range(400)]
    return [*out, (400, None, None, None, None), (401, "d9", "c1", "", "")]


def made(spark, rows, tmp_path, fields=("text",)):
    return Index.create(spark.createDataFrame(rows, SCHEMA).repartition(3), f"file://{tmp_path}/ix", "id", fields, ("collection_id", "doc_id"))


def pairs(df):
    return [(r["id"], round(r["score"], 9), r["rank"]) for r in df.collect()]


def scanned(spark, rows, asked, k):
    return pairs(retrieval.bm25_top(spark.createDataFrame(rows, SCHEMA), asked, k))


@pytest.mark.parametrize("first", [100, 1])
def test_best_k_by_bounds(spark, rows, tmp_path, monkeypatch, first):
    monkeypatch.setattr(index_module, "FIRST", first)
    monkeypatch.setattr(index_module, "BLOCK", 4)
    ix = made(spark, rows, tmp_path)
    for asked in ("w0 w7 w39", "W12", "nothing", "w0 w1 w2 w3 w4 w5", ""):
        assert pairs(ix.top(asked, 10)) == scanned(spark, rows, asked, 10), asked


def test_insert_delete_merge_and_old_versions(spark, rows, tmp_path):
    frame = lambda some: spark.createDataFrame(some, SCHEMA)
    one = made(spark, rows[:150], tmp_path)
    two = one.insert(frame(rows[150:300])).insert(frame(rows[300:]))
    assert two.version == 3 and pairs(two.top("w3 w9", 20)) == scanned(spark, rows, "w3 w9", 20)
    left = [r for r in rows if r[0] % 4]
    gone = two.delete(frame([r for r in rows if r[0] % 4 == 0]).select("id"))
    assert pairs(gone.top("w3 w9", 20)) == scanned(spark, left, "w3 w9", 20)
    merged = gone.merge()
    assert len(merged.now["segments"]) == 1 and merged.count == len(left) and pairs(merged.top("w3 w9", 20)) == scanned(spark, left, "w3 w9", 20)
    back = merged.insert(frame([rows[0]]))  # a deleted id may come again
    assert pairs(back.top("w3 w9", 20)) == scanned(spark, [*left, rows[0]], "w3 w9", 20)
    assert pairs(one.top("w3 w9", 20)) == scanned(spark, rows[:150], "w3 w9", 20) and pairs(gone.top("w3 w9", 5)) == pairs(merged.top("w3 w9", 5))
    assert merged.merge().version == merged.version


def test_deleted_ids_that_come_again_before_a_merge(spark, rows, tmp_path):
    frame = lambda some: spark.createDataFrame(some, SCHEMA)
    ix = made(spark, rows, tmp_path).delete(frame(rows[:50]).select("id")).insert(frame(rows[:20]))
    left = rows[:20] + rows[50:]
    assert pairs(ix.top("w3 w9", 20)) == scanned(spark, left, "w3 w9", 20)
    assert pairs(ix.merge().top("w3 w9", 20)) == scanned(spark, left, "w3 w9", 20)


def test_writers_that_meet(spark, rows, tmp_path):
    a = made(spark, rows[:100], tmp_path)
    b = Index(spark, a.path)
    a.insert(spark.createDataFrame(rows[100:200], SCHEMA))
    both = b.insert(spark.createDataFrame(rows[200:], SCHEMA))  # made on version 1, committed on 2
    assert both.version == 3 and pairs(both.top("w5", 9)) == scanned(spark, rows, "w5", 9)
    with pytest.raises(Conflict):
        both.versions.commit(2, {})
    again = Index.create(spark.createDataFrame(rows[:1], SCHEMA), a.path, "id", ("text",))
    assert again.version == 3 and again.count == len(rows)


def test_filters(spark, rows, tmp_path):
    ix = made(spark, rows, tmp_path)
    docs = spark.createDataFrame([(f"d{i}", i % 2) for i in range(140)], "id string, odd int")
    among = ix.among(["c0", "c1"], ["c1", "c2"], docs, docs["odd"] == 1)
    kept = [r for r in rows if r[2] == "c1" and r[1] and int(r[1][1:]) % 2]
    assert pairs(ix.top("w3 w9", 15, among)) == scanned(spark, kept, "w3 w9", 15)
    assert ix.among() is None and pairs(ix.top("", 3, among)) == scanned(spark, kept, "", 3)


def by_hand(rows, fields, asked, k):
    """BM25 of clauses over lists of words."""
    token = lambda x: re.findall(r"[^\W_]+", (x or "").lower())
    texts = {r[0]: {"title": token(r[3]), "text": token(r[4])} for r in rows}
    n, mean = len(texts), sum(len(t[f]) for t in texts.values() for f in fields) / len(texts)
    count = lambda t, w, f: sum(t[x].count(w) for x in ([f] if f else fields))
    idf = lambda w, f: (lambda d: math.log(1 + (n - d + 0.5) / (d + 0.5)))(sum(count(t, w, f) > 0 for t in texts.values()))

    def phrase(t, c):
        found = 0
        for f in [c.field] if c.field else fields:
            for i, w in enumerate(t[f]):
                at = i
                for x in c.words[1:] if w == c.words[0] else ():
                    at = next((j for j in range(at + 1, len(t[f])) if t[f][j] == x), 10**9)
                found += w == c.words[0] and at - i <= len(c.words) - 1 + c.slop
        return found

    out = []
    for i, t in texts.items():
        dl, score, some, keep = sum(len(t[f]) for f in fields), 0.0, False, True
        for c in asked:
            parts = [(phrase(t, c), sum(idf(w, c.field) for w in c.words))] if c.slop is not None else [(count(t, w, c.field), idf(w, c.field)) for w in c.words]
            for tf, x in parts:
                if c.need == "none":
                    keep &= tf == 0
                    continue
                score, some = score + (c.boost * x * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) if tf else 0), some or tf > 0
                keep &= tf > 0 or c.need != "all"
        if keep and some:
            out.append((i, round(score, 9)))
    out = sorted(out, key=lambda x: (-x[1], x[0]))[:k]
    return [(i, s, r + 1) for r, (i, s) in enumerate(out)]


@pytest.mark.parametrize("asked", [
    [clause("w0 w1", slop=0)], [clause("w0 w1 w0", slop=2)], [clause("w0", "all"), clause("w2", "none"), clause("w7", boost=3.0)], [clause("beta", "all", field="title"), clause("w1 w2")],
    [clause("beta gamma", slop=0, field="title", need="all"), clause("w0 w3", slop=4, field="text")], [clause("w1 w2", "all"), clause("w3 w4", "none", slop=1)], [clause("alpha w0")],
])
def test_clauses(spark, rows, tmp_path, asked):
    assert pairs(made(spark, rows, tmp_path, ("title", "text")).top(asked, 12)) == by_hand(rows, ("title", "text"), asked, 12)


def test_faults_and_empty_tables(spark, rows, tmp_path):
    for bad in ({"need": "some"}, {"boost": 0.0}, {"slop": -1}):
        with pytest.raises(ValueError):
            Clause(("a",), **bad)
    ix = made(spark, [], tmp_path)
    assert ix.count == 0 and ix.top("w1", 5).collect() == [] and ix.top([clause("w1 w2", slop=0)], 5).collect() == []
    with pytest.raises(ValueError):
        ix.top([clause("a", field="author")], 5)
    full = ix.insert(spark.createDataFrame(rows, SCHEMA))
    assert pairs(full.top("w1", 5)) == scanned(spark, rows, "w1", 5)


def test_no_text_is_read(spark, rows, tmp_path):
    ix = made(spark, rows, tmp_path)
    docs = spark.createDataFrame([("d1", "{}")], "id string, metadata string")
    for df in (ix.top("w0 w7", 5), ix.top("w0 w7", 5, ix.among(["c1"], None, docs, docs["metadata"] == "{}")), ix.top([clause("w0 w7", slop=3)], 5)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp" not in plan and "text" not in plan.lower().replace("textinput", "")


def test_files_of_a_term(spark, tmp_path):
    many = [(i, "d", "c", None, " ".join(f"t{(i * 7 + j) % 900:03d}" for j in range(30))) for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ix = made(spark, many, tmp_path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = ix.now["segments"][0]["files"]
    assert len(files) > 1 and len(ix._entries(["t001"], ["n"]).inputFiles()) < len(files)


def test_fingerprint(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(3).write.parquet(path)
    before = fingerprint(spark, path)
    assert before == fingerprint(spark, path)
    spark.range(1).write.mode("append").parquet(path)
    assert before != fingerprint(spark, path)
    versions = Versions(spark, f"file://{tmp_path}/v")
    assert versions.read() == (0, {}) and versions.commit(1, {"a": "é"}) == 1 and versions.read() == (1, {"a": "é"})


def test_ranges_without_a_second_inversion(spark, rows, tmp_path, monkeypatch):
    def none(*_):
        raise AssertionError("a sort by range inverts its rows twice")

    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", none)
    ix = made(spark, rows, tmp_path).insert(spark.createDataFrame([(900, "d", "c1", None, "w3 w9")], SCHEMA))
    gone = ix.delete(spark.createDataFrame([(i,) for i in range(0, 402, 4)], "id long")).merge()
    left = [r for r in [*rows, (900, "d", "c1", None, "w3 w9")] if r[0] % 4 or r[0] >= 402]
    assert pairs(gone.top("w3 w9", 20)) == scanned(spark, left, "w3 w9", 20)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_merged_places(spark, rows, tmp_path, monkeypatch, most):
    """Deleted ids that are sent and that are joined: phrases are found as before, and nothing of a deleted row is left."""
    monkeypatch.setattr(index_module, "GONE", most)
    asked, left = [clause("w0 w1", slop=3), clause("w2")], [r for r in rows if r[0] % 3]
    ix = made(spark, rows, tmp_path).delete(spark.createDataFrame([(r[0],) for r in rows if r[0] % 3 == 0], "id long"))
    merged = ix.merge()
    assert pairs(merged.top(asked, 12)) == by_hand(left, ("text",), asked, 12)
    held = merged._entries(None, ["n", "max_tf", "min_dl", "ids", "tfs", "dls", "starts", "places"]).collect()
    assert all(len(r["ids"]) == len(r["tfs"]) == r["n"] and len(r["places"]) == sum(r["tfs"]) and r["max_tf"] == max(r["tfs"]) and r["min_dl"] == min(r["dls"]) and all(i % 3 for i in r["ids"]) for r in held)


def test_words_alone(spark, rows, tmp_path):
    ix = made(spark, rows, tmp_path)
    among = spark.createDataFrame([(r[0],) for r in rows if r[0] % 2], "id long")
    assert "places" not in ix.top("w0 w7", 5, among)._jdf.queryExecution().executedPlan().toString()


def test_a_term_of_many_files():
    import numpy as np
    import pyarrow as pa

    blocks = np.arange(40)
    files = lambda t: set(index_module._file(pa.array([t] * 40), blocks, ["b", "m", "m", "m", "t"]).to_pylist())
    assert [files(t) for t in ("a", "b", "c", "m", "n", "z")] == [{0}, {0}, {1}, {1, 2, 3, 4}, {4}, {5}]


def test_ranges_of_files(spark, rows, tmp_path, monkeypatch):
    """The ends of files are those of their terms, and no task sorts the terms to find them."""
    plans, collect = [], type(spark.range(0)).collect
    monkeypatch.setattr(type(spark.range(0)), "collect", lambda self: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or collect(self))
    ix = made(spark, rows, tmp_path)
    assert not [p for p in plans if "input_file_name" in p and "MapInArrow" not in p]
    (segment,) = ix.now["segments"]
    for file, first, last in segment["files"]:
        terms = [r["term"] for r in spark.read.parquet(f"{ix.path}/{segment['name']}/postings/{file}").select("term").collect()]
        assert (min(terms), max(terms)) == (first, last)
