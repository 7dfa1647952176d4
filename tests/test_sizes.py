"""Work that has to grow with its tables, seen on small ones."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestone import catalog
from lodestone.functions.vectors import distances
from lodestone.operators import evaluation, index, vector_index
from lodestone.sources import feeds
from lodestone.streaming import leases

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_many_cases_are_not_sent_whole(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "_few", lambda cases: False)
    for name in ("title_match_rank", "hit_mrr_summary", "run_compare"):
        assert "Broadcast" not in plan(__spark_entry__.queries()[name](spark, SMALL)), name
    assert catalog._evaluated(spark, SMALL).count() > 0


def test_pages_of_feeds_of_any_size(tmp_path):
    body = tmp_path / "big.xml"
    with body.open("w") as f:
        f.write('<feed><link rel="next" href="after.xml"/>')
        for i in range(3000):
            f.write(f"<entry><id>{i}</id><summary>{'x' * 4000}</summary></entry>")
        f.write("</feed>")
    assert body.stat().st_size > feeds.MOST_BYTES
    entries, after = feeds.parsed(f"file://{body}", feeds.fetch(f"file://{body}"))
    assert [x[0] for x in entries] == [str(i) for i in range(3000)] and after == f"file://{tmp_path}/after.xml"
    body.write_text("<feed><entry><id>1</id></entry>")  # cut
    with pytest.raises(ValueError):
        feeds.parsed(f"file://{body}", feeds.fetch(f"file://{body}"))


def test_lines_are_numbered_over_files(spark, tmp_path):
    spark.range(50).selectExpr("cast(id as string) as value").repartitionByRange(4, F.length("value"), "value").sortWithinPartitions(F.length("value"), "value").write.text(f"{tmp_path}/lines")
    got = evaluation.numbered_lines(spark, f"{tmp_path}/lines", whole=True)
    assert got.select("file").distinct().count() > 1 and sorted((r["line"], int(r["value"])) for r in got.collect()) == [(i + 1, i) for i in range(50)]


def test_products_of_vectors_are_held_in_parts(spark, monkeypatch):
    rng, k = np.random.default_rng(1), 4
    m = rng.normal(size=(300, 5)).astype("float32")
    m[7], m[9], m[100:110] = 0, m[8], m[50]
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<float>").repartition(2)
    want = vector_index.nearest_of_each(rows.where("id % 3 = 0"), rows, k, "id", "embedding", "id", "embedding").collect()
    monkeypatch.setattr(vector_index, "HELD", 1)  # parts of 16 rows
    parts = vector_index.nearest_of_each(rows.where("id % 3 = 0"), rows, k, "id", "embedding", "id", "embedding").collect()
    assert sorted(map(tuple, parts)) == sorted(map(tuple, want)) and len(want) == 100 * k
    for q, i, d, rank in want:
        if q != 0 and np.linalg.norm(m[q]) > 0:
            d_ = distances(m.astype(float), m[q].astype(float) / np.linalg.norm(m[q].astype(float)))
            assert sorted(range(300), key=lambda j: (round(d_[j], 12), j))[rank - 1] == i


@pytest.mark.parametrize("deleted", [False, True])
def test_queries_are_scored_in_parts(spark, tmp_path, monkeypatch, deleted):
    monkeypatch.setattr(index, "ASKERS", 3)
    rows = spark.createDataFrame([(i, f"all w{i % 7} w{i % 11} " + "x " * (i % 5)) for i in range(200)], "id long, text string")
    made = index.Index.create(rows, f"file://{tmp_path}/i")
    made = made.delete(rows.where("id % 9 = 0").select("id")) if deleted else made
    asked = [(q, f"all w{q} w{q + 1}") for q in range(8)]
    got = made.top_of_each(spark.createDataFrame(asked, "query_id long, query string"), 5).collect()
    assert [x["score"] for x in got if x["query_id"] == 7 and x["rank"] == 1]
    for q, text in asked[::3]:
        want = [(r["id"], r["rank"], r["score"]) for r in made.top(text, 5).orderBy("rank").collect()]
        own = sorted(((r["id"], r["rank"], r["score"]) for r in got if r["query_id"] == q), key=lambda x: x[1])
        assert [x[:2] for x in own] == [x[:2] for x in want] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(own, want, strict=True))


def test_blocks_of_queries_share_the_exchange_of_postings(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, f"all w{i % 7} w{i % 11} " + "x " * (i % 5)) for i in range(200)], "id long, text string")
    made = index.Index.create(rows, f"file://{tmp_path}/i")
    asked = spark.createDataFrame([(q, f"all w{q} w{q + 1}") for q in range(8)] + [(8, ""), (9, "none")], "query_id long, query string")
    one = made.top_of_each(asked, 5)
    want = sorted(map(tuple, one.collect()))
    monkeypatch.setattr(index, "QUERIES", 3)
    several = made.top_of_each(asked, 5)
    assert sorted(map(tuple, several.collect())) == want and len(want) == 40
    final = several._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 2 and final.count("+- Exchange hashpartitioning(block") == 1


@pytest.mark.parametrize("added", [1 << 20, 50])
def test_weak_terms_leave_out_no_row(monkeypatch, added):
    monkeypatch.setattr(index, "ADDED", added)
    rng, n, k, askers = np.random.default_rng(3), 600, 4, 20
    texts = [[f"w{x:02d}" for x in np.minimum(rng.zipf(1.3, rng.integers(1, 40)), 60)] for _ in range(n)]
    texts[300:320] = [texts[0]] * 20  # ties
    df = {t: sum(t in set(x) for x in texts) for t in {t for x in texts for t in x}}
    known = sorted(t for t in df if t != "w03")  # a term that no query asks for
    of, idf, mean = {t: i for i, t in enumerate(known)}, np.array([index._idf(n, df[t]) for t in known]), float(np.mean([*map(len, texts)]))
    queries = [sorted({x for x in texts[i * 7][:6] if x in of}) for i in range(askers)]
    best = index._Best([np.array([of[t] for t in q], np.int32) for q in queries], k)
    for start in range(0, n, 50):
        posted = [(t, i, x.count(t), len(x)) for i, x in enumerate(texts[start : start + 50], start) for t in set(x)]
        lists = []
        for half in (0, 25):  # a term of a block may have several rows
            for t in df:
                own = [p for p in posted if p[0] == t and half <= p[1] - start < half + 25]
                lists += [{"block": start, "term": t, "ids": [p[1] for p in own], "tfs": [p[2] for p in own], "dls": [p[3] for p in own]}] if own else []
        best.add(index._Block(pa.Table.from_pylist(lists), of, idf, mean, askers))
    got = [(r["n"], r["id"], r["score"]) for r in best.best().to_pylist()]
    want = []
    for j, q in enumerate(queries):
        scores = [(sum((idf[of[t]] * index.weight(float(x.count(t)), float(len(x)), mean) for t in q if t in x), 0.0), i) for i, x in enumerate(texts)]
        want += [(j, i, s) for s, i in sorted((-s, i) for s, i in scores if s > 0)[:k] for s in [-s]]
    assert got == want


def test_documents_share_states_of_leases():
    kept, timers = [], []

    class Held:
        exists = lambda self: bool(kept)
        get = lambda self: kept[-1]
        update = lambda self, x: kept.append(x)

    class Handle:
        getValueState = lambda self, *_: Held()
        listTimers = lambda self: list(timers)
        deleteTimer = timers.remove
        registerTimer = timers.append

    class Now:
        getCurrentWatermarkInMs = lambda self: 20_000

    p = leases.Leases(10, 4)
    p.init(Handle())
    frame = pd.DataFrame([("a", 0, 5_000_000, "claim", "w"), ("b", 0, 1_000_000, "claim", None), ("a", 0, 6_000_000, "done", "w")], columns=["doc_id", "idx", "us", "kind", "worker_id"])
    (out,) = p.handleInputRows((1,), iter([frame]), None)
    assert [tuple(r)[:4] for r in out.itertuples(index=False)] == [("a", 0, 5_000_000, "claimed"), ("a", 0, 6_000_000, "done"), ("b", 0, 1_000_000, "claimed")] and timers == [11_001]
    (out,) = p.handleExpiredTimer((1,), Now(), None)
    assert [tuple(r)[:4] for r in out.itertuples(index=False)] == [("b", 0, 11_000_000, "requeued")] and timers == []


def test_prose_is_read_by_no_pattern(spark, monkeypatch):
    from lodestone.operators import chunks, splitting

    read, prose = [], "Some words, and | more of $ them. " * 300 + "\n" + "A line [of] its own.\n" * 200
    counting = type("Counting", (), {"finditer": lambda self, text: read.append(text) or iter(())})()
    monkeypatch.setattr(splitting, "PROTECTED", {k: (counting,) * len(v) for k, v in splitting.PROTECTED.items()} if isinstance(splitting.PROTECTED, dict) else (counting,) * len(splitting.PROTECTED))
    assert splitting.split(prose, splitting.SplitConfig(384, 76), splitting.Signals())[0] and read == []
    rows = spark.createDataFrame([(0, prose), (1, prose + "\fx"), (2, None)], "i int, text string").select("i", chunks.signals(F.coalesce("text", F.lit("")), "auto").alias("s")).collect()
    assert {r["i"]: len(r["s"]["languages"]) > 0 for r in rows} == {0: False, 1: True, 2: False}  # languages are worked out where chapters are looked for


def test_signals_are_those_of_the_profile(spark):
    from lodestone.operators import structure

    bits = ["# H\n", "## Sub #\n", "# \n", "#no\n", "\n\n\n", "Word word. ", "中文。", "```\n# a\n```\n", "\f", "1. Intro\n", "1.2.3 x\n", "ALL CAPS HEADING\n", "Chapter 3: x\n", "第三章 z\n", "---\n", "Seite 3 von 4\n", "| a | b |\n", "ü", " ```\n"]
    rng = np.random.default_rng(3)
    texts = ["", "# a\n# b\n# c", *["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(200)]]
    p = structure.profile(F.col("text"))
    found = spark.createDataFrame([(t,) for t in texts], "text string").select("text", structure.calls(F.col("text")).alias("c"), p["tiers"].alias("tiers"), p["dominant_level"].alias("level"), p["languages"].alias("languages")).collect()
    for r in found:
        assert (r["c"]["tiers"], r["c"]["level"]) == (r["tiers"], r["level"]) and r["c"]["languages"] == (r["languages"] if "heuristic" in r["tiers"] else []), r["text"]
    assert {tuple(r["tiers"]) for r in found} == {("legacy",), ("heuristic", "legacy"), ("heading", "legacy"), ("heading", "heuristic", "legacy")}


def test_hashes_of_chunks_by_any_white_space():
    import hashlib

    from lodestone.operators.chunks import _WORD, text_hash

    spaces = [" ", "  ", "\n", "\t", "\r\n", "\v", "\f", "\x1c", "\x1f", "\x85", "\xa0", "　", "​", ""]
    for a in spaces:
        for b in spaces:
            for text in (f"{a}one{b}two{a}", f"one{a}{b}two", f"{a}é{b}"):
                assert text_hash(text) == hashlib.sha256(" ".join(_WORD.findall(text)).encode()).hexdigest(), repr(text)


def test_rows_of_tables_are_found_as_before():
    import random
    import re

    from lodestone.operators import splitting

    slow = r"[ ]*(?:\|[^|\n]*)+\|[\r\n]+"
    head = re.compile(slow + r"[ \t\n\f\r]*(?:\|[ \t\n\f\r]*:?-{3,}:?[ \t\n\f\r]*)+\|[\r\n]+")
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice(["|", "|", "-", "---", " ", "\n", "|\n", "\r", "a", ":", "|---|\n"]) for _ in range(rng.randint(2, 30)))
        found = sorted((m.span() for p in (head, re.compile(slow)) for m in p.finditer(text)), key=lambda s: (s[0], -s[1]))
        out = []
        for a, b in found:
            if not out or a >= out[-1][1]:
                out.append((a, b))
        assert splitting.protected(text) == out, repr(text)


def test_chunks_are_embedded_where_they_are_split(spark, tmp_path):
    text = "\n\n".join(f"Sentence {i % 5} is one of some. " * 12 for i in range(40))
    for name, ids in (("once", range(6)), ("again", [0, 1, 1, None, None, 2])):
        spark.createDataFrame([(i, text + "x" * k) for k, i in enumerate(ids)], "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
    once, again = (catalog.embed_documents(spark, f"{tmp_path}/{name}") for name in ("once", "again"))
    assert "hashpartitioning" not in plan(once) and "hashpartitioning" in plan(again)
    got = [r["id"] for r in once.collect()]
    assert len(got) == len(set(got)) > 12
    found = [r["id"] for r in again.select("id").where("id <> ''").collect()]
    assert len(found) == len(set(found)) > 6


def test_slots_of_words_are_bounded_and_right(monkeypatch):
    import hashlib

    from lodestone.operators.embedding import HashEmbedder, _Slots

    def plain(text, dim):
        out = np.zeros(dim, np.float32)
        for w in text.lower().split():
            h = hashlib.blake2b(w.encode(), digest_size=8).digest()
            out[int.from_bytes(h[:4], "little") % dim] += 1 if h[4] & 1 else -1
        return out / (np.linalg.norm(out) or 1)

    monkeypatch.setattr(_Slots, "MOST", 5)
    e, texts = HashEmbedder(7), ["", "One two", "one TWO three four", " ".join(f"w{i % 13}" for i in range(60)), "ÄÖ two"]
    assert np.allclose(e(texts), [plain(t, 7) for t in texts], atol=1e-7) and len(e.slots) <= 5 and len(e.slots.before) <= 5
    assert e([]) == [] and np.allclose(e(texts[::-1]), [plain(t, 7) for t in texts[::-1]], atol=1e-7)
