import json
import random
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions import text as T
from lodestone.functions.metadata import metadata_filter
from lodestone.operators import chunks, embedding, evaluation, metrics, retrieval, shards, splitting as S, stitch, tables
from lodestone.sources import formats, html, readers
from lodestone.streaming import jobs


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---------------------------------------------------------------- shards


@pytest.mark.parametrize(
    ("pages", "size", "overlap", "expected"),
    [
        (40, 20, 0, [(1, 20), (21, 40)]), (45, 20, 0, [(1, 20), (21, 40), (41, 45)]), (1, 20, 1, [(1, 1)]), (5, 1, 1, [(i, i) for i in range(1, 6)]),
        (100, 20, 1, [(1, 20), (20, 39), (39, 58), (58, 77), (77, 96), (96, 100)]), (0, 20, 1, []),
    ],
)
def test_fixed_bounds(spark, pages, size, overlap, expected):
    d = spark.createDataFrame([(1, pages)], "id int, pages int")
    assert [r[2:] for r in rows(shards.fixed_bounds(d, "id", "pages", size, overlap).orderBy("idx"))] == expected


def test_chapter_bounds(spark):
    d = spark.createDataFrame([(1, 80), (2, 25)], "id int, pages int")
    outline = spark.createDataFrame([(1, 1), (1, 21), (1, 61), (2, 1), (2, 10), (2, 99)], "id int, page int")
    got = rows(shards.chapter_bounds(d, outline, "id", "pages", 20).orderBy("id", "idx"))
    one, two = [r[2:] for r in got if r[0] == 1], [r[2:] for r in got if r[0] == 2]
    assert one == [(1, 20), (21, 40), (41, 60), (61, 80)]
    assert two == [(1, 9), (10, 24), (25, 25)]


def test_ladder_and_resplit(spark):
    d = spark.createDataFrame([("a", 0, 1, 20, 2), ("a", 1, 21, 40, 3), ("a", 2, 41, 41, 2), ("a", 3, 42, 50, 2)], "doc_id string, idx int, page_start int, page_end int, attempts int")
    got = rows(shards.resplit(d).orderBy("idx"))
    assert [r[3:] for r in got if r[1] == 0] == [(1, 5), (6, 10), (11, 15), (16, 20)]
    assert [r[3:] for r in got if r[1] == 1] == [(i, i) for i in range(21, 41)]
    assert {r[1] for r in got} == {0, 1} and [r[2] for r in got] == list(range(4, 28))


# ---------------------------------------------------------------- text


def test_text_functions(spark):
    d = spark.createDataFrame([("",), ("abc",), ("a" * 10,), ("中文字符中文",), ("Der Hund und die Katze",), (" a\t b c ",), (None,)], "t string")
    got = d.select(T.token_estimate(F.col("t"), "en"), T.language(F.col("t")), T.collapsed(F.col("t"))).collect()
    assert [r[0] for r in got[:4]] == [0, 1, 3, 2]
    assert [r[1] for r in got[:5]] == ["mixed", "en", "en", "zh", "de"]
    assert got[5][2] == "a b c" and got[6][0] == 0


def test_truncation_uuid_and_paths(spark):
    d = spark.createDataFrame([("aé中",)], "t string")
    assert [d.select(T.truncated_bytes(F.col("t"), n)).first()[0] for n in (0, 1, 2, 3, 5, 6)] == ["", "a", "a", "aé", "aé", "aé中"]
    assert d.select(T.uuid5(F.lit("chunk:d:h"))).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "chunk:d:h"))
    assert d.select(T.heading_path(F.lit("# A\n## B")), T.heading_path(F.lit(""))).first()[:] == (["A", "B"], None)
    assert d.select(T.payload_markdown(F.lit('{"markdown": "x"}')), T.payload_markdown(F.lit("{no"))).first()[:] == ("x", "{no")


def test_titles(spark):
    d = spark.createDataFrame([("C++ Crash Course", "cpluspluscrashcourse-fast"), ("Go", "Cloud Native Go"), ("a.b", "A B")], "a string, b string")
    assert [r[0] for r in d.select(T.titles_match(F.col("a"), F.col("b"))).collect()] == [True, False, True]
    assert d.select(T.normal_title(F.lit("C++ Crash_Course"))).first()[0] == "cplusplus crash course"
    junk = d.limit(1).select(T.is_junk(F.array(F.lit("Table of Contents")), F.lit("t")), T.is_junk(F.array(F.lit("x"), F.lit(" Index ")), F.lit("t")), T.is_junk(F.array(F.lit("x")), F.lit("a.PDF")), T.is_junk(F.array().cast("array<string>"), F.lit(None).cast("string")))
    assert junk.first()[:] == (True, True, True, False)


def test_metadata_filter(spark):
    d = spark.createDataFrame(
        [("Alpha", '{"year": 2021}'), ("alpha", '{"year": "2019", "custom_tag": "y"}'), ("Beta", '{"year": "n/a"}'), ("Beta", '{"year": null}'), ("Gamma", "{}"), (None, None)], "author string, metadata string"
    )
    n = lambda f: d.where(metadata_filter(f)).count()
    assert n({"year_from": 2018, "year_to": "2022"}) == 2 and n({"author": "ALPHA"}) == 2 and n({"custom_tag": "y"}) == 1 and metadata_filter({}) is None
    for bad in ({"bad key!": "x"}, {"author": 42}, {"year_from": "soon"}, {"k": 5}):
        with pytest.raises(ValueError):
            metadata_filter(bad)


# ---------------------------------------------------------------- chunking


def verbatim(text, found):
    for c in found:
        assert text[c.start : c.end] == c.text[c.prefix :], (c.start, c.end, c.prefix)


def table(n):
    return "| Name | Value |\n| --- | --- |\n" + "".join(f"| row {i} | value {i} |\n" for i in range(n))


def test_protected_regions():
    assert len(S.protected("See [a](http://x) and ![b](http://y).")) == 2
    assert len(S.protected("$$x=1$$ then `code` and\n```py\nprint(1)\n```\n")) == 3


@pytest.mark.parametrize(("n", "size"), [(200, 400), (120, 400), (30, 200)])
def test_tables_keep_rows_and_headers(n, size):
    text = "Intro.\n\n" + table(n) + "\nAfter."
    found = S.plain(text, S.SplitConfig(size, 80).normalised())
    verbatim(text, found)
    for c in found:
        if "| row" in c.text:
            assert c.text.lstrip().startswith(("| Name", "Intro")) and "| --- |" in c.text
        assert all(x.startswith("|") and x.endswith("|") for x in c.text.splitlines() if "row" in x)
    assert {x for c in found for x in c.text.splitlines() if "row" in x} == {f"| row {i} | value {i} |" for i in range(n)}


def test_second_table_gets_its_own_header():
    text = table(30) + "\n" + table(30).replace("Name", "Other")
    found = S.plain(text, S.SplitConfig(300, 80).normalised())
    verbatim(text, found)
    assert "| Other | Value |" in found[-1].text and "Name" not in found[-1].text


def test_stray_brackets():
    text = "[" + "\n\n".join(f"Paragraph {i} with some words in it." for i in range(60))
    found = S.plain(text, S.SplitConfig(300, 80).normalised())
    verbatim(text, found)
    assert len(found) >= 2 and all(c.end - c.start <= len(text) // 2 for c in found)


def test_tiers():
    headed = "\n".join(f"## Part {i}\n\n" + f"Some text of part {i}. " * 20 + "\n" for i in range(6))
    found, tried = S.split(headed, S.SplitConfig(512, 80), S.Signals(("heading", "legacy"), 2, ("en",)))
    verbatim(headed, found)
    assert tried[0] == ("heading", None) and found[0].breadcrumb.startswith("## Part 0")
    marked = "\n".join(f"Chapter {i}: Title\n\n" + "Words and more words. " * 20 for i in range(8))
    verbatim(marked, S.split(marked, S.SplitConfig(512, 80), S.Signals(("heuristic", "legacy"), 0, ("en",)))[0])


def test_faults():
    c = lambda n: S.Chunk("x" * n, 0, n)
    assert S.fault([], 10, 100) and S.fault([c(900)], 900, 100) and S.fault([c(300), c(100)], 400, 100)
    assert S.fault([c(100), c(100)], 200, 100) is None


def test_random_texts_are_verbatim(spark):
    rng = random.Random(4)
    bits = ["# H\n", "## Sub\n\n", table(3), "\n\n", "Word word. ", "中文。", "```\ncode\n```\n", "[l](http://x) ", "\f", "1. Intro\n", "ALL CAPS HEADING\n", "$$a$$", "x" * 700, "\n\n\n\n"]
    texts = {str(i): "".join(rng.choice(bits) for _ in range(rng.randint(0, 120))) for i in range(150)}
    covered = {k: set() for k in texts}
    for r in chunks.raw_chunks(spark.createDataFrame(list(texts.items()), "doc_id string, text string"), parent_size=600, child_size=200).collect():
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["text"][r["prefix"] :]
        covered[r["doc_id"]] |= set(range(r["start"], r["end"]))
    assert all(i in covered[k] or t[i].isspace() for k, t in texts.items() for i in range(len(t)))


def test_page_map():
    text = "line one\nline two\nline three\n"
    m = S.PageMap(text, [1, 2, 3])
    assert m.of(0, 8) == (1, 1) and m.of(9, 17) == (2, 2) and m.of(0, len(text)) == (1, 3)
    assert S.PageMap(text, [1, 2]).of(0, 3) == (None, None)


def test_stitch(spark):
    text, pages = stitch.stitched([("# A\nx\n## Shared", 1, 2), ("## Shared\ny", 3, 4)])
    assert text.count("## Shared") == 1 and pages == [1, 1, 2, 4]
    text, pages = stitch.stitched([("a\nb", 1, 2), ("c\nd", 3, 4), ("", 5, 6)])
    assert pages == [1, 2, 3, 4] and text == "a\nb\nc\nd\n"
    assert stitch.stitched([]) == ("\n", None) and stitch.stitched([("a", None, None)])[1] is None
    d = spark.createDataFrame([(1, 1, 3, 4, "late"), (1, 0, 1, 2, '{"markdown": "early"}')], "doc_id int, idx int, page_start int, page_end int, payload string")
    assert rows(stitch.stitch(d)) == [(1, "early\nlate\n", [1, 3])]


def test_chunk_rows(spark):
    text = "\n".join(f"## Part {i}\n\n" + f"Some text of part {i}. " * 30 for i in range(6))
    d = spark.createDataFrame([("a", text), ("b", "short"), ("c", ""), ("d", None)], "doc_id string, text string")
    got = chunks.chunked(d).collect()
    for doc in ("a", "b"):
        own = sorted((r for r in got if r["doc_id"] == doc), key=lambda r: r["seq"])
        assert [r["seq"] for r in own] == list(range(len(own))) and [r["is_parent"] for r in own] == sorted((r["is_parent"] for r in own), reverse=True)
        ids = {r["id"] for r in own if r["is_parent"]}
        assert all(r["parent_id"] in ids or r["parent_id"] is None for r in own) and len({r["chunk_hash"] for r in own}) == len(own)
    assert {r["doc_id"] for r in got} == {"a", "b"}
    assert chunks.profiles(d).count() == 4


# ---------------------------------------------------------------- retrieval


@pytest.fixture(scope="module")
def store(spark):
    c = [("p", "d1", None, True, 0, 1, 10, "parent text", None, "c1"), ("x", "d1", "p", False, 1, 1, 3, "alpha beta", [1.0, 0.0], "c1"), ("y", "d1", "p", False, 2, 4, 8, "gamma", [0.9, 0.1], "c1"), ("z", "d2", None, False, 0, None, None, "alpha", [0.0, 1.0, 0.0], "c2"), ("o", "gone", None, False, 0, 1, 1, "alpha", [0.0, 0.0], "c1")]
    chunks_ = spark.createDataFrame(c, "id string, doc_id string, parent_id string, is_parent boolean, seq int, page_start int, page_end int, text string, embedding array<float>, collection_id string").withColumn("heading_path", F.lit(None).cast("array<string>"))
    docs = spark.createDataFrame([("d1", "One", 0.5, "A", '{"year": 2020}'), ("d2", "Two", None, "B", "{}")], "id string, title string, completeness double, author string, metadata string")
    return chunks_, docs


def test_hybrid_scores(store):
    chunks_, docs = store
    got = {r["chunk_id"]: r for r in retrieval.hybrid_search(chunks_, docs, [1.0, 0.0], "alpha", 8, collections=["c1"]).collect()}
    assert set(got) == {"x", "y"}
    assert got["y"]["score"] == pytest.approx(1 / 62) and got["y"]["parent_text"] == "parent text" and got["x"]["partial"]
    single = retrieval.hybrid_search(chunks_, docs, [1.0, 0.0], "beta", 8, collections=["c1"]).collect()
    assert single[0]["chunk_id"] == "x" and single[0]["score"] == pytest.approx(1 / 61 + 0.3 / 61)


def test_filters_come_before_the_top(store):
    chunks_, docs = store
    got = retrieval.hybrid_search(chunks_, docs, [0.0, 1.0], "", 1, scope=["c1"], metadata=metadata_filter({"author": "a"})).collect()
    assert [r["chunk_id"] for r in got] == ["y"]


def test_multi_search(spark, store):
    chunks_, docs = store
    cols = spark.createDataFrame([("c1", "m1"), ("c2", "m2"), ("c3", None)], "id string, embedding_model_id string")
    calls = []

    def embed(model, query):
        calls.append(model)
        return [1.0, 0.0] if model == "m1" else [0.0, 1.0, 0.0]

    got = {r["chunk_id"]: r["score"] for r in retrieval.multi_search(chunks_, docs, cols, "alpha", 8, embed).collect()}
    assert calls == ["m1", "m2"] and {"x", "y", "z"} == set(got) and got["z"] > 1 / 61
    assert retrieval.multi_search(chunks_, docs, cols, "alpha", 8, embed, ["c2"], ["c1"]).count() == 0


def test_rerank_and_reads(store):
    chunks_, docs = store
    hits = retrieval.hybrid_search(chunks_, docs, [1.0, 0.0], "alpha", 8, collections=["c1"])
    assert [r["chunk_id"] for r in retrieval.reranked(hits, "q", lambda q, t: [len(x) == 5 for x in t], 1).collect()] == ["y"]

    def fails(q, t):
        raise ConnectionError

    kept = retrieval.reranked(hits, "q", fails, 2).collect()
    assert [r["chunk_id"] for r in kept] == ["x", "y"] and not kept[0]["reranked"]
    paged = lambda a, b: [r["id"] for r in retrieval.read_pages(chunks_, F.lit(a), F.lit(b)).where("doc_id = 'd1'").collect()]
    assert paged(8, 12) == ["p"] and paged(20, 25) == []
    near = retrieval.neighbours(chunks_, chunks_.where("id = 'y'").select("doc_id", "seq"), 3)
    assert {r["id"] for r in near.collect()} == {"x", "y"}


# ---------------------------------------------------------------- counters, tables, queues


def test_percentiles_and_completeness(spark):
    d = spark.createDataFrame([("a", i) for i in range(1, 11)] + [("b", None)], "k string, v int")
    got = {r["k"]: r for r in metrics.percentiles(d, ["k"], "v", {"p50": 50, "p95": 95}).collect()}
    assert (got["a"]["p50"], got["a"]["p95"]) == (5, 9) and "b" not in got
    c = spark.createDataFrame([(290, 39224), (0, 0), (3, 1)], "t int, f int").select(metrics.completeness(F.col("t"), F.col("f")).cast("string")).collect()
    assert [r[0] for r in c] == ["0.0000", None, "0.6667"]
    assert metrics.period_start("24h", datetime(2024, 1, 2)) == datetime(2024, 1, 1)
    with pytest.raises(ValueError):
        metrics.period_start("1y", datetime(2024, 1, 2))


def test_tables(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (3, "d")], "id int, x string")
    assert sorted(rows(tables.insert_ignore(t, new, ["id"], ["x"]))) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(rows(tables.upsert(t, new.where("x <> 'd'"), ["id"]))) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(rows(tables.update_from(t, new.where("id = 2"), ["id"]))) == [(1, "a"), (2, "B")]
    assert rows(tables.duplicates(new, ["id"])) == [(3, 2)]
    n = spark.createDataFrame([(1, 5), (2, 7)], "id int, n int")
    assert sorted(rows(tables.added(n, spark.createDataFrame([(1, 2), (1, 1), (1, None), (3, 9)], "id int, n int"), ["id"]))) == [(1, 8), (2, 7)]
    keys = spark.createDataFrame([("a", None, 3), ("b", 1, None), ("c", None, None)], "id string, revoked_at int, last_used_at int")
    gone = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    assert sorted(rows(tables.revoked(keys, gone, F.lit(9)))) == [("a", 9, 3), ("b", 1, None), ("c", None, None)]
    used = spark.createDataFrame([("a", 2), ("b", 4), ("b", 6)], "api_key_id string, created_at int")
    assert sorted(rows(tables.touched(keys, used))) == [("a", None, 3), ("b", 1, 6), ("c", None, None)]
    shard = spark.createDataFrame([("d", 0, "pending", 0), ("d", 1, "done", 1)], "doc_id string, idx int, state string, attempts int").withColumn("worker_id", F.lit(None).cast("string")).withColumn("lease_until", F.lit(None).cast("timestamp"))
    got = {r["idx"]: r for r in tables.claimed(shard, shard.select("doc_id", "idx"), "w", F.lit("2024-01-01").cast("timestamp"), 600).collect()}
    assert got[0]["state"] == "running" and got[0]["attempts"] == 1 and got[1]["state"] == "done"


def test_jobs_and_stream(spark, tmp_path):
    jobs_ = spark.createDataFrame([("d1", 0, 1, 2), ("d2", 1, 3, 4)], "doc_id string, idx int, page_start int, page_end int")
    entries = jobs.encoded(jobs_).unionByName(spark.createDataFrame([("{broken",), (json.dumps({"schema_version": 9, "doc_id": "x"}),)], "job string"))
    got = jobs.decoded(entries).collect()
    assert sorted(r["bad"] for r in got) == [False, False, True, True]
    entries.write.json(str(tmp_path / "in"))
    seen = []
    q = jobs.consume(spark.readStream.schema("job string").json(str(tmp_path / "in")), lambda df, epoch: seen.extend(r["doc_id"] for r in df.collect()), str(tmp_path / "bad"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(seen) == ["d1", "d2"] and spark.read.parquet(str(tmp_path / "bad")).count() == 2


def test_streaming_rollup_equals_batch(spark, tmp_path):
    d = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 17) as done_at, cast(id % 3 as int) as page_start, cast(id % 3 + 2 as int) as page_end, if(id % 5 = 0, 'failed', 'done') as state from range(50)")
    d.write.parquet(str(tmp_path / "in"))
    q = jobs.streaming_rollup(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), "0 seconds").writeStream.format("memory").queryName("roll").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = metrics.minute_rollup(d.withColumn("duration_ms", F.lit(1)).withColumn("peak_rss_mb", F.lit(1)))
    cols = ["bucket", "pages_parsed", "shards_done", "shards_failed"]
    assert sorted(rows(spark.table("roll").select(cols))) == sorted(rows(batch.select(cols)))


# ---------------------------------------------------------------- evaluation, sources, embedding


def test_evaluation(spark, tmp_path):
    cases = spark.createDataFrame([("a", "exact", ["Cloud Native Go"], ["intro"]), ("b", "drift", ["Something Else"], None)], "id string, category string, expected_doc_titles array<string>, expected_headings array<string>")
    res = spark.createDataFrame([("a", 1, "Other", ["x"]), ("a", 2, None, ["x"]), ("a", 3, "Cloud Native Go", ["Introduction"]), ("b", 1, "No", ["Index"])], "id string, rank int, doc_title string, heading_path array<string>")
    ranked = {r["id"]: r for r in evaluation.ranked_hits(cases, res, 8).collect()}
    assert ranked["a"]["rank"] == 3 and ranked["a"]["heading_hit"] and ranked["b"]["rank"] is None and ranked["b"]["junk"] == 1
    total = evaluation.summary(evaluation.ranked_hits(cases, res, 8), 8).where("category is null").first()
    assert total["hit_3"] == 0.5 and total["mrr"] == pytest.approx(1 / 3)
    (tmp_path / "c.jsonl").write_text('{"id":"1","query":"q","expected_doc_titles":["Long enough title"],"category":"exact"}\n{"id":"1","query":"","expected_doc_titles":["Go"],"category":"odd"}\nnope\n')
    faults = {(r["id"], r["fault"]) for r in evaluation.load_cases(spark, str(tmp_path / "c.jsonl"))[1].collect()}
    assert {("1", "no query"), ("1", "a title under 8 characters"), ("1", "unknown category"), ("1", "id used twice"), (None, "not JSON")} <= faults
    assert "| overall | 2 |" in evaluation.report([r.asDict() for r in evaluation.summary(evaluation.ranked_hits(cases, res, 8), 8).collect()])


def test_formats_and_html(spark):
    import io
    import zipfile

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
    d = spark.createDataFrame([(b"%PDF-1.7", "x"), (buf.getvalue(), "a.docx"), (buf.getvalue(), "a"), (b"PK\x03\x04", "a"), (b"<!DOCTYPE html><p>", "a.txt"), (b"# hi", "a.md"), (b"hi", "a"), (bytes(range(30)), "a")], "body binary, name string")
    got = [r[0] for r in d.select(formats.sniffed(F.col("body"), F.col("name"))).collect()]
    assert got == ["pdf", "docx", "epub", None, "html", "md", "txt", None]
    v = [r[0] for r in d.select(formats.verified(formats.sniffed(F.col("body"), F.col("name")), F.col("body"))).collect()]
    assert v[1] is None and v[3] == "unknown format" and v[6] is None
    md = html.to_markdown("<html><head><title>t</title></head><body><nav>n</nav><h1>A</h1><p>b <b>c</b></p><ul><li>d</li></ul><table><tr><th>x</th></tr><tr><td>1|2</td></tr></table><script>s</script></body></html>")
    assert md == "# A\n\nb c\n\n- d\n\n| x |\n| --- |\n| 1\\|2 |\n"
    ips = spark.createDataFrame([("10.0.0.1",), ("8.8.8.8",), ("::1",), ("junk",)], "ip string")
    assert [r[0] for r in ips.select(readers.forbidden_address(F.col("ip"))).collect()] == [True, False, True, True]
    feed = '<feed><link rel="next" href="p2"/><entry><id>1</id><title>T</title><link rel="http://opds-spec.org/acquisition" href="a.pdf" type="application/pdf"/><link rel="http://opds-spec.org/acquisition" href="a.epub" type="application/epub+zip"/></entry></feed>'
    f = spark.createDataFrame([("http://h/x/feed", feed)], "url string, xml string")
    assert rows(readers.feed_entries(f)) == [("http://h/x/feed", "1", "T", "http://h/x/a.epub", "application/epub+zip")]
    assert rows(readers.next_pages(f)) == [("http://h/x/feed", "http://h/x/p2")]


def test_embedding(spark):
    parts = list(embedding.batches(["a b", "c " * 10, "d", "e"], tokens=4, most=2))
    assert [[i for i, _ in p] for p in parts] == [[0], [1], [2, 3]] and len(parts[1][0][1].split()) == 4
    d = spark.createDataFrame([(1, "a b"), (2, "")], "id int, text string")
    got = {r["id"]: r["embedding"] for r in embedding.embedded(d, embedding.HashEmbedder).collect()}
    assert len(got[1]) == 64 and sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-5)
    fails, waits = [3], []

    def call(texts):
        if fails[0]:
            fails[0] -= 1
            raise ConnectionError
        return [[0.0] * 2 for _ in texts]

    assert embedding.Guarded(call, 2, pause=waits.append)(["x"]) == [[0.0, 0.0]] and waits == [0.5, 1.0, 2.0]
    with pytest.raises(ValueError):
        embedding.Guarded(lambda t: [[0.0]], 2)(["x"])


def test_config():
    assert [config.top_k(x) for x in (None, 0, 3, 99)] == [8, 8, 3, 25] and config.page_of_list(2, 500) == (50, 50)
    assert config.SplitConfig(0, 0).normalised() == config.SplitConfig(512, 80) and config.SplitConfig(100, 90).normalised().overlap == 50
    with pytest.raises(ValueError):
        config.top_k(-1)


def test_line_numbers_of_files_in_many_splits(spark, tmp_path):
    import json

    from lodestone.operators import evaluation

    good = lambda i: json.dumps({"id": f"q{i}", "query": "x " * (i % 7 + 1), "expected_doc_titles": ["A Long Enough Title"], "category": "exact"})
    lines = [good(i) if i % 13 else "" for i in range(900)]
    lines[500], lines[700], lines[701], lines[702] = "{broken", good(3), good(4).replace("exact", "odd"), good(5).replace("A Long Enough Title", "short")
    for name in ("a.jsonl", "b.jsonl"):
        (tmp_path / name).write_text("\n".join(lines if name == "a.jsonl" else ["", good(5000)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
    try:
        numbered = evaluation.numbered_lines(spark, str(tmp_path))
        assert numbered.rdd.getNumPartitions() > 5
        got = {(r["file"].rpartition("/")[2], r["line"]): r["value"] for r in numbered.collect()}
        assert got == {("a.jsonl", i + 1): x for i, x in enumerate(lines)} | {("b.jsonl", 1): "", ("b.jsonl", 2): good(5000)}
        cases, faults = evaluation.load_cases(spark, str(tmp_path))
        assert cases.count() == sum(x != "" for x in lines) + 1
        found = sorted((r["line"], r["fault"]) for r in faults.collect())
        assert [x for x in found if x[0] == 501][0] == (501, "no id") and (501, "not JSON") in found and [x for x in found if x[0] > 600] == [(701, "id used twice"), (702, "id used twice"), (702, "unknown category"), (703, "a title under 8 characters"), (703, "id used twice")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_texts_of_few_files_are_dealt(spark, tmp_path):
    from lodestone.operators.chunks import chunked, dealt

    spark.range(40).selectExpr("cast(id as string) as doc_id", "repeat('word word. ', 50) as text").coalesce(1).write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t"))
    assert dealt(d).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism and dealt(spark.range(3)).rdd.getNumPartitions() == spark.range(3).rdd.getNumPartitions()
    many = d.repartition(9)
    many.write.parquet(str(tmp_path / "many"))
    assert "RoundRobin" not in dealt(spark.read.parquet(str(tmp_path / "many")))._jdf.queryExecution().executedPlan().toString()
    assert chunked(d).groupBy("doc_id").count().count() == 40


def test_few_texts_are_objects_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from lodestone.operators import chunks
    from lodestone.sources import html

    seen = []

    class Batch:
        def __init__(self, values):
            self.values = values

        def slice(self, i, n):
            return Batch(self.values[i : i + n])

        def to_pylist(self):
            seen.append(len(self.values))
            return self.values

        def __len__(self):
            return len(self.values)

        num_rows = property(__len__)

    assert list(chunks._rows(Batch(list(range(1000))))) == list(range(1000)) and max(seen) <= chunks.AT_ONCE
    pages = [f"<p>{i}</p>" if i % 7 else None for i in range(500)]
    assert html._in_parts(Batch(pages)).to_pylist() == [html.to_markdown(x) for x in pages] and max(seen) <= html.AT_ONCE
    assert html._in_parts(pa.array([], pa.string())).to_pylist() == []


def test_term_stats(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "B c b b"), (5, "a")], "doc_id long, text string").repartition(3)
    stats = retrieval.term_stats(docs)
    assert sorted(map(tuple, stats.collect())) == [("a", 2, 3, 2), ("b", 2, 4, 3), ("c", 1, 1, 1)]
    assert "hashpartitioning(term" in (plan := stats._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(term, id" not in plan
    assert retrieval.term_stats(docs.where("doc_id in (2, 3)")).collect() == []
