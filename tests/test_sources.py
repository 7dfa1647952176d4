"""Feeds in pages as a data source, the event sink and observed counters."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.plans import views
from lodestone.sources import feeds
from lodestone.streaming import event_log

ACQ = feeds.RELATION


def page(entries, after=None):
    link = f'<link rel="next" href="{after}"/>' if after else ""
    return f'<feed xmlns="http://www.w3.org/2005/Atom">{link}{"".join(entries)}</feed>'


def entry(i, links="", title=True):
    return f"<entry><id>e{i}</id>{f'<title>T{i}</title>' if title else ''}<author><name>A</name></author><author><name/></author>{links}</entry>"


def lay(folder):
    pdf, epub = f'<link rel="{ACQ}/open" href="a.pdf" type="application/pdf"/>', '<link href="../b.epub" type="application/epub+zip"/>'
    (folder / "one").mkdir()
    (folder / "one" / "1.xml").write_text(page([entry(1, pdf + epub), entry(2), entry(2)], "2.xml"))
    (folder / "one" / "2.xml").write_text(page([entry(3, f'<link rel="{ACQ}" href="ftp://x/y"/><link rel="{ACQ}" href=" "/>', title=False)], "3.xml"))
    (folder / "one" / "3.xml").write_text(page([entry(4, pdf)], "1.xml"))  # leads back
    (folder / "two.xml").write_text(page([]))
    return [f"file://{folder}/one/1.xml", f"file://{folder}/two.xml"]


def loaded(spark, urls):
    spark.dataSource.register(feeds.FeedSource)
    return spark.read.format("feed").option("urls", json.dumps(urls)).load()


def test_feeds_in_pages(spark, tmp_path):
    got = loaded(spark, lay(tmp_path)).orderBy("page_no", "entry_no")
    assert [(r["page_no"], r["entry_no"], r["id"], r["title"], r["authors"]) for r in got.collect()] == [(0, 0, "e1", "T1", ["A"]), (0, 1, "e2", "T2", ["A"]), (0, 2, "e2", "T2", ["A"]), (1, 0, "e3", None, ["A"]), (2, 0, "e4", "T4", ["A"])]
    first, third = got.collect()[0], got.collect()[3]
    assert first["href"] == f"file://{tmp_path}/b.epub" and first["type"] == "application/epub+zip" and [x["href"] for x in first["links"]] == [f"file://{tmp_path}/one/a.pdf", f"file://{tmp_path}/b.epub"]
    assert (third["href"], third["links"]) == (None, [])
    assert loaded(spark, lay_two(tmp_path)).rdd.getNumPartitions() == 2


def lay_two(folder):
    return [f"file://{folder}/one/3.xml", f"file://{folder}/two.xml"]


def test_what_is_no_feed(tmp_path):
    for body in (b"<html/>", b"not xml"):
        with pytest.raises(ValueError):
            feeds.parsed("file:///x", body)
    with pytest.raises(ValueError):
        feeds.fetch("ftp://x/y")


def test_a_feed_as_a_stream_that_grows(spark, tmp_path):
    urls = lay(tmp_path)
    (tmp_path / "one" / "2.xml").write_text(page([entry(3)]))  # ends here at first
    spark.dataSource.register(feeds.FeedSource)

    def run():
        source = spark.readStream.format("feed").option("urls", json.dumps(urls)).load().drop("links", "authors")
        source.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["page_no"], r["id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [(0, "e1"), (0, "e2"), (0, "e2"), (1, "e3")]
    assert run() == [(0, "e1"), (0, "e2"), (0, "e2"), (1, "e3")]
    (tmp_path / "one" / "2.xml").write_text(page([entry(3)], "3.xml"))
    assert run() == [(0, "e1"), (0, "e2"), (0, "e2"), (1, "e3"), (2, "e4")]


def test_event_sink(spark, tmp_path):
    spark.dataSource.register(event_log.EventLog)
    for i in range(2):
        spark.range(5 * i, 5 * i + 5).selectExpr("id", "concat('é', id) as message").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        source = spark.readStream.schema("id long, message string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        source.writeStream.format("event_log").option("path", f"file://{tmp_path}/log").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["epoch"], r["id"], r["message"]) for r in spark.read.json(f"{tmp_path}/log").collect())

    assert run() == run() == [(i // 5, i, f"é{i}") for i in range(10)]


def test_a_batch_is_committed_again_or_leaves_nothing(tmp_path):
    from pyspark.sql import Row

    writer = event_log.EventWriter(f"file://{tmp_path}/log")
    first = [writer.write(iter([Row(a=1), Row(a=2)])), writer.write(iter([]))]
    writer.commit(first, 3)
    writer.commit([writer.write(iter([Row(a=1), Row(a=2)]))], 3)
    assert [p.name for p in sorted((tmp_path / "log" / "epoch=3").iterdir())] == ["part-00000.json"] and (tmp_path / "log" / "epoch=3" / "part-00000.json").read_text() == '{"a": 1}\n{"a": 2}\n'
    writer.abort([writer.write(iter([Row(a=9)])), None], 4)
    assert list((tmp_path / "log" / ".aside").iterdir()) == [] and not (tmp_path / "log" / "epoch=4").exists()


def test_counters_while_rows_pass(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "search").otherwise("ingest").alias("kind"), (F.col("id") % 7).alias("milliseconds"))
    passed, seen = event_log.counted(rows)
    assert passed.where("kind = 'ingest'").count() == 666
    assert seen.get == views.request_counters(rows).first().asDict()
    empty, none = event_log.counted(rows.limit(0), "none")
    empty.collect()
    assert none.get == {"requests": 0, "searches": 0, "search_mean_ms": None}
