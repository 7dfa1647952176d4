"""Tables in versions, and the streams that keep them: rollup and leases."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import metrics
from lodestone.sources.tables import Change, Tables
from lodestone.sources.versions import Conflict, Versions
from lodestone.streaming import leases, rollup

DOCS, CHUNKS = ("id long, name string", ("id",)), ("id long, doc long, text string", ("id",))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def made(spark, tmp_path):
    return Tables(spark, f"file://{tmp_path}/t", {"docs": DOCS, "chunks": CHUNKS}, buckets=4)


def docs(spark, some):
    return spark.createDataFrame(some, "id long, name string")


def test_upsert_delete_and_old_versions(spark, made):
    one = made.commit({"docs": Change(upserts=docs(spark, [(1, "a"), (2, "b"), (None, "n"), (3, "c")]))})
    two = made.commit({"docs": Change(upserts=docs(spark, [(2, "B"), (None, "N"), (9, None)]), deletes=docs(spark, [(3, "")]).select("id"))})
    assert rows(made.read("docs")) == rows(docs(spark, [(1, "a"), (2, "B"), (None, "N"), (9, None)])) and rows(made.read("docs", one)) == rows(docs(spark, [(1, "a"), (2, "b"), (None, "n"), (3, "c")]))
    assert (one, two) == (2, 3) and made.latest() == 3
    made.commit({"docs": Change(deletes=made.read("docs").select("id"))})
    assert rows(made.read("docs")) == []
    made.vacuum(1)
    assert made.versions.numbers() == [4] and rows(made.read("docs")) == []


def test_the_last_row_of_a_key_counts(spark, made):
    new = spark.createDataFrame([(1, "late", 5), (1, "early", 1)] + [(2, "x", None)] * 300 + [(2, "y", 1)], "id long, name string, seq int")
    made.commit({"docs": Change(upserts=new, order="seq")})
    assert rows(made.read("docs")) == [(1, "late"), (2, "y")]


def test_only_touched_buckets_are_written(spark, made):
    made.commit({"docs": Change(upserts=docs(spark, [(i, "a") for i in range(50)]))})
    before = made.versions.read()[1]["tables"]["docs"]["files"]
    made.commit({"docs": Change(upserts=docs(spark, [(7, "b")]))})
    after = made.versions.read()[1]["tables"]["docs"]["files"]
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1 and made.read("docs").where("name = 'b'").count() == 1


class Between(Tables):
    """Lets another writer commit while this one works out its own change."""

    other = None

    def _worked_out(self, now, name, change):
        out = super()._worked_out(now, name, change)
        if self.other:
            other, self.other = self.other, None
            other()
        return out


def test_two_writers(spark, made):
    made.commit({"docs": Change(upserts=docs(spark, [(i, "a") for i in range(20)]))})
    same = Between(spark, made.path)
    same.other = lambda: made.commit({"docs": Change(upserts=docs(spark, [(i, "other") for i in range(10)]))})
    same.commit({"docs": Change(upserts=docs(spark, [(5, "mine"), (6, "mine")]))})  # the same buckets: worked out again
    found = dict(rows(made.read("docs")))
    assert [found[i] for i in (0, 4, 5, 6, 9, 15)] == ["other", "other", "mine", "mine", "other", "a"] and made.latest() == 4
    apart = Between(spark, made.path)
    apart.other = lambda: made.commit({"chunks": Change(upserts=spark.createDataFrame([(1, 1, "t")], CHUNKS[0]))})
    apart.commit({"docs": Change(upserts=docs(spark, [(5, "again")]))})
    assert made.read("chunks").count() == 1 and dict(rows(made.read("docs")))[5] == "again"


def test_a_write_that_dies_leaves_the_old_version(spark, made, monkeypatch):
    made.commit({"docs": Change(upserts=docs(spark, [(1, "a")]))})
    monkeypatch.setattr(Versions, "commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        made.commit({"docs": Change(upserts=docs(spark, [(1, "b"), (2, "c")]))})
    monkeypatch.undo()
    assert rows(made.read("docs")) == [(1, "a")]
    with pytest.raises(Conflict):
        made.versions.commit(made.latest(), {})


def test_cascade_is_one_commit(spark, made):
    made.commit({"docs": Change(upserts=docs(spark, [(1, "a"), (2, "b")])), "chunks": Change(upserts=spark.createDataFrame([(i, i % 3, "t") for i in range(12)], CHUNKS[0]))})
    before = made.latest()
    assert made.cascade("docs", spark.createDataFrame([(1,), (1,)], "gone long"), {"chunks": "doc"}) == before + 1
    assert rows(made.read("docs")) == [(2, "b")] and {r["doc"] for r in made.read("chunks").collect()} == {0, 2} and made.read("chunks", before).count() == 12


def test_a_batch_that_runs_again_changes_nothing(spark, made):
    change = lambda name: {"docs": Change(upserts=docs(spark, [(1, name)]))}
    first = made.commit(change("a"), ("stream", 0))
    assert made.commit(change("b"), ("stream", 0)) == first and rows(made.read("docs")) == [(1, "a")]
    made.commit(change("c"), ("stream", 1))
    assert rows(made.read("docs")) == [(1, "c")]


def shards(spark, n):
    return spark.range(n).select(
        (F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("id"), F.lit(900)))).alias("done_at"), F.lit(1).alias("page_start"), (F.col("id") % 5 + 1).cast("int").alias("page_end"),
        F.when(F.col("id") % 7 == 0, "failed").otherwise("done").alias("state"), F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40)).cast("int")).alias("duration_ms"), (F.col("id") % 3).cast("int").alias("peak_rss_mb"), F.col("id"),
    )


def test_rollup_of_a_stream(spark, tmp_path):
    all_rows = shards(spark, 400).withColumn("done_at", F.when(F.col("id") % 50 > 0, F.col("done_at")))
    for i in range(2):
        all_rows.where(f"id % 3 = {i}").drop("id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(all_rows.drop("id").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = lambda: rollup.keep_rollup(source(), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint", "1 hour").awaitTermination()
    run()
    all_rows.where("id % 3 = 2").drop("id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()  # from the checkpoint
    got = Tables(spark, f"file://{tmp_path}/out").read("rollup")
    want = metrics.minute_rollup(all_rows).select(*got.columns)
    assert rows(got) == rows(want) and got.count() >= 15


def lease_events(rng):
    kinds = ["claim", "claim", "renew", "done", "failed"]
    return [(f"d{rng.integers(0, 4)}", int(rng.integers(0, 2)), pd.Timestamp(1_700_000_000 + 40 * i, unit="s"), kinds[rng.integers(0, 5)], f"w{rng.integers(0, 2)}") for i in range(240)]


def test_steps_of_a_lease():
    at, lease = lambda s: pd.Timestamp(s, unit="s"), pd.Timedelta(seconds=10)
    new = lambda: {"state": "pending", "attempts": 0, "until": pd.Timestamp(0), "worker": None}
    assert leases.steps(new(), [(at(0), "claim", "a"), (at(5), "claim", "b"), (at(6), "renew", "a"), (at(15), "done", "b"), (at(16), "claim", "b")], lease, 4) == [
        (at(0), "claimed", 1, "a"), (at(5), "refused", 1, "b"), (at(6), "renewed", 1, "a"), (at(15), "refused", 1, "b"), (at(16), "requeued", 1, "a"), (at(16), "claimed", 2, "b"),
    ]
    assert [x[1] for x in leases.steps(new(), [(at(0), "claim", "a"), (at(20), "claim", "a"), (at(40), "done", "a")], lease, 2, at(99))] == ["claimed", "requeued", "claimed", "escalated", "refused"]
    assert [x[1] for x in leases.steps(new(), [(at(0), "claim", "a"), (at(1), "failed", "a"), (at(2), "claim", "b"), (at(3), "done", "b"), (at(4), "claim", "b")], lease, 9)] == ["claimed", "failed", "claimed", "done", "refused"]


def test_leases_of_a_stream_with_restart(spark, tmp_path):
    import numpy as np

    events = lease_events(np.random.default_rng(3))
    schema = "doc_id string, idx int, at timestamp, kind string, worker_id string"

    def feed(some):
        seconds = [(d, i, int(at.timestamp()), kind, w) for d, i, at, kind, w in some]
        spark.createDataFrame(seconds, schema.replace("at timestamp", "at long")).withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        leases.keep_leases(source, f"{tmp_path}/out", f"file://{tmp_path}/checkpoint", lease_seconds=300, most=2).awaitTermination()

    feed(events[:90])
    feed(events[90:150])
    run()
    feed(events[150:])
    run()
    want, last = [], max(e[2] for e in events)
    for key in sorted({e[:2] for e in events}):
        shard = {"state": "pending", "attempts": 0, "until": pd.Timestamp(0), "worker": None}
        own = sorted(((e[2], e[3], e[4]) for e in events if e[:2] == key))
        want += [(*key, *x) for x in leases.steps(shard, own, pd.Timedelta(seconds=300), 2, last - pd.Timedelta(milliseconds=1))]
    got = spark.read.schema(leases.TRANSITIONS.format(kind="string")).parquet(f"{tmp_path}/out")
    assert sorted((r[0], r[1], pd.Timestamp(r[2], unit="us"), *r[3:]) for r in got.withColumn("at", F.unix_micros("at")).collect()) == sorted(want)
    assert {"claimed", "requeued", "escalated", "refused", "done"} <= {r["action"] for r in got.collect()}
    assert leases.events_of(got).count() == sum(x[3] == "escalated" for x in want)
