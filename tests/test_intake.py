"""Queues whose depth governs what comes in."""

from pyspark.sql import functions as F

from lodestone.streaming import intake


def keys(df):
    return sorted((r["stream"], r["doc_id"], r["idx"]) for r in df.collect())


def jobs(spark, some):
    return spark.createDataFrame([(s, d, i, at, "{}") for s, d, i, at in some], "stream string, doc_id string, idx int, at long, job string").withColumn("at", F.timestamp_seconds("at"))


def test_a_flood_waits_in_order_and_drains(spark, tmp_path):
    tables = intake.queue_tables(spark, f"file://{tmp_path}/q")
    flood = [("a", f"d{i:02d}", 0, 100 + i) for i in range(12)] + [("b", "x", None, 5), ("b", None, 1, 6)]
    intake.admit(tables, jobs(spark, flood + flood[:4]), cap=5)
    assert keys(tables.read("queued").where("stream = 'a'")) == [("a", f"d{i:02d}", 0) for i in range(5)] and tables.read("queued").where("stream = 'b'").count() == 2 and tables.read("waiting").count() == 7
    intake.admit(tables, jobs(spark, [("a", "d03", 0, 1), ("a", "d11", 0, 1), ("a", "early", 0, 1)]), cap=5)  # known ones, and one that is older
    assert tables.read("queued").count() == 7 and tables.read("waiting").count() == 8
    seen = []
    for _ in range(5):
        queued = tables.read("queued", tables.latest())
        seen.append(keys(queued.where("stream = 'a'")))
        assert len(seen[-1]) <= 5
        intake.admit(tables, done=queued, cap=5)
    assert seen[1] == [("a", "d05", 0), ("a", "d06", 0), ("a", "d07", 0), ("a", "d08", 0), ("a", "early", 0)] and seen[2] == [("a", f"d{i:02d}", 0) for i in (9, 10, 11)] and seen[3] == seen[4] == []
    assert sorted(x for s in seen for x in s) == sorted([("a", f"d{i:02d}", 0) for i in range(12)] + [("a", "early", 0)])


def test_a_stream_of_jobs_with_restart(spark, tmp_path):
    lag = intake.Lag()
    spark.streams.addListener(lag)
    some = [("a", f"d{i % 9}", i % 2, 1_700_000_000 + i) for i in range(60)]
    frame = jobs(spark, some)

    def run():
        source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        intake.intake(source, f"file://{tmp_path}/q", f"file://{tmp_path}/checkpoint", cap=7).awaitTermination()

    try:
        jobs(spark, some[:40]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
        jobs(spark, some[30:]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
    finally:
        spark.streams.removeListener(lag)
    tables = intake.queue_tables(spark, f"file://{tmp_path}/q")
    queued, waiting = tables.read("queued"), tables.read("waiting")
    assert queued.count() == 7 and keys(queued.unionByName(waiting)) == sorted({x[:3] for x in some})
    before = tables.latest()
    assert intake.admit(tables, frame, None, 7, ("intake", 1)) == before  # a batch that ran already
    assert sum(x[2] for x in lag.seen) == 70 and lag.rows_a_second() > 0 and lag.rows_a_second("other") is None


def test_rounds_are_those_of_one_commit_after_the_other(spark, tmp_path):
    tables = intake.queue_tables(spark, f"file://{tmp_path}/q")
    flood = [("a", f"d{i % 37}", i % 3, 100 + i % 11) for i in range(400)] + [("b", "x", None, 5), ("b", None, 1, 6), (None, "y", 0, 7), (None, "z", 0, 8), (None, "y", 1, 9)]
    intake.admit(tables, jobs(spark, flood), cap=2)
    got = sorted(((r["round"], r["stream"], r["doc_id"], r["idx"]) for r in intake.rounds(tables, 2).collect()), key=str)
    want, n = [], 0
    while n < 3:
        queued = tables.read("queued", tables.latest())
        want += [(n, *k) for k in ((r["stream"], r["doc_id"], r["idx"]) for r in queued.collect())]
        intake.admit(tables, done=queued, cap=2)
        n += 1
    assert [x for x in got if x[0] < 3] == sorted(want, key=str) and len(got) == 111 + 5 and max(x[0] for x in got) == 55


def test_a_job_that_comes_more_than_once_in_a_batch_has_its_earliest_time(spark, tmp_path):
    some = [("a", f"d{i % 40}", i % 2, 1_700_000_000 + i * 37 % 1009) for i in range(1009)] + [(None, "x", None, 1_700_000_000 - i) for i in range(20)]
    jobs(spark, some).repartition(9, "at").write.parquet(f"{tmp_path}/in")  # a job's rows lie in several files, in no order
    source = spark.readStream.schema(intake.JOBS).parquet(f"{tmp_path}/in")
    intake.intake(source, f"file://{tmp_path}/q", f"file://{tmp_path}/checkpoint", cap=7).awaitTermination()
    tables, first = intake.queue_tables(spark, f"file://{tmp_path}/q"), {}
    for s, d, i, at in some:
        first[s, d, i] = min(at, first.get((s, d, i), at))
    got = [((r["stream"], r["doc_id"], r["idx"]), r["s"]) for r in tables.read("queued").unionByName(tables.read("waiting")).withColumn("s", F.unix_seconds("at")).collect()]
    assert len(got) == len(first) and dict(got) == first
    order = sorted((k for k in first if k[0] == "a"), key=lambda k: (first[k], *k[1:]))
    assert keys(tables.read("queued").where("stream = 'a'")) == sorted(order[:7])


def test_rows_of_a_job_are_held_as_one(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(intake, "HELD", 10)
    rows = [{"stream": "a", "doc_id": None if i % 7 == 0 else f"d{i % 7}", "idx": 0, "at": (i * 37) % 211, "job": "{}", "last": (i * 37) % 211} for i in range(211)]
    got = pa.Table.from_batches(intake._earliest(iter(pa.Table.from_pylist(rows).to_batches(3)))).to_pylist()
    want = {}
    for r in rows:
        at = [r["at"], *want.get(r["doc_id"], [])]
        want[r["doc_id"]] = [min(at), max(at)]
    assert {r["doc_id"]: [r["at"], r["last"]] for r in got} == want and len(got) == 7
    assert list(intake._earliest(iter([]))) == []
