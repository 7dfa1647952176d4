"""Intake of jobs that their queue's depth governs: what is beyond the cap waits, in order, and nothing is lost or queued twice."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..config import BACKLOG_CAP
from ..session import shared_path
from ..sources.tables import Change, Tables

KEY = ("stream", "doc_id", "idx")
JOBS = "stream string, doc_id string, idx int, at timestamp, job string"
#: Rows of a task's batch that are held besides one of each job.
HELD = 1 << 20


def queue_tables(spark: SparkSession, path: str) -> Tables:
    """The tables `queued`, which consumers take jobs from, and `waiting`."""
    return Tables(spark, path, {"queued": (JOBS, KEY), "waiting": (JOBS, KEY)})


def _apart(rows: DataFrame, others: DataFrame) -> DataFrame:
    """rows whose job is not among others."""
    gone = others.select(*[F.col(k).alias(f"gone_{k}") for k in KEY])
    return rows.join(gone, [F.col(k).eqNullSafe(F.col(f"gone_{k}")) for k in KEY], "left_anti")


def admit(tables: Tables, jobs: DataFrame | None = None, done: DataFrame | None = None, cap: int = BACKLOG_CAP, applied: tuple[str, int] | None = None) -> int:
    """One commit: jobs (JOBS) come to wait, unless they are queued or wait already; done ones leave the queue; of those that wait the earliest of each stream are
    queued, as many as there is room for. At most `cap` jobs of a stream come out of each task that looks for the earliest."""
    queued, waiting = tables.read("queued"), tables.read("waiting")
    left = queued if done is None else _apart(queued, done)
    if jobs is not None:
        first = jobs.groupBy(*KEY).agg(F.min(F.struct("at", "job")).alias("x")).select(*KEY, "x.at", "x.job")
        waiting_now = waiting.unionByName(_apart(_apart(first, left), waiting))
    else:
        waiting_now = waiting
    depth = left.groupBy(F.col("stream").alias("own")).agg(F.count(F.lit(1)).alias("depth"))  # a row for each stream
    place = F.row_number().over(Window.partitionBy("stream").orderBy("at", *KEY[1:]))
    ranked = waiting_now.withColumn("place", place).where(F.col("place") <= cap)
    taken = ranked.join(depth, F.col("stream").eqNullSafe(F.col("own")), "left").where(F.col("place") <= cap - F.coalesce("depth", F.lit(0))).select(*waiting.columns)
    held = [waiting_now.persist(), taken.persist()]  # a commit reads its rows more than once; the second is made of the first
    try:
        rest = _apart(held[0], held[1])
        return tables.commit({"queued": Change(upserts=held[1], deletes=None if done is None else done.select(*KEY)), "waiting": Change(upserts=rest, deletes=held[1].select(*KEY))}, applied)
    finally:
        for x in held:
            x.unpersist()


def rounds(tables: Tables, cap: int = BACKLOG_CAP) -> DataFrame:
    """(stream, doc_id, idx, round) of all jobs that are queued (round 0) or wait: the round in which each is queued where consumers finish all that is queued before the next
    `admit`. That is what `admit(done=queued)` gives one commit after the other, worked out at once: jobs are sorted over the tasks, and counts of the tasks before say where
    each task's jobs of a stream begin, so no stream is one task's."""
    spark, order = tables.spark, ("stream", "at", *KEY[1:])
    version = tables.latest()
    path = shared_path(spark, "rounds")  # written, so that the tasks that are counted are those that are numbered
    waiting = tables.read("waiting", version).repartitionByRange(*order).sortWithinPartitions(*order)
    waiting.select(*KEY, F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("nth")).write.parquet(path)
    rows = spark.read.parquet(path)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("own").orderBy("own_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy(F.col("stream").alias("own"), F.col("task").alias("own_task")).agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first")).select("own", "own_task", "first", before.alias("before"))
    placed = rows.join(F.broadcast(starts), F.col("stream").eqNullSafe(F.col("own")) & (F.col("task") == F.col("own_task")))  # a row for each stream of a task
    later = placed.select(*KEY, (F.floor((F.col("before") + F.col("nth") - F.col("first")) / cap) + 1).cast("int").alias("round"))
    return tables.read("queued", version).select(*KEY, F.lit(0).alias("round")).unionByName(later)


def _of_each_job(rows: pa.Table) -> pa.Table:
    """The earliest row of each job, with the latest time that it came at."""
    rows = rows.take(pc.sort_indices(rows, [("at", "ascending"), ("job", "ascending")], null_placement="at_start"))
    found = rows.append_column("nth", pa.array(range(len(rows)), pa.int64())).group_by(list(KEY)).aggregate([("nth", "min"), ("last", "max")])
    return rows.take(found["nth_min"]).drop_columns("last").append_column("last", found["last_max"])


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n, most = [], 0, HELD
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n > most:
            held = _of_each_job(pa.Table.from_batches(held)).combine_chunks().to_batches()
            n = sum(x.num_rows for x in held)
            most = HELD + 2 * n
    if n:
        yield from _of_each_job(pa.Table.from_batches(held)).to_batches(1 << 14)


def intake(entries: DataFrame, path: str, checkpoint: str, cap: int = BACKLOG_CAP, late: str = "10 minutes", name: str = "intake") -> StreamingQuery:
    """Runs a stream of jobs (JOBS) into the queue until it has read what there is. A job that comes again within `late` is dropped by the stream's own state, one that is queued
    or waits whenever it comes; a batch that runs again changes nothing. Of a job's rows in a batch the earliest counts: the state would keep the one that reaches it first, so
    each batch brings it one row of a job."""
    tables = queue_tables(entries.sparkSession, path)

    def batch(df: DataFrame, epoch: int) -> None:
        admit(tables, df, None, cap, (name, epoch))

    # a job is late where all its rows are, so the state goes by the latest
    once = entries.select(*KEY, "at", "job", F.col("at").alias("last")).repartition(*KEY).mapInArrow(_earliest, f"{JOBS}, last timestamp")
    rows = once.withWatermark("last", late).dropDuplicatesWithinWatermark(list(KEY)).drop("last")
    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Lag(StreamingQueryListener):
    """The last `keep` progress reports of all queries: name, batch, rows read, seconds. `spark.streams.addListener(Lag())`."""

    def __init__(self, keep: int = 100) -> None:
        super().__init__()
        self.seen: deque[tuple[str | None, int, int, float]] = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.seen.append((p.name, p.batchId, p.numInputRows, p.batchDuration / 1000))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def rows_a_second(self, name: str | None = None) -> float | None:
        """Rows that the reports show for a second of work; null without any."""
        own = [x for x in self.seen if x[0] == name and x[3] > 0]
        return sum(x[2] for x in own) / sum(x[3] for x in own) if own else None
