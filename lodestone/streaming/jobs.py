"""Queues, leases and rollups: batch sweeps over state tables and their streaming forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import MAX_ATTEMPTS, STUCK_MINUTES
from ..schema import TERMINAL_STATES

JOB = "schema_version int, doc_id string, idx int, page_start int, page_end int, source_uri string"


def encoded(jobs: DataFrame) -> DataFrame:
    """(job): a JSON envelope for each row."""
    fields = [c for c in ("doc_id", "idx", "page_start", "page_end", "source_uri") if c in jobs.columns]
    return jobs.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), *fields)).alias("job"))


def decoded(entries: DataFrame) -> DataFrame:
    """Entries with parsed job fields and `bad`, true for those to quarantine."""
    rows = entries.withColumn("__j", F.from_json("job", JOB))
    bad = F.col("__j").isNull() | F.col("__j.doc_id").isNull() | ~F.coalesce(F.col("__j.schema_version") == 1, F.lit(False))
    return rows.select(*entries.columns, "__j.doc_id", "__j.idx", "__j.page_start", "__j.page_end", bad.alias("bad"))


def settled(total: Column, done: Column, failed: Column) -> Column:
    return F.coalesce((total > 0) & (done + failed >= total), F.lit(False))


def expired(shards: DataFrame, now: Column) -> DataFrame:
    """Running shards whose lease has run out, to be queued again."""
    return shards.where((F.col("state") == "running") & (F.col("lease_until") < now))


def escalated(shards: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """Pending shards at the attempt cap, and how many each document has of them."""
    rows = shards.where((F.col("state") == "pending") & (F.col("attempts") >= max_attempts))
    return rows, rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("newly_failed"))


def rescued(shards: DataFrame, documents: DataFrame, queued: DataFrame, now: Column, grace_minutes: int = 2) -> DataFrame:
    """Pending shards, never tried, of running documents, older than the grace, that no queued job (doc_id, idx) stands for."""
    alive = documents.where(~F.col("state").isin(*TERMINAL_STATES)).select(F.col("id").alias("doc_id"))
    rows = shards.where((F.col("state") == "pending") & (F.col("attempts") == 0) & (F.col("created_at") < now - F.make_interval(mins=F.lit(grace_minutes))))
    return rows.join(alive, "doc_id", "left_semi").join(queued.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti")


def embed_rescued(documents: DataFrame, queued: DataFrame) -> DataFrame:
    """Settled documents still in parsing that no queued embed job (doc_id) stands for."""
    rows = documents.where((F.col("state") == "parsing") & settled(F.col("total_shards"), F.col("shards_done"), F.col("shards_failed")))
    return rows.join(queued.select(F.col("doc_id").alias("id")), "id", "left_anti")


def stuck(documents: DataFrame, now: Column, minutes: int = STUCK_MINUTES) -> DataFrame:
    return documents.where(~F.col("state").isin(*TERMINAL_STATES) & (F.col("updated_at") < now - F.make_interval(mins=F.lit(minutes))))


def reclaimed(entries: DataFrame, idle_seconds: int = 1200, most: int = 50, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Stale entries, at most `most` a stream by longest idle, with what becomes of each: quarantine at the cap, else requeue."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("idle_seconds"), "entry_id"))
    rows = entries.where(F.col("idle_seconds") >= idle_seconds).withColumn("__n", n).where(F.col("__n") <= most).drop("__n")
    return rows.withColumn("action", F.when(F.col("delivered_count") >= max(5, max_attempts + 1), "quarantine").otherwise("requeue"))


def dead_letters(entries: DataFrame) -> DataFrame:
    """An event for each quarantined entry."""
    return entries.where("action = 'quarantine'").select(F.lit("error").alias("level"), F.lit("queue").alias("stage"), F.lit("DLQ").alias("code"), F.to_json(F.struct("stream", "entry_id", "delivered_count", "job")).alias("context"))


def queue_depth(entries: DataFrame) -> DataFrame:
    return entries.groupBy("stream").agg(F.count_if(F.col("delivered_count") == 0).alias("undelivered"), F.count_if(F.col("delivered_count") > 0).alias("pending"), F.count(F.lit(1)).alias("depth"))


def streaming_rollup(shards: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Rows and failures a minute of done_at over a stream; percentiles come from the stored rows of a bucket."""
    rows = shards.withWatermark("done_at", late).groupBy(F.window("done_at", "1 minute").alias("w"))
    return rows.agg(F.sum(F.col("page_end") - F.col("page_start") + 1).alias("pages_parsed"), F.count(F.lit(1)).alias("shards_done"), F.count_if(F.col("state") == "failed").alias("shards_failed")).select(F.col("w.start").alias("bucket"), "pages_parsed", "shards_done", "shards_failed")


def settle_stream(done: DataFrame, totals: DataFrame) -> DataFrame:
    """Running counts of ended shards by document joined with its total: `settled` turns true once all have ended."""
    counts = done.groupBy("doc_id").agg(F.count_if(F.col("state") == "failed").alias("failed"), F.count(F.lit(1)).alias("ended"))
    return counts.join(totals, "doc_id").withColumn("settled", F.col("ended") >= F.col("total_shards"))


def consume(entries: DataFrame, handler: Callable[[DataFrame, int], None], quarantine: str, checkpoint: str) -> StreamingQuery:
    """Runs handler on the good jobs of each batch, whose effects must be idempotent, and writes bad entries to quarantine, by epoch."""

    def batch(df: DataFrame, epoch: int) -> None:
        rows = decoded(df)
        rows.where("bad").write.mode("overwrite").parquet(f"{quarantine.rstrip('/')}/epoch={epoch}")  # a batch that runs again replaces its own
        handler(rows.where("not bad").drop("bad"), epoch)

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failures_with_ttl(failures: DataFrame, hours: int = 6, cap: int = 5) -> DataFrame:
    """(key, failures, blocked) for a stream of (key, at): counts restart when a key was quiet for `hours`."""
    from typing import Any

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: Any, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        count = state.get[0] if state.exists else 0
        for f in frames:
            count += len(f)
        state.update((count,))
        state.setTimeoutDuration(hours * 3_600_000)
        yield pd.DataFrame({"key": [key[0]], "failures": [count], "blocked": [count >= cap]})

    return failures.groupBy("key").applyInPandasWithState(update, "key string, failures long, blocked boolean", "n long", "update", GroupStateTimeout.ProcessingTimeTimeout)
