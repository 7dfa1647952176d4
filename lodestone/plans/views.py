"""What operators of the service look at: lanes, counters, settings, rollups, progress, and admission under load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import BACKLOG_CAP, CHILD_SIZE, CHUNK_OVERLAP, CHUNK_SIZE, LEASE_SECONDS, MAX_ATTEMPTS, PAGE_CAP, PARENT_SIZE, RERANK_POOL, SHARD_PAGES, TOP_K, TOP_K_MAX, YIELD_CHARS

STALE_MINUTES, CONSUMER_MINUTES, PENDING_SHOWN, ROLLUPS = 15, 5, 100, 60


def settings(**changed) -> dict[str, int | str]:
    """The settings in force, by name."""
    out = {
        "parent_size": PARENT_SIZE, "child_size": CHILD_SIZE, "child_overlap": CHILD_SIZE // 5, "strategy": "auto", "chunk_size": CHUNK_SIZE, "chunk_overlap": CHUNK_OVERLAP, "shard_pages": SHARD_PAGES,
        "yield_chars": YIELD_CHARS, "lease_seconds": LEASE_SECONDS, "max_attempts": MAX_ATTEMPTS, "backlog_cap": BACKLOG_CAP, "page_cap": PAGE_CAP, "top_k": TOP_K, "top_k_max": TOP_K_MAX, "rerank_pool": RERANK_POOL,
    }
    if unknown := set(changed) - set(out):
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return out | changed


def latest_rollups(rollups: DataFrame, n: int = ROLLUPS) -> DataFrame:
    return rollups.orderBy(F.desc("bucket")).limit(n)


def lanes(streams: DataFrame, entries: DataFrame, consumers: DataFrame) -> DataFrame:
    """A row for each stream (stream): those that wait, are in flight (the PENDING_SHOWN oldest delivered ones, as a queue lists them) or stale, and live consumers.

    entries: (stream, entry_id, delivered_count, idle_seconds); consumers: (stream, consumer, idle_seconds).
    """
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("stream").orderBy("entry_id"))
    shown = entries.where("delivered_count > 0").withColumn("n", place).where(F.col("n") <= PENDING_SHOWN)
    pending = shown.groupBy("stream").agg(F.count(F.lit(1)).alias("in_flight"), F.count_if(F.col("idle_seconds") > 60 * STALE_MINUTES).alias("stale"))
    undelivered = entries.where("delivered_count = 0").groupBy("stream").agg(F.count(F.lit(1)).alias("undelivered"))
    alive = consumers.where(F.col("idle_seconds") < 60 * CONSUMER_MINUTES).groupBy("stream").agg(F.count(F.lit(1)).alias("consumers"))
    out = streams.select("stream")
    for one in (undelivered, pending, alive):
        out = out.join(one, "stream", "left")
    out = out.na.fill(0, ["undelivered", "in_flight", "stale", "consumers"])
    return out.select("stream", (F.col("undelivered") + F.col("in_flight")).alias("waiting"), "in_flight", "stale", "consumers")


def admitted(depth: DataFrame, cap: int = BACKLOG_CAP) -> DataFrame:
    """(stream, depth) with whether new work is taken: not beyond cap entries that wait."""
    return depth.withColumn("admitted", F.col("depth") <= cap)


def request_counters(requests: DataFrame) -> DataFrame:
    """One row: requests (kind, milliseconds) by kind and the mean time of searches in whole milliseconds, null without any."""
    spent, n = F.sum(F.when(F.col("kind") == "search", F.col("milliseconds"))), F.count_if(F.col("kind") == "search")
    return requests.agg(F.count(F.lit(1)).alias("requests"), n.alias("searches"), F.when(n > 0, F.floor(spent / n)).alias("search_mean_ms"))


def eta_hours(pending: Column, per_minute: Column) -> Column:
    """Hours until pending pages are done; null while nothing moves."""
    return F.when(per_minute > 0, pending / per_minute / 60)


def ready_percent(ready: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100 * ready / total)).otherwise(0).cast("int")
