"""State counters, rollups, usage, drift and completeness over the pipeline's tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import TERMINAL_STATES


def percentiles(rows: DataFrame, keys: list[str], value: str, ps: dict[str, int]) -> DataFrame:
    """keys with floor percentiles of value, however many rows a key has: ranks instead of collected lists.

    Equal values are counted first, so what a key sorts are its distinct values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("to", F.sum("c").over(up)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    aggs = [F.min(F.when(F.col("to") > F.floor((F.col("n") - 1) * p / 100), F.col(value))).alias(name) for name, p in ps.items()]
    return ranked.groupBy(*keys).agg(*aggs)


def state_counts(rows: DataFrame, state: str = "state") -> DataFrame:
    return rows.groupBy(state).agg(F.count(F.lit(1)).alias("n"))


def snapshot(documents: DataFrame, shards: DataFrame) -> DataFrame:
    """One row: documents by state, those that wait to be embedded, active ones, shards by state."""
    d = documents.agg(
        F.count(F.lit(1)).alias("documents"), *[F.count_if(F.col("state") == s).alias(f"documents_{s}") for s in ("uploaded", "parsing", "embedding", "ready", "failed", "partial")],
        F.count_if((F.col("state") == "parsing") & (F.col("total_shards") > 0) & (F.col("shards_done") + F.col("shards_failed") >= F.col("total_shards"))).alias("awaiting_embed"),
        F.count_if(~F.col("state").isin(*TERMINAL_STATES)).alias("active"),
    )
    s = shards.agg(*[F.count_if(F.col("state") == x).alias(f"shards_{x}") for x in ("pending", "running", "done", "failed", "skipped")])
    return d.crossJoin(s)  # one row each


def usage(keys: DataFrame, calls: DataFrame, since: Column) -> DataFrame:
    """(id, calls, last_call) since a time, most calls first."""
    found = calls.where(F.col("created_at") >= since).groupBy("api_key_id").agg(F.count(F.lit(1)).alias("calls"), F.max("created_at").alias("last_call"))
    return keys.join(found, keys["id"] == found["api_key_id"]).select(keys["id"], "calls", "last_call").orderBy(F.desc("calls"), "id")


def period_start(period: str, now: datetime) -> datetime:
    if period == "today":
        return now.replace(hour=0, minute=0, second=0, microsecond=0)
    spans = {"24h": timedelta(hours=24), "7d": timedelta(days=7), "30d": timedelta(days=30)}
    if period not in spans:
        raise ValueError(f"unknown period {period!r}")
    return now - spans[period]


def minute_rollup(shards: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """A row for each minute with finished shards: pages, rows done (failed ones too), failed, chunks embedded, p50 and p95 of done ones."""
    rows = shards.where("done_at is not null").withColumn("bucket", F.date_trunc("minute", "done_at"))
    base = rows.groupBy("bucket").agg(
        F.sum(F.col("page_end") - F.col("page_start") + 1).alias("pages_parsed"), F.count(F.lit(1)).alias("shards_done"), F.count_if(F.col("state") == "failed").alias("shards_failed"),
    )
    done = rows.where("state = 'done'")
    out = base.join(percentiles(done, ["bucket"], "duration_ms", {"parse_p50_ms": 50, "parse_p95_ms": 95}), "bucket", "left").join(percentiles(done, ["bucket"], "peak_rss_mb", {"peak_rss_p95_mb": 95}), "bucket", "left")
    if chunks is None:
        return out.withColumn("chunks_embedded", F.lit(0).cast("long"))
    embedded = chunks.where("embedded_at is not null").groupBy(F.date_trunc("minute", "embedded_at").alias("bucket")).agg(F.count(F.lit(1)).alias("chunks_embedded"))
    return out.join(embedded, "bucket", "left").withColumn("chunks_embedded", F.coalesce("chunks_embedded", F.lit(0)))


def recount(documents: DataFrame, shards: DataFrame) -> DataFrame:
    """documents (id) with counters found again from shards; skipped shards don't count."""
    found = shards.groupBy(F.col("doc_id").alias("id")).agg(
        F.count_if(F.col("state") != "skipped").cast("int").alias("true_total"), F.count_if(F.col("state") == "done").cast("int").alias("true_done"), F.count_if(F.col("state") == "failed").cast("int").alias("true_failed"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("true_total", "true_done", "true_failed")}
    return documents.join(found, "id", "left").withColumns(zero)


def drifted(documents: DataFrame, shards: DataFrame, limit: int | None = None) -> DataFrame:
    rows = recount(documents, shards).where("not (coalesce(total_shards, 0) <=> true_total and shards_done <=> true_done and shards_failed <=> true_failed)").orderBy("created_at", "id")
    return rows if limit is None else rows.limit(limit)


def repaired(documents: DataFrame, shards: DataFrame) -> DataFrame:
    rows = recount(documents, shards)
    return rows.withColumns({"total_shards": F.col("true_total"), "shards_done": F.col("true_done"), "shards_failed": F.col("true_failed")}).select(*documents.columns)


def completeness(total: Column, failed: Column) -> Column:
    """Share of shards that did not fail, within 0..1, four decimals; null without shards."""
    return F.when(total > 0, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (total - failed) / total)), 4).cast("decimal(5,4)"))


def final_state(failed: Column) -> Column:
    return F.when(failed > 0, "partial").otherwise("ready")


def collection_stats(collections: DataFrame, documents: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Every collection with its documents, bytes and shards; 0 where there are none."""
    d = documents.groupBy("collection_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("byte_size").alias("bytes"), F.sum("total_shards").alias("shards"))
    out = collections.select(F.col("id").alias("collection_id")).join(d, "collection_id", "left")
    if chunks is not None:
        out = out.join(chunks.groupBy("collection_id").agg(F.count(F.lit(1)).alias("chunks")), "collection_id", "left")
    return out.na.fill(0)


def throughput(polls: DataFrame, time: str = "at", total: str = "pages", keep: int = 60, each_seconds: int = 5) -> DataFrame:
    """Pages a minute over the last `keep` polls of a running total, for each poll."""
    w = Window.partitionBy("host").orderBy(time)
    delta = F.greatest(F.coalesce(F.col(total) - F.lag(total).over(w), F.lit(0)), F.lit(0))
    last = w.rowsBetween(-(keep - 1), 0)
    return polls.withColumn("delta", delta).withColumn("per_minute", F.sum("delta").over(last) / (F.count("delta").over(last) / F.lit(60 / each_seconds))).drop("delta")
