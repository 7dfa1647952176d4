"""The minute rollup of a stream of finished shards, with exact percentiles, kept up to date in a versioned table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.tables import Change, Tables

_LINES = "us bigint, pages_parsed bigint, shards_done bigint, shards_failed bigint, parse_p50_ms bigint, parse_p95_ms bigint, peak_rss_p95_mb bigint"
ROLLUP = "bucket timestamp, pages_parsed bigint, shards_done bigint, shards_failed bigint, parse_p50_ms bigint, parse_p95_ms bigint, peak_rss_p95_mb bigint"
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which processors with several states need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def counted(shards: DataFrame) -> DataFrame:
    """(bucket, what, value, n) of shards (done_at, page_start, page_end, state, duration_ms, peak_rss_mb), added up in each Arrow batch before any exchange: a hot minute
    sends its distinct values, not its rows. what: p (n pages), d (n shards), f (n failed ones), t (n done ones that took value), r (n done ones that peaked at value)."""
    rows = shards.where("done_at is not null").select(F.date_trunc("minute", F.col("done_at").cast("timestamp")).alias("bucket"), (F.col("page_end") - F.col("page_start") + 1).cast("long").alias("pages"), "state", F.col("duration_ms").cast("long").alias("t"), F.col("peak_rss_mb").cast("long").alias("r"))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.to_pandas()
            done, parts = f[f["state"] == "done"], []
            for what, frame, value, n in (("p", f, None, f["pages"].fillna(0)), ("d", f, None, pd.Series(1, f.index)), ("f", f[f["state"] == "failed"], None, None), ("t", done[done["t"].notna()], "t", None), ("r", done[done["r"].notna()], "r", None)):
                n = pd.Series(1, frame.index) if n is None else n
                parts.append(pd.DataFrame({"bucket": frame["bucket"], "what": what, "value": frame[value].astype("int64") if value else 0, "n": n.astype("int64")}))
            whole = pd.concat(parts).groupby(["bucket", "what", "value"], as_index=False)["n"].sum()
            yield pa.RecordBatch.from_pandas(whole, pa.schema([("bucket", b.schema.field("bucket").type), ("what", pa.string()), ("value", pa.int64()), ("n", pa.int64())]), preserve_index=False)

    return rows.mapInArrow(added, "bucket timestamp, what string, value bigint, n bigint")


def floor_percentiles(counts: pd.DataFrame, p: int) -> pd.Series:
    """By minute, element (n - 1) * p / 100, rounded down, of the sorted values; counts (minute, value, n) is sorted by the first two."""
    up = counts.groupby("minute")["n"].cumsum()
    at = (counts.groupby("minute")["n"].transform("sum") - 1) * p // 100
    return counts[(up > at) & (up - counts["n"] <= at)].set_index("minute")["value"]


class Rollup(StatefulProcessor):
    """State of an hour: for each of its minutes how often each value of each kind was seen. A batch gives the new lines of the minutes that it has rows of; a timer
    drops the state `late` after the hour. Rows of a minute that ended longer than `late` before the watermark are left out. Each state that a batch asks for is some
    calls from Python to the store, so an hour is one state, not 60; a worker holds the values of one hour, where a day's grew with the events past its memory."""

    def __init__(self, late_ms: int) -> None:
        self.late = late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "minute array<bigint>, what array<string>, value array<bigint>, n array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        hour = int(key[0])  # times are microseconds since 1970 here, whatever the session's zone
        new = pd.concat(list(rows))
        new["minute"] = (new["us"] - hour) // 60_000_000
        start = hour // 1000
        new = new[start + (new["minute"] + 1) * 60_000 + self.late > timerValues.getCurrentWatermarkInMs()]
        if new.empty:
            return
        touched, new = sorted(new["minute"].unique()), new[["minute", "what", "value", "n"]]
        if self.seen.exists():
            new = pd.concat([pd.DataFrame(dict(zip(new.columns, map(list, self.seen.get()), strict=True))), new])
        whole = new.groupby(["minute", "what", "value"], as_index=False)["n"].sum()
        self.seen.update(tuple(whole[c].tolist() for c in ("minute", "what", "value", "n")))
        self.handle.registerTimer(start + 3_600_000 + self.late)
        own = whole[whole["minute"].isin(touched)]
        totals = own.groupby(["what", "minute"])["n"].sum()
        out = pd.DataFrame(index=pd.Index(touched, name="minute"))
        for name, what in (("pages_parsed", "p"), ("shards_done", "d"), ("shards_failed", "f")):
            out[name] = totals[what] if what in totals.index.levels[0] and what in totals.index else 0
            out[name] = out[name].fillna(0).astype("int64")
        for name, what, p in (("parse_p50_ms", "t", 50), ("parse_p95_ms", "t", 95), ("peak_rss_p95_mb", "r", 95)):
            out[name] = floor_percentiles(own[own["what"] == what], p).astype("Int64")
        out.insert(0, "us", hour + out.index.to_numpy() * 60_000_000)
        yield out.reset_index(drop=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def rollup_stream(shards: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The lines of the minutes that a batch of the stream changes: what `metrics.minute_rollup` gives for all rows so far."""
    ms = int(pd.Timedelta(late).total_seconds() * 1000)
    rows = counted(shards).withWatermark("bucket", late)
    rows = rows.withColumns({"us": F.unix_micros("bucket"), "hour": F.unix_micros(F.date_trunc("hour", "bucket"))})
    lines = rows.groupBy("hour").transformWithStateInPandas(Rollup(ms), _LINES, "Update", "EventTime")
    return lines.select(F.timestamp_micros("us").alias("bucket"), *[c for c in lines.columns if c != "us"])


def keep_rollup(shards: DataFrame, path: str, checkpoint: str, late: str = "10 minutes", name: str = "rollup") -> StreamingQuery:
    """Runs the rollup of a stream until it has read what there is, into the table `rollup` of `Tables` under path. A batch that runs again changes nothing."""
    spark = shards.sparkSession
    tables = Tables(spark, path, {"rollup": (ROLLUP, ("bucket",))})

    def upsert(lines: DataFrame, epoch: int) -> None:
        held = lines.persist()  # a commit reads its rows more than once, the state should be asked once
        try:
            tables.commit({"rollup": Change(upserts=held)}, (name, epoch))
        finally:
            held.unpersist()

    with rocks(spark):
        return rollup_stream(shards, late).writeStream.foreachBatch(upsert).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
