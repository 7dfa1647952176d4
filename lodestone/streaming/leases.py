"""Claims and leases of shards as a stream: a state for each group of documents with timers, instead of sweeps over tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import LEASE_SECONDS, MAX_ATTEMPTS
from .rollup import rocks

TRANSITIONS = "doc_id {kind}, idx int, at timestamp, action string, attempts int, worker_id string"
_STEPS = TRANSITIONS.format(kind="string").replace("at timestamp", "us bigint")
#: States that the documents of a stream share.
GROUPS = 4096
OPEN = ("pending", "failed")


def steps(shard: dict, events: list[tuple[pd.Timestamp | int, str, str | None]], lease: pd.Timedelta | int, most: int, now: pd.Timestamp | int | None = None) -> list[tuple]:
    """What happens to a shard: (at, action, attempts, worker) for its events (at, kind, worker) in order, and for leases that end at `now` or before.

    Kinds: claim, renew, done, failed. A claim of a shard that is pending or failed starts a lease and counts an attempt, any other claim is refused. A lease that ends
    puts the shard back to pending, or fails it once it had `most` attempts. Whoever doesn't hold the lease can't renew, finish or fail.
    """
    out = []

    def end(until: pd.Timestamp | int | None) -> None:
        if shard["state"] == "running" and (until is None or shard["until"] <= until):
            over = shard["attempts"] >= most
            out.append((shard["until"], "escalated" if over else "requeued", shard["attempts"], shard["worker"]))
            shard.update(state="failed" if over else "pending", worker=None)

    for at, kind, worker in events:
        end(at)
        if kind == "claim" and shard["state"] in OPEN:
            shard.update(state="running", attempts=shard["attempts"] + 1, until=at + lease, worker=worker)
            action = "claimed"
        elif kind != "claim" and shard["state"] == "running" and shard["worker"] == worker:
            if kind == "renew":
                shard["until"], action = at + lease, "renewed"
            else:
                shard.update(state=kind, worker=None)
                action = kind
        else:
            action = "refused"
        out.append((at, action, shard["attempts"], worker))
    if now is not None:
        end(now)
    return out


class Leases(StatefulProcessor):
    """State of a group of documents: their shards. One timer stands at the end of the lease that ends first; it fires once the watermark has passed it, whether rows come
    or not. Each state that a batch asks for is some calls from Python to the store, so documents share GROUPS states at most. Times are microseconds since 1970, whatever
    the session's zone."""

    def __init__(self, lease_seconds: int, most: int) -> None:
        self.lease, self.most = lease_seconds * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shards = handle.getValueState("shards", "doc_id array<string>, idx array<int>, state array<string>, attempts array<int>, until array<bigint>, worker array<string>")

    def _held(self) -> dict[tuple[str | None, int], dict]:
        if not self.shards.exists():
            return {}
        return {(d, i): {"state": s, "attempts": n, "until": u, "worker": w} for d, i, s, n, u, w in zip(*self.shards.get(), strict=True)}

    def _keep(self, held: dict[tuple[str | None, int], dict]) -> None:
        self.shards.update(([d for d, _ in held], [i for _, i in held], *([x[c] for x in held.values()] for c in ("state", "attempts", "until", "worker"))))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ends = [x["until"] // 1000 for x in held.values() if x["state"] == "running"]
        if ends:
            self.handle.registerTimer(min(ends) + 1)

    def _lines(self, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=["doc_id", "idx", "us", "action", "attempts", "worker_id"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, found = self._held(), []
        whole = pd.concat(list(rows)).dropna(subset=["idx"])
        whole = whole.sort_values(["doc_id", "idx", "us", "kind", "worker_id"], kind="stable")
        known = lambda x: None if pd.isna(x) else x
        each = zip(map(known, whole["doc_id"]), whole["idx"].astype("int64").tolist(), whole["us"].tolist(), whole["kind"], map(known, whole["worker_id"]), strict=True)
        for shard_id, own in groupby(each, lambda x: x[:2]):
            shard = held.setdefault(shard_id, {"state": "pending", "attempts": 0, "until": 0, "worker": None})
            found += [(*shard_id, *x) for x in steps(shard, [x[2:] for x in own], self.lease, self.most)]
        self._keep(held)
        yield self._lines(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, found, now = self._held(), [], timerValues.getCurrentWatermarkInMs() * 1000
        for shard_id, shard in held.items():
            found += [(*shard_id, *x) for x in steps(shard, [], self.lease, self.most, now)]
        self._keep(held)
        yield self._lines(found)

    def close(self) -> None:
        pass


def lease_stream(events: DataFrame, lease_seconds: int = LEASE_SECONDS, most: int = MAX_ATTEMPTS, late: str = "0 seconds") -> DataFrame:
    """(doc_id, idx, at, action, attempts, worker_id) of a stream of (doc_id, idx, at, kind, worker_id): each event with what came of it, and each lease that ended. The
    transitions do not depend on how the stream falls into batches, as long as the events of a shard come in the order of their time."""
    kind = events.schema["doc_id"].dataType.simpleString()
    rows = events.withWatermark("at", late).withColumns({"us": F.unix_micros("at"), "group": F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)), "doc_id": F.col("doc_id").cast("string")})
    found = rows.groupBy("group").transformWithStateInPandas(Leases(lease_seconds, most), _STEPS, "Append", "EventTime")
    return found.select(F.col("doc_id").cast(kind).alias("doc_id"), "idx", F.timestamp_micros("us").alias("at"), "action", "attempts", "worker_id")


def keep_leases(events: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Runs the leases of a stream until it has read what there is; transitions are parquet files under path, each batch once."""
    with rocks(events.sparkSession):
        return lease_stream(events, **options).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_of(transitions: DataFrame) -> DataFrame:
    """A log line for each shard that failed for its attempts."""
    gone = transitions.where("action = 'escalated'")
    return gone.select("doc_id", F.col("idx").alias("shard_idx"), F.lit("error").alias("level"), F.lit("parse").alias("stage"), F.lit("SHARD_TIMEOUT").alias("code"), F.concat(F.lit("shard escalated to failed after "), "attempts", F.lit(" attempts")).alias("message"), F.col("at").alias("created_at"))
