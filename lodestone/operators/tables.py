"""Table maintenance on immutable tables: each function returns the new rows of a table."""

from __future__ import annotations

import secrets
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import TERMINAL_STATES


def first_of(rows: DataFrame, keys: Iterable[str], order: Iterable) -> DataFrame:
    """The first row of each key."""
    keys = list(keys)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def insert_ignore(table: DataFrame, rows: DataFrame, keys: Iterable[str], order: Iterable) -> DataFrame:
    """table and those of rows whose key it lacks, each key once."""
    keys = list(keys)
    new = first_of(rows, keys, order).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(new, allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, keys: Iterable[str]) -> DataFrame:
    keys = list(keys)
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def update_from(table: DataFrame, changes: DataFrame, keys: Iterable[str]) -> DataFrame:
    """table with the columns of changes where it has the key and they aren't null."""
    keys = list(keys)
    new = [c for c in changes.columns if c not in keys]
    joined = table.join(changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in new]), keys, "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in new}).select(*table.columns)


def added(table: DataFrame, amounts: DataFrame, keys: Iterable[str]) -> DataFrame:
    """table with the columns of amounts, summed by key, added to its own; rows without an amount and null amounts change nothing."""
    keys = list(keys)
    more = [c for c in amounts.columns if c not in keys]
    joined = table.join(amounts.groupBy(*keys).agg(*[F.sum(c).alias(f"__{c}") for c in more]), keys, "left")
    return joined.withColumns({c: (F.col(c) + F.coalesce(f"__{c}", F.lit(0))).cast(table.schema[c].dataType) for c in more}).select(*table.columns)


def delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """documents, shards and chunks without the documents gone (id)."""
    ids = gone.select("id").distinct()
    by_doc = ids.withColumnRenamed("id", "doc_id")
    return {k: t.join(ids, "id", "left_anti") if k == "documents" else t.join(by_doc, "doc_id", "left_anti") for k, t in tables.items()}


def duplicates(rows: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Keys that occur more than once: what a unique constraint would refuse."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def claimed(shards: DataFrame, wanted: DataFrame, worker: str, now: Column, lease_seconds: int) -> DataFrame:
    """shards with those wanted (doc_id, idx) that are pending or failed set to running under a lease."""
    mark = wanted.select("doc_id", "idx", F.lit(True).alias("__want"))
    rows = shards.join(mark, ["doc_id", "idx"], "left")
    take = F.coalesce(F.col("__want") & F.col("state").isin("pending", "failed"), F.lit(False))
    return rows.withColumns({
        "attempts": F.when(take, F.col("attempts") + 1).otherwise(F.col("attempts")), "worker_id": F.when(take, F.lit(worker)).otherwise(F.col("worker_id")),
        "lease_until": F.when(take, now + F.make_interval(secs=F.lit(lease_seconds))).otherwise(F.col("lease_until")), "state": F.when(take, "running").otherwise(F.col("state")),
    }).select(*shards.columns)


def reset(documents: DataFrame, ids: DataFrame, state: str = "uploaded") -> DataFrame:
    """documents with those of ids set back for another run."""
    mark = ids.select("id", F.lit(True).alias("__reset")).distinct()
    rows = documents.join(mark, "id", "left")
    on = F.col("__reset").isNotNull()
    zero = {c: F.when(on, 0).otherwise(F.col(c)) for c in ("shards_done", "shards_failed") if c in documents.columns}
    return rows.withColumns({"state": F.when(on, state).otherwise(F.col("state")), **zero}).select(*documents.columns)


def retry_scope(scope: str, documents: DataFrame, shards: DataFrame) -> DataFrame:
    """Documents (id) that a retry of this scope takes."""
    ended = documents.where(F.col("state").isin(*TERMINAL_STATES))
    if scope == "shards":
        return ended.join(shards.where("state = 'failed'").select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi").select("id")
    if scope in ("embed", "full"):
        return ended.select("id")
    if scope == "rechunk":
        return documents.where(F.col("state").isin("ready", "partial")).select("id")
    raise ValueError(f"unknown scope {scope!r}")


def new_key() -> tuple[str, str]:
    """A secret and its hash; only the hash is kept."""
    import hashlib

    secret = "key_" + secrets.token_hex(32)
    return secret, hashlib.sha256(secret.encode()).hexdigest()


def valid_keys(keys: DataFrame, now: Column, scope: str | None = None, collection: str | None = None) -> DataFrame:
    """Keys that aren't revoked or expired, have the scope, and may see the collection (an empty list allows all)."""
    rows = keys.where(F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    if scope:
        rows = rows.where(F.array_contains("scopes", scope))
    if collection:
        rows = rows.where(F.coalesce(F.size("collections") == 0, F.lit(True)) | F.array_contains("collections", collection))
    return rows


def revoked(keys: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """keys with those of ids (id) revoked; one revoked before keeps its time."""
    rows = keys.join(ids.select("id", F.lit(True).alias("__gone")).distinct(), "id", "left")
    return rows.withColumn("revoked_at", F.coalesce("revoked_at", F.when(F.col("__gone"), now))).select(*keys.columns)


def touched(keys: DataFrame, used: DataFrame) -> DataFrame:
    """keys last used at their latest row of used (api_key_id, created_at), if that is later."""
    last = used.groupBy(F.col("api_key_id").alias("id")).agg(F.max("created_at").alias("__last"))
    return keys.join(last, "id", "left").withColumn("last_used_at", F.greatest("last_used_at", "__last")).select(*keys.columns)


def unreferenced(models: DataFrame, collections: DataFrame, column: str) -> DataFrame:
    """Models that no collection is bound to: those that may be deleted."""
    return models.join(collections.select(F.col(column).alias("id")).where("id is not null"), "id", "left_anti")
