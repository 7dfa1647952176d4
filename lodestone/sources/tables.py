"""Tables in versions: upserts, deletes and cascades by key over several tables as one commit.

A table is dealt over buckets by the hash of its key, a bucket is some files, and a version (`sources.versions`) lists the files of each bucket. A commit reads and
writes the buckets that its changes fall into, and no others. If another writer has made a version meanwhile, the commit stands where none
of its buckets changed, and is worked out again where one did. Old versions stay readable until `vacuum`.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .versions import Conflict, Versions

TRIES = 8


@dataclass(frozen=True)
class Change:
    """Rows to insert or replace by key (of one key the last by `order` counts, any without one), keys to delete; deletes come first."""

    upserts: DataFrame | None = None
    deletes: DataFrame | None = None
    order: str | None = None


class Tables:
    """Tables under a path. tables: name to (schema, key columns)."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, tuple[str, ...]]] | None = None, buckets: int = 16) -> None:
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)
        if not self.versions.numbers():
            if tables is None:
                raise ValueError(f"no tables under {path}")
            first = {"buckets": buckets, "applied": {}, "tables": {n: {"schema": s, "keys": list(k), "files": {}} for n, (s, k) in tables.items()}}
            try:
                self.versions.commit(1, first)
            except Conflict:
                pass

    def latest(self) -> int:
        return max(self.versions.numbers())

    def read(self, name: str, version: int | None = None) -> DataFrame:
        _, now = self.versions.read(version)
        return self._files(now, name, None)

    def _files(self, now: dict, name: str, buckets: set[int] | None) -> DataFrame:
        table = now["tables"][name]
        paths = [f"{self.path}/{name}/{f}" for b, f in table["files"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(table["schema"]).parquet(*paths) if paths else self.spark.createDataFrame([], table["schema"])

    def _bucket(self, now: dict, name: str):
        return F.pmod(F.xxhash64(*now["tables"][name]["keys"]), F.lit(now["buckets"])).cast("int")

    def _worked_out(self, now: dict, name: str, change: Change) -> tuple[set[int], dict[str, str]]:
        """The buckets that the change falls into, and the new folder of each that still has rows."""
        table, own = now["tables"][name], self._bucket(now, name)
        keys = table["keys"]
        frames = [x.select(*keys) for x in (change.upserts, change.deletes) if x is not None]
        touched: set[int] = set()
        for x in frames:
            touched |= {r[0] for r in x.select(own.alias("b")).distinct().collect()}  # buckets at most
        rows = self._files(now, name, touched)
        if change.deletes is not None:
            gone = change.deletes.select(*[F.col(k).alias(f"gone_{k}") for k in keys])
            rows = rows.join(gone, [F.col(k).eqNullSafe(F.col(f"gone_{k}")) for k in keys], "left_anti")
        if change.upserts is not None:
            new = change.upserts.select(*[F.col(c) for c in rows.columns], (F.col(change.order) if change.order else F.lit(0)).alias("__order"))
            both = rows.withColumns({"__new": F.lit(0), "__order": F.lit(None).cast(new.schema["__order"].dataType)}).unionByName(new.withColumn("__new", F.lit(1)))
            # a struct's maximum is aggregated before the exchange, so a key with many rows is one row of each task
            rest = [c for c in rows.columns if c not in keys]
            best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest) if rest else F.lit(0), F.struct("__new", "__order", F.xxhash64(*rest) if rest else F.lit(0))).alias("__row"))
            rows = best.select(*[F.col(f"__row.{c}").alias(c) if c in rest else F.col(c) for c in rows.columns])
        made = uuid.uuid4().hex
        rows.withColumn("__bucket", own).repartition(F.col("__bucket")).write.partitionBy("__bucket").parquet(f"{self.path}/{name}/{made}")
        there = self.versions.folders(f"{name}/{made}")
        return touched, {f.partition("=")[2]: f"{made}/{f}" for f in there if f.startswith("__bucket=")}

    def commit(self, changes: dict[str, Change], applied: tuple[str, int] | None = None) -> int:
        """Makes a version with all changes, and returns its number. applied: (source, number) of a batch; one that a version holds already changes nothing."""
        for _ in range(TRIES):
            number, now = self.versions.read()
            if applied and now["applied"].get(applied[0], -1) >= applied[1]:
                return number
            done = {name: self._worked_out(now, name, change) for name, change in changes.items()}
            while True:
                later, current = self.versions.read()
                if any(current["tables"][n]["files"].get(str(b)) != now["tables"][n]["files"].get(str(b)) for n, (touched, _) in done.items() for b in touched):
                    break  # a bucket changed: worked out again
                if applied and current["applied"].get(applied[0], -1) >= applied[1]:
                    return later
                tables = dict(current["tables"])
                for n, (touched, files) in done.items():
                    tables[n] = tables[n] | {"files": {b: f for b, f in tables[n]["files"].items() if int(b) not in touched} | files}
                try:
                    return self.versions.commit(later + 1, current | {"tables": tables, "applied": current["applied"] | ({applied[0]: applied[1]} if applied else {})})
                except Conflict:
                    continue
        raise Conflict(f"{self.path}: the same buckets were changed by others {TRIES} times")

    def cascade(self, name: str, keys: DataFrame, children: dict[str, str]) -> int:
        """Deletes rows of a table by its one key, and the rows of children (table to column) that refer to them, in one commit."""
        key = self.versions.read()[1]["tables"][name]["keys"][0]
        gone = keys.select(F.col(keys.columns[0]).alias(key)).distinct()
        changes = {name: Change(deletes=gone)}
        for child, column in children.items():
            own = self.versions.read()[1]["tables"][child]["keys"]
            below = self.read(child).join(gone.withColumnRenamed(key, "__gone"), F.col(column) == F.col("__gone"), "left_semi").select(*own)
            changes[child] = Change(deletes=below)
        return self.commit(changes)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes the folders that none of the last `keep` versions lists, and the older versions."""
        numbers = self.versions.numbers()
        held = {(n, f.split("/")[0]) for v in numbers[-keep:] for n, t in self.versions.read(v)[1]["tables"].items() for f in t["files"].values()}
        old = {(n, f.split("/")[0]) for v in numbers[:-keep] for n, t in self.versions.read(v)[1]["tables"].items() for f in t["files"].values()}
        self.versions.remove([f"{n}/{made}" for n, made in sorted(old - held)] + [f"v-{v:010d}.json" for v in numbers[:-keep]])
