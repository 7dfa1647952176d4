"""Exact deduplication by a minimal perfect hash over the digests of earlier loads.

Method: `build_index` turns the distinct digests of what is already held into a minimal perfect hash,
in shards by digest prefix: levels of bit arrays in which a key owns a bit that no other key of its level
claims, ranks being the slots. A slot holds the full digest, its group's size and the winner's locator
(its id, and the number of its row, which tells repeated rows apart). `exact_dedup` first groups a new load by digest, so that a text that fills a third of the rows is
one row before any shuffle, then looks each digest up: a slot whose full digest is equal to the byte makes
it a repeat and adds it to that group; any other digest is no member and forms a group of its own.
A shard's size is bounded, so that it fits a task.

Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest id of a group
stays; of rows with the same id and text one stays. A null id counts as less than any other. Ids are whole numbers,
as a locator in a slot is; other types are refused. An empty table gives no rows; other columns are ignored, and kept by `kept` whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ._blocks import tidied
from ._store import fresh, joined_by_size, written
from ._words import mixed

#: Digests that a shard holds on average at most.
SHARD_KEYS = 200_000
SPREAD = 1.5
LEVELS = 48
NO_ID = -(2**63)
_SLOT = np.dtype([("digest", "V32"), ("winner", "i8"), ("row", "i8"), ("size", "i8")])
_FIELDS = ("winner", "row", "size")
INDEX = "shard int, keys binary, bits binary, levels array<long>, slots binary"


def text_digest(text: bytes | None) -> bytes:
    return hashlib.sha256((text or b"").lower()).digest()


def _digests(batches):
    for b in batches:
        texts = b.column("text").cast(pa.large_binary())
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), pa.array([text_digest(x.as_py()) for x in texts], pa.binary())], ["id", "row", "digest"])


def _keys(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests.view(np.uint64).reshape(-1, 4)[:, 1])


def _place(key: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(key + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)


class PerfectHash:
    """Slots 0..n-1 for n distinct 64-bit keys; a key outside them gets any slot or -1."""

    def __init__(self, levels: list[int], bits: np.ndarray):
        self.levels, self.bits = levels, bits
        self.rank = np.concatenate(([0], np.cumsum(bits)))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, parts = [], []
        while len(keys):
            if len(levels) == LEVELS:
                raise ValueError("two digests agree in the 64 bits that place them")
            size = max(64, int(SPREAD * len(keys)))
            at = _place(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(size)
            parts.append(alone)
            keys = keys[~alone[at]]
        return cls(levels, np.concatenate(parts) if parts else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, open_, base = np.full(len(keys), -1), np.arange(len(keys)), 0
        for i, size in enumerate(self.levels):
            at = base + _place(keys[open_], i, size).astype(np.int64)
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_, base = open_[~hit], base + size
        return out


def _void(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "V32")


def _indexed(batches):
    rows: dict[int, list] = {}
    for b in batches:
        shard = b.column("shard").to_numpy()
        part = np.zeros(b.num_rows, _SLOT)
        part["digest"] = _void(b.column("digest"))
        for name in _FIELDS:
            part[name] = b.column(name).to_numpy()
        for k in np.unique(shard).tolist():
            rows.setdefault(k, []).append(part[shard == k])
    for shard, got in rows.items():
        held = np.concatenate(got)
        keys = _keys(np.ascontiguousarray(held["digest"]))
        order = np.argsort(keys, kind="stable")
        tied = keys[order][1:] == keys[order][:-1]
        apart = np.ones(len(keys), bool)  # digests that share the placing bits are kept in full beside the slots
        apart[order[1:][tied]] = False
        hash_ = PerfectHash.build(keys[apart])
        slots = np.zeros(int(apart.sum()), _SLOT)
        slots[hash_.slots(keys[apart])] = held[apart]
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([held[~apart].tobytes()], pa.binary()), pa.array([np.packbits(hash_.bits).tobytes()], pa.binary()), pa.array([hash_.levels], pa.list_(pa.int64())), pa.array([slots.tobytes()], pa.binary())], ["shard", "keys", "bits", "levels", "slots"])


def digest_groups(digests: DataFrame) -> DataFrame:
    """(digest, winner, row, size) of (id, row, digest): the largest id, then the largest row."""
    best = F.max(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "row")).alias("best")
    return digests.groupBy("digest").agg(best, F.count(F.lit(1)).alias("size")).select("digest", F.col("best.id").alias("winner"), "best.row", "size")


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("shard", F.expr(f"cast(conv(hex(substr(digest, 1, 4)), 16, 10) % {shards} as int)"))


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """The index of (digest, winner, row, size) with distinct digests, one row a shard."""
    return _sharded(groups, shards).repartition("shard").mapInArrow(tidied(_indexed), INDEX)


LOOKED = "digest binary, winner long, row long, size long, member boolean"


def _taken_in(slots: np.ndarray, at: np.ndarray, new: np.ndarray) -> None:
    """Adds groups to the slots at: sizes are summed, the larger (id, row) wins. No slot occurs twice."""
    more = (new["winner"] > slots["winner"][at]) | ((new["winner"] == slots["winner"][at]) & (new["row"] > slots["row"][at]))
    for name in ("winner", "row"):
        slots[name][at[more]] = new[name][more]
    slots["size"][at] += new["size"]


def _looked_up(batches):
    """Rows sorted by (shard, kind): a shard's index, if it has one, then distinct digests to look up. Yields whole groups."""
    state: dict = {"shard": None}

    def rows(part, member):
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in part["digest"]], pa.binary()), *[pa.array(np.ascontiguousarray(part[x])) for x in _FIELDS], pa.array(np.full(len(part), member))], ["digest", *_FIELDS, "member"])

    def held():
        for slots in (state.get("slots"), state.get("beside")):
            for i in range(0, 0 if slots is None else len(slots), 50_000):
                yield rows(slots[i : i + 50_000], True)

    for b in batches:
        shard, kind = b.column("shard").to_numpy(), b.column("kind").to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 0), [True])))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if shard[i] != state["shard"]:
                yield from held()
                state = {"shard": shard[i]}
            if kind[i] == 0:
                levels = b.column("levels")[i].as_py()
                bits = np.unpackbits(np.frombuffer(b.column("bits")[i].as_py(), np.uint8))[: sum(levels)].astype(bool)
                state |= {"hash": PerfectHash(levels, bits), "slots": np.frombuffer(b.column("slots")[i].as_py(), _SLOT).copy(), "beside": np.frombuffer(b.column("keys")[i].as_py(), _SLOT).copy()}
                continue
            new = np.zeros(j - i, _SLOT)
            new["digest"] = _void(b.column("digest").slice(i, j - i))
            for name in _FIELDS:
                new[name] = b.column(name).slice(i, j - i).to_numpy()
            member = np.zeros(j - i, bool)
            if "hash" in state and len(state["slots"]):
                slots = state["slots"]
                at = state["hash"].slots(_keys(np.ascontiguousarray(new["digest"])))
                member = (at >= 0) & (slots["digest"][np.maximum(at, 0)] == new["digest"])
                _taken_in(slots, at[member], new[member])
                for k in range(len(state["beside"])):
                    same = ~member & (new["digest"] == state["beside"]["digest"][k])
                    _taken_in(state["beside"], np.full(int(same.sum()), k), new[same])
                    member |= same
            if not member.all():
                yield rows(new[~member], False)
    yield from held()


def merged_groups(index: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """(digest, winner, row, size, member): the index's groups with what groups adds to them, and the groups of nonmembers."""
    empty = F.lit(None)
    held = index.select("shard", F.lit(0).alias("kind"), empty.cast("binary").alias("digest"), *[F.lit(0).cast("long").alias(x) for x in _FIELDS], "keys", "bits", "levels", "slots")
    new = _sharded(groups, shards).select("shard", F.lit(1).alias("kind"), "digest", *_FIELDS, empty.cast("binary").alias("keys"), empty.cast("binary").alias("bits"), empty.cast("array<long>").alias("levels"), empty.cast("binary").alias("slots"))
    return held.unionAll(new).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(tidied(_looked_up), LOOKED)


def _whole(docs: DataFrame, id_col: str) -> None:
    if not isinstance(docs.schema[id_col].dataType, (T.IntegralType, T.NullType)):
        raise TypeError(f"{id_col} is no column of whole numbers")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loads: int = 2) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of docs.

    The rows come as `loads` loads, dealt by a hash of the id; each is looked up in the index of those before it.
    """
    _whole(docs, id_col)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    digests = written(docs.mapInArrow(tidied(_digests), "id long, row long, digest binary"), "digests")  # the numbers of rows are settled once
    load = F.pmod(F.xxhash64("id"), F.lit(loads))
    groups = written(digest_groups(digests.where(load == 0)), "groups")
    total = digests.count()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SHARD_KEYS + 1)
    for k in range(1, loads):
        index = written(build_index(groups.select("digest", *_FIELDS), shards), "index")
        groups = written(merged_groups(index, digest_groups(digests.where(load == k)), shards), "groups")
    out = joined_by_size(digests.withColumnRenamed("row", "own"), groups.select("digest", *_FIELDS), "digest", "size", total)
    return out.select(
        F.col("id").alias(id_col), F.when(F.col("winner") != NO_ID, F.col("winner")).alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("own") == F.col("row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay; of rows with the same id and text one."""
    own, winner, digest, turn = (fresh(docs, x) for x in ("own", "winner", "digest", "turn"))
    stay = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias(winner), F.unhex("text_sha256").alias(digest))
    stay = written(stay, "stay")
    schema = T.StructType([*docs.schema.fields, T.StructField(own, T.BinaryType())])

    def run(batches):
        for b in batches:
            digests = pa.array([text_digest(x.as_py()) for x in b.column(text_col).cast(pa.large_binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, digests], [*b.schema.names, own])

    rows = docs.mapInArrow(tidied(run), schema)
    rows = rows.join(stay, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(winner)) & (F.col(own) == F.col(digest)), "left_semi")
    if docs.select(id_col).groupBy(id_col).count().where("count > 1").isEmpty():
        return rows.drop(own)
    order = F.row_number().over(Window.partitionBy(id_col, own).orderBy(F.lit(1)))  # each task sends one row of a group
    return rows.withColumn(turn, order).where(F.col(turn) == 1).drop(own, turn)
