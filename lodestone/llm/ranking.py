"""Grouped ranking with ties: the first k places of every group of a table, and how many rows tie with each.

Method: mergeable truncated maps. A group's map holds its k best distinct pairs, each with its exact count: a pair that k better ones of
any part of the rows precede is not among the k best of all, and a pair that is among those was dropped by no part. Tasks build the maps
of their rows; `aggregateByKey` merges them as tables of many groups, one for each bucket of groups, in a tree of `FAN` parts a node, so
no merge meets more than that many. A group's pairs that begin within its first k rows are its cutoffs; they filter the rows, and
a sort by range over all tasks gives the rest their positions. Rows that are alike are told apart by where they were read, so that a range may
end between them, and each range passes on the counts of its first and last group only.

Groups with over 1 / MANY of all rows (at most MANY by construction) get their cutoffs by broadcast, so that no task gets all rows of one;
the others' rows meet theirs by (group, pair). Nothing else is broadcast but two rows for each range.

Results for odd input: null is a value like others in a group; in pairs and in the later keys it comes last, and nulls are equal; rows
that are alike in all keys count each for itself; tables without rows give none. Columns that are not named are left out, and
names of results that the table has already get an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._store import MANY, fresh, written

#: Rows that a task takes into its maps at once, and entries of maps that it holds before it passes them on.
CHUNK, HELD = 400_000, 1_000_000
#: Parts that one node of the tree merges.
FAN = 64


def _starts(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Where the values of columns change, in a table that is sorted by them."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in columns:
        codes = table[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def truncated(table: pa.Table, group: list[str], pair: list[str], k: int) -> pa.Table:
    """The maps of table (group, pair, n, lines): equal entries add up, k best pairs of each group stay, sorted. n: rows of the
    pair; lines: rows of the group, carried by its first entry."""
    table = table.group_by(group + pair, use_threads=False).aggregate([("n", "sum"), ("lines", "sum")])
    table = table.rename_columns([c.removesuffix("_sum") if c in ("n_sum", "lines_sum") else c for c in table.column_names]).sort_by([(c, "ascending") for c in group + pair])
    start = _starts(table, group)
    lines = np.zeros(table.num_rows, np.int64)
    if len(start):
        lines[start] = np.add.reduceat(table["lines"].to_numpy(), start)
    place = np.arange(table.num_rows) - np.repeat(start, np.diff(np.append(start, table.num_rows)))
    return table.select([*group, *pair, "n"]).append_column("lines", pa.array(lines)).filter(pa.array(place < k))


def _packed(table: pa.Table) -> bytes:
    batches = table.combine_chunks().to_batches()
    return batches[0].serialize().to_pybytes() if batches else b""


def _unpacked(data: bytes, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(data), schema)] if data else [], schema)


def maps(rows: DataFrame, group: list[str], pair: list[str], k: int) -> DataFrame:
    """(group, pair, n, lines): the truncated map of each group of rows; lines is 0 but for the best pair. Group and pair hold no column named
    b, node, n or lines."""
    spark = rows.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select(F.pmod(F.xxhash64(*group), F.lit(buckets)).cast("int").alias("b"), F.spark_partition_id().alias("node"), *group, *pair)
    by = ["b", *group]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wait, waiting, node = None, [], 0, 0

        def merged() -> pa.Table:
            new = pa.Table.from_batches(wait)
            one = pa.array(np.ones(new.num_rows, np.int64))
            new = truncated(new.append_column("n", one).append_column("lines", one), by, pair, k)
            return new if held is None else truncated(pa.concat_tables([held, new.cast(held.schema)]), by, pair, k)

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cut = np.append(_starts(table, ["b"]), table.num_rows)
            for i, j in zip(cut, cut[1:], strict=False):
                yield pa.RecordBatch.from_arrays([pa.array([table["b"][i].as_py()], pa.int32()), pa.array([node], pa.int32()), pa.array([_packed(table.slice(i, j - i))], pa.binary())], ["b", "node", "map"])

        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node")[0].as_py()
            wait.append(batch.select([*by, *pair]))
            waiting += batch.num_rows
            if waiting >= CHUNK:
                held, wait, waiting = merged(), [], 0
                if held.num_rows >= HELD:
                    yield from out(held)
                    held = None
        if wait:
            held = merged()
        if held is not None:
            yield from out(held)

    spark_schema = StructType([*keyed.drop("node").schema.fields, StructField("n", LongType()), StructField("lines", LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark_schema)

    def add(held: bytes, new: bytes) -> bytes:
        if not held or not new:
            return held or new
        both = [_unpacked(x, schema) for x in (held, new)]
        return _packed(truncated(pa.concat_tables(both), by, pair, k).cast(schema))

    tree = keyed.mapInArrow(partial, "b int, node int, map binary").rdd.map(lambda r: ((r[0], r[1]), bytes(r[2])))
    nodes = tree.getNumPartitions()
    while True:
        nodes = -(-nodes // FAN)
        tree = tree.map(lambda x: ((x[0][0], x[0][1] // FAN), x[1])).aggregateByKey(b"", add, add, buckets, lambda key: key[0] + key[1])
        if nodes <= 1:
            break
    packed = spark.createDataFrame(tree.map(lambda x: (x[1],)), "map binary", verifySchema=False)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("map"):
                yield from _unpacked(x.as_py(), schema).drop_columns(["b"]).to_batches(max_chunksize=100_000)

    return packed.mapInArrow(opened, StructType(spark_schema.fields[1:]))


def _same(left: list[Column], right: list[Column]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & a.eqNullSafe(b)
    return out


def cutoffs(rows: DataFrame, group: list[str], pair: list[str], k: int) -> DataFrame:
    """(group, pair, tied, lines): the pairs of each group that begin within its first k rows, with their counts and that of the group."""
    whole = Window.partitionBy(*group)
    order = whole.orderBy(*[F.col(c).asc_nulls_last() for c in pair])
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = maps(rows, group, pair, k).select(*group, *pair, "n", F.sum("lines").over(whole).alias("lines"), before.alias("before"))
    return found.where(F.col("before") < k).select(*group, *pair, F.col("n").alias("tied"), "lines")


def _positions(sorted_rows: DataFrame, group: list[str], k: int) -> DataFrame:
    """sorted_rows (part, group, …) with `place` in their group within the part, as far as k; and `edge`: rows for the counts of the first and the last group."""
    schema = StructType([*sorted_rows.schema.fields, StructField("place", LongType()), StructField("edge", LongType())])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, first, edge = None, 0, None, None  # the group read last, its rows so far, whether it is the part's first

        def closed(n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*edge.columns, pa.nulls(1, pa.int64()), pa.array([n])], [*edge.schema.names, "place", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            start = _starts(table, group)
            size = np.diff(np.append(start, batch.num_rows))
            place = np.arange(batch.num_rows) - np.repeat(start, size)
            for i in sorted({0, len(start) - 1}):
                key = tuple(batch.column(c)[int(start[i])].as_py() for c in group)
                if key == last:
                    place[: size[0]] += count
                    count += int(size[0])
                    continue
                if first:
                    yield closed(count)
                first, last, count, edge = last is None, key, int(size[i]), batch.slice(int(start[i]), 1)
            keep = pa.array(place < k)
            left = [*batch.filter(keep).columns, pa.array(place + 1, pa.int64()).filter(keep), pa.nulls(keep.true_count, pa.int64())]
            yield pa.RecordBatch.from_arrays(left, [*batch.schema.names, "place", "edge"])
        if edge is not None:
            yield closed(count)

    return sorted_rows.mapInArrow(numbered, schema)


def ranked(rows: DataFrame, group: list[str], pair: list[str], then: list[str], k: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """(group, pair, then, carry, pos, tied): the rows at places 1 to k of each group, by pair and then by the columns `then`, all ascending,
    nulls last; tied: rows of the group with the same pair. The three name different columns of rows, of types that can be sorted."""
    spark, names = rows.sparkSession, list(dict.fromkeys([*group, *pair, *then, *carry]))
    pos, tied = fresh(rows.select(*names), "pos"), fresh(rows.select(*names), "tied")
    own = {c: f"c{i}" for i, c in enumerate(names)}
    g, p, t = ([own[c] for c in part] for part in (group, pair, then))
    lines = rows.select(*[F.col(c).alias(n) for c, n in own.items()], F.monotonically_increasing_id().alias("at"))
    top = written(cutoffs(lines, g, p, k), "cutoffs")
    least = rows.count() // MANY + 1
    keys = [*g, *p]
    low = top.select(*[F.col(c).alias(f"k_{c}") for c in keys], "tied", "lines")
    alike = lambda cs: _same([F.col(c) for c in cs], [F.col(f"k_{c}") for c in cs])
    large = low.where(F.col("lines") >= least)
    of_large = lines.join(F.broadcast(large), alike(keys)).select(*lines.columns, "tied")
    rest = lines.join(F.broadcast(large.select(*[f"k_{c}" for c in g]).distinct()), alike(g), "left_anti")
    of_rest = rest.join(low.where(F.col("lines") < least), alike(keys)).select(*lines.columns, "tied")
    left = written(of_large.unionByName(of_rest), "ranked")
    order = [F.col(c).asc_nulls_last() for c in [*g, *p, *t]] + [F.col("at")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), *left.columns)
    placed = written(_positions(dealt, g, k), "places")
    edges = placed.where(F.col("edge").isNotNull())  # two rows for each range at most
    earlier = F.coalesce(F.sum("edge").over(Window.partitionBy(*g).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = edges.select(F.col("part").alias("k_part"), *[F.col(c).alias(f"k_{c}") for c in g], earlier.alias("earlier")).where("earlier > 0")
    out = placed.where(F.col("edge").isNull()).join(F.broadcast(earlier), (F.col("part") == F.col("k_part")) & alike(g), "left")
    out = out.withColumn("place", F.col("place") + F.coalesce("earlier", F.lit(0))).where(F.col("place") <= k)
    return out.select(*[F.col(n).alias(c) for c, n in own.items()], F.col("place").alias(pos), F.col("tied").alias(tied))
