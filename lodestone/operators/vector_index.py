"""A vector index: vectors of one dimension in lists around centroids, exact and approximate nearest neighbours by cosine, and tables of queries.

Each dimension has its lists: centroids fitted by k-means on a sample of SAMPLE vectors a list at most, every vector in the list of its nearest centroid,
files sorted by list. A list knows its radius, the largest distance of a member from the centroid (on the unit sphere). No member can be nearer to a query
than the centroid is less the radius. Exact search reads the lists in which the k best can lie: first the nearest ones, then those that can still hold
something nearer than the k-th found. Approximate search reads a number of lists. Vectors of length 0 are a list of their own, which comes last.

A version (`sources.versions`) lists, for each dimension, loads of files with the first and last list of each; `insert` adds a load by the centroids that are there,
`delete` a table of ids that counts for the loads before it. Radii are kept by load. Ids are unique; ties go to the smaller id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.vectors import distances
from ..sources.versions import Conflict, Versions
from .retrieval import checked_vector, dense_top

#: Vectors that the fit sees for each list, lists of a dimension at most, and rounds of k-means.
SAMPLE, LISTS, ROUNDS = 64, 2048, 8
#: Numbers of a block of queries: what is sent to every task, 32 MB at most.
BLOCK = 1 << 22
#: Numbers of a product of rows and queries that a task holds at once.
HELD = 1 << 20
#: Lists read before any bound is known, and slack for rounding.
FIRST, SLACK = 4, 1e-6
#: Goes up with the form of what is written.
FORMAT = 1


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(length > 0, length, 1.0)[:, None], length


def _nearest(u: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """List and distance of the nearest centroid of each row."""
    square = np.maximum((u * u).sum(1)[:, None] - 2 * u @ centroids.T + (centroids * centroids).sum(1), 0)
    best = square.argmin(1)
    return best, np.sqrt(square[np.arange(len(u)), best])


def fitted(rows: DataFrame, dim: int, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of rows (id, v) of one dimension: k-means over a sample by the hash of the id; each round sums in the tasks, and no vector but the first ones leaves them."""
    spark, n = rows.sparkSession, rows.count()
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(n // (SAMPLE * lists) + 1)) == 0).select("id", "v")
    first = np.array([r["v"] for r in sample.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(lists).collect()], np.float64).reshape(-1, dim)  # `lists` rows
    centroids = _unit(first)[0] if len(first) else np.zeros((1, dim))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(sent.value), np.zeros(len(sent.value), np.int64)
            for b in batches:
                if b.num_rows:
                    u = _unit(matrix(b.column("v"), dim))[0]
                    at, _ = _nearest(u, sent.value)
                    np.add.at(total, at, u)
                    count += np.bincount(at, minlength=len(count))
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.float64()))], ["list", "n", "sum"])

        part = sample.mapInArrow(sums, "list bigint, n bigint, sum array<double>")
        whole = part.select("list", "n", F.posexplode("sum").alias("i", "x")).groupBy("list", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        new = centroids.copy()
        for r in whole.groupBy("list").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s")).collect():  # a row for each list
            new[r["list"]] = np.array([x["x"] for x in r["s"]]) / r["n"]
        moved, centroids = float(np.abs(new - centroids).max()), new
        sent.unpersist()
        if moved < 1e-6:
            break
    return centroids


class VectorIndex:
    """The latest version under a path, as of when it was opened."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)
        self.version, self.now = self.versions.read()
        self.read_lists: tuple[int, int] = (0, 0)  # lists read by the last search, and lists there are

    @classmethod
    def create(cls, rows: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding", keep: tuple[str, ...] = (), lists: int | None = None) -> VectorIndex:
        """A new index; lists: for each dimension, by default the square root of its vectors. Null and empty vectors are left out."""
        out, spark = cls(rows.sparkSession, path), rows.sparkSession
        named = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), *keep)
        out.now = {"id": id_col, "vector": vector_col, "kind": named.schema["id"].dataType.simpleString(), "element": named.schema["v"].dataType.simpleString(), "keep": [f"{c} {named.schema[c].dataType.simpleString()}" for c in keep], "dims": {}, "deleted": []}
        dims = named.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each dimension
        for d, n in sorted((r["d"], r["n"]) for r in dims):
            centroids = fitted(named.where(F.size("v") == d), d, min(LISTS, lists or max(1, int(n**0.5))))
            name = f"c-{uuid.uuid4().hex}"
            spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{out.path}/{name}")
            out.now["dims"][str(d)] = {"centroids": name, "lists": len(centroids), "loads": [out._load(named, d, centroids)]}
        try:
            out.versions.commit(1, out.now)
        except Conflict:
            out.versions.remove([x["name"] for d in out.now["dims"].values() for x in d["loads"]])
        return cls(spark, path)

    def _centroids(self, dim: int) -> np.ndarray:
        held = self.now["dims"][str(dim)]
        rows = self.spark.read.schema("list int, centroid array<double>").parquet(f"{self.path}/{held['centroids']}").collect()  # LISTS rows at most
        return np.array([r["centroid"] for r in sorted(rows)]).reshape(-1, dim)

    def _load(self, named: DataFrame, dim: int, centroids: np.ndarray) -> dict:
        """Writes the vectors of one dimension by list; what the version says of them."""
        sent, last = self.spark.sparkContext.broadcast(centroids), len(centroids)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    u, length = _unit(matrix(b.column("v"), dim))
                    at, far = _nearest(u, sent.value)
                    zero = length == 0
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(zero, last, at).astype(np.int32)), pa.array(np.where(zero, 0.0, far))], [*b.schema.names, "list", "far"])

        rows = named.where(F.size("v") == dim)
        schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields] + ["list int", "far double"])
        name = f"l-{uuid.uuid4().hex}"
        rows.mapInArrow(placed, schema).repartitionByRange("list", "id").sortWithinPartitions("list", "id").write.parquet(f"{self.path}/{name}")
        held = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        files = held.groupBy(F.input_file_name().alias("file")).agg(F.min("list").alias("first"), F.max("list").alias("last")).collect()  # a row for each file
        radii = held.groupBy("list").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()  # a row for each list
        return {"name": name, "schema": schema, "files": [[r["file"].rpartition("/")[2], r["first"], r["last"]] for r in files], "lists": {str(r["list"]): [r["far"], r["n"]] for r in radii}}

    def _committed(self, change) -> VectorIndex:
        for _ in range(8):
            number, now = self.versions.read()
            try:
                self.versions.commit(number + 1, change(now))
                return VectorIndex(self.spark, self.path)
            except Conflict:
                continue
        raise Conflict(f"{self.path}: others made 8 versions meanwhile")

    def insert(self, rows: DataFrame) -> VectorIndex:
        """With rows of the dimensions that the index has, whose ids it doesn't hold; a dimension that it lacks is an error."""
        keep = [x.split(" ")[0] for x in self.now["keep"]]
        named = rows.select(F.col(self.now["id"]).alias("id"), F.col(self.now["vector"]).alias("v"), *keep)
        dims = sorted(r[0] for r in named.where(F.size("v") > 0).select(F.size("v")).distinct().collect())
        if missing := [d for d in dims if str(d) not in self.now["dims"]]:
            raise ValueError(f"no lists for vectors of {missing[0]} numbers")
        loads = {str(d): self._load(named, d, self._centroids(d)) for d in dims}
        return self._committed(lambda now: now | {"dims": {d: x | {"loads": x["loads"] + ([loads[d]] if d in loads else [])} for d, x in now["dims"].items()}})

    def delete(self, ids: DataFrame) -> VectorIndex:
        name = f"d-{uuid.uuid4().hex}"
        ids.select(F.col(ids.columns[0]).alias("id")).distinct().write.parquet(f"{self.path}/{name}")
        return self._committed(lambda now: now | {"deleted": [*now["deleted"], {"name": name, "loads": [x["name"] for d in now["dims"].values() for x in d["loads"]]}]})

    def vectors(self, dim: int, lists: Iterable[int] | None = None) -> DataFrame:
        """(id, v, kept columns, list) of the vectors of a dimension in lists, or of all, from the files that hold them."""
        wanted, out = None if lists is None else sorted(set(lists)), None
        for load in self.now["dims"].get(str(dim), {"loads": []})["loads"]:
            files = [f"{self.path}/{load['name']}/{f}" for f, first, last in load["files"] if wanted is None or any(first <= x <= last for x in wanted)]
            if not files:
                continue
            rows = self.spark.read.schema(load["schema"]).parquet(*files).drop("far")
            rows = rows if wanted is None else rows.where(F.col("list").isin(wanted))
            for d in self.now["deleted"]:
                if load["name"] in d["loads"]:
                    gone = self.spark.read.schema(f"id {self.now['kind']}").parquet(f"{self.path}/{d['name']}").withColumnRenamed("id", "gone")
                    rows = rows.join(gone, F.col("id") == F.col("gone"), "left_anti")
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            out = self.spark.createDataFrame([], ", ".join([f"id {self.now['kind']}", f"v {self.now['element']}", *self.now["keep"], "list int"]))
        return out

    def _bounds(self, unit: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists with members, nearest centroid first, the distance of each centroid, and the least distance a member can have; the zero vectors' list is no part."""
        centroids, far = self._centroids(dim), {}
        for load in self.now["dims"][str(dim)]["loads"]:
            for x, (r, _) in load["lists"].items():
                far[int(x)] = max(far.get(int(x), 0.0), r)
        some = np.array(sorted(x for x in far if x < len(centroids)), np.int64)
        away = np.sqrt(np.maximum(((centroids[some] - unit) ** 2).sum(1), 0)) if len(some) else np.zeros(0)
        order = np.argsort(away, kind="stable")
        some, away = some[order], away[order]
        return some, away, np.maximum(away - np.array([far[int(x)] for x in some]), 0)

    def nearest(self, vector: Iterable[float], k: int, probes: int | None = None, among: DataFrame | None = None) -> DataFrame:
        """(id, distance, rank) as `dense_top` gives them, exactly or from `probes` lists; among: ids (one column) to search."""
        q = np.array(checked_vector(vector))
        dim = len(q)
        length = np.linalg.norm(q)
        limited = lambda rows: rows if among is None else rows.join(among.toDF("own"), F.col("id") == F.col("own"), "left_semi")
        if str(dim) not in self.now.get("dims", {}):
            self.read_lists = (0, 0)
            return dense_top(self.vectors(dim), q, k, "id", "v")
        total = len({x for load in self.now["dims"][str(dim)]["loads"] for x in load["lists"]})
        some, _, least = self._bounds(q / (length or 1.0), dim)
        if probes is not None:
            self.read_lists = (min(probes, len(some)), total)
            return dense_top(limited(self.vectors(dim, some[:probes].tolist())), q, k, "id", "v")
        if length == 0 or len(some) <= FIRST:
            self.read_lists = (total, total)
            return dense_top(limited(self.vectors(dim)), q, k, "id", "v")
        known = dense_top(limited(self.vectors(dim, some[:FIRST].tolist())), q, k, "id", "v").collect()
        worst = np.sqrt(max(2 * known[-1]["distance"], 0)) + SLACK if len(known) == k else np.inf
        more = [int(x) for x in some[FIRST:][least[FIRST:] <= worst]] + ([len(self._centroids(dim))] if len(known) < k else [])
        self.read_lists = (FIRST + len(more), total)
        found = self.spark.createDataFrame([tuple(r)[:2] for r in known], f"id {self.now['kind']}, distance double")
        rest = dense_top(limited(self.vectors(dim, more)), q, k, "id", "v").select("id", "distance")
        return found.unionByName(rest).orderBy("distance", "id").limit(k).withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))


def _best(ids: pa.Array, asked: np.ndarray, distance: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of rows (query, id, distance) the k nearest of each query, ties by id, sorted."""
    order = pa.compute.sort_indices(pa.table({"q": asked, "d": distance, "id": ids}), [("q", "ascending"), ("d", "ascending"), ("id", "ascending")]).to_numpy()
    asked = asked[order]
    start = np.flatnonzero(np.append(True, asked[1:] != asked[:-1])) if len(asked) else np.zeros(0, np.int64)
    place = np.arange(len(asked)) - np.repeat(start, np.diff(np.append(start, len(asked))))
    kept = order[place < k]
    return ids.take(pa.array(kept)), asked[place < k], distance[kept]


def nearest_of_each(queries: DataFrame, rows: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "vector", id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of each query among those of its dimension, by exact cosine, for a table of queries.

    Queries go to the tasks in blocks of BLOCK numbers at most, and the rows are read once for each block: a batch is multiplied with the block, and a task keeps
    k rows of each query, which are all that leaves it. Null and empty queries have no rows; a query id that repeats counts as one query for each row.
    """
    spark, out = rows.sparkSession, None
    q = queries.select(F.col(query_id).alias("q"), F.col(query_vector).alias("v")).where(F.size("v") > 0)
    named = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kind = f"{{}} {named.schema['id'].dataType.simpleString()}"

    def part(held: list, dim: int) -> DataFrame:
        sent = spark.sparkContext.broadcast(_unit(np.array([r["v"] for r in held], np.float64).reshape(-1, dim))[0])

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, ids, asked, distance = sent.value, None, np.zeros(0, np.int64), np.zeros(0)
            worst, step, part_ = np.full(len(block), np.inf), max(16, HELD // max(len(block), 1)), max(16, HELD // dim)
            for b in batches:
                for i in range(0, b.num_rows, step):
                    own = b.slice(i, step)
                    m = matrix(own.column("v"), dim)
                    u, length = _unit(m)
                    d = u @ block.T
                    np.subtract(1.0, d, out=d)
                    d[length == 0] = np.inf
                    # of a query with k rows already, only what may be among them
                    limit = np.minimum(np.partition(d, k - 1, axis=0)[k - 1] if len(d) > k and np.isinf(worst).any() else np.inf, worst)
                    row, col = np.nonzero(d <= limit + SLACK)
                    if not len(row):
                        continue
                    near = np.concatenate([distances(m[row[j : j + part_]], block[col[j : j + part_]]) for j in range(0, len(row), part_)])
                    new = own.column("id").take(pa.array(row))
                    ids = new if ids is None else pa.concat_arrays([ids, new])
                    ids, asked, distance = _best(ids, np.concatenate([asked, col]), np.concatenate([distance, near]), k)
                    full = np.bincount(asked, minlength=len(block)) >= k
                    worst[full] = np.maximum.reduceat(distance, np.flatnonzero(np.append(True, asked[1:] != asked[:-1])))[full[np.unique(asked)]]
            if ids is not None:
                yield pa.RecordBatch.from_arrays([pa.array(asked.astype(np.int32)), ids, pa.array(distance)], ["n", "id", "distance"])

        top = named.where(F.size("v") == dim).mapInArrow(best, f"n int, {kind.format('id')}, distance double")
        rank = F.row_number().over(Window.partitionBy("n").orderBy("distance", "id"))
        names = spark.createDataFrame([(i, r["q"]) for i, r in enumerate(held)], f"n int, q {q.schema['q'].dataType.simpleString()}")
        return top.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "n").select(F.col("q").alias(query_id), "id", "distance", "rank")  # a block's ids

    for dim in sorted(r[0] for r in q.select(F.size("v")).distinct().collect()):
        held: list = []
        for r in q.where(F.size("v") == dim).toLocalIterator():  # a block at a time
            held.append(r)
            if len(held) * dim >= BLOCK:
                one, held = part(held, dim), []
                out = one if out is None else out.unionByName(one)
        if held:
            one = part(held, dim)
            out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], f"{query_id} {q.schema['q'].dataType.simpleString()}, {kind.format('id')}, distance double, rank int") if out is None else out
