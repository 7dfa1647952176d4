"""A search index: postings with positions in blocks of rows, in segments that are never changed, and BM25 over them.

A segment holds `postings`, one row for each term and block of at most 1024 rows (term, block, n, max_tf, min_dl, and arrays of ids, occurrences, lengths,
starts and places: those of an entry are as many as it has occurrences, from its start on), sorted by term, and `rows` (id, dl and the columns to filter by). The manifest (`sources.versions`) lists the segments, the terms at the ends of each of
their files, numbers of rows and words, and the deleted ids. So a query opens the files of its terms only, and no text.

* `insert` adds a segment, `delete` a table of ids, `merge` makes one segment of all, from the postings; each is one commit, and a writer that loses to
  another repeats its commit on the newer version. Readers keep the version that they began with.
* Postings are dealt by ranges of terms once, where rows are inserted. The ends of the ranges come from the terms of about SAMPLE rows: they decide how much a file holds,
  not what is in the index. A merge copies postings, still in order, without the deleted rows; a term's then lie in as many places as there were segments.
  Places are read only for clauses that ask for a field or a phrase.
* Best k over everything: a block can give a row at most the sum over terms of idf * f(max_tf, min_dl). Where there are many blocks, those with the largest
  bounds are scored first, and of the others only such are read whose bound reaches the k-th score found.
* With a filter, or with deleted ids, the rows left are the corpus: their number, mean length and terms are counted in the same pass over the postings.

Places tell fields apart (field * 2^40 + word), so clauses may ask for a field, phrases and words near each other. Ids are unique; ties go to the smaller id.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..config import BM25_B, BM25_K1
from ..sources.versions import Conflict, Versions
from .chunks import dealt
from .retrieval import query_terms, terms

#: Powers of two: rows of a block, and words of a field.
BLOCK, FIELD = 10, 40
#: Blocks scored without looking at bounds.
FIRST = 16
TRIES = 8
#: Goes up with the form of what is written.
FORMAT = 3
#: Bytes of a row group of postings.
GROUP = 1 << 20
#: Entries of a file of postings, and rows whose terms give the ends of the files.
FILE, SAMPLE = 1 << 20, 1 << 10
#: Deleted ids that a merge sends to its tasks; more are joined.
GONE = 1 << 20
#: Queries that one pass over the postings answers, those whose scores a task holds at once, and entries that it adds up at once for them.
QUERIES, ASKERS, ADDED = 1 << 18, 1 << 10, 1 << 20


@dataclass(frozen=True)
class Clause:
    """Words that should (any), must (all) or must not (none) occur: each for itself, or with slop in this order with at most so many
    other words between them in all; in one field or in any; what they add to the score is multiplied by boost."""

    words: tuple[str, ...]
    need: str = "any"
    slop: int | None = None
    field: str | None = None
    boost: float = 1.0

    def __post_init__(self) -> None:
        if self.need not in ("any", "all", "none") or self.boost <= 0 or (self.slop is not None and self.slop < 0):
            raise ValueError(f"no such clause: {self}")


def clause(text: str, need: str = "any", slop: int | None = None, field: str | None = None, boost: float = 1.0) -> Clause:
    import regex

    return Clause(tuple(regex.findall(r"[\p{L}\p{N}]+", text.lower())) if slop is not None else tuple(query_terms(text)), need, slop, field, boost)


def _inverted(batch: pa.RecordBatch, fields: int, ends_: list[str]) -> pa.RecordBatch:
    """The postings of the rows (id, block, f0, f1, …: lists of terms) of one block."""
    rows, values, row, place = batch.num_rows, [], [], []
    for f in range(fields):
        lists = batch.column(f"f{f}").fill_null([])
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values.append(lists.flatten())
        row.append(np.repeat(np.arange(rows), sizes))
        place.append(np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + (f << FIELD))
    coded = pa.concat_arrays(values).dictionary_encode()
    code, row, place = coded.indices.to_numpy(), np.concatenate(row), np.concatenate(place)
    length = np.bincount(row, minlength=rows)
    order = np.lexsort((place, row, code))
    code, row, place = code[order], row[order], place[order]
    entry = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1]))) if len(code) else np.zeros(0, np.int64)
    tf, who = np.diff(np.append(entry, len(code))), row[entry]
    term = np.flatnonzero(np.append(True, code[entry][1:] != code[entry][:-1])) if len(code) else np.zeros(0, np.int64)
    return _posted(coded.dictionary.take(pa.array(code[entry][term])), np.full(len(term), batch.column("block")[0].as_py() if rows else 0), np.append(term, len(entry)), batch.column("id").take(pa.array(who)), tf, length[who], place, ends_)


def _posted(term: pa.Array, block: np.ndarray, ends: np.ndarray, ids: pa.Array, tf: np.ndarray, dl: np.ndarray, place: np.ndarray, ends_: list[str]) -> pa.RecordBatch:
    """Rows of postings, each with the entries from one of ends to the next, and the file that each goes to."""
    entry = np.append(0, np.cumsum(tf))  # of an entry's places
    first = ends[:-1]
    most, least = (np.maximum.reduceat(tf, first), np.minimum.reduceat(dl, first)) if len(first) else (tf, dl)
    lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), x)
    starts = entry[:-1] - np.repeat(entry[first], np.diff(ends))
    return pa.RecordBatch.from_arrays(
        [term, pa.array(block), *(pa.array(x.astype(np.int32)) for x in (np.diff(ends), most, least)), lists(ends, ids), *(lists(ends, pa.array(x.astype(np.int32))) for x in (tf, dl, starts)), lists(entry[ends], pa.array(place, pa.int64())), _file(term, block, ends_)],
        ["term", "block", "n", "max_tf", "min_dl", "ids", "tfs", "dls", "starts", "places", "file"],
    )


def _file(term: pa.Array, block: np.ndarray, ends: list[str]) -> pa.Array:
    """Numbers of files that the last terms of the others part; a term that ends several is dealt over them by block."""
    many = {t for t, u in zip(ends, ends[1:], strict=False) if t == u}
    out = []
    for t, b in zip(term.to_pylist(), block.tolist(), strict=True):
        i = bisect_left(ends, t)
        out.append(i + b % (bisect_right(ends, t) - i + 1) if t in many else i)
    return pa.array(out, pa.int32())


def _repacked(batch: pa.RecordBatch, gone: pa.Array | None) -> pa.RecordBatch:
    """Postings (term, block, ids, tfs, dls, places) without the entries of gone ids."""
    ids, tf, dl, place = (batch.column(x).flatten() for x in ("ids", "tfs", "dls", "places"))
    tf, dl, place = (x.to_numpy(zero_copy_only=False) for x in (tf, dl, place))
    of = np.repeat(np.arange(batch.num_rows), batch.column("ids").value_lengths().to_numpy(zero_copy_only=False))
    if gone is not None:
        stays = ~pa.compute.is_in(ids, value_set=gone).to_numpy(zero_copy_only=False)
        ids, tf, dl, of, place = ids.filter(pa.array(stays)), tf[stays], dl[stays], of[stays], place[np.repeat(stays, tf)]
    n = np.bincount(of, minlength=batch.num_rows)
    some = np.flatnonzero(n)
    return _posted(batch.column("term").take(pa.array(some)), batch.column("block").to_numpy()[some], np.append(0, np.cumsum(n[some])), ids, tf, dl, place, []).drop_columns("file")


def _ends(counts: DataFrame, share: float, cores: int) -> list[str]:
    """The last terms of all files but one, from the entries (term, n) of a share of the rows: ever so many terms apart that files hold about FILE entries."""
    found = sorted((r["term"], r["n"]) for r in counts.collect())  # the terms of a bounded sample
    upto = np.cumsum([n for _, n in found]) if found else np.zeros(1, np.int64)
    entries = int(upto[-1] / share)
    files = max(-(-entries // FILE), min(cores, entries // 2048 + 1))
    return [found[i][0] for i in np.searchsorted(upto, [upto[-1] * k / files for k in range(1, files)])] if found else []


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last term of each file (own, term) of a batch."""
    for batch in batches:
        own = batch.column("own")
        for one in own.unique():
            ends = pa.compute.min_max(batch.column("term").filter(pa.compute.equal(own, one))).as_py()
            yield pa.RecordBatch.from_pylist([{"own": one.as_py(), "first": ends["min"], "last": ends["max"]}])


def _postings_schema(kind: str) -> str:
    return f"term string, block bigint, n int, max_tf int, min_dl int, ids array<{kind}>, tfs array<int>, dls array<int>, starts array<int>, places array<bigint>"


def weight(tf: Column | float, dl: Column | float, mean: float, k1: float = BM25_K1, b: float = BM25_B):
    return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / (mean or 1.0)))


def _idf(n: float, df: float) -> float:
    return float(np.log(1.0 + (n - df + 0.5) / (df + 0.5)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block of batches that are sorted by block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                if held and held[0].column("block")[0].as_py() != block[i]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _first(rows: pa.Table, k: int) -> pa.Table:
    """Of rows (n, score, id) the k best of each n, ties by id, sorted."""
    rows = rows.take(pa.compute.sort_indices(rows, [("n", "ascending"), ("score", "descending"), ("id", "ascending")])).combine_chunks()
    n = rows["n"].to_numpy()
    start = np.flatnonzero(np.append(True, n[1:] != n[:-1])) if len(n) else np.zeros(0, np.int64)
    return rows.filter(pa.array(np.arange(len(n)) - np.repeat(start, np.diff(np.append(start, len(n)))) < k))


class _Block:
    """The entries of a block's terms that queries ask for, by term and row."""

    def __init__(self, table: pa.Table, of: dict[str, int], idf: np.ndarray, mean: float, askers: int) -> None:
        ids = table["ids"].combine_chunks()
        term = np.repeat(np.array([of.get(t, -1) for t in table["term"].to_pylist()], np.int64), ids.value_lengths().to_numpy(zero_copy_only=False))
        ids = ids.flatten().dictionary_encode()
        part = weight(*(table[c].combine_chunks().flatten().to_numpy().astype(np.float64) for c in ("tfs", "dls")), mean)
        asked = np.flatnonzero(term >= 0)
        self.ids, self.rows, self.idf = ids.dictionary, len(ids.dictionary), idf
        self.key = term[asked] * self.rows + ids.indices.to_numpy()[asked]
        order = np.argsort(self.key)
        self.key, self.part = self.key[order], part[asked][order]
        term, self.row = np.divmod(self.key, max(self.rows, 1))
        self.start = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.start, len(term)))
        self.most = np.maximum.reduceat(self.part, self.start) if len(term) else self.part
        #: Where a term lies, -1 for one that the block doesn't have.
        self.at = np.full(len(idf), -1, np.int64)
        self.at[term[self.start]] = np.arange(len(self.start))
        # terms of many rows are looked up by row: as many numbers as 8 times their entries at most
        many = np.flatnonzero(8 * self.size >= self.rows)
        self.many, self.of_many = np.full(len(self.start), -1, np.int64), np.zeros((len(many), self.rows))
        self.many[many] = np.arange(len(many))
        own = np.repeat(self.many, self.size)
        self.of_many[own[own >= 0], self.row[own >= 0]] = self.part[own >= 0]
        #: Sums of rows for one query after the other; zeros between uses.
        self.sums = np.zeros(askers * self.rows)

    def weighed(self, term: np.ndarray, row: np.ndarray) -> np.ndarray:
        """What a term of the block adds to a row's score."""
        own = self.many[self.at[term]]
        out, few = self.of_many[own, row] if len(self.of_many) else np.zeros(len(row)), np.flatnonzero(own < 0)
        key = term[few] * self.rows + row[few]
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        out[few] = np.where(self.key[i] == key, self.part[i], 0.0)
        return self.idf[term] * out


class _Best:
    """The k best rows of each query of a group, over blocks that come one after the other.

    `least` is a score that k rows of a query are known to reach. Terms of a query that together can't add as much in a block are weak: rows that hold no others are not looked at,
    and of the others only those are scored whole that can reach it. A score is the sum over the query's terms in their order, so equal rows have equal scores.
    """

    def __init__(self, asked: list[np.ndarray], k: int) -> None:
        """asked: numbers of the terms of each query, in order."""
        self.k, self.n = k, len(asked)
        self.ends = np.cumsum([0, *map(len, asked)])
        self.q, self.t = np.repeat(np.arange(self.n), np.diff(self.ends)), np.concatenate(asked).astype(np.int64)
        self.least, self.found, self.new, self.waiting = np.zeros(self.n), None, [], 0

    def add(self, block: _Block) -> None:
        at = block.at[self.t]
        here = np.flatnonzero(at >= 0)
        if not len(here):
            return
        q, t, at = self.q[here], self.t[here], at[here]
        bound = block.idf[t] * block.most[at]
        order = np.lexsort((bound, q))
        upto, first = np.cumsum(bound[order]), np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        upto -= np.repeat(upto[first] - bound[order][first], np.diff(np.append(first, len(q))))
        weak = upto < self.least[q] * (1 - 1e-9) - 1e-6  # q is in order already
        strong, weak = np.sort(order[~weak]), order[weak]
        less = np.cumsum(np.append(0, np.bincount(q[weak], minlength=self.n))), t[weak], bound[weak]  # the weak terms of each query, the weakest first
        q, t, at = q[strong], t[strong], at[strong]
        # queries in turn, as many as have about ADDED entries
        entries = np.bincount(q, block.size[at], self.n)
        cuts = np.searchsorted((np.cumsum(entries) - entries) // ADDED, np.arange(entries.sum() // ADDED + 2))
        for a, b in zip(cuts, cuts[1:], strict=False):
            i, j = np.searchsorted(q, (a, b))
            if j > i:
                self._added(block, a, b, q[i:j], t[i:j], at[i:j], less)

    def _added(self, block: _Block, a: int, b: int, q: np.ndarray, t: np.ndarray, at: np.ndarray, less: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        n = block.size[at]
        entry = np.repeat(block.start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        asker = np.repeat(q - a, n)
        cell = asker * block.rows + block.row[entry]
        score = block.sums[: (b - a) * block.rows]
        np.add.at(score, cell, np.repeat(block.idf[t], n) * block.part[entry])  # in the order of terms
        if block.rows >= self.k and 8 * len(cell) >= len(score):  # many rows: the k-th of the block is worth knowing
            kth = np.partition(score.reshape(b - a, -1), block.rows - self.k, axis=1)[:, block.rows - self.k]
            self.least[a:b] = np.maximum(self.least[a:b], kth * (1 - 1e-9))
        ends, term, bound = less
        rest = np.diff(np.append(0, np.cumsum(bound))[ends])
        reach = self.least * (1 - 1e-9) - 1e-6  # a whole score may be another sum than that of its parts
        found = cell[score[cell] >= (reach - rest)[a:b][asker]]
        nth, last = np.arange(len(found), dtype=np.int32), np.empty(len(score), np.int32)
        last[found] = nth
        found = found[last[found] == nth]  # each once
        asker, row = np.divmod(found, block.rows)
        asker, known = asker + a, score[found]
        score[cell] = 0
        # what weak terms add at most gives way to what they add, the strongest first
        most, had = known + rest[asker], (ends[asker + 1] - ends[asker]).copy()
        for i in range(int(had.max(initial=0))):
            more = np.flatnonzero(i < had)
            j = ends[asker[more] + 1] - 1 - i
            most[more] += block.weighed(term[j], row[more]) - bound[j]
            stays = most >= reach[asker]
            asker, row, known, most, had = asker[stays], row[stays], known[stays], most[stays], had[stays]
        some = np.flatnonzero(had)
        score = known
        score[some] = self._whole(block, asker[some], row[some])
        stays = score >= self.least[asker]
        if stays.any():
            self.new.append(pa.table({"n": asker[stays], "score": score[stays], "id": block.ids.take(pa.array(row[stays]))}))
            self.waiting += self.new[-1].num_rows
            if self.waiting >= self.k * self.n:
                self.best()

    def _whole(self, block: _Block, asker: np.ndarray, row: np.ndarray) -> np.ndarray:
        score, first, last = np.zeros(len(asker)), self.ends[asker], self.ends[asker + 1]
        for i in range(int((last - first).max(initial=0))):
            more = np.flatnonzero(first + i < last)
            term = self.t[first[more] + i]
            here = block.at[term] >= 0
            score[more[here]] += block.weighed(term[here], row[more[here]])
        return score

    def best(self) -> pa.Table | None:
        """(n, score, id) of the k best rows of each query so far."""
        if self.new:
            self.found = _first(pa.concat_tables([*self.new, *([] if self.found is None else [self.found])]), self.k)
            self.new, self.waiting = [], 0
            n = self.found["n"].to_numpy()
            last = np.flatnonzero(np.append(n[1:] != n[:-1], True))
            full = last[np.diff(np.append(-1, last)) == self.k]
            self.least[n[full]] = np.maximum(self.least[n[full]], self.found["score"].to_numpy()[full])
        return self.found


class Index:
    """The latest version of an index under a path, as of when it was opened."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)
        self.version, self.now = self.versions.read()

    # ------------------------------------------------------------ writing

    @classmethod
    def create(cls, rows: DataFrame, path: str, id_col: str = "id", fields: tuple[str, ...] = ("text",), keep: tuple[str, ...] = ()) -> Index:
        """A new index of rows; keep: columns to filter by. Where another writer has made one meanwhile, that is opened."""
        out = cls(rows.sparkSession, path)
        kept = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep]
        out.now = {"id": id_col, "kind": rows.schema[id_col].dataType.simpleString(), "fields": list(fields), "keep": kept, "segments": [], "deleted": []}
        segment = out._segment(rows)
        try:
            out.versions.commit(1, out.now | {"segments": [segment]})
        except Conflict:
            out.versions.remove([segment["name"]])
        return cls(rows.sparkSession, path)

    def _committed(self, change) -> Index:
        """The index after change, a function of a version's description, on the latest version."""
        for _ in range(TRIES):
            number, now = self.versions.read()
            try:
                self.versions.commit(number + 1, change(now))
                return Index(self.spark, self.path)
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {TRIES} versions were made by others")

    def _segment(self, rows: DataFrame) -> dict:
        fields, keep = self.now["fields"], [x.split(" ")[0] for x in self.now["keep"]]
        rows = dealt(rows.select(*dict.fromkeys([self.now["id"], *keep, *fields])))
        at = rows.select(F.col(self.now["id"]).alias("id"), *keep, *[terms(F.col(f)).alias(f"f{i}") for i, f in enumerate(fields)])
        dl = sum((F.coalesce(F.size(f"f{i}"), F.lit(0)) for i in range(len(fields))), F.lit(0))
        share = min(1.0, SAMPLE / max(rows.count(), 1))
        # terms are looked for in the rows of the sample only
        some = rows.sample(share, 0) if share < 1 else rows
        words = F.array_distinct(F.flatten(F.array(*[F.coalesce(terms(F.col(f)), F.array().cast("array<string>")) for f in fields])))
        ends = _ends(some.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")), share, self.spark.sparkContext.defaultParallelism)

        def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block = batch.column("block").to_numpy()
                cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), batch.num_rows]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    if j > i:
                        yield _inverted(batch.slice(i, j - i), len(fields), ends)

        own = uuid.uuid4().int >> 66  # segments number their blocks apart
        split = at.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK).bitwiseXOR(F.lit(own)))
        posted = split.select("id", "block", *[f"f{i}" for i in range(len(fields))]).mapInArrow(inverted, f"{_postings_schema(self.now['kind'])}, file int")
        # small files: a task sorts a bounded number of entries; what the lists tell is not sent
        sent = posted.drop("n", "max_tf", "min_dl").repartitionById(len(ends) + 1, "file").drop("file").sortWithinPartitions("term", "block")
        told = {"n": F.size("ids"), "max_tf": F.array_max("tfs"), "min_dl": F.array_min("dls")}
        names = [x.split(" ")[0] for x in _postings_schema(self.now["kind"]).split(", ")]
        return self._written(sent.select(*[told[x].alias(x) if x in told else x for x in names]), at.select("id", dl.alias("dl"), *keep))

    def _written(self, posted: DataFrame, lengths: DataFrame) -> dict:
        """A segment of postings, in order in each of their partitions, and rows, and its part of the manifest."""
        name = f"s-{uuid.uuid4().hex}"
        # small row groups: a query decodes those of its terms
        posted.write.option("parquet.block.size", GROUP).parquet(f"{self.path}/{name}/postings")
        lengths.write.parquet(f"{self.path}/{name}/rows")
        spark = self.spark
        # a task passes on a row for each file of a batch; a least string by groups would sort all terms first
        own = F.xxhash64(F.substring_index(F.input_file_name(), "/", -1)).alias("own")
        ranges = spark.read.schema("term string").parquet(f"{self.path}/{name}/postings").select(own, "term").mapInArrow(_ranges, "own bigint, first string, last string").groupBy("own").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        names = spark.createDataFrame([(x,) for x in self.versions.folders(f"{name}/postings") if x.endswith(".parquet")], "file string")
        files = names.join(ranges, F.xxhash64("file") == F.col("own")).select("file", "first", "last").orderBy("file")
        rows, words = spark.read.schema("dl int").parquet(f"{self.path}/{name}/rows").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return {"name": name, "rows": rows, "words": words, "files": [list(r) for r in files.collect()]}  # a row for each file

    def insert(self, rows: DataFrame) -> Index:
        """With rows, whose ids the index doesn't hold."""
        segment = self._segment(rows)
        return self._committed(lambda now: now | {"segments": [*now["segments"], segment]})

    def delete(self, ids: DataFrame) -> Index:
        """Without the rows of ids (one column)."""
        name = f"d-{uuid.uuid4().hex}"
        ids.select(F.col(ids.columns[0]).alias("id")).distinct().write.parquet(f"{self.path}/{name}")
        return self._committed(lambda now: now | {"deleted": [*now["deleted"], {"name": name, "segments": [s["name"] for s in now["segments"]]}]})

    def merge(self, most: int = 8) -> Index:
        """One segment where there are more than `most` or ids are deleted; made of postings, no text is read. Older versions can still be read."""
        if len(self.now["segments"]) <= most and not self.now["deleted"]:
            return self
        # rows stay in their block, and segments number their blocks apart: no postings are joined
        columns, schema = ["ids", "tfs", "dls", "starts", "places"], _postings_schema(self.now["kind"])
        posted = None
        for segments, deleted in self._groups():
            held = self._entries(None, columns, segments)
            gone = self._gone(deleted)
            if deleted and gone is None:
                left = self._without(self._opened(held), deleted)
                lists = left.groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("id", "tf", "dl", "places"))).alias("e"))  # rows of a block
                held = lists.select("term", "block", *[F.col(f"e.{x}").alias(f"{x}s") for x in ("id", "tf", "dl")], F.flatten("e.places").alias("places")).repartitionByRange("term", "block").sortWithinPartitions("term", "block")

            def repacked(batches: Iterator[pa.RecordBatch], gone=gone) -> Iterator[pa.RecordBatch]:
                ids = gone.value if gone is not None else None
                for batch in batches:
                    yield _repacked(batch, ids)

            one = held.mapInArrow(repacked, schema)
            posted = one if posted is None else posted.unionByName(one)
        old = {s["name"] for s in self.now["segments"]}
        segment = self._written(posted, self.rows())

        def change(now: dict) -> dict:
            if not old <= {s["name"] for s in now["segments"]} or now["deleted"] != self.now["deleted"]:
                self.versions.remove([segment["name"]])
                raise RuntimeError("the segments to merge were merged or deleted from meanwhile")
            return now | {"segments": [segment, *(s for s in now["segments"] if s["name"] not in old)], "deleted": []}

        return self._committed(change)

    def _gone(self, deleted: list[str]):
        """The ids of tables of deleted ones, for tasks; None where there are none, or more than GONE."""
        if not deleted:
            return None
        ids = self.spark.read.schema(f"id {self.now['kind']}").parquet(*[f"{self.path}/{name}" for name in deleted])
        if ids.count() > GONE:
            return None
        return self.spark.sparkContext.broadcast(ids.toArrow()["id"].combine_chunks())

    # ------------------------------------------------------------ reading

    def _groups(self) -> list[tuple[list[dict], list[str]]]:
        """Segments that the same tables of deleted ids apply to: a deletion reaches the segments that were there."""
        groups: dict[tuple[str, ...], list[dict]] = {}
        for s in self.now["segments"]:
            groups.setdefault(tuple(d["name"] for d in self.now["deleted"] if s["name"] in d["segments"]), []).append(s)
        return [(segments, list(deleted)) for deleted, segments in groups.items()]

    def _left(self, read, schema: str) -> DataFrame:
        """What read gives for the segments of each group, with the column id, without the deleted ids."""
        out = None
        for segments, deleted in self._groups():
            rows = self._without(read(segments), deleted)
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], schema) if out is None else out

    def _without(self, rows: DataFrame, deleted: list[str]) -> DataFrame:
        for name in deleted:
            gone = self.spark.read.schema(f"id {self.now['kind']}").parquet(f"{self.path}/{name}").withColumnRenamed("id", "gone")
            rows = rows.join(gone, F.col("id") == F.col("gone"), "left_anti")
        return rows

    def rows(self) -> DataFrame:
        """(id, dl, kept columns) of the rows that are not deleted."""
        schema = ", ".join([f"id {self.now['kind']}", "dl int", *self.now["keep"]])
        return self._left(lambda segments: self.spark.read.schema(schema).parquet(*[f"{self.path}/{s['name']}/rows" for s in segments]), schema)

    def _entries(self, asked: list[str] | None, columns: list[str], segments: list[dict] | None = None) -> DataFrame:
        """Postings of the asked terms, or of all, from the files that can hold them."""
        schema, files = _postings_schema(self.now["kind"]), []
        for s in self.now["segments"] if segments is None else segments:
            files += [f"{self.path}/{s['name']}/postings/{f}" for f, first, last in s["files"] if first is not None and (asked is None or any(first <= t <= last for t in asked))]
        rows = self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
        rows = rows if asked is None else rows.where(F.col("term").isin(asked))
        return rows.select("term", "block", *columns)

    @staticmethod
    def _opened(rows: DataFrame) -> DataFrame:
        """(term, block, id, tf, dl) of postings, and places where they have them."""
        names, own = ["ids", "tfs", "dls"], [F.col("e.ids").alias("id")]
        if "places" not in rows.columns:
            each = rows.select("term", "block", F.explode(F.arrays_zip(*names)).alias("e"))
            return each.select("term", "block", *own, F.col("e.tfs").alias("tf"), F.col("e.dls").alias("dl"))
        # an entry takes its own places along, not all of its row's
        parts = F.zip_with("starts", "tfs", lambda start, tf: F.slice(F.col("places"), start + 1, tf))
        each = rows.select("term", "block", F.explode(F.arrays_zip(*names, parts.alias("parts"))).alias("e"))
        return each.select("term", "block", *own, F.col("e.tfs").alias("tf"), F.col("e.dls").alias("dl"), F.col("e.parts").alias("places"))

    def _left_entries(self, asked: list[str] | None, places: bool = True) -> DataFrame:
        """(term, block, id, tf, dl) of the rows that are not deleted, and their places if asked for."""
        more = ["starts", "places"] if places else []
        schema = f"term string, block bigint, id {self.now['kind']}, tf int, dl int" + (", places array<bigint>" if places else "")
        return self._left(lambda segments: self._opened(self._entries(asked, ["ids", "tfs", "dls", *more], segments)), schema)

    def among(self, collections: DataFrame | list[str] | None = None, scope: list[str] | None = None, documents: DataFrame | None = None, metadata: Column | None = None) -> DataFrame | None:
        """Ids of the rows in the collections (a list, or a table with one column) within the scope, of documents (id) that the metadata predicate holds for; None
        if nothing is asked. The index keeps collection_id, and doc_id for the predicate, without which ids are those of documents."""
        rows = self.rows()
        if not isinstance(collections, DataFrame) and not collections and not scope and metadata is None:
            return None
        if isinstance(collections, DataFrame):
            rows = rows.join(collections.toDF("collection_id"), "collection_id", "left_semi")
        elif collections:
            rows = rows.where(F.col("collection_id").isin(collections))
        rows = rows.where(F.col("collection_id").isin(scope)) if scope else rows
        if metadata is not None:
            own = "doc_id" if "doc_id" in rows.columns else "id"
            rows = rows.join(documents.where(metadata).select(F.col("id").alias("__doc")), F.col(own) == F.col("__doc"), "left_semi")
        return rows.select("id")

    @property
    def count(self) -> int:
        return sum(s["rows"] for s in self.now["segments"])

    def stats(self) -> DataFrame:
        """(rows, words, terms, entries) of what the index holds, deleted rows included."""
        held = self._entries(None, ["n"]).groupBy("term").agg(F.sum("n").alias("n")).agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"))
        return held.select(F.lit(self.count).cast("long").alias("rows"), F.lit(sum(s["words"] for s in self.now["segments"])).cast("long").alias("words"), "terms", "entries")

    def _scored(self, entries: DataFrame, idf: dict[str, float], mean: float, k: int) -> DataFrame:
        """The best k of entries (term, id, tf, dl)."""
        of = F.lit(0.0)
        for t, x in idf.items():
            of = F.when(F.col("term") == t, x).otherwise(of)
        best = entries.groupBy("id").agg(F.sum(of * weight(F.col("tf").cast("double"), F.col("dl"), mean)).alias("score")).orderBy(F.desc("score"), "id").limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))

    def top(self, asked: str | list[Clause], k: int, among: DataFrame | None = None) -> DataFrame:
        """(id, score, rank): the best k by BM25 of a text, any of whose terms counts, or of clauses. among: ids (one column, distinct) to search, which are then the corpus."""
        if isinstance(asked, str):
            words = query_terms(asked)
            if not words:
                rows = self.rows()
                rows = rows if among is None else rows.join(among.toDF("own"), F.col("id") == F.col("own"), "left_semi")
                best = rows.select("id", F.lit(0.0).alias("score")).orderBy("id").limit(k)
                return best.withColumn("rank", F.row_number().over(Window.orderBy("id")))
            if among is None and not self.now["deleted"]:
                return self._by_bounds(words, k)
            asked = [Clause(tuple(words))]
        return self._by_clauses(asked, k, among)

    def _by_bounds(self, words: list[str], k: int) -> DataFrame:
        n, mean = self.count, sum(s["words"] for s in self.now["segments"]) / max(self.count, 1)
        heads = self._entries(words, ["n", "max_tf", "min_dl"])
        blocks = (n >> BLOCK) + len(self.now["segments"]) + 8
        if blocks <= FIRST:
            df: dict[str, int] = {}
            for r in heads.select("term", "n").collect():  # FIRST rows for each word asked
                df[r["term"]] = df.get(r["term"], 0) + r["n"]
            idf = {t: _idf(n, df[t]) for t in sorted(df)}
            return self._scored(self._opened(self._entries(words, ["ids", "tfs", "dls"])), idf, mean, k)
        idf = {r["term"]: _idf(n, r["df"]) for r in heads.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        of = F.lit(0.0)
        for t, x in idf.items():
            of = F.when(F.col("term") == t, x).otherwise(of)
        bounds = heads.groupBy("block").agg(F.sum(of * weight(F.col("max_tf").cast("double"), F.col("min_dl"), mean)).alias("bound"))
        first = bounds.orderBy(F.desc("bound"), "block").limit(FIRST).collect()
        posted = self._entries(words, ["ids", "tfs", "dls"])
        chosen = [r["block"] for r in first]
        best = self._scored(self._opened(posted.where(F.col("block").isin(chosen))), idf, mean, k).collect()
        least = best[-1]["score"] if len(best) == k else 0.0
        rest = bounds.where((F.col("bound") >= least * (1 - 1e-9)) & ~F.col("block").isin(chosen)).select("block")
        known = self.spark.createDataFrame([tuple(r) for r in best], f"id {self.now['kind']}, score double, rank int")
        more = self._scored(self._opened(posted.join(rest, "block", "left_semi")), idf, mean, k)
        both = known.unionByName(more).orderBy(F.desc("score"), "id").limit(k).drop("rank")
        return both.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))

    def top_of_each(self, queries: DataFrame, k: int, query_id: str = "query_id", query_text: str = "query") -> DataFrame:
        """(query_id, id, score, rank): what `top` gives for each row of a table of queries, in one pass over the postings of all their terms for each QUERIES of them.

        A block of queries is sent to the tasks as the numbers of their terms. Postings are dealt by block of rows, so all terms of a row meet; a
        task passes on k rows of each query. Where there are several blocks of queries, all postings are dealt, once for all of them. Queries without terms have no rows here; a query id
        that repeats counts as one query for each row.
        """
        spark = self.spark
        q = queries.select(F.col(query_id).alias("q"), F.col(query_text).alias("t"))
        id_type, q_type = self.now["kind"], q.schema["q"].dataType.simpleString()
        corpus = self.rows().agg(F.count(F.lit(1)), F.avg("dl")).first() if self.now["deleted"] else (self.count, sum(s["words"] for s in self.now["segments"]) / max(self.count, 1))
        n, mean = corpus[0], corpus[1] or 0.0

        def posted(of_terms) -> DataFrame:
            if not self.now["deleted"]:
                return of_terms(self._entries(None, ["n", "ids", "tfs", "dls"]))
            schema = f"term string, block bigint, id {id_type}, tf int, dl int"
            left = self._left(lambda segments: self._opened(of_terms(self._entries(None, ["ids", "tfs", "dls"], segments))), schema)
            lists = left.groupBy("term", "block").agg(F.collect_list(F.struct("id", "tf", "dl")).alias("e"))  # rows of a block
            return lists.select("term", "block", F.size("e").alias("n"), *[F.col(f"e.{x}").alias(f"{x}s") for x in ("id", "tf", "dl")])

        def dealt_(rows: DataFrame) -> DataFrame:
            return rows.select("block", "term", "ids", "tfs", "dls").repartition(2 * spark.sparkContext.defaultParallelism, "block")

        def part(own: list, words: list[list[str]], alone: bool) -> DataFrame:
            names = sorted({t for x in words for t in x})
            terms_ = F.broadcast(spark.createDataFrame(pa.table({"own": pa.array(names, pa.string())})))  # a block's terms
            of_terms = lambda rows: rows.join(terms_, F.col("term") == F.col("own"), "left_semi")
            df = {r["term"]: r["n"] for r in posted(of_terms).groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each of them
            known = [t for t in names if t in df]
            of = {t: i for i, t in enumerate(known)}
            asked = [np.array([of[t] for t in sorted(x) if t in of], np.int32) for x in words]
            sent = spark.sparkContext.broadcast((known, np.array([_idf(n, df[t]) for t in known]), np.cumsum([0, *map(len, asked)]), np.concatenate(asked)))

            def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                known, idf, ends, numbers = sent.value
                of = {t: i for i, t in enumerate(known)}
                groups = [_Best([numbers[ends[j] : ends[j + 1]] for j in range(i, min(i + ASKERS, len(ends) - 1))], k) for i in range(0, len(ends) - 1, ASKERS)]
                for table in _blocks(batches):
                    block = _Block(table, of, idf, mean, ASKERS)
                    for one in groups:
                        one.add(block)
                for c, one in enumerate(groups):
                    found = one.best()
                    if found is not None:
                        yield from pa.table({"n": pa.array((found["n"].to_numpy() + c * ASKERS).astype(np.int32)), "id": found["id"], "score": found["score"]}).to_batches()

            # the same postings for every block of queries, so that their exchange is one
            top = dealt_(posted(of_terms if alone else lambda rows: rows)).sortWithinPartitions("block").mapInArrow(best, f"n int, id {id_type}, score double")
            rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "id"))
            ids = spark.createDataFrame(list(enumerate(own)), f"n int, q {q_type}")
            return top.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(ids), "n").select(F.col("q").alias(query_id), "id", "score", "rank")  # a block's ids

        out, own, words = None, [], []
        for r in q.toLocalIterator():  # a block at a time
            found = query_terms(r["t"] or "")
            if found and len(own) >= QUERIES:
                one, own, words = part(own, words, False), [], []
                out = one if out is None else out.unionByName(one)
            if found:
                own.append(r["q"])
                words.append(found)
        if own:
            one = part(own, words, out is None)
            out = one if out is None else out.unionByName(one)
        return spark.createDataFrame([], f"{query_id} {q_type}, id {id_type}, score double, rank int") if out is None else out

    def _by_clauses(self, asked: list[Clause], k: int, among: DataFrame | None) -> DataFrame:
        words = sorted({w for c in asked for w in c.words})
        placed = any(c.slop is not None or c.field is not None for c in asked)
        corpus, entries = self.rows(), self._left_entries(words, placed)
        if among is not None:
            own = among.toDF("own")
            corpus, entries = (x.join(own, F.col("id") == F.col("own"), "left_semi") for x in (corpus, entries))
        within = lambda p, f: p if f is None else F.filter(p, lambda x: F.shiftright(x, FIELD) == self.now["fields"].index(f))
        unknown = [c.field for c in asked if c.field is not None and c.field not in self.now["fields"]]
        if unknown:
            raise ValueError(f"the index has no field {unknown[0]}")
        need = sorted({(w, c.field) for c in asked for w in c.words}, key=str)
        counts = entries.agg(*[F.count_if((F.col("term") == w) & (F.lit(True) if f is None else F.size(within(F.col("places"), f)) > 0)).alias(f"d{i}") for i, (w, f) in enumerate(need)])
        if among is None and not self.now["deleted"]:
            n, mean, found = self.count, sum(s["words"] for s in self.now["segments"]) / max(self.count, 1), counts.first()
        else:
            both = corpus.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean")).crossJoin(counts).first()  # one row each
            n, mean, found = both["n"], both["mean"] or 0.0, both
        idf = {x: _idf(n, found[f"d{i}"]) for i, x in enumerate(need)}
        # at most a row for each word asked is collected for an id
        rows = entries.groupBy("id").agg(F.first("dl").alias("dl"), F.map_from_entries(F.collect_list(F.struct("term", "places" if placed else "tf"))).alias("m"))
        none = F.array().cast("array<bigint>")
        at = lambda w, f: within(F.coalesce(F.try_element_at("m", F.lit(w)), none), f)
        times = lambda w, f: F.size(at(w, f)) if placed else F.coalesce(F.try_element_at("m", F.lit(w)), F.lit(0))

        def phrase(c: Clause) -> Column:
            def next_(w: str, last: Column) -> Column:
                return F.array_min(F.filter(at(w, c.field), lambda y: y > last))

            def from_(x: Column) -> Column:
                last = x
                for w in c.words[1:]:
                    last = next_(w, last)
                return F.coalesce(last - x <= len(c.words) - 1 + c.slop, F.lit(False))

            return F.size(F.filter(at(c.words[0], c.field), from_))

        score, some, keep = F.lit(0.0), F.lit(False), F.lit(True)
        for c in asked:
            if not c.words:
                continue
            parts = [(phrase(c), sum(idf[w, c.field] for w in c.words))] if c.slop is not None else [(times(w, c.field), idf[w, c.field]) for w in c.words]
            for tf, x in parts:
                if c.need == "none":
                    keep = keep & (tf == 0)
                    continue
                score = score + F.when(tf > 0, c.boost * x * weight(tf.cast("double"), F.col("dl"), mean)).otherwise(0.0)
                some = some | (tf > 0)
                keep = keep & (tf > 0) if c.need == "all" else keep
        best = rows.where(keep & some).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
