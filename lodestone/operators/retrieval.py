"""Filtered top-k retrieval: exact cosine, BM25, and their fusion by weighted reciprocal ranks.

All filters are applied to the rows before either leg takes its top k. Each leg's limit is the final limit. Ranks are taken after the
limit, so no window sees more than k rows. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import BM25_B, BM25_K1, BM25_WEIGHT, DENSE_WEIGHT, DIM_MAX, RRF_K
from ..functions.vectors import distances

if TYPE_CHECKING:
    from .index import Index

TERM = r"[\p{L}\p{N}]+"


def checked_vector(vector: Iterable[float], dim: int | None = None) -> list[float]:
    vector = [float(x) for x in vector]
    if not 1 <= len(vector) <= DIM_MAX or (dim is not None and len(vector) != dim):
        raise ValueError(f"vector of {len(vector)} numbers; expected {dim or f'1 to {DIM_MAX}'}")
    return vector


def candidates(chunks: DataFrame, collections: list[str] | None = None, scope: list[str] | None = None, documents: DataFrame | None = None, metadata: Column | None = None) -> DataFrame:
    """Searchable chunks: children, of the asked collections within the scope, of documents that the metadata predicate holds for."""
    rows = chunks.where(~F.col("is_parent")) if "is_parent" in chunks.columns else chunks
    if collections:
        rows = rows.where(F.col("collection_id").isin(collections))
    if scope:
        rows = rows.where(F.col("collection_id").isin(scope))
    if metadata is not None and documents is not None:
        rows = rows.join(documents.where(metadata).select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return rows


def dense_top(rows: DataFrame, vector: Iterable[float], k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, distance, rank): the k nearest by cosine distance among vectors of the query's dimension; zero vectors come last.

    Distances are computed in Arrow batches, each of which passes on its own k nearest only.
    """
    q = np.array(checked_vector(vector))
    q = q / (np.linalg.norm(q) or 1.0)
    kind = rows.schema[id_col].dataType.simpleString()
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.size("v") == len(q))

    def nearest(batches):
        for b in batches:
            if not b.num_rows:
                continue
            m = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, len(q))
            d = distances(m, q)
            ids = b.column("id")
            best = pa.compute.sort_indices(pa.table({"d": d, "id": ids}), [("d", "ascending"), ("id", "ascending")])[:k]
            yield pa.RecordBatch.from_arrays([ids.take(best), pa.array(d).take(best)], ["id", "distance"])

    top = rows.mapInArrow(nearest, f"id {kind}, distance double").orderBy("distance", "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))


def dense_top_groups(rows: DataFrame, vector: Iterable[float], k: int, group_col: str, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(group, id, distance, rank): dense_top of every group in one pass; a batch passes on k rows of each group, a task's share of a group is cut to k before the exchange."""
    q = np.array(checked_vector(vector))
    q = q / (np.linalg.norm(q) or 1.0)
    schema = f"group {rows.schema[group_col].dataType.simpleString()}, id {rows.schema[id_col].dataType.simpleString()}, distance double"
    rows = rows.select(F.col(group_col).alias("group"), F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.size("v") == len(q))

    def nearest(batches):
        for b in batches:
            if not b.num_rows:
                continue
            m = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, len(q))
            d = distances(m, q)
            t = pa.table({"group": b.column("group"), "id": b.column("id"), "distance": d}).sort_by([("group", "ascending"), ("distance", "ascending"), ("id", "ascending")])
            codes = t["group"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            first = np.concatenate(([True], codes[1:] != codes[:-1]))
            place = np.arange(len(codes)) - np.maximum.accumulate(np.where(first, np.arange(len(codes)), 0))
            yield from t.filter(pa.array(place < k)).combine_chunks().to_batches()

    rank = F.row_number().over(Window.partitionBy("group").orderBy("distance", "id"))
    return rows.mapInArrow(nearest, schema).withColumn("rank", rank).where(F.col("rank") <= k)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def query_terms(query: str) -> list[str]:
    import regex

    return sorted(set(regex.findall(TERM, query.lower())))


def postings(rows: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(term, id, tf, dl): a row for each term of each text."""
    split = rows.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("t"))
    return split.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df, cf, max_tf): in how many rows a term is, how often in all, and how often in one at most. A row's terms are counted where it is read, so a task passes on a row for each term of a batch."""

    def counted(batches):
        for b in batches:
            lists = b.column("t").fill_null([])
            coded = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            n = len(coded.dictionary)
            pair, tf = np.unique(row * n + coded.indices.to_numpy(), return_counts=True)
            code = pair % max(n, 1)
            most = np.zeros(n, np.int64)
            np.maximum.at(most, code, tf)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(code, minlength=n)), pa.array(np.bincount(code, tf, n).astype(np.int64)), pa.array(most)], ["term", "df", "cf", "max_tf"])

    counts = rows.select(terms(F.col(text_col)).alias("t")).mapInArrow(counted, "term string, df long, cf long, max_tf long")
    return counts.groupBy("term").agg(*[f(x).alias(x) for f, x in ((F.sum, "df"), (F.sum, "cf"), (F.max, "max_tf"))])


def _occurrences(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == F.lit(term)))


def bm25_top(rows: DataFrame, query: str, k: int, id_col: str = "id", text_col: str = "text", extra_col: str | None = None, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """(id, score, rank): the k best by BM25 over rows, any term counting; a query without terms matches all with score 0.

    One pass counts rows, lengths and each term's documents; a second scores the rows that hold a term. Terms of extra_col add to those of text_col.
    """
    asked = query_terms(query)
    text = F.col(text_col) if extra_col is None else F.concat_ws(" ", extra_col, text_col)
    if not asked:
        top = rows.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).orderBy("id").limit(k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy("id")))
    split = rows.select(F.col(id_col).alias("id"), terms(text).alias("t"))
    counts = split.select("id", F.size("t").alias("dl"), *[_occurrences("t", q).alias(f"tf{i}") for i, q in enumerate(asked)])
    some = F.coalesce(*[F.when(F.col(f"tf{i}") > 0, True) for i in range(len(asked))], F.lit(False))
    stats = counts.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("dl", F.lit(0))).alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked))])
    joined = counts.where(some).crossJoin(F.broadcast(stats))  # stats is one row
    score = F.lit(0.0)
    for i in range(len(asked)):
        tf, df = F.col(f"tf{i}").cast("double"), F.col(f"df{i}").cast("double")
        idf = F.log(1.0 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * F.col("dl") / F.col("mean")))
    top = joined.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def rrf(rank: Column, weight: float) -> Column:
    return F.coalesce(F.lit(weight) / (F.lit(float(RRF_K)) + rank), F.lit(0.0))


def fused(dense: DataFrame, words: DataFrame) -> DataFrame:
    """(id, score, dense_rank, bm25_rank): both legs by weighted reciprocal rank. At most the rows of both; the final limit
    comes after the join with documents, which drops hits without one."""
    d, w = dense.select("id", F.col("rank").alias("dense_rank")), words.select("id", F.col("rank").alias("bm25_rank"))
    both = d.join(w, "id", "full").withColumn("score", rrf(F.col("dense_rank"), DENSE_WEIGHT) + rrf(F.col("bm25_rank"), BM25_WEIGHT))
    return both.select("id", "score", "dense_rank", "bm25_rank")


def fused_legs(legs: list[tuple[DataFrame, float]]) -> DataFrame:
    """(id, score): any number of legs (id, rank) with weights; an id's scores add up."""
    rows = None
    for leg, weight in legs:
        one = leg.select("id", rrf(F.col("rank"), weight).alias("s"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("id").agg(F.sum("s").alias("score"))


def with_rows(hits: DataFrame, rows: DataFrame, id_col: str = "id") -> DataFrame:
    """rows of the hits, at most k of each leg, with the columns of hits (id, …): ids are fetched, and the scan filters by them."""
    found = hits.collect()
    known = rows.sparkSession.createDataFrame([tuple(r) for r in found], hits.schema)
    return _with_ids(rows, id_col, [r["id"] for r in found]).join(F.broadcast(known.withColumnRenamed("id", "__hit")), F.col(id_col) == F.col("__hit")).drop("__hit")


def _with_ids(rows: DataFrame, column: str, ids: list) -> DataFrame:
    """The rows whose column is one of few ids: a filter that the scan gets."""
    return rows.where(F.col(column).isin(sorted({x for x in ids if x is not None})))


def enriched(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with their chunk, its parent's text ('' without) and its document; hits without a document go.

    The hits, at most k rows of each leg, are fetched once; their chunks, parents and documents are then read by id, and no text is dealt."""
    spark, found = chunks.sparkSession, hits.select("id", "score").collect()
    own = _with_ids(chunks, "id", [r["id"] for r in found]).select("id", "doc_id", "parent_id", "page_start", "page_end", F.coalesce("heading_path", F.array().cast("array<string>")).alias("heading_path"), "text")
    links = own.select("doc_id", "parent_id").distinct().collect() if found else []
    parents = _with_ids(chunks.where("is_parent"), "id", [r["parent_id"] for r in links]).select(F.col("id").alias("parent_id"), F.col("text").alias("parent"))
    docs = _with_ids(documents, "id", [r["doc_id"] for r in links]).select(F.col("id").alias("doc_id"), "title", "completeness")
    scores = spark.createDataFrame([tuple(r) for r in found], hits.select("id", "score").schema)
    rows = own.join(F.broadcast(scores), "id").join(F.broadcast(docs), "doc_id").join(F.broadcast(parents), "parent_id", "left")
    return rows.select(
        F.col("id").alias("chunk_id"), "doc_id", "title", "page_start", "page_end", "heading_path", F.coalesce("parent", F.lit("")).alias("parent_text"), "text", "score",
        F.coalesce(F.col("completeness") < 1, F.lit(False)).alias("partial"), "completeness", F.lit(False).alias("reranked"),
    )


def _words_leg(rows: DataFrame, query: str, k: int, index: Index | None, among: DataFrame | None) -> DataFrame:
    """The BM25 leg, over the index where there is one, else over the texts of rows."""
    if index is not None:
        return index.top(query, k, among)
    return bm25_top(rows, query, k, extra_col="header_breadcrumb" if "header_breadcrumb" in rows.columns else None)


def hybrid_search(chunks: DataFrame, documents: DataFrame, vector, query: str, k: int, collections: list[str] | None = None, scope: list[str] | None = None, metadata: Column | None = None, index: Index | None = None) -> DataFrame:
    rows = candidates(chunks, collections, scope, documents, metadata)
    among = index.among(collections, scope, documents, metadata) if index is not None else None
    hits = fused(dense_top(rows, vector, k), _words_leg(rows, query, k, index, among))
    return enriched(hits, chunks, documents).orderBy(F.desc("score"), "chunk_id").limit(k)


def multi_search(chunks: DataFrame, documents: DataFrame, collections: DataFrame, query: str, k: int, embed: Callable[[str, str], list[float]], targets: list[str] | None = None, scope: list[str] | None = None, metadata: Column | None = None, index: Index | None = None) -> DataFrame:
    """One BM25 leg over all targets within the scope and one dense leg for each embedding model bound to them, embedded once a model."""
    allowed = collections.select(F.col("id").alias("collection_id"), "embedding_model_id")
    for some in (targets, scope):
        allowed = allowed.where(F.col("collection_id").isin(some)) if some else allowed
    models = [r[0] for r in allowed.select("embedding_model_id").distinct().collect()]  # a row for each model
    if not models:
        return enriched(chunks.limit(0).select("id", F.lit(0.0).alias("score")), chunks, documents)
    base = candidates(chunks, None, scope, documents, metadata)
    within = lambda own: base.join(own.select("collection_id"), "collection_id", "left_semi")
    among = index.among(allowed.select("collection_id"), scope, documents, metadata) if index is not None else None
    legs = [(_words_leg(within(allowed), query, k, index, among), BM25_WEIGHT)]
    for model in sorted(x for x in models if x):
        legs.append((dense_top(within(allowed.where(F.col("embedding_model_id") == model)), embed(model, query), k), DENSE_WEIGHT))
    return enriched(fused_legs(legs), chunks, documents).orderBy(F.desc("score"), "chunk_id").limit(k)


def reranked(hits: DataFrame, query: str, scorer: Callable[[str, list[str]], list[float]] | None, k: int, id_col: str = "chunk_id") -> DataFrame:
    """The first k of at most a pool of hits by the scorer's numbers, ties in the fused order; if it fails, the fused order stays."""
    if scorer is None:
        return hits.orderBy(F.desc("score"), id_col).limit(k)
    schema = hits.schema

    def run(batches):
        import pandas as pd

        rows = pd.concat(list(batches), ignore_index=True) if batches else None
        if rows is None or rows.empty:
            return
        rows = rows.sort_values(["score", id_col], ascending=[False, True], kind="stable")
        try:
            got = list(scorer(query, rows["text"].tolist()))
        except Exception:  # noqa: BLE001  a scorer that fails leaves the fused order
            yield rows.head(k)
            return
        rows["score"] = [float(x) if x is not None else 0.0 for x in got + [0.0] * (len(rows) - len(got))][: len(rows)]
        rows["reranked"] = True
        yield rows.sort_values("score", ascending=False, kind="stable").head(k)

    return hits.repartition(1).mapInPandas(lambda it: run(list(it)), schema)  # a pool of hits, some 30 rows, behind an exchange: scans keep their tasks


def neighbours(chunks: DataFrame, anchors: DataFrame, width: int = 2) -> DataFrame:
    """Chunks of the anchors' (doc_id, seq) documents and kind with seq within width of it."""
    a = anchors.join(chunks.select("doc_id", "seq", "is_parent"), ["doc_id", "seq"]).select("doc_id", F.col("seq").alias("anchor"), F.col("is_parent").alias("kind"))
    near = F.explode(F.sequence(F.col("anchor") - width, F.col("anchor") + width)).alias("seq")
    return chunks.join(a.select("doc_id", "anchor", "kind", near), ["doc_id", "seq"]).where("is_parent = kind").drop("kind")


def read_pages(chunks: DataFrame, start: Column, end: Column) -> DataFrame:
    """Chunks that overlap pages start..end, parents only where a parent does, in order."""
    rows = chunks.where((F.col("page_start") <= end) & (F.col("page_end") >= start))
    kind = F.max("is_parent").over(Window.partitionBy("doc_id"))
    return rows.withColumn("kind", kind).where("is_parent = kind").drop("kind")


def page_text(chunks: DataFrame, first: int, last: int, pages: int | None = None) -> DataFrame:
    """(doc_id, text): at most 30 pages from first on, chunk texts with a blank line between."""
    first = max(first, 1)
    last = min(max(last, first), first + 29, pages or 10**9)
    rows = read_pages(chunks, F.lit(first), F.lit(last))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
