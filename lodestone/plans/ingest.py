"""Whole plans: sources to chunks with vectors, and one search entry for them."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, functions as F

from ..config import RERANK_POOL, top_k
from ..functions.metadata import metadata_filter
from ..operators.chunks import chunked
from ..operators.embedding import embedded
from ..operators.index import Index
from ..operators.registry import reranker
from ..operators.retrieval import hybrid_search, multi_search, reranked
from ..operators.stitch import stitch
from ..sources.html import markdown


def from_shards(shards: DataFrame, **options) -> DataFrame:
    """Chunks of documents given as page-range shards. One exchange, by document."""
    return chunked(stitch(shards), text_col="markdown", pages_col="pages", **options)


def from_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", **options) -> DataFrame:
    return chunked(pages.select(F.col(id_col).alias("doc_id"), markdown(F.col(html_col)).alias("text")), **options)


def with_vectors(chunks: DataFrame, make: Callable) -> DataFrame:
    return chunks.join(embedded(chunks, make), "id", "left")


class DimensionMismatch(ValueError):
    """A query vector of another dimension than its model has."""


def search(
    chunks: DataFrame, documents: DataFrame, query: str, embed: Callable[[str, str], list[float]], collections: DataFrame, targets: list[str] | None = None, scope: list[str] | None = None, metadata: dict | None = None,
    k: int | None = None, scorer: Callable | None = None, index: Index | None = None, models: DataFrame | None = None, scorers: Mapping[str, Callable] | None = None, rerank: bool | str | None = None,
) -> DataFrame:
    """Hits with citations. One target takes the single path with a pool for the scorer, any other number the path over all models.

    models (id, query_prefix, vector_dim): a query is embedded behind its model's prefix, and a vector of another dimension is an error. scorers: rerank models by id; rerank: one of their ids, False for
    none, True for the one bound to the only target (rerank_model_id of collections), which is an error where none is; by default that one if there is one.
    A scorer given takes their place.
    """
    k, where = top_k(k), metadata_filter(metadata)
    if targets and scope:
        targets = [t for t in targets if t in scope]
        if not targets:
            return multi_search(chunks, documents, collections.limit(0), query, k, embed)
    if scorer is None and (scorers or rerank):
        bound = {}
        if targets and len(targets) == 1 and "rerank_model_id" in collections.columns:
            row = collections.where(F.col("id") == targets[0]).select("rerank_model_id").first()
            bound = {targets[0]: row[0] if row else None}
        scorer = reranker(rerank, scorers or {}, bound, targets)

    def vector_of(model: str, text: str) -> list[float]:
        known = models.where(F.col("id") == model).select("query_prefix", "vector_dim").first() if models is not None else None
        got = embed(model, (known["query_prefix"] or "") + text if known else text)
        if known and known["vector_dim"] and len(got) != known["vector_dim"]:
            raise DimensionMismatch(f"model {model}: a vector of {len(got)} numbers, expected {known['vector_dim']}")
        return got

    if targets and len(targets) == 1:
        model = collections.where(F.col("id") == targets[0]).select("embedding_model_id").first()
        pool = max(k, RERANK_POOL) if scorer else k
        hits = hybrid_search(chunks, documents, vector_of(model[0] if model else "", query), query, pool, targets, scope, where, index)
    else:
        hits = multi_search(chunks, documents, collections, query, k, vector_of, targets, scope, where, index)
    return reranked(hits, query, scorer, k)
