"""The verbs of the service as methods that return DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..config import page_of_list
from ..functions.text import preview
from ..operators import metrics, retrieval
from ..operators.index import Index
from .ingest import search


@dataclass
class Engine:
    documents: DataFrame
    chunks: DataFrame
    collections: DataFrame
    shards: DataFrame | None = None
    embed: Callable[[str, str], list[float]] | None = None
    scope: list[str] | None = None
    embedding_models: DataFrame | None = None
    rerank_models: DataFrame | None = None
    keys: DataFrame | None = None
    #: Of the child chunks, with collection_id and doc_id kept; without one, searches read texts.
    index: Index | None = None
    #: Scorers of rerank models by their ids.
    scorers: Mapping[str, Callable] | None = None

    def _scoped(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("collection_id").isin(self.scope)) if self.scope else rows

    def search(self, query: str, targets: list[str] | None = None, metadata: dict | None = None, top_k: int | None = None, scorer: Callable | None = None, rerank: bool | str | None = None) -> DataFrame:
        return search(self.chunks, self.documents, query, self.embed, self.collections, targets, self.scope, metadata, top_k, scorer, self.index, self.embedding_models, self.scorers, rerank)

    def get_document(self, doc_id: str) -> DataFrame:
        return self._scoped(self.documents).where(F.col("id") == doc_id).limit(1)

    def list_documents(self, state: str | None = None, collection: str | None = None, title: str | None = None, page: int | None = None, size: int | None = None) -> DataFrame:
        """Latest update first; each filter only where given."""
        rows = self._scoped(self.documents)
        for column, value in (("state", state), ("collection_id", collection)):
            rows = rows.where(F.col(column) == value) if value else rows
        rows = rows.where(F.ilike("title", F.lit(f"%{title}%"))) if title else rows
        limit, offset = page_of_list(page, size)
        return rows.orderBy(F.desc("updated_at"), "id").offset(offset).limit(limit)

    def list_collections(self) -> DataFrame:
        rows = self.collections.where(F.col("id").isin(self.scope)) if self.scope else self.collections
        n = self.documents.groupBy(F.col("collection_id").alias("id")).agg(F.count(F.lit(1)).alias("documents"))
        return rows.join(n, "id", "left").na.fill(0, ["documents"]).orderBy("created_at", "id")

    def get_shard(self, doc_id: str, idx: int) -> DataFrame:
        return self.shards.where((F.col("doc_id") == doc_id) & (F.col("idx") == idx)).limit(1)

    def get_model(self, model_id: str, rerank: bool = False) -> DataFrame:
        return (self.rerank_models if rerank else self.embedding_models).where(F.col("id") == model_id).limit(1)

    def get_key(self, key_hash: str) -> DataFrame:
        """The key of a hash, if it is not revoked, without the hash."""
        rows = self.keys.where(F.col("key_hash") == key_hash)
        return (rows.where(F.col("revoked_at").isNull()) if "revoked_at" in rows.columns else rows).drop("key_hash").limit(1)

    def list_models(self, rerank: bool = False) -> DataFrame:
        return (self.rerank_models if rerank else self.embedding_models).orderBy("created_at", "id")

    def list_keys(self) -> DataFrame:
        """The keys without their hashes, last used first."""
        return self.keys.drop("key_hash").orderBy(F.desc_nulls_last("last_used_at"), "id")

    def list_chunks(self, doc_id: str, page: int | None = None, size: int | None = None) -> DataFrame:
        limit, offset = page_of_list(page, size)
        rows = self._scoped(self.chunks).where(F.col("doc_id") == doc_id).orderBy("seq", "id").offset(offset).limit(limit)
        return rows.withColumn("text", preview(F.col("text"))).drop("embedding")

    def preview_chunk(self, chunk_id: str) -> DataFrame:
        return self._scoped(self.chunks).where(F.col("id") == chunk_id).limit(1).drop("embedding")

    def chunk_context(self, chunk_id: str, width: int = 2) -> DataFrame:
        """A chunk with its neighbours of the same kind, in order."""
        anchor = self._scoped(self.chunks).where(F.col("id") == chunk_id).select("doc_id", "seq")
        return retrieval.neighbours(self.chunks.drop("embedding"), anchor, width).orderBy("seq")

    def read_pages(self, doc_id: str, first: int, last: int) -> DataFrame:
        doc = self.get_document(doc_id).select("page_count").first()
        return retrieval.page_text(self._scoped(self.chunks).where(F.col("doc_id") == doc_id), first, last, doc[0] if doc else None)

    def stats(self) -> DataFrame:
        return metrics.collection_stats(self.collections, self.documents, self.chunks.where(~F.col("is_parent")))

    def pipeline(self) -> DataFrame:
        return metrics.snapshot(self.documents, self.shards)
