"""Schemas of the tables and the closed sets of states."""

from __future__ import annotations

DOCUMENTS = "id string, collection_id string, title string, author string, filename string, byte_size bigint, source_uri string, content_sha256 string, page_count int, mime_type string, state string, error_code string, error_detail string, total_shards int, shards_done int, shards_failed int, chunk_count int, completeness decimal(5,4), metadata string, uploaded_by string, created_at timestamp, updated_at timestamp, ready_at timestamp"
SHARDS = "doc_id string, idx int, page_start int, page_end int, state string, attempts int, needs_ocr boolean, mean_chars_per_page float, parsed_uri string, worker_id string, lease_until timestamp, duration_ms int, peak_rss_mb int, done_at timestamp, error_code string, error_detail string, created_at timestamp"
CHUNKS = "id string, doc_id string, collection_id string, chunk_hash string, parent_id string, is_parent boolean, seq int, page_start int, page_end int, heading_path array<string>, header_breadcrumb string, text string, token_count int, embedding array<float>, embedded_at timestamp, created_at timestamp"
EVENTS = "id bigint, doc_id string, shard_idx int, level string, stage string, code string, message string, context string, worker_id string, created_at timestamp"
COLLECTIONS = "id string, name string, embedding_model string, vector_dim int, created_at timestamp, rerank_model_id string, embedding_model_id string"
API_KEYS = "id string, name string, key_hash string, scopes array<string>, collections array<string>, expires_at timestamp, revoked_at timestamp, last_used_at timestamp, created_at timestamp"
KEY_USAGE = "id bigint, api_key_id string, surface string, action string, created_at timestamp"
ROLLUP = "bucket timestamp, pages_parsed bigint, shards_done bigint, shards_failed bigint, chunks_embedded bigint, parse_p50_ms int, parse_p95_ms int, peak_rss_p95_mb int, queue_depth map<string,bigint>, search_p95_ms int, search_count int"
JOBS = "stream string, entry_id string, job string, delivered_count int"

DOCUMENT_STATES = ("uploaded", "splitting", "parsing", "embedding", "indexing", "ready", "failed", "partial", "archived")
SHARD_STATES = ("pending", "running", "done", "failed", "skipped")
TERMINAL_STATES = ("failed", "ready", "partial", "archived")
KEY_SCOPES = ("search", "ingest", "admin")
KEYS = {"documents": ("id",), "shards": ("doc_id", "idx"), "chunks": ("doc_id", "chunk_hash"), "events": ("id",), "api_keys": ("key_hash",), "metrics_rollup": ("bucket",)}
