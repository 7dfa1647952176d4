"""Defaults that carry meaning."""

from __future__ import annotations

from dataclasses import dataclass

SHARD_PAGES = 20
CHUNK_SIZE, CHUNK_OVERLAP = 512, 80
PARENT_SIZE, CHILD_SIZE = 2048, 384
LEASE_SECONDS = 600
OCR_CHARS, YIELD_CHARS = 20, 50
BACKLOG_CAP, PAGE_CAP = 2000, 800
STUCK_MINUTES, MAX_ATTEMPTS = 60, 4
TOP_K, TOP_K_MAX, READ_PAGES, RERANK_POOL = 8, 25, 30, 30
EMBED_TEXTS, EMBED_TOKENS, EMBED_CHARS = 48, 1900, 6000
QUERY_PREFIX = "search_query: "
RRF_K, DENSE_WEIGHT, BM25_WEIGHT = 60, 1.0, 0.3
BM25_K1, BM25_B = 1.2, 0.75
DIM_MAX = 2000


def top_k(asked: int | None) -> int:
    """None and 0 mean the default, more than TOP_K_MAX is cut to it, less than 0 is an error."""
    if not asked:
        return TOP_K
    if asked < 0:
        raise ValueError("top_k must be at least 1")
    return min(asked, TOP_K_MAX)


def page_of_list(page: int | None, size: int | None) -> tuple[int, int]:
    """(limit, offset) of page >= 1 with 1..200 rows, 50 otherwise."""
    size = size if size and 1 <= size <= 200 else 50
    return size, (max(page or 1, 1) - 1) * size


@dataclass(frozen=True)
class SplitConfig:
    """Sizes in code points; size and overlap of 0 or less fall to the defaults, overlap is at most half the size."""

    size: int = CHUNK_SIZE
    overlap: int = CHUNK_OVERLAP
    strategy: str = "auto"
    token_limit: int = 0
    language: str = "mixed"

    def normalised(self) -> SplitConfig:
        size = self.size if self.size > 0 else CHUNK_SIZE
        if self.token_limit > 0:
            from .functions.text import chars_for_tokens

            size = min(size, max(1, chars_for_tokens(self.token_limit, self.language)))
        overlap = self.overlap if self.overlap > 0 else CHUNK_OVERLAP
        return SplitConfig(size, min(overlap, size // 2), self.strategy, self.token_limit, self.language)


def parent_and_child(parent: int = PARENT_SIZE, child: int = CHILD_SIZE, strategy: str = "auto") -> tuple[SplitConfig, SplitConfig]:
    return SplitConfig(parent, CHUNK_OVERLAP, strategy).normalised(), SplitConfig(child, child // 5, strategy).normalised()
