"""Small registries held on the driver: models, bindings, key terms."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from ..config import DIM_MAX, EMBED_CHARS, EMBED_TEXTS, EMBED_TOKENS, QUERY_PREFIX

EMBED_PROVIDERS, RERANK_PROVIDERS = ("tei", "ollama", "openai"), ("tei", "openai")
KEY_TERMS = {"1d": 1, "7d": 7, "30d": 30, "90d": 90}


@dataclass(frozen=True)
class EmbeddingModel:
    name: str
    provider: str
    model_id: str
    ingest_url: str
    query_url: str
    vector_dim: int
    query_prefix: str = QUERY_PREFIX
    batch_size: int = EMBED_TEXTS
    ctx_budget: int = EMBED_TOKENS
    truncate_chars: int = EMBED_CHARS

    def faults(self) -> list[str]:
        rules = [
            (bool(self.name), "no name"), (self.provider in EMBED_PROVIDERS, "unknown provider"), (1 <= self.vector_dim <= DIM_MAX, f"dimension outside 1..{DIM_MAX}"),
            (self.batch_size >= 1, "batch_size under 1"), (self.ctx_budget >= 1, "ctx_budget under 1"), (self.truncate_chars >= 0, "truncate_chars under 0"),
        ]
        return [m for ok, m in rules if not ok]

    def confirmed(self, probed: int) -> EmbeddingModel:
        """The model with the dimension that a probe returned; another one that was set is an error."""
        if self.vector_dim not in (0, probed):
            raise ValueError(f"the endpoint returns {probed} numbers, not {self.vector_dim}")
        return replace(self, vector_dim=probed)


def reranker(asked: bool | str | None, models: Mapping[str, object], bindings: Mapping[str, str | None], targets: list[str] | None):
    """The model that reranks: none if asked is False; the one named; else that of the only target. True without any is an error."""
    if asked is False:
        return None
    if isinstance(asked, str):
        if asked not in models:
            raise ValueError(f"unknown rerank model {asked!r}")
        return models[asked]
    bound = bindings.get(targets[0]) if targets and len(targets) == 1 else None
    if bound is not None:
        return models[bound]
    if asked:
        raise ValueError("no rerank model is bound")
    return None


def key_expiry(term: str | None, now: datetime) -> datetime | None:
    if term in (None, "", "never"):
        return None
    if term not in KEY_TERMS:
        raise ValueError(f"unknown term {term!r}")
    return now + timedelta(days=KEY_TERMS[term])


def allowed(collections: list[str] | None, asked: list[str] | None) -> list[str] | None:
    """Targets within a key's allowlist; an empty allowlist allows all; asking for one outside is an error."""
    if not collections:
        return asked
    if asked and (out := [x for x in asked if x not in collections]):
        raise PermissionError(f"not allowed: {', '.join(out)}")
    return asked or list(collections)
