"""Embedding texts in batches bounded by tokens and texts, through any callable."""

from __future__ import annotations

import hashlib
import json
import random
import threading
import time
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..config import DIM_MAX, EMBED_CHARS, EMBED_TEXTS, EMBED_TOKENS
from ..functions.text import embedding_text
from .registry import EmbeddingModel


def batches(texts: list[str], tokens: int = EMBED_TOKENS, most: int = EMBED_TEXTS) -> Iterator[list[tuple[int, str]]]:
    """(position, text) lists of at most `most` texts and `tokens` white-space tokens; a longer text is cut to the budget, alone."""
    out: list[tuple[int, str]] = []
    held = 0
    for i, text in enumerate(texts):
        words = text.split()
        if len(words) > tokens:
            text, words = " ".join(words[:tokens]), words[:tokens]
        if out and (len(out) >= most or held + len(words) > tokens):
            yield out
            out, held = [], 0
        out.append((i, text))
        held += len(words)
    if out:
        yield out


#: The state that hashes of words start from.
_EMPTY = hashlib.blake2b(digest_size=8)


class _Slots(dict):
    """2 * dimension + sign of words, from their hashes. At most twice MOST are kept: of those before the last MOST, the ones that came up again since."""

    MOST = 1 << 18

    def __init__(self, dim: int):
        self.dim, self.before = dim, {}

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.before = dict(self)
            self.clear()
        slot = self.before.get(word)
        if slot is None:
            state = _EMPTY.copy()
            state.update(word.encode())
            h = int.from_bytes(state.digest(), "little")
            slot = (h & 0xFFFFFFFF) % self.dim * 2 + (h >> 32 & 1)
        self[word] = slot
        return slot


class HashEmbedder:
    """Deterministic vectors from word hashes, for tests and runs without a model."""

    def __init__(self, dim: int = 64):
        if not 1 <= dim <= DIM_MAX:
            raise ValueError(f"dimension {dim} is outside 1..{DIM_MAX}")
        self.dim, self.slots = dim, _Slots(dim)

    def array(self, texts: list[str]) -> np.ndarray:
        """A row for each text: its words counted by dimension and sign, all texts at once."""
        words = [text.lower().split() for text in texts]
        slots = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(words)), np.int64)
        slots += np.repeat(np.arange(len(texts)) * 2 * self.dim, [len(w) for w in words])
        counts = np.bincount(slots, minlength=len(texts) * 2 * self.dim).reshape(len(texts), self.dim, 2)
        out = (counts[:, :, 1] - counts[:, :, 0]).astype(np.float32)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return self.array(texts).tolist()


class Unavailable(ConnectionError):
    """An endpoint that can't answer now; another try may."""


class Refused(RuntimeError):
    """An answer that another try won't change."""


class Guarded:
    """A client with retries and a breaker: after `threshold` failures in a row it refuses for `cooldown` seconds, then lets one caller try, while others are still refused; if
    that try fails, it refuses again. Pauses double from half a second to 30, and are longer by `chance` (0 to 1) times a half, so that tasks that failed together don't come back together."""

    def __init__(
        self, call: Callable[[list[str]], list[list[float]]], dim: int, retries: int = 3, threshold: int = 5, cooldown: float = 30.0, pause: Callable[[float], None] = time.sleep,
        clock: Callable[[], float] = time.monotonic, chance: Callable[[], float] = lambda: 0.0,
    ):
        self.call, self.dim, self.retries, self.threshold, self.cooldown, self.pause, self.clock, self.chance = call, dim, retries, threshold, cooldown, pause, clock, chance
        self.failures, self.opened, self.trying, self.lock = 0, 0.0, False, threading.Lock()

    def _enter(self) -> None:
        with self.lock:
            if self.failures >= self.threshold:
                if self.trying or self.clock() - self.opened < self.cooldown:
                    raise Unavailable("the breaker is open")
                self.trying = True

    def __call__(self, texts: list[str]) -> list[list[float]]:
        for attempt in range(self.retries + 1):
            self._enter()
            try:
                got = self.call(texts)
            except OSError:  # connections and time limits
                with self.lock:
                    self.failures, self.trying = self.failures + 1, False
                    if self.failures >= self.threshold:
                        self.opened = self.clock()
                        raise
                if attempt == self.retries:
                    raise
                self.pause(min(30.0, 0.5 * 2**attempt) * (1 + self.chance() / 2))
                continue
            except BaseException:
                with self.lock:
                    self.trying = False
                raise
            with self.lock:
                self.failures, self.trying = 0, False
            if len(got) != len(texts) or any(len(v) != self.dim for v in got):
                raise ValueError(f"expected {len(texts)} vectors of {self.dim}")
            return got
        raise AssertionError


#: Where each provider takes texts, and under which name.
ENDPOINTS = {"tei": ("/embed", "inputs"), "ollama": ("/api/embed", "input"), "openai": ("/v1/embeddings", "input")}


def vectors_of(answer: object) -> list[list[float]]:
    """The vectors of a provider's answer: a list, or what lies under `embeddings` or `data`; anything else is an error, with the provider's message where it gives one."""
    if isinstance(answer, dict):
        if isinstance(answer.get("embeddings"), list):
            answer = answer["embeddings"]
        elif isinstance(answer.get("data"), list):
            answer = [x.get("embedding") if isinstance(x, dict) else None for x in answer["data"]]
        else:
            error = answer.get("error")
            raise Refused(f"provider error: {error['message']}" if isinstance(error, dict) and isinstance(error.get("message"), str) else f"not an answer with vectors: {str(answer)[:100]}")
    if not isinstance(answer, list) or not all(isinstance(v, list) and all(isinstance(x, int | float) and not isinstance(x, bool) for x in v) for v in answer):
        raise Refused("not an answer with vectors")
    return [[float(x) for x in v] for v in answer]


def _post(url: str, body: bytes, headers: dict[str, str]) -> tuple[int, bytes]:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, body, headers), timeout=60) as answer:  # noqa: S310
            return answer.status, answer.read()
    except HTTPError as e:
        return e.code, e.read(200)


class Endpoint:
    """A client of a model's endpoint for ingestion or for queries; send posts a body and returns (status, body)."""

    def __init__(self, model: EmbeddingModel, plane: str = "ingest", key: str | None = None, send: Callable[[str, bytes, dict[str, str]], tuple[int, bytes]] = _post):
        if model.provider not in ENDPOINTS or plane not in ("ingest", "query"):
            raise ValueError(f"no such endpoint: {model.provider}, {plane}")
        path, self.field = ENDPOINTS[model.provider]
        self.model, self.send = model, send
        self.url = (model.query_url if plane == "query" else model.ingest_url).rstrip("/") + path
        self.headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key and model.provider == "openai" else {})

    def __call__(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        most = self.model.truncate_chars
        body = {self.field: [t[:most] if most else t for t in texts]} | ({} if self.model.provider == "tei" else {"model": self.model.model_id})
        status, answer = self.send(self.url, json.dumps(body).encode(), self.headers)
        if status in (429, 503):
            raise Unavailable(f"status {status}")
        if status >= 400:
            raise Refused(f"status {status}: {answer[:200].decode(errors='replace')}")
        try:
            found = json.loads(answer)
        except ValueError as e:
            raise Unavailable("an answer that is no JSON") from e
        return vectors_of(found)


def _arrow(parts: list) -> pa.Array:
    """Vectors as lists, or as tables of numbers, as one column."""
    kind = pa.list_(pa.float32())
    if not parts or not isinstance(parts[0], np.ndarray):
        return pa.array([v for part in parts for v in part], kind)
    table = np.concatenate(parts)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * table.shape[1], pa.int32()), pa.array(table.ravel(), pa.float32()))


def embedded(chunks: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], id_col: str = "id", model: EmbeddingModel | None = None) -> DataFrame:
    """(id, embedding) for child chunks; make builds a client in each task. Vectors are tied to ids by the row, not by order. With a model the client is guarded, and its
    batches and texts have the model's bounds. Without one, a client's `array`, which gives a table of numbers, is preferred to lists of them."""
    tokens, most, chars = (model.ctx_budget, model.batch_size, model.truncate_chars) if model else (EMBED_TOKENS, EMBED_TEXTS, EMBED_CHARS)
    kind = chunks.schema[id_col].dataType.simpleString()
    child = chunks.where(~F.col("is_parent")) if "is_parent" in chunks.columns else chunks
    crumb = F.col("header_breadcrumb") if "header_breadcrumb" in chunks.columns else F.lit("")
    rows = child.select(F.col(id_col).alias("id"), (F.substring(embedding_text(crumb, F.col("text")), 1, chars) if chars else embedding_text(crumb, F.col("text"))).alias("text"))

    def run(rows):
        client = Guarded(make(), model.vector_dim, chance=random.random) if model else make()
        call = getattr(client, "array", client)
        for b in rows:
            # positions rise through the parts, so vectors come in the order of the rows
            parts = [(part, call([t for _, t in part])) for part in batches(b.column("text").to_pylist(), tokens, most)]
            if any(len(part) != len(found) for part, found in parts):
                raise ValueError("not a vector for each text")
            yield pa.RecordBatch.from_arrays([b.column("id"), _arrow([found for _, found in parts])], ["id", "embedding"])

    return rows.mapInArrow(run, f"id {kind}, embedding array<float>").withColumnRenamed("id", id_col)
