"""Chunk rows of a table of texts: splitting in Arrow batches, then hashing, deduplication and numbering as expressions."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..config import CHILD_SIZE, PARENT_SIZE, parent_and_child
from ..functions import text as T
from ..functions.text import let
from .splitting import Chunk, PageMap, Signals, children_of, split
from .structure import calls, dealt, profiles

RAW = "doc_id string, is_parent boolean, ord int, parent_ord int, start int, end int, prefix int, text string, breadcrumb string, page_start int, page_end int, chunk_hash string, parent_hash string, seq int, first boolean"
_NAMES = [x.split()[0] for x in RAW.split(", ")]
_KINDS = [pa.string(), pa.bool_(), *[pa.int32()] * 5, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_()]
#: Runs of anything but Unicode white space, as in functions.text.word_list.
_WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

_BLANK = " \t\n\v\f\r"


def text_hash(text: str) -> str:
    """What functions.text.chunk_hash gives."""
    if text.isascii():
        line = text.strip(_BLANK).replace("\n", " ")
        if "  " not in line and "\t" not in line and "\r" not in line and "\f" not in line and "\v" not in line:  # words with one space between
            return hashlib.sha256(line.encode()).hexdigest()
    # str.split differs by the four separators only, which are no white space of Unicode's
    words = _WORD.findall(text) if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text else text.split()
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def numbered(rows: list[tuple[bool, str]]) -> list[int | None]:
    """The seq of each (is_parent, hash), in order: the first of each hash stays, a parent before a child; dense, parents first."""
    tops, lows = {}, {}
    for i, (is_parent, hash_) in enumerate(rows):
        (tops if is_parent else lows).setdefault(hash_, i)
    out: list[int | None] = [None] * len(rows)
    for k, i in enumerate([*tops.values(), *(i for h, i in lows.items() if h not in tops)]):
        out[i] = k
    return out


def raw_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pages_col: str | None = None, parent_size: int = PARENT_SIZE, child_size: int = CHILD_SIZE, strategy: str = "auto") -> DataFrame:
    """Parents and children of each row's text, in order, hashed and numbered where the text is split: nothing is shuffled. seq is null for
    rows that repeat another's hash; parent_hash is that of the parent of a child, if that stays; first tells of a child whether no child before it has its hash. The signals of texts, and then of their parents, are expressions
    (`structure.calls`); Python only packs."""
    parent, child = parent_and_child(parent_size, child_size, strategy)
    pages = F.col(pages_col) if pages_col else F.lit(None).cast("array<int>")
    rows = dealt(docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), pages.alias("pages")))
    tops = rows.withColumn("signals", signals(F.col("text"), strategy)).mapInArrow(lambda batches: _parents(batches, parent), _TOPS)
    known = F.transform("tops", lambda t: F.struct(*[t[x].alias(x) for x in _CHUNK], signals(t["text"], strategy).alias("signals")))
    return tops.withColumn("tops", known).mapInArrow(lambda batches: _children(batches, child), RAW)


_CHUNK = ("text", "start", "end", "prefix", "breadcrumb")
_TOPS = "doc_id string, text string, pages array<int>, tops array<struct<text:string,start:int,end:int,prefix:int,breadcrumb:string>>"
#: Characters of texts whose rows go on together, and rows of a batch that are objects at a time.
PASSED_ON, AT_ONCE = 1 << 22, 1 << 6


def _rows(b: pa.RecordBatch):
    """The rows of a batch as objects, few at a time: a batch of ten thousand texts is never whole twice."""
    for i in range(0, b.num_rows, AT_ONCE):
        yield from b.slice(i, AT_ONCE).to_pylist()


def signals(text: Column, strategy: str) -> Column:
    """`calls` of a text, with lists as strings."""
    return let(calls(text, strategy), lambda x: F.struct(F.array_join(x["tiers"], ",").alias("tiers"), x["level"].alias("level"), F.array_join(x["languages"], ",").alias("languages")))


@lru_cache(1 << 10)
def _known(tiers: str, level: int, languages: str) -> Signals:
    return Signals(tuple(tiers.split(",")), level, tuple(languages.split(",")) if languages else ())


def _signals(x: dict) -> Signals:
    return _known(x["tiers"], x["level"], x["languages"])


def _parents(batches, config):
    """Rows of texts with their parents; the text goes on where its lines have pages, which the children need."""
    kinds = pa.schema([("doc_id", pa.string()), ("text", pa.string()), ("pages", pa.list_(pa.int32())), ("tops", pa.list_(pa.struct(list(zip(_CHUNK, (pa.string(), *[pa.int32()] * 3, pa.string()), strict=True)))))])
    for b in batches:
        out, size = [], 0
        for r in _rows(b):
            tops = split(r["text"], config, _signals(r["signals"]))[0]
            out.append({"doc_id": r["doc_id"], "text": r["text"] if r["pages"] else None, "pages": r["pages"], "tops": [{x: getattr(c, x) for x in _CHUNK} for c in tops]})
            size += len(r["text"])
            if size > PASSED_ON:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, kinds)


def _children(batches, config):
    """The parents that stay and all children of each text, hashed and numbered."""
    for b in batches:
        out: list[tuple] = []
        size = 0
        for r in _rows(b):
            doc, where = r["doc_id"], PageMap(r["text"] or "", r["pages"])
            rows_, lows, hashes, seen = [], [], [], set()
            for k, t in enumerate(r["tops"]):
                top = Chunk(*[t[x] for x in _CHUNK])
                stays, found = children_of(top, config, _signals(t["signals"]))
                hashes.append(text_hash(top.text) if stays else None)
                if stays:
                    rows_.append((True, k, None, top, hashes[k], None))
                lows += [(k, c) for c in found]
                size += len(top.text)
            rows_ += [(False, i, k, c, text_hash(c.text), hashes[k]) for i, (k, c) in enumerate(lows)]
            seqs = numbered([(x[0], x[4]) for x in rows_])
            out += [(doc, top, k, parent_, c.start, c.end, c.prefix, c.text, c.breadcrumb, *where.of(c.start, c.end), own, above, seq, None if top else own not in seen and not seen.add(own)) for (top, k, parent_, c, own, above), seq in zip(rows_, seqs, strict=True)]
            if size > PASSED_ON:
                yield _batch(out)
                out, size = [], 0
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


def deduplicated(chunks: DataFrame) -> DataFrame:
    """Of (doc_id, is_parent, chunk_hash, seq): what `numbered` keeps of each document's rows in the order of seq, with the new seq."""
    kind = chunks.schema["doc_id"].dataType.simpleString()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("seq", kind="stable")
        f["new"] = pd.array(numbered(list(zip(f["is_parent"], f["chunk_hash"], strict=True))), "Int32")
        return f[f["new"].notna()][["doc_id", "seq", "new"]]

    kept = chunks.select("doc_id", "is_parent", "chunk_hash", "seq").groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, seq {chunks.schema['seq'].dataType.simpleString()}, new int")
    return chunks.join(kept, ["doc_id", "seq"]).withColumn("seq", F.col("new")).drop("new")


def chunked(docs: DataFrame, **options) -> DataFrame:
    """Chunk rows as stored: ids from (doc_id, hash), children linked to parents that stayed, token estimates, heading paths. One pass, no exchange; a row is a document."""
    rows, child = raw_chunks(docs, **options).where("seq is not null"), ~F.col("is_parent")
    return rows.select(
        T.chunk_id(F.col("doc_id"), F.col("chunk_hash")).alias("id"), "doc_id", "chunk_hash", F.when(F.col("parent_hash").isNotNull(), T.chunk_id(F.col("doc_id"), F.col("parent_hash"))).alias("parent_id"),
        "is_parent", "seq", "page_start", "page_end", F.when(child, T.heading_path(F.col("breadcrumb"))).alias("heading_path"),
        F.when(child, F.col("breadcrumb")).alias("header_breadcrumb"), "text", "start", "end", "prefix", F.greatest(F.lit(1), T.token_estimate(F.col("text"))).alias("token_count"),
    )


__all__ = ["chunked", "deduplicated", "numbered", "profiles", "raw_chunks", "split"]
