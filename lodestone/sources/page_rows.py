"""Operators on documents given as rows of pages (doc_id, page, text): lengths, ranges, outlines, and what is wrong with a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import PAGE_CAP


def page_chars(pages: DataFrame) -> DataFrame:
    """(doc_id, page, chars): code points of text on each page, 0 for null."""
    return pages.select("doc_id", "page", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))


def sliced(pages: DataFrame, shards: DataFrame) -> DataFrame:
    """The pages of each shard (doc_id, idx, page_start, page_end), numbered from 1 within it. A shard is dealt as its page numbers, so the join is one by equality."""
    own = shards.select("doc_id", "idx", F.col("page_start").alias("from"), F.explode(F.sequence("page_start", "page_end")).alias("page"))
    return pages.join(own, ["doc_id", "page"]).select("doc_id", "idx", (F.col("page") - F.col("from") + 1).cast("int").alias("page"), "text")


def outline(pages: DataFrame, marker: str = r"^#{1,2}[ \t]+(.+)$") -> DataFrame:
    """(doc_id, page, title): the first heading of each page that has one."""
    title = F.regexp_extract("text", f"(?m){marker}", 1)
    return pages.select("doc_id", "page", F.trim(title).alias("title")).where("title <> ''")


def page_fault(message: Column) -> Column:
    """What an error of a reader means: encrypted, else corrupt; null without one."""
    return F.when(message.isNull(), None).when(F.rlike(F.lower(message), F.lit("encrypt|password")), "encrypted").otherwise("corrupt")


def within_page_cap(count: Column, cap: int = PAGE_CAP) -> Column:
    return F.coalesce((count >= 1) & (count <= cap), F.lit(False))
