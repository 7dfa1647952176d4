"""Page-range shards, by expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import SHARD_PAGES


def fixed_windows(first: Column, last: Column, size: int | Column, overlap: int = 0) -> Column:
    """Array of (page_start, page_end): windows of size pages over first..last, each starting overlap pages before the one before
    ended; a window never starts at or before the previous start, and none follows the one that reaches the end."""
    size = F.lit(size) if isinstance(size, int) else size
    step = F.greatest(F.lit(1), size - overlap)
    count = F.greatest(F.ceil((last - first + 1 - size) / step), F.lit(0)).cast("int")
    return F.when(
        last >= first,
        F.transform(F.sequence(F.lit(0), count), lambda i: F.struct((first + i * step).cast("int").alias("page_start"), F.least(last, first + i * step + size - 1).cast("int").alias("page_end"))),
    )


def fixed_bounds(docs: DataFrame, id_col: str, pages_col: str, size: int = SHARD_PAGES, overlap: int = 1) -> DataFrame:
    """(id, idx, page_start, page_end); documents without pages give none."""
    w = fixed_windows(F.lit(1), F.col(pages_col), size, overlap)
    return docs.where(F.col(pages_col) >= 1).select(id_col, F.posexplode(w).alias("idx", "b")).select(id_col, "idx", "b.page_start", "b.page_end")


def chapter_bounds(docs: DataFrame, outline: DataFrame, id_col: str, pages_col: str, size: int = SHARD_PAGES) -> DataFrame:
    """Fixed windows inside each chapter, chapters starting at the outline's pages (id, page), held within 1..pages."""
    paged = docs.where(F.col(pages_col) >= 1).select(id_col, F.col(pages_col).alias("pages"))
    marks = outline.select(id_col, "page").join(paged, id_col).select(id_col, "pages", F.greatest(F.lit(1), F.least("page", "pages")).alias("first"))
    starts = marks.unionByName(paged.select(id_col, "pages", F.lit(1).alias("first"))).distinct()
    by_doc = Window.partitionBy(id_col).orderBy("first")
    chapters = starts.withColumn("last", F.coalesce(F.lead("first").over(by_doc) - 1, F.col("pages")))
    rows = chapters.select(id_col, F.explode(fixed_windows(F.col("first"), F.col("last"), size)).alias("b"))
    idx = F.row_number().over(Window.partitionBy(id_col).orderBy("b.page_start")) - 1
    return rows.select(id_col, idx.alias("idx"), "b.page_start", "b.page_end")


def ladder_action(span: Column, attempts: Column, size: int = SHARD_PAGES) -> Column:
    """What a failed shard does next."""
    return F.when(span < 2, "text_only").when((attempts == 2) & (span >= 4 * max(1, size // 4) // 2), "split").when(attempts == 3, "split").otherwise("text_only")


def resplit(shards: DataFrame, id_col: str = "doc_id", size: int = SHARD_PAGES) -> DataFrame:
    """Sub-shards of those whose ladder says split; idx goes on after the document's last one."""
    span = F.col("page_end") - F.col("page_start") + 1
    split = shards.where(ladder_action(span, F.col("attempts"), size) == "split").withColumn("size", F.when(F.col("attempts") < 3, F.greatest(F.lit(1), F.floor(span / 4).cast("int"))).otherwise(1))
    rows = split.select(id_col, F.col("idx").alias("parent_idx"), F.explode(fixed_windows(F.col("page_start"), F.col("page_end"), F.col("size"))).alias("b"))
    after = shards.groupBy(id_col).agg((F.max("idx") + 1).alias("next"))
    order = F.row_number().over(Window.partitionBy(id_col).orderBy("parent_idx", "b.page_start")) - 1
    return rows.withColumn("n", order).join(after, id_col).select(id_col, "parent_idx", (F.col("next") + F.col("n")).cast("int").alias("idx"), "b.page_start", "b.page_end")


def slices_pdf(mime: Column, page_start: Column, page_end: Column, pages: Column) -> Column:
    return (mime == "application/pdf") & (page_start > 0) & (page_end >= page_start) & ~((page_start == 1) & (page_end >= pages))


def needs_ocr(pages: DataFrame, id_col: str = "doc_id", chars_col: str = "chars", least: int = 20) -> DataFrame:
    """(id, mean_chars, needs_ocr): mean characters a page below least; no page counts as 0.0 and true."""
    mean = F.coalesce(F.avg(chars_col), F.lit(0.0))
    return pages.groupBy(id_col).agg(mean.alias("mean_chars"), (mean < least).alias("needs_ocr"))
