"""Events of the pipeline: listing, counts and a tail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

DEFAULT, MOST = 100, 500


def listed(events: DataFrame, doc: str | None = None, level: str | None = None, stage: str | None = None, after: int | None = None, oldest_first: bool = False, limit: int | None = None) -> DataFrame:
    """Events that every given filter holds for, by id; `after` is the cursor. A limit outside 1..500 means 100."""
    rows = events
    for column, value in (("doc_id", doc), ("level", level), ("stage", stage)):
        rows = rows.where(F.col(column) == value) if value not in (None, "") else rows
    rows = rows.where(F.col("id") > after) if after and after > 0 else rows
    return rows.orderBy("id" if oldest_first else F.desc("id")).limit(limit if limit and 1 <= limit <= MOST else DEFAULT)


def warnings(events: DataFrame) -> DataFrame:
    """One row: quarantined jobs and what the janitor did beyond information."""
    return events.agg(F.count_if(F.col("stage") == "dlq").alias("dlq"), F.count_if((F.col("stage") == "janitor") & (F.col("level") != "info")).alias("janitor_warnings"))


def tail(spark: SparkSession, path: str, schema: str, after: int = 0, doc: str | None = None, files_a_batch: int = 100) -> DataFrame:
    """A stream of the events appended under path with ids past the cursor; the first batch holds the history."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path).where(F.col("id") > after)
    return rows.where(F.col("doc_id") == doc) if doc else rows
