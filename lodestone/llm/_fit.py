"""Bounded samples of labelled rows for models that are fitted on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

FOLDS = 5


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by FOLDS; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def hash_sample(rows: DataFrame, columns: list[str], most: int, total: int) -> DataFrame:
    """Of total rows the distinct ones whose hash of columns is below most / total, so that reruns agree: `most` at most on average,
    whatever row is repeated how often; over 1.25 * most (of 2500 and more) has a probability below 10^-30."""
    if total > most:
        hashed = F.xxhash64(*columns).bitwiseAND(F.lit(2**62 - 1))
        rows = rows.where(hashed < int(most / total * 2**62))
    return rows.dropDuplicates(columns)


def fetched(rows: DataFrame) -> pa.Table:
    return rows.toArrow()
