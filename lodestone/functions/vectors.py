"""Vector columns: dot product, norm and cosine distance in double precision."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where either is a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, 1.0 - dot(a, b) / n)


def distances(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine distances of the rows of m from q, a row of length 1 or one for each; infinite for rows of length 0. Equal rows get equal numbers wherever
    they stand, which products of whole matrices don't promise."""
    length = np.sqrt(np.einsum("ij,ij->i", m, m))
    return np.where(length > 0, 1.0 - np.einsum("ij,ij->i", m, np.broadcast_to(q, m.shape)) / np.where(length > 0, length, 1.0), np.inf)
