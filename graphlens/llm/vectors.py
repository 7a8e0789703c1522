"""Vectors of a table as integer matrices; shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of a greater size count as this: sums of products of 1 024 of them still fit in 64 bits.
LIMIT = 1 << 26


def complete(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def complete_rows(embeddings: DataFrame, label: Column) -> DataFrame:
    """``vec_id``, ``label`` and ``embedding`` of the rows with a complete vector; other columns are dropped."""
    rows = embeddings.filter(complete(F.col("embedding")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))


def matrix(lists, width: int | None = None) -> np.ndarray:
    """floor(256 * x) of an Arrow array of lists, a row each; short vectors are filled up with zeros to ``width`` (the longest)."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    size = np.diff(offsets)
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    whole = np.clip(np.floor(256.0 * values), -LIMIT, LIMIT).astype(np.int64)
    width = int(size.max(initial=0)) if width is None else width
    if (size == width).all():
        return whole.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(whole)) - (offsets[:-1] - offsets[0])[row]] = whole
    return out


def widened(rows: np.ndarray, width: int) -> np.ndarray:
    """``rows`` with zeros behind, up to ``width`` columns."""
    return rows if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
